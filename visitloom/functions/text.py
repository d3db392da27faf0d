"""Text functions as column expressions: terms, sentences, chapters, model replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema

# What term cleaning takes out, in this order.
NOISE = ["initial encounter", "unspecified", "nos", "nec", "<none>", "<None>", ";", ":"]
NOISE_PATTERNS = [r"at \d+ oclock position", r"during pregnancy[^\n]*", r"due to[^\n]*", "with late onset", "with dysplasia", "without dysplasia"]

# Chapters by the first letter of a code.
CHAPTERS = {
    "A": "Certain infectious and parasitic diseases",
    "B": "Certain infectious and parasitic diseases",
    "C": "Neoplasms",
    "D": "Neoplasms",
    "E": "Endocrine, nutritional and metabolic diseases",
    "F": "Mental, Behavioral and Neurodevelopmental disorders",
    "G": "Diseases of the nervous system",
    "H": "Diseases of the eye, adnexa, ear and mastoid process",
    "I": "Diseases of the circulatory system",
    "J": "Diseases of the respiratory system",
    "K": "Diseases of the digestive system",
    "L": "Diseases of the skin and subcutaneous tissue",
    "M": "Diseases of the musculoskeletal system and connective tissue",
    "N": "Diseases of the genitourinary system",
    "O": "Pregnancy, childbirth and the puerperium",
    "P": "Certain conditions originating in the perinatal period",
    "Q": "Congenital malformations, deformations and chromosomal abnormalities",
    "R": "Symptoms, signs and abnormal clinical and laboratory findings, not elsewhere classified",
    "S": "Injury, poisoning and certain other consequences of external causes",
    "T": "Injury, poisoning and certain other consequences of external causes",
    "Z": "Factors influencing health status and contact with health services",
}
NO_RECORD = "No information recorded for this visit."


def strip(c: Column) -> Column:
    """Without white space, of any kind, at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


#: The patterns that cleaning takes out, in the order in which it does.
CUT_B = (r"(?U)\s*\([^)]*hcc[^)]*\)", r"(?U)\b\d{3}\.\d{1,2}\b")
CUT_A = (r"[\"']", r"^\\+|\\+$", r"\([^)]*hcc[^)]*\)", r"\(cms[^)]*\)", r"(?U)\b\(\d{3}(\.\d+)?\)", ",")


def clean_term(c: Column, variant: str = "A") -> Column:
    """A term for embedding and matching; variant A for vocabularies, B for scores. Null becomes empty."""
    t = strip(F.lower(F.coalesce(c, F.lit(""))))
    if variant == "B":
        for pattern in CUT_B:
            t = F.regexp_replace(t, pattern, "")
        for n in NOISE:
            t = F.replace(t, F.lit(n), F.lit(""))
        return squeeze(t)
    if variant != "A":
        raise ValueError(f"no variant {variant}")
    for pattern in CUT_A:
        t = F.regexp_replace(t, pattern, "")
    for n in NOISE:
        t = F.replace(t, F.lit(n), F.lit(""))
    for pattern in NOISE_PATTERNS:
        t = F.regexp_replace(t, "(?U)" + pattern, "")
    return squeeze(t)


def present(names: Column) -> Column:
    """Names that are neither null nor empty."""
    return F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def sentence(diagnoses: Column, medications: Column, treatments: Column) -> Column:
    """A visit in words; parts without names are left out."""
    part = lambda label, names: F.when(F.size(names) > 0, F.concat(F.lit(f"{label}: "), F.array_join(names, ", ")))
    parts = F.concat_ws("; ", *[part(c.title(), present(n)) for c, n in zip(schema.CATEGORIES, (diagnoses, medications, treatments))])
    return F.when(parts == "", F.lit(NO_RECORD)).otherwise(parts)


def visit_terms(diagnoses: Column, medications: Column, treatments: Column, variant: str = "A") -> Column:
    """Cleaned terms of a visit, empty ones left out."""
    names = F.concat(*[F.coalesce(n, F.array().cast("array<string>")) for n in (diagnoses, medications, treatments)])
    return F.filter(F.transform(names, lambda x: clean_term(x, variant)), lambda x: x != "")


def chapter(code: Column) -> Column:
    """The chapter of a code; null for a null or empty one, ``Other`` for other letters."""
    table = F.create_map(*[F.lit(x) for pair in CHAPTERS.items() for x in pair])
    return F.when(code.isNotNull() & (code != ""), F.coalesce(F.try_element_at(table, F.upper(F.substring(code, 1, 1))), F.lit("Other")))


def score_of(reply: Column) -> Column:
    """The first digit of a reply, with its decimals; null if there is none or the reply reports an error."""
    found = F.regexp_extract(reply, r"\d(?:\.\d+)?", 0)
    return F.when(reply.startswith("ERROR:") | (found == ""), None).otherwise(found).try_cast("double")


def fenced_json(reply: Column) -> Column:
    """What stands between the first ```` ```json ```` and the next fence; null if there is none."""
    found = F.regexp_extract(reply, r"(?s)```json(.*?)(?:```|$)", 1)
    return F.when(F.instr(reply, "```json") > 0, strip(found))


def _summary(json: Column) -> Column:
    return F.coalesce(F.get_json_object(json, "$.patient_summary"), F.get_json_object(json, "$.summary"))


def clean_reply(reply: Column) -> Column:
    """The summary that a reply holds as fenced or bare JSON; else its text without thoughts and bracketed asides."""
    fenced = F.regexp_extract(reply, r"(?s)```json\s*(\{.*?\})\s*```", 1)
    bare = F.when(strip(reply).startswith("{"), reply)
    thoughtless = F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")
    aside = F.regexp_replace(thoughtless, r"(?U)\s*\[[^\n]*?\]\s*", " ")
    return squeeze(F.coalesce(_summary(F.nullif(fenced, F.lit(""))), _summary(bare), aside))


def prediction_of(reply: Column) -> Column:
    """The predicted visit as a struct; null if the reply holds none."""
    return F.from_json(fenced_json(reply), schema.PREDICTION)["predicted_visit"]


def synonym_of(reply: Column, term: Column) -> Column:
    """The first synonym in a dictionary reply that differs from the term and has under five words; empty if none."""
    entries = F.from_json(reply, schema.SYNONYM_REPLY)
    level = lambda x, f: F.flatten(F.transform(x, lambda e: F.coalesce(e[f], F.from_json(F.lit("[]"), _EMPTY[f]))))
    words = level(level(level(entries, "meanings"), "definitions"), "synonyms")
    fits = F.filter(F.transform(words, lambda w: clean_term(w)), lambda w: (w != "") & (w != clean_term(term)) & (F.size(F.split(w, " ")) < 5))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(""))


_EMPTY = {
    "meanings": "array<struct<definitions:array<struct<synonyms:array<string>>>>>",
    "definitions": "array<struct<synonyms:array<string>>>",
    "synonyms": "array<string>",
}
