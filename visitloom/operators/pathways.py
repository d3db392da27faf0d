"""Pathways of diagnoses, from an agent that may be installed or not.

An agent is anything that answers the question "what pathway does this diagnosis belong to": a function of a question. Packages offer one under the entry
point group ``visitloom.pathways``; without any, narratives stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts
from . import models, visits

GROUP = "visitloom.pathways"
# Fixed value: the question that agents answer to.
QUESTION = "Find KEGG pathway for {}"


def agent(name: str | None = None) -> Callable[[], Callable[[str], str]] | None:
    """A maker of the installed agent of that name, of the first by name if none is given, or None if there is no such."""
    found = sorted((e for e in entry_points(group=GROUP) if name in (None, e.name)), key=lambda e: e.name)
    return found[0].load() if found else None


def with_pathways(narratives: DataFrame, narrative: str, diagnosis: str, make: Callable[[], Callable[[str], str]] | None = None, in_flight: int = 4) -> DataFrame:
    """``narratives`` with the pathway of the key diagnosis added to the text, and a column ``pathway``.

    Each distinct diagnosis is asked for once, whatever the number of patients that have it. Rows without a diagnosis, and those whose diagnosis the agent fails on or
    knows no pathway for, keep their text and have a null pathway; so have all rows without an agent.
    """
    if make is None:
        return narratives.withColumn("pathway", F.lit(None).cast("string"))

    def service():
        ask = make()
        return lambda d: str(ask(QUESTION.format(d)) or "")

    known = narratives.select(F.col(diagnosis).alias("__d")).where("__d IS NOT NULL AND __d <> ''").distinct()
    known = models.lookup(known, "__d", service, in_flight).select("__d", F.when(F.trim("raw") != "", F.trim("raw")).alias("pathway"))
    out = narratives.drop("pathway").join(known, F.col(diagnosis) == F.col("__d"), "left").drop("__d")
    more = prompts.with_pathway(F.col(narrative), F.col(diagnosis), F.col("pathway"))
    return out.withColumn(narrative, F.when(F.col("pathway").isNull(), F.col(narrative)).otherwise(more))


def pathway_narratives(histories: DataFrame, make_llm=models.StubLLM, make_agent=None, visits_told: int = 5, in_flight: int = 4) -> DataFrame:
    """patient_id, narrative, diagnosis, pathway of histories (patient_id, sentences, diagnoses: a list of names for each visit).

    The narrative is the model's summary of the first ``visits_told`` visits; the key diagnosis is the first of the last visit that has one.
    """
    h = histories.select("patient_id", prompts.narrative(F.col("sentences"), visits_told).alias("prompt"), visits.first_qualifying(F.col("diagnoses")).alias("diagnosis"))
    told = models.complete(h, "prompt", make_llm, in_flight=in_flight).select("patient_id", F.col("reply").alias("narrative"), "diagnosis")
    return with_pathways(told, "narrative", "diagnosis", make_agent or agent(), in_flight)
