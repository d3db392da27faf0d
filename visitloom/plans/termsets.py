"""Queries over terms: cleaning, pairing, vocabularies, samples, similarity baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions import vectors as VF
from ..operators import neighbors, pairs, sampling
from ..sources import adapters as A
from .history import CHAPTER, ITEMS, buckets

TERMS = """terms AS (SELECT p_name || ' ' || lower(p_type) AS term, p_brand || '-' || CAST(p_size AS VARCHAR) AS code, p_partkey AS key, p_brand, p_size, p_name FROM part)"""
PAIRS = "pairs AS (SELECT DISTINCT a.term, b.term AS counterpart FROM terms a JOIN terms b ON a.code = b.code AND a.term < b.term)"


def clean_term_a(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), F.initcap("p_name"), F.lit(", Unspecified (250.1); (HCC 12)  \"x\" initial encounter")).alias("raw"))
    return p.select("p_partkey", text.clean_term(F.col("raw"), "A").alias("term"))


def clean_term_b(spark, d):
    p = A.table(spark, d, "part").select("p_partkey", F.concat(F.lit("  "), F.initcap("p_name"), F.lit(" 250.12 Unspecified (HCC 12); nos  x")).alias("raw"))
    return p.select("p_partkey", text.clean_term(F.col("raw"), "B").alias("term"))


def clean_documents(spark, d):
    docs = A.table(spark, d, "documents")
    return docs.select("doc_id", F.md5(text.clean_term(F.col("text"), "B")).alias("digest"))


def code_pairs(spark, d):
    return pairs.pairs_by_code(A.terms(spark, d))


def pairs_in_sample(spark, d):
    """Pairs whose ends are both among 2000 terms drawn by the hash of the term."""
    t = A.terms(spark, d)
    sample = sampling.sample_n(t.select("term").distinct(), "term", 2000)
    return pairs.both_in(pairs.pairs_by_code(t), sample, "term", "counterpart")


def _mapping(spark, d):
    t = A.terms(spark, d).where("p_size <= 25")
    return t.select("code", F.col("p_brand").alias("rxnorm"), "key")


def rxnorm_map_join(spark, d):
    m = pairs.mapped(A.terms(spark, d).select("term", "code", "key"), _mapping(spark, d).withColumnRenamed("code", "k").withColumnRenamed("key", "row"), "code", "k", "rxnorm", "row")
    return m.select("key", "term", "code", "rxnorm")


def medication_pairs(spark, d):
    t = A.terms(spark, d).select("term", "code").distinct()
    m = _mapping(spark, d).withColumnRenamed("code", "k").withColumn("rxnorm", F.concat("rxnorm", F.lit("/"), "k"))
    return pairs.medication_pairs(t, m, "k", "rxnorm", "key")


def lonely_terms(spark, d):
    return pairs.lonely(A.terms(spark, d), pairs.pairs_by_code(A.terms(spark, d)))


def synonym_pairs(spark, d):
    """Lonely terms paired with a synonym; the stand-in dictionary knows each term with its words turned about."""
    alone = pairs.lonely(A.terms(spark, d), pairs.pairs_by_code(A.terms(spark, d)))
    entry = F.concat(F.lit('[{"meanings":[{"definitions":[{"synonyms":["'), F.array_join(F.reverse(F.slice(F.split("term", " "), 1, 3)), " "), F.lit('"]}]}]}]'))
    return pairs.synonym_pairs(alone, text.synonym_of(entry, F.col("term")))


def term_vocab(spark, d):
    return A.items(spark, d).select("category", text.clean_term(F.col("name")).alias("term")).where("term <> ''").distinct()


def pair_type_counts(spark, d):
    p = pairs.pairs_by_code(A.terms(spark, d)).withColumn("category", F.lit("medication"))
    same = F.substring_index("term", " ", 2) == F.substring_index("counterpart", " ", 2)
    return p.withColumn("type", F.when(same, "same_name").otherwise("code")).groupBy("category", "type").agg(F.count("*").alias("n"))


def group_examples(spark, d):
    e = sampling.sample_per_group(A.table(spark, d, "part").select("p_brand", F.col("p_partkey").alias("key")), ["p_brand"], "key", 5)
    return e.select("p_brand", "key")


def seeded_sample(spark, d):
    return sampling.sample_n(A.persons(spark, d).select("person_id"), "person_id", 100)


def similar_pairs(spark, d):
    return sampling.similar_pairs(buckets(spark, d))


def dissimilar_pairs(spark, d):
    return sampling.dissimilar_pairs(buckets(spark, d))


def _vectors(spark, d):
    return A.table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def pairwise_cosine(spark, d):
    p = neighbors.pairwise_metrics(_vectors(spark, d), "vec_id", "embedding", metrics=("cosine_similarity",))
    return p.select("vec_id_1", "vec_id_2", F.round("cosine_similarity", 6).alias("cosine_similarity"))


def pairwise_euclidean(spark, d):
    p = neighbors.pairwise_metrics(_vectors(spark, d), "vec_id", "embedding", metrics=("euclidean_distance",))
    return p.select("vec_id_1", "vec_id_2", F.round("euclidean_distance", 6).alias("euclidean_distance"))


def knn_topk(spark, d):
    k = neighbors.nearest(_vectors(spark, d), "vec_id", "embedding", 10, "cosine")
    return k.select("vec_id", "rank", "neighbor", F.round("distance", 6).alias("distance"))


def knn_euclidean(spark, d):
    k = neighbors.nearest(_vectors(spark, d), "vec_id", "embedding", 10, "euclidean")
    return k.select("vec_id", "rank", "neighbor", F.round("distance", 6).alias("distance"))


def baseline_similarity(spark, d):
    s = sampling.sample_n(_vectors(spark, d), "vec_id", 300)
    return neighbors.mean_similarity(s, "vec_id", "embedding").select("n_pairs", F.round("average_similarity", 6).alias("average_similarity"))


def baseline_closed_form(spark, d):
    return neighbors.mean_similarity_closed(_vectors(spark, d), "embedding").select("n", F.round("average_similarity", 6).alias("average_similarity"))


WORD_SIZE = 8


def _word_vectors(spark, d):
    """word, vec: the distinct words of the documents and of part names stand for what a model knows, digits of their hashes for its vectors."""
    texts = A.table(spark, d, "documents").select("text").union(A.table(spark, d, "part").select("p_name"))
    words = texts.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).where("word <> ''").distinct()
    part = lambda i: F.conv(F.substring(F.md5("word"), F.lit(4 * i + 1), F.lit(4)), 16, 10).cast("double") / 32768.0 - 0.75
    return words.select("word", F.array(*[part(i) for i in range(WORD_SIZE)]).alias("vec"))


def baseline_model_vocab(spark, d):
    """The average similarity of a sample of all words that the model knows, not only of the terms at hand."""
    w = _word_vectors(spark, d)
    return neighbors.baseline(w, w, "word", "vec", "model_vocab").select("n", F.round("average_similarity", 6).alias("average_similarity"))


def normalized_by_vocab(spark, d):
    """Similarity of part names that share a code over the average of the words that the model knows; a name's vector is the mean of its words'."""
    model = _word_vectors(spark, d)
    avg = neighbors.baseline(model, model, "word", "vec", "model_vocab").select("average_similarity")
    p = _name_pairs(spark, d)
    words = pairs.ends(p).select("term", F.explode(F.array_distinct(F.split(F.lower("term"), r"[^a-z]+"))).alias("word")).join(model, "word")
    lib = words.groupBy("term").agg(F.array(*[F.avg(F.get("vec", F.lit(i))) for i in range(WORD_SIZE)]).alias("vec"))
    both = pairs.with_vectors(p, lib, "term", "vec", "term", "counterpart")
    both = both.select("term", "counterpart", VF.cosine(F.col("vec_1"), F.col("vec_2")).alias("cos")).join(F.broadcast(avg))
    return both.select("term", "counterpart", F.round("cos", 6).alias("cosine_similarity"), F.round(VF.normalised_similarity(F.col("cos"), F.col("average_similarity")), 4).alias("normalized_similarity"))


def _name_pairs(spark, d):
    t = A.table(spark, d, "part").select(F.col("p_name").alias("term"), F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("code"))
    return pairs.pairs_by_code(t)


def normalized_similarity(spark, d):
    """Similarity of term pairs over the vocabulary's average, both ends in the vocabulary."""
    lib = A.term_vectors(spark, d)
    avg = neighbors.mean_similarity_closed(lib, "vec").select("average_similarity")
    p = pairs.with_vectors(_name_pairs(spark, d), lib, "term", "vec", "term", "counterpart")
    p = p.select("term", "counterpart", VF.cosine(VF.doubles(F.col("vec_1")), VF.doubles(F.col("vec_2"))).alias("cos")).join(F.broadcast(avg))
    return p.select("term", "counterpart", F.round("cos", 6).alias("cosine_similarity"), F.round(VF.normalised_similarity(F.col("cos"), F.col("average_similarity")), 4).alias("normalized_similarity"))


def pool_by_label(spark, d):
    """Mean vector of each label, as its norm and first component."""
    p = _vectors(spark, d).select("label", F.posexplode(VF.doubles(F.col("embedding"))).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return p.groupBy("label").agg(F.round(F.sqrt(F.sum(F.col("x") * F.col("x"))), 6).alias("norm"), F.round(F.max(F.when(F.col("i") == 0, F.col("x"))), 6).alias("first"))


QUERIES = {f.__name__: f for f in (
    clean_term_a, clean_term_b, clean_documents, code_pairs, pairs_in_sample, rxnorm_map_join, medication_pairs, lonely_terms, synonym_pairs, term_vocab, pair_type_counts, group_examples, seeded_sample, similar_pairs,
    dissimilar_pairs, pairwise_cosine, pairwise_euclidean, knn_topk, knn_euclidean, baseline_similarity, baseline_closed_form, baseline_model_vocab, normalized_by_vocab, normalized_similarity, pool_by_label)}

VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
COS = "list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e))"
BUCKETS = f"{ITEMS}, buckets AS (SELECT DISTINCT {CHAPTER} AS chapter, CAST(o_custkey AS VARCHAR) AS patient_id FROM items JOIN orders ON encounter_id = CAST(o_orderkey AS VARCHAR) WHERE category = 'diagnoses'), s AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY md5(patient_id || '|42'), patient_id) AS r FROM buckets), t AS (SELECT * FROM s WHERE r <= 10)"
KNN = """WITH {v}, p AS (SELECT a.vec_id, b.vec_id AS neighbor, {d} AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 9), neighbor) AS INT) AS rank FROM p) SELECT vec_id, rank, neighbor, round(distance, 6) AS distance FROM r WHERE rank <= 10"""


def _sql_clean(raw: str, variant: str) -> str:
    """Term cleaning as nested SQL calls."""
    gone = lambda e, p: f"regexp_replace({e}, '{p}', '', 'g')"
    e = f"trim(lower({raw}))"
    first = ["[\"'']", r"^\\+|\\+$", r"\([^)]*hcc[^)]*\)", r"\(cms[^)]*\)", r"\b\(\d{3}(\.\d+)?\)", ","] if variant == "A" else [r"\s*\([^)]*hcc[^)]*\)", r"\b\d{3}\.\d{1,2}\b"]
    for p in first:
        e = gone(e, p)
    for n in text.NOISE:
        e = f"replace({e}, '{n}', '')"
    for p in text.NOISE_PATTERNS if variant == "A" else []:
        e = gone(e, p)
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


WORDS = f"""words AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM (SELECT text FROM documents UNION ALL SELECT p_name FROM part)),
wv AS MATERIALIZED (SELECT word, list_transform(range({WORD_SIZE}), lambda i: ('0x' || substr(md5(word), 4 * i::INT + 1, 4))::INT / 32768.0 - 0.75) AS e FROM words WHERE word <> ''),
ws AS MATERIALIZED (SELECT * FROM wv ORDER BY md5(word || '|42'), word LIMIT 300), av AS (SELECT avg({COS}) AS m FROM ws a JOIN ws b ON a.word < b.word)"""

SQL = {
    "baseline_model_vocab": f"WITH {WORDS} SELECT (SELECT count(*) FROM ws) AS n, round(m, 6) AS average_similarity FROM av",
    "normalized_by_vocab": f"""WITH {WORDS}, t AS (SELECT DISTINCT p_name AS term, p_brand || '-' || p_size AS code FROM part),
p AS (SELECT DISTINCT x.term, y.term AS counterpart FROM t x JOIN t y ON x.code = y.code AND x.term < y.term),
n AS (SELECT DISTINCT term, unnest(string_split_regex(lower(term), '[^a-z]+')) AS word FROM t),
x AS (SELECT term, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM n JOIN wv USING (word)), y AS (SELECT term, i, avg(x) AS x FROM x GROUP BY 1, 2),
lib AS (SELECT term, list(x ORDER BY i) AS e FROM y GROUP BY 1)
SELECT p.term, counterpart, round({COS}, 6) AS cosine_similarity, round(({COS} - m) / m, 4) AS normalized_similarity FROM p JOIN lib a ON a.term = p.term JOIN lib b ON b.term = counterpart, av""",
    "clean_term_a": f"""SELECT p_partkey, {_sql_clean("'  ' || p_name || ', Unspecified (250.1); (HCC 12)  \"x\" initial encounter'", "A")} AS term FROM part""",
    "clean_term_b": f"""SELECT p_partkey, {_sql_clean("'  ' || p_name || ' 250.12 Unspecified (HCC 12); nos  x'", "B")} AS term FROM part""",
    "clean_documents": f"SELECT doc_id, md5({_sql_clean('text', 'B')}) AS digest FROM documents",
    "code_pairs": f"WITH {TERMS}, {PAIRS} SELECT * FROM pairs",
    "pairs_in_sample": f"""WITH {TERMS}, {PAIRS}, s AS (SELECT DISTINCT term FROM terms ORDER BY md5(term || '|42'), term LIMIT 2000)
SELECT * FROM pairs WHERE term IN (SELECT term FROM s) AND counterpart IN (SELECT term FROM s)""",
    "rxnorm_map_join": f"""WITH {TERMS}, m AS (SELECT code, arg_max(p_brand, key) AS rxnorm FROM terms WHERE p_size <= 25 GROUP BY 1)
SELECT key, term, t.code, rxnorm FROM terms t LEFT JOIN m ON t.code = m.code""",
    "medication_pairs": f"""WITH {TERMS}, m AS (SELECT code, arg_max(p_brand || '/' || code, key) AS rx FROM terms WHERE p_size <= 25 GROUP BY 1),
x AS (SELECT DISTINCT term, rx FROM terms JOIN m USING (code)), p AS (SELECT DISTINCT a.term, b.term AS counterpart FROM x a JOIN x b ON a.rx = b.rx AND a.term < b.term),
l AS (SELECT DISTINCT term, code FROM terms WHERE term NOT IN (SELECT term FROM p UNION SELECT counterpart FROM p))
SELECT * FROM p UNION SELECT a.term, b.term FROM l a JOIN l b ON a.code = b.code AND a.term < b.term""",
    "lonely_terms": f"WITH {TERMS}, {PAIRS} SELECT term FROM terms EXCEPT (SELECT term FROM pairs UNION SELECT counterpart FROM pairs)",
    "synonym_pairs": f"""WITH {TERMS}, {PAIRS}, l AS (SELECT term FROM terms EXCEPT (SELECT term FROM pairs UNION SELECT counterpart FROM pairs)),
s AS (SELECT term, array_to_string(list_reverse(string_split(term, ' ')[1:3]), ' ') AS s FROM l) SELECT DISTINCT least(term, s) AS term, greatest(term, s) AS counterpart FROM s WHERE s <> term AND s <> ''""",
    "term_vocab": f"WITH {ITEMS} SELECT DISTINCT category, name AS term FROM items",
    "pair_type_counts": f"""WITH {TERMS}, {PAIRS} SELECT 'medication' AS category, CASE WHEN array_to_string(string_split(term, ' ')[1:2], ' ') = array_to_string(string_split(counterpart, ' ')[1:2], ' ') THEN 'same_name' ELSE 'code' END AS type, count(*) AS n FROM pairs GROUP BY 1, 2""",
    "group_examples": "SELECT p_brand, key FROM (SELECT p_brand, p_partkey AS key, row_number() OVER (PARTITION BY p_brand ORDER BY md5(p_partkey || '|42'), p_partkey) AS r FROM part) WHERE r <= 5",
    "seeded_sample": "SELECT CAST(c_custkey AS VARCHAR) AS person_id FROM customer ORDER BY md5(c_custkey || '|42'), 1 LIMIT 100",
    "similar_pairs": f"""WITH {BUCKETS}, p AS (SELECT a.chapter, a.patient_id AS patient_1, b.patient_id AS patient_2 FROM t a JOIN t b ON a.chapter = b.chapter AND a.patient_id < b.patient_id),
q AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY md5(patient_1 || '-' || patient_2 || '|42'), patient_1, patient_2) AS r FROM p) SELECT chapter, patient_1, patient_2 FROM q WHERE r <= 5""",
    "dissimilar_pairs": f"""WITH {BUCKETS}, p AS (SELECT DISTINCT least(a.patient_id, b.patient_id) AS patient_1, greatest(a.patient_id, b.patient_id) AS patient_2 FROM t a JOIN t b ON a.chapter < b.chapter AND a.patient_id <> b.patient_id)
SELECT * FROM p ORDER BY md5(patient_1 || '-' || patient_2 || '|42'), patient_1, patient_2 LIMIT 50""",
    "pairwise_cosine": f"WITH {VEC} SELECT a.vec_id AS vec_id_1, b.vec_id AS vec_id_2, round({COS}, 6) AS cosine_similarity FROM v a JOIN v b ON a.vec_id < b.vec_id",
    "pairwise_euclidean": f"WITH {VEC} SELECT a.vec_id AS vec_id_1, b.vec_id AS vec_id_2, round(list_distance(a.e, b.e), 6) AS euclidean_distance FROM v a JOIN v b ON a.vec_id < b.vec_id",
    "knn_topk": KNN.format(v=VEC, d=f"1 - {COS}"),
    "knn_euclidean": KNN.format(v=VEC, d="list_distance(a.e, b.e)"),
    "baseline_similarity": f"WITH {VEC}, s AS (SELECT * FROM v ORDER BY md5(vec_id || '|42'), vec_id LIMIT 300) SELECT count(*) AS n_pairs, round(avg({COS}), 6) AS average_similarity FROM s a JOIN s b ON a.vec_id < b.vec_id",
    "baseline_closed_form": f"WITH {VEC} SELECT (SELECT count(*) FROM v) AS n, round(avg({COS}), 6) AS average_similarity FROM v a JOIN v b ON a.vec_id < b.vec_id",
    "normalized_similarity": f"""WITH {VEC}, n AS (SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS vec_id FROM (SELECT DISTINCT p_name FROM part)), lib AS (SELECT p_name AS term, e FROM n JOIN v USING (vec_id)),
av AS (SELECT avg({COS}) AS m FROM lib a JOIN lib b ON a.term < b.term), t AS (SELECT DISTINCT p_name AS term, p_brand || '-' || p_size AS code FROM part),
p AS (SELECT DISTINCT x.term, y.term AS counterpart FROM t x JOIN t y ON x.code = y.code AND x.term < y.term)
SELECT p.term, counterpart, round({COS}, 6) AS cosine_similarity, round(({COS} - m) / m, 4) AS normalized_similarity FROM p JOIN lib a ON a.term = p.term JOIN lib b ON b.term = counterpart, av""",
    "pool_by_label": f"""WITH {VEC}, x AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2)
SELECT label, round(sqrt(sum(x * x)), 6) AS norm, round(max(x) FILTER (i = 1), 6) AS first FROM m GROUP BY 1""",
}
