"""The queries of this subpackage: each operator over its whole table, as contracted, and oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, fingerprints, html, lengths, lines, lm, minhash, mixing, packing, quality, topk, urls, whitening
from .common import table

#: The production rules of op2: host, path prefix, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS r(host, path, verdict)")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH rules(h, p, verdict) AS (VALUES {rules}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id,
  coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)
SELECT page_id, host, path,
  (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1) AS rule,
  coalesce((SELECT verdict FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, length(h) DESC LIMIT 1), 'allow') AS verdict
FROM s
""".format(rules=", ".join(str(r) for r in URL_RULES))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, exact_words=1).select("doc_id", "n_lines", "n_removed", "text")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


OP5_POWERS = {"source": 0.7, "lang": 0.8, "topic": 0.9}


def _op5_sql(rounds: int = 12, seed: int = 7) -> str:
    """The same fit as unrolled CTEs: one for each margin of each round."""
    ctes = ["""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, source AS s0, lang AS l0,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n_tokens,
  len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) + 1 AS n_lines FROM documents)""",
            """t AS (SELECT *, CASE WHEN n_tokens <= 50 THEN 'short' WHEN n_tokens < 12 * n_lines THEN 'list'
  WHEN n_tokens > 1000 THEN 'long' ELSE 'prose' END AS topic FROM d)""",
            "w0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE AS weight FROM t GROUP BY ALL)"]
    for m, p in OP5_POWERS.items():
        ctes.append(f"a_{m} AS MATERIALIZED (SELECT {m}, pow(sum(tokens), {p}) AS x FROM w0 GROUP BY 1)")
        ctes.append(f"t_{m} AS MATERIALIZED (SELECT {m}, x / (SELECT sum(x) FROM a_{m}) AS target FROM a_{m})")
    k = 0
    for _ in range(rounds):
        for m in OP5_POWERS:
            ctes.append(f"w{k + 1} AS MATERIALIZED (SELECT w.source, w.lang, w.topic, tokens, weight * target / sum(weight) OVER (PARTITION BY w.{m}) AS weight FROM w{k} w JOIN t_{m} x ON w.{m} = x.{m})")
            k += 1
    return f"""WITH {", ".join(ctes)}, r AS (SELECT source, lang, topic, weight / tokens / (SELECT max(weight / tokens) FROM w{k}) AS p FROM w{k})
SELECT doc_id, s0 AS source, l0 AS lang, t.topic, n_tokens, round(p, 6) AS probability,
  ('0x' || substr(md5(doc_id || ':{seed}'), 1, 12))::BIGINT / 281474976710656.0 < p AS kept
FROM t JOIN r ON t.source = r.source AND t.lang = r.lang AND t.topic = r.topic"""


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text")
    return lengths.summarise(lengths.histogram(docs))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs, carry=["doc_id"]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    scored = lm.score_texts(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents),
u AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM u GROUP BY 1, 2, 3),
f AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS in_lang FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT *, 1 + (1000000000 * (n + 5)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p,
  1 + (1000000000 * (in_lang + 5)::HUGEINT) // (sum(in_lang) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS q FROM f),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
x AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT * FROM x WHERE part = 'pair' OR rank <= 50
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    of = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    return rows.select("vec_id", "n", "deviation", "identity_error", of).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", F.col("deviation").try_cast("bigint").alias("deviation"),
        "c.whitened", "c.explained", "identity_error")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_test(table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict:
    return {
        "op1_packing": op1_packing,
        "op2_url_filter": op2_url_filter,
        "op3_topk_search": op3_topk_search,
        "op4_line_dedup": op4_line_dedup,
        "op5_mixing": op5_mixing,
        "op6_token_counts": op6_token_counts,
        "op7_quality_rules": op7_quality_rules,
        "op8_minhash_dedup": op8_minhash_dedup,
        "op9_html_extraction": op9_html_extraction,
        "op10_lm_scoring": op10_lm_scoring,
        "op11_source_divergence": op11_source_divergence,
        "op12_whitening": op12_whitening,
        "op13_fingerprints": op13_fingerprints,
    }


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": OP11_SQL, "op3_topk_search": OP3_SQL, "op2_url_filter": OP2_SQL, "op5_mixing": _op5_sql()}
