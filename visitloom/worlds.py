"""The four pipelines as graphs of stages, and their command line.

``python -m visitloom.worlds world_2 --tables DIR --root OUT --num_patients 200``

World 1 predicts a patient's next visit from its history and those of its nearest patients, World 2 compares ways of telling how alike
patients are, World 3 judges predictions against what came, World 4 measures term embeddings. Each stage keeps its table below ``config.path(root)``; a
second run skips what is there for the same configuration.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass
from dataclasses import fields as fields_of

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import RunConfig
from .functions import prompts, text
from .functions import vectors as VF
from .operators import calibration, loaders, matching, models, neighbors, pairs, pathways, sampling, stats
from .operators import visits as V
from .schema import CATEGORIES
from .sources import adapters as A
from .sources import sinks
from .stages import Stage, run_graph


@dataclass(frozen=True)
class Means:
    """What a run works with: where flat tables are, and makers of the model, the embedder and the pathway agent; URLs that must answer first."""

    tables: str
    llm: Callable[[], models.LLM] = models.StubLLM
    embedder: Callable[[], models.Embedder] = models.HashingEmbedder
    agent: Callable | None = None
    services: tuple[str, ...] = ()
    in_flight: int = 4


def _keyed(df: DataFrame) -> DataFrame:
    """With one key of patient and visit."""
    return df.withColumn("key", F.concat_ws("@", "patient_id", F.col("visit_idx").cast("string")))


def _visits(spark, c: RunConfig, m: Means) -> DataFrame:
    """patient_id, visit_idx, sentence, names by category, of a repeatable sample of patients."""
    v = A.sentences(spark, m.tables)
    who = sampling.sample_n(v.select("patient_id").distinct(), "patient_id", c.num_patients)
    return v.join(who, "patient_id", "left_semi").select("patient_id", "visit_idx", "sentence", *CATEGORIES)


def _vectors(spark, c: RunConfig, visits: DataFrame, m: Means) -> DataFrame:
    """patient_id, visit_idx, vec, history of every window of ``num_visits`` visits, by sentences or by bags of terms."""
    if c.representation_method == "bag_of_codes":
        value = F.array_join(text.visit_terms(*[F.col(x) for x in CATEGORIES]), " ")
    else:
        value = F.col("sentence")
    w = V.windows(visits, value, c.num_visits).select("patient_id", F.col("end_idx").alias("visit_idx"), F.array_join("window", " | ").alias("history"))
    return models.embed(w, "history", m.embedder, errors="embed_error").where("vec IS NOT NULL").drop("embed_error")


def _narratives(spark, c: RunConfig, visits: DataFrame, m: Means) -> DataFrame:
    """patient_id, visit_idx, narrative of the history up to each visit that ends a window; with the pathway of its key diagnosis if an agent is there."""
    p = V.prefixes(visits, F.struct("sentence", "diagnoses")).where(F.col("visit_idx") >= c.num_visits - 1)
    p = p.select("patient_id", "visit_idx", F.transform("history", lambda x: x["sentence"]).alias("sentences"), F.transform("history", lambda x: x["diagnoses"]).alias("dx"))
    p = p.select("patient_id", "visit_idx", prompts.narrative(F.col("sentences"), 1 << 20).alias("prompt"), V.first_qualifying(F.col("dx")).alias("diagnosis"))
    told = models.complete(p, "prompt", m.llm, in_flight=m.in_flight).select("patient_id", "visit_idx", F.col("reply").alias("narrative"), "diagnosis")
    return pathways.with_pathways(told, "narrative", "diagnosis", m.agent, m.in_flight)


def world_1(root: str, m: Means) -> list[Stage]:
    """Histories, their vectors, nearest patients, narratives, predictions."""
    at = lambda name: f"{root}/{name}"

    def near(spark, c, visits, vectors):
        """The window that a prediction starts from against windows of other patients at the same place."""
        first = vectors.where(F.col("visit_idx") == c.num_visits - 1)
        metric = "cosine" if c.distance_metric == "cosine" else "euclidean"
        return neighbors.nearest(first, "patient_id", "vec", c.num_neighbors, metric).withColumn("visit_idx", F.lit(c.num_visits - 1))

    def predictions(spark, c, visits, near, told):
        enough = V.with_min_history(visits, c.num_visits).select("patient_id")
        own = told.where(F.col("visit_idx") == c.num_visits - 1).join(enough, "patient_id", "left_semi").select("patient_id", "narrative")
        other = told.select(F.col("patient_id").alias("neighbor"), "visit_idx", F.col("narrative").alias("other"))
        block = F.struct("rank", prompts.neighbor_block(F.col("neighbor"), F.col("other")).alias("block"))
        cases = near.join(other, ["neighbor", "visit_idx"]).groupBy("patient_id").agg(F.sort_array(F.collect_list(block)).getField("block").alias("cases"))
        return models.predict(own.join(cases, "patient_id", "left"), "narrative", "cases", m.llm, in_flight=m.in_flight).drop("raw")

    return [
        Stage("visits", at("visits"), lambda s, c: _visits(s, c, m)),
        Stage("vectors", at("vectors"), lambda s, c, v: _vectors(s, c, v, m), (at("visits"),)),
        Stage("neighbors", at("neighbors"), near, (at("visits"), at("vectors"))),
        Stage("narratives", at("narratives"), lambda s, c, v: _narratives(s, c, v, m), (at("visits"),), m.services),
        Stage("predictions", at("predictions"), predictions, (at("visits"), at("neighbors"), at("narratives")), m.services),
    ]


def world_2(root: str, m: Means) -> list[Stage]:
    """Vectors and narratives of windows, all metrics of every pair, their rank correlation and the matrix of a sample."""
    at = lambda name: f"{root}/{name}"

    def metrics(spark, c, vectors, told):
        return calibration.pair_metrics(_keyed(vectors).select("key", "vec"), _keyed(told).select("key", "narrative"), "key", "vec", m.llm, m.in_flight)

    def correlations(spark, c, pairs_):
        """One row for each two metrics: n, rho and its p value."""
        names = ("cosine_similarity", "euclidean_distance", "llm_relevance_score")
        rows = []
        for i, x in enumerate(names):
            for y in names[i + 1:]:
                r = stats.spearman(pairs_, x, y).first()
                rows.append((x, y, r["n"], r["rho"], stats.spearman_p(r["rho"], r["n"])))
        return spark.createDataFrame(rows, "x string, y string, n long, rho double, p double")

    def matrix(spark, c, pairs_):
        keys = sampling.sample_n(pairs.keys_of(pairs_, "key_1", "key_2"), "key", 50)
        some = pairs.both_in(pairs_, keys, "key_1", "key_2")
        out = [pairs.symmetric(some, "key_1", "key_2", v, pairs.diagonal_of(v)).select(F.lit(v).alias("metric"), "key_1", "key_2", F.col(v).alias("value"))
               for v in ("cosine_similarity", "euclidean_distance", "llm_relevance_score")]
        return out[0].unionByName(out[1]).unionByName(out[2])

    def known(spark, c, visits):
        dx = A.items(spark, m.tables).where("category = 'diagnoses'").join(A.visits(spark, m.tables).select("encounter_id", "patient_id"), "encounter_id")
        buckets = dx.join(visits.select("patient_id").distinct(), "patient_id", "left_semi").select(text.chapter(F.col("code")).alias("chapter"), "patient_id").where("chapter IS NOT NULL").distinct()
        return buckets

    def check(spark, c, buckets, vectors, told):
        last = lambda df, v: df.groupBy("patient_id").agg(F.max_by(v, "visit_idx").alias(v))
        return calibration.calibrate(buckets, last(vectors, "vec"), last(told, "narrative"), m.llm, in_flight=m.in_flight)

    return [
        Stage("visits", at("visits"), lambda s, c: _visits(s, c, m)),
        Stage("vectors", at("vectors"), lambda s, c, v: _vectors(s, c, v, m), (at("visits"),)),
        Stage("narratives", at("narratives"), lambda s, c, v: _narratives(s, c, v, m), (at("visits"),), m.services),
        Stage("metrics", at("metrics"), metrics, (at("vectors"), at("narratives")), m.services),
        Stage("correlations", at("correlations"), correlations, (at("metrics"),)),
        Stage("matrix", at("matrix"), matrix, (at("metrics"),)),
        Stage("buckets", at("buckets"), known, (at("visits"),)),
        Stage("calibration", at("calibration"), check, (at("buckets"), at("vectors"), at("narratives")), m.services),
    ]


def world_3(root: str, m: Means) -> list[Stage]:
    """Predictions of World 1 against the visit that came: terms, their idf and vectors, greedy matches, scores. Patients of World 1 with the same configuration."""
    at = lambda name: f"{root}/{name}"
    lists = lambda of: F.array(*[F.struct(F.lit(k).alias("category"), of(k).alias("names")) for k in CATEGORIES])

    def terms(spark, c, visits, predictions):
        """patient_id, section, category, pos, term."""
        real = V.nth_visit(visits, c.num_visits).join(predictions.select("patient_id"), "patient_id", "left_semi").select("patient_id", F.lit("actual").alias("section"), lists(F.col).alias("l"))
        said = predictions.where("predicted_visit IS NOT NULL").select("patient_id", F.lit("predicted").alias("section"), lists(lambda k: F.col(f"predicted_visit.{k}")).alias("l"))
        flat = real.unionByName(said).select("patient_id", "section", F.explode("l").alias("l")).select("patient_id", "section", "l.category", F.posexplode("l.names").alias("pos", "name"))
        return flat.select("patient_id", "section", "category", "pos", text.clean_term(F.col("name")).alias("term")).where("term <> ''")

    def library(spark, c, terms):
        lib = models.embed(terms.select("term").distinct(), "term", m.embedder, errors="embed_error")
        return terms.select("category", "term").distinct().join(lib, "term")

    def matches(spark, c, terms, library, idf):
        side = lambda s: terms.where(F.col("section") == s).select("patient_id", "category", "pos", "term")
        return matching.greedy(matching.candidates(side("actual"), side("predicted"), library.where("vec IS NOT NULL"), idf))

    return [
        Stage("terms", at("terms"), terms, (at("visits"), at("predictions"))),
        Stage("idf", at("idf"), lambda s, c, t, p: matching.idf_registry(t, p.select("patient_id")), (at("terms"), at("predictions"))),
        Stage("library", at("library"), library, (at("terms"),)),
        Stage("matches", at("matches"), matches, (at("terms"), at("library"), at("idf"))),
        Stage("scores", at("scores"), lambda s, c, x, p: matching.scores(x, p.select("patient_id")), (at("matches"), at("predictions"))),
    ]


def world_4(root: str, m: Means) -> list[Stage]:
    """Term pairs by code, their similarity under the embedder, as it is and over the vocabulary's average, its density; also as JSON by model and category."""
    at = lambda name: f"{root}/{name}"

    def term_pairs(spark, c):
        items = A.items(spark, m.tables).select("category", text.clean_term(F.col("name")).alias("term"), F.substring("code", 1, 2).alias("code")).where("term <> ''")
        return pairs.pairs_by_code(items.select("term", F.concat_ws("|", "category", "code").alias("code"))).join(
            items.select("term", "category").distinct(), "term").select("category", "term", "counterpart").distinct()

    def library(spark, c, found):
        return models.embed(pairs.ends(found), "term", m.embedder, errors="embed_error")

    def scores(spark, c, found, lib):
        known = lib.where("vec IS NOT NULL")
        avg = neighbors.baseline(known, known, "term", "vec").select("average_similarity")
        both = pairs.with_vectors(found, known, "term", "vec", "term", "counterpart")
        cos = both.select("category", "term", "counterpart", VF.cosine(VF.doubles(F.col("vec_1")), VF.doubles(F.col("vec_2"))).alias("cosine_similarity")).join(F.broadcast(avg))
        out = cos.withColumn("normalized_similarity", VF.normalised_similarity(F.col("cosine_similarity"), F.col("average_similarity"))).withColumn("model", F.lit(c.vectorizer_method)).drop("average_similarity")
        sinks.export_json(out, at("scores-json"), ("model", "category"))
        return out

    return [
        Stage("pairs", at("pairs"), term_pairs),
        Stage("library", at("library"), library, (at("pairs"),)),
        Stage("scores", at("scores"), scores, (at("pairs"), at("library"))),
        Stage("density", at("density"), lambda s, c, x: stats.density(x, "normalized_similarity", "category"), (at("scores"),)),
    ]


WORLDS = {"world_1": (world_1,), "world_2": (world_2,), "world_3": (world_1, world_3), "world_4": (world_4,)}


def run_world(spark: SparkSession, world: str, config: RunConfig, root: str, means: Means, at_once: int = 4, report=None) -> dict[str, str]:
    """What became of each stage of a world; World 3 runs World 1 first, as part of the same graph."""
    folder = config.path(root)
    stages = {s.name: s for make in WORLDS[world] for s in make(f"{folder}/{make.__name__}" if make is not world_3 else f"{folder}/world_1", means)}
    return run_graph(spark, config, stages.values(), at_once, f"visitloom-{world}", report)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="visitloom.worlds", description="Longitudinal record analytics on Spark.")
    p.add_argument("world", choices=sorted(WORLDS))
    p.add_argument("--tables", required=True, help="folder of the flat tables")
    p.add_argument("--root", required=True, help="folder of what the stages keep, in a store that all executors reach")
    p.add_argument("--endpoint", help="chat endpoint of the model; a stand-in without one")
    p.add_argument("--health", help="URL that answers once the endpoint is up")
    p.add_argument("--embedder", default="hashing:64", help="kind:path of the embedding model")
    p.add_argument("--in_flight", type=int, default=4, help="questions that a task has out at once")
    p.add_argument("--at_once", type=int, default=4, help="stages that run at the same time")
    p.add_argument("--grid", nargs="*", default=[], metavar="name=v1,v2", help="run every combination of these values")
    for f in fields_of(RunConfig):
        p.add_argument(f"--{f.name}", type=type(f.default), default=f.default)
    return p


def configs(args: argparse.Namespace) -> list[RunConfig]:
    """The configuration of the arguments, or one for each combination of the grid."""
    kinds = {f.name: type(f.default) for f in fields_of(RunConfig)}
    base = RunConfig(**{k: getattr(args, k) for k in kinds})
    grid = {}
    for item in args.grid:
        name, _, values = item.partition("=")
        if name not in kinds or not values:
            raise SystemExit(f"--grid takes name=v1,v2 of {sorted(kinds)}, not {item}")
        grid[name] = [kinds[name](v) for v in values.split(",")]
    return list(base.grid(**grid)) if grid else [base]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs a world for each configuration, says what became of every stage, and returns 1 if any failed."""
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"visitloom-{args.world}").getOrCreate()
    kind, _, path = args.embedder.partition(":")
    llm = models.StubLLM
    if args.endpoint:
        llm = lambda: models.HttpLLM(args.endpoint, args.model_name)
    means = Means(args.tables, llm, loaders.model(spark, kind, path), pathways.agent(), tuple(filter(None, [args.health])), args.in_flight)
    bad = False
    for config in configs(args):
        out = run_world(spark, args.world, config, args.root, means, args.at_once, lambda name, state: print(f"{config.suffix()} {name}: {state}", flush=True))
        bad |= any(s not in ("ran", "skipped") for s in out.values())
    return int(bad)


if __name__ == "__main__":
    sys.exit(main())
