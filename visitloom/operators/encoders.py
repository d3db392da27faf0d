"""Patient encoders: a gated recurrent network over visits, and a baseline for readmission."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import one_thread, ship_package
from .sampling import ticket
from .stats import average_rank


class GRU:
    """One gated recurrent layer; z mixes the old state in, r gates what the candidate sees of it."""

    def __init__(self, inputs: int, hidden: int, seed: int = 42, weights: dict | None = None):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(hidden), s)
        self.w = weights or {g: (draw(hidden, inputs), draw(hidden, hidden), np.zeros(hidden)) for g in "zrh"}

    def states(self, xs: np.ndarray) -> np.ndarray:
        """The state after each row of ``xs``."""
        sig = lambda v: 1 / (1 + np.exp(-v))
        (wz, uz, bz), (wr, ur, br), (wh, uh, bh) = (self.w[g] for g in "zrh")
        h, out = np.zeros(len(bz)), []
        for x in xs:
            z, r = sig(wz @ x + uz @ h + bz), sig(wr @ x + ur @ h + br)
            h = (1 - z) * h + z * np.tanh(wh @ x + uh @ (r * h) + bh)
            out.append(h)
        return np.array(out).reshape(-1, len(bz))

    def of_lists(self, xs: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """States of many lists at once, a step at a time: the state of every list after its first, second.. input, that of its last from then on.

        ``at`` are the rows of ``xs`` that the lists name, one list behind the other. The state before all inputs, zeros, comes first.
        """
        sig = lambda v: 1 / (1 + np.exp(-v))
        (wz, uz, bz), (wr, ur, br), (wh, uh, bh) = (self.w[g] for g in "zrh")
        pz, pr, ph = xs @ wz.T + bz, xs @ wr.T + br, xs @ wh.T + bh  # once for each row, however many lists name it
        order = np.argsort(-sizes, kind="stable")
        first = (np.cumsum(sizes) - sizes)[order]
        h, out = np.zeros((len(sizes), len(bz))), [np.zeros((len(sizes), len(bz)))]
        for t in range(int(sizes.max(initial=0))):
            n = int((sizes > t).sum())
            x, old = at[first[:n] + t], h[:n]
            z, r = sig(pz[x] + old @ uz.T), sig(pr[x] + old @ ur.T)
            h[:n] = (1 - z) * old + z * np.tanh(ph[x] + (r * old) @ uh.T)
            out.append(np.empty_like(h))
            out[-1][order] = h
        return out


def encode_histories(windows: DataFrame, embed_size: int = 64, hidden: int = 32, seed: int = 42, attention: bool = False) -> DataFrame:
    """patient_id, visit_idx, vec of windows (patient_id, end_idx, window: array<array<string>> of terms).

    Two levels: a network over a visit's terms gives the visit, one over the visits the patient; with
    ``attention`` the states of visits are weighted by their likeness to the last instead of taking the last.
    A batch of windows goes through both a step at a time; visits that its windows share, and terms, are worked out once.
    """
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from .models import HashingEmbedder

        one_thread()
        emb, terms, visits = HashingEmbedder(embed_size), GRU(embed_size, hidden, seed), GRU(hidden, hidden, seed + 1)
        for b in batches:
            told = pc.list_flatten(b.column(2))
            words = pc.list_flatten(told).dictionary_encode()
            of_words = np.array(emb.encode(words.dictionary.to_pylist())).reshape(-1, embed_size)
            sizes = pc.list_value_length(told).to_numpy(zero_copy_only=False).astype(int)
            # windows overlap: equal visits are worked out once
            codes, of_visit, known = words.indices.to_numpy(zero_copy_only=False).astype(int), np.zeros(len(sizes), int), [np.zeros((1, hidden))]
            first = np.cumsum(sizes) - sizes
            for size in np.unique(sizes[sizes > 0]):
                which = np.nonzero(sizes == size)[0]
                lists, same = np.unique(codes[first[which][:, None] + np.arange(size)], axis=0, return_inverse=True)
                of_visit[which] = sum(map(len, known)) + same.ravel()
                known.append(terms.of_lists(of_words, lists.ravel(), np.full(len(lists), size))[-1])
            n = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(int)
            states = visits.of_lists(np.concatenate(known), of_visit, n)
            vec = states[-1]
            if attention:
                s = np.stack(states[1:], axis=1)
                weights = np.exp((s * vec[:, None]).sum(2)) * (np.arange(s.shape[1]) < n[:, None])
                vec = ((weights / weights.sum(1, keepdims=True))[:, :, None] * s).sum(1)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * hidden, pa.int32()), pa.array(vec.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), vec], ["patient_id", "visit_idx", "vec"])

    ship_package(windows.sparkSession)
    return windows.select("patient_id", F.col("end_idx").cast("int"), "window").mapInArrow(run, "patient_id string, visit_idx int, vec array<double>")


def encode_sentences(windows: DataFrame, sentence_window: str = "window") -> DataFrame:
    """patient_id, visit_idx, vec of windows of sentences, joined by bars and embedded."""
    from .models import embed

    joined = windows.select("patient_id", F.col("end_idx").alias("visit_idx"), F.array_join(sentence_window, " | ").alias("history"))
    return embed(joined, "history").drop("history")


def split_by_patient(examples: DataFrame, patient: str = "patient_id", test_share: float = 0.25, seed: int = 42) -> DataFrame:
    """``examples`` with split, ``train`` or ``test``: all examples of a patient on one side, by a hash of the patient."""
    part = F.conv(F.substring(ticket(F.col(patient), seed), 1, 8), 16, 10).cast("double") / 2.0**32
    return examples.withColumn("split", F.when(part < test_share, "test").otherwise("train"))


def readmission_model(examples: DataFrame, vec: str = "vec", label: str = "readmitted", regularisation: float = 0.01):
    """A fitted pipeline from patient vectors to readmission, scaled and logistic: the baseline that encoders are to beat.

    Examples without a label or a vector take no part. Both labels must be there.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler

    steps = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", maxIter=50, regParam=regularisation)]
    return Pipeline(stages=steps).fit(_features(examples.where(F.col(label).isNotNull()), vec).withColumn("label", F.col(label).cast("double")))


def _features(examples: DataFrame, vec: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return examples.where(F.col(vec).isNotNull()).withColumn("features", array_to_vector(F.col(vec)))


def readmission_scores(model, examples: DataFrame, vec: str = "vec") -> DataFrame:
    """``examples`` that have a vector, with the probability of readmission."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_features(examples, vec))
    # never null, so that no later filter on it is moved before the one on vectors
    return scored.select(*examples.columns, F.coalesce(F.get(vector_to_array("probability"), F.lit(1)), F.lit(float("nan"))).alias("probability"))


def auc(scored: DataFrame, label: str = "readmitted", score: str = "probability") -> DataFrame:
    """n, positives, auc: the chance that a positive has the larger score, ties counted half, from average ranks. Null if there is only one label."""
    r = average_rank(scored.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), F.col(score).alias("s")), "s", "r")
    t = r.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0.0)).cast("bigint").alias("positives"), F.sum(F.col("r") * F.col("y")).alias("sum"))
    n, p = F.col("n"), F.col("positives")
    return t.select("n", "positives", F.when((p > 0) & (p < n), (F.col("sum") - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))
