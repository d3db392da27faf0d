"""Embedding models by name: their files are shipped once to every executor and loaded once in every Python worker."""

from __future__ import annotations

import os
from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark import SparkFiles
from pyspark.sql import SparkSession

from ..session import ship_package
from .models import Embedder, HashingEmbedder

#: Packages add loaders of their own under this group of entry points.
GROUP = "visitloom.embedders"
_loaders: dict[str, Callable[[str], Embedder]] = {}
_loaded: dict[tuple[str, str], Embedder] = {}
_shipped: set[tuple[str, str]] = set()


def loader(kind: str):
    """Registers a function that makes an embedder of a local file or folder."""
    def keep(fn: Callable[[str], Embedder]):
        _loaders[kind] = fn
        return fn
    return keep


def loader_of(kind: str) -> Callable[[str], Embedder]:
    """A registered loader, or that of an installed package."""
    if kind not in _loaders:
        found = [e for e in entry_points(group=GROUP) if e.name == kind]
        if not found:
            raise KeyError(f"no loader for models of kind {kind}; known are {sorted(_loaders)}")
        _loaders[kind] = found[0].load()
    return _loaders[kind]


class StaticEmbedder:
    """A text is the mean of the vectors of its words, weighted if weights are there; words that the model does not know add nothing."""

    def __init__(self, words: list[str], vectors, weights=None):
        import numpy as np

        self.at = {w: i for i, w in enumerate(words)}
        self.vectors = np.asarray(vectors, "f4")
        self.weights = np.ones(len(words), "f4") if weights is None else np.asarray(weights, "f4")

    def encode(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        out = []
        for t in texts:
            rows = [self.at[w] for w in t.lower().split() if w in self.at]
            w = self.weights[rows]
            total = float(w.sum())
            out.append((w @ self.vectors[rows] / total).tolist() if total else np.zeros(self.vectors.shape[1]).tolist())
        return out


@loader("static")
def load_static(path: str) -> Embedder:
    """An ``.npz`` file with ``words``, ``vectors`` and, if wanted, ``weights``."""
    import numpy as np

    with np.load(path, allow_pickle=False) as f:
        return StaticEmbedder(f["words"].tolist(), f["vectors"], f["weights"] if "weights" in f else None)


@loader("hashing")
def load_hashing(path: str) -> Embedder:
    """No file: the path is the number of components."""
    return HashingEmbedder(int(os.path.basename(path)))


@loader("sentence-transformers")
def load_sentence_transformer(path: str) -> Embedder:
    """A local folder of the package of that name, if it is installed."""
    from sentence_transformers import SentenceTransformer

    model = SentenceTransformer(path)

    class Wrapped:
        def encode(self, texts):
            return model.encode(list(texts), convert_to_numpy=True).astype(float).tolist()

    return Wrapped()


def in_worker(kind: str, path: str, load: Callable[[str], Embedder]) -> Embedder:
    """The model of a shipped path, loaded on first use and kept for all later tasks of this worker."""
    if (kind, path) not in _loaded:
        local = SparkFiles.get(path)
        _loaded[kind, path] = load(local if os.path.exists(local) else path)
    return _loaded[kind, path]


def model(spark: SparkSession, kind: str, path: str) -> Callable[[], Embedder]:
    """What ``models.embed`` takes as ``make``: a model file or folder, sent to executors when they first run a task and loaded once a worker.

    The path may lie in any store that Spark reads. An unknown kind is refused here, not in a task.
    """
    load = loader_of(kind)
    ship_package(spark)
    name = os.path.basename(path.rstrip("/"))
    if kind != "hashing" and (spark.sparkContext.applicationId, path) not in _shipped:
        spark.sparkContext.addFile(path, recursive=True)
        _shipped.add((spark.sparkContext.applicationId, path))
    # the loader travels with a task, the model does not
    return lambda: in_worker(kind, name, load)
