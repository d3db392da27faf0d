"""Run configuration: an immutable value that is passed on, its paths, its command line and its grids."""

from __future__ import annotations

import argparse
import itertools
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class RunConfig:
    representation_method: str = "visit_sentence"
    vectorizer_method: str = "biobert-mnli-mednli"
    distance_metric: str = "euclidean"
    num_visits: int = 6
    num_patients: int = 5000
    num_neighbors: int = 10
    model_name: str = "medgemma"
    workers: int = 4
    save_every: int = 10

    def __post_init__(self):
        if self.distance_metric not in ("cosine", "euclidean"):
            raise ValueError(f"distance_metric must be cosine or euclidean, not {self.distance_metric}")
        if self.representation_method not in ("visit_sentence", "bag_of_codes"):
            raise ValueError(f"unknown representation_method {self.representation_method}")
        if min(self.num_visits, self.num_patients, self.num_neighbors) < 1:
            raise ValueError("num_visits, num_patients and num_neighbors must be positive")

    def path(self, root: str = "data") -> str:
        """The folder of this run's tables."""
        return "/".join([root, self.representation_method, safe_name(self.vectorizer_method), f"visits_{self.num_visits}",
                         f"patients_{self.num_patients}", f"metric_{self.distance_metric}", f"neighbors_{self.num_neighbors}"])

    def suffix(self) -> str:
        return "_".join(map(str, (self.representation_method, safe_name(self.vectorizer_method), self.distance_metric, self.num_visits, self.num_patients, self.num_neighbors)))

    def fingerprint(self) -> str:
        return repr(sorted(asdict(self).items()))

    def grid(self, **values) -> Iterator["RunConfig"]:
        """One configuration for each combination of the given lists."""
        for combo in itertools.product(*values.values()):
            yield replace(self, **dict(zip(values, combo)))


def safe_name(name: str) -> str:
    return name.replace("/", "-")


def title(name: str) -> str:
    return name.replace("_", " ").title()


def parse_args(argv: list[str] | None = None) -> RunConfig:
    p = argparse.ArgumentParser(description="Longitudinal record analytics on Spark.")
    for f in fields(RunConfig):
        p.add_argument(f"--{f.name}", type=type(f.default), default=f.default)
    return RunConfig(**vars(p.parse_args(argv)))
