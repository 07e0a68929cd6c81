"""Bounded samples of labelled rows, and the small logistic fit that calibrates scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, most_bytes: int) -> list[tuple[str, int]]:
    """At most per_class (text, label) pairs of each of the labels 0 and 1, texts of at most most_bytes, in the order of a hash of the id.

    The ids are picked first (a top-k of id hashes), so the broadcast that fetches their texts has at most 2 * per_class rows, and the
    driver gets at most that many texts of bounded size: of rows that repeat an id, one (the least text). Equal texts count once; null
    labels, ids and texts are left out.
    """
    ids = None
    for value in (0, 1):
        some = labels.where((F.col(label) == value) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(per_class)
        ids = some if ids is None else ids.union(some)
    rows = docs.where(F.octet_length("text") <= most_bytes).select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y", "h").agg(F.min("text").alias("text")).select("text", "y", "h").collect()
    rows.sort(key=lambda r: (r["h"], r["text"]))
    return list({r["text"]: (r["text"], r["y"]) for r in rows}.values())


class Logistic:
    """Ridge-penalised logistic regression by Newton steps; ``prior`` is what the weights are drawn to, ``least`` what none goes below."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 0.01, prior: np.ndarray | None = None, scale: bool = True, least: np.ndarray | None = None):
        self.mean = x.mean(0) if scale else np.zeros(x.shape[1])
        self.spread = x.std(0) + 1e-9 if scale else np.ones(x.shape[1])
        x = self._scaled(x)
        prior = np.zeros(x.shape[1]) if prior is None else prior
        self.weights = prior.astype(float)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            slope = x.T @ (p - y) + ridge * (self.weights - prior)
            curve = (x * (p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(x.shape[1])
            step = np.linalg.solve(curve, slope)
            before = self.weights
            self.weights = before - step / max(1.0, np.abs(step).max() / 4)
            if least is not None:
                self.weights = np.maximum(self.weights, least)
            if np.abs(self.weights - before).max() < 1e-6:
                break

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(x - self.mean) / self.spread, np.ones(len(x))]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._scaled(x) @ self.weights, -30, 30)))
