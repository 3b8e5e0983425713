"""Logistic calibration of scores, fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigree.session import shared_table


def held_out(id_col: str = "doc_id", mod: int = 5) -> Column:
    """Whether crc32 of the id as text leaves remainder 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod == 0, F.lit(False))


def training_ids(labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> list[tuple[int, int]]:
    """At most `most` (id, 0/1) pairs of rows that may be learned from, in the order of a hash.

    Rows without id or label are left out; of ids with several labels the larger counts.
    """
    rows = (
        labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
        .where("id is not null and y in (0, 1)")
        .where(~held_out("id"))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(most)
        .collect()
    )
    return [(r.id, r.y) for r in rows]


def labelled(docs: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(id, y, text) of a bounded list of ids, one row for each (the least text), written once."""
    given = docs.sparkSession.createDataFrame(pairs, "id long, y int")
    rows = docs.join(F.broadcast(given), "id").groupBy("id", "y").agg(F.min("text").alias("text"))
    return shared_table(rows, "labelled")


class Logistic:
    """Ridge-penalised logistic regression on standardised features."""

    def __init__(self, ridge: float = 1.0) -> None:
        self.ridge = ridge
        self.w: np.ndarray | None = None
        self.rate = 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        """With no rows or a single class, scores are the smoothed share of label 1."""
        self.rate = (y.sum() + 1) / (len(y) + 2)
        if len(y) == 0 or y.min() == y.max():
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), self.ridge)
        penalty[0] = 1e-6
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            g = z.T @ (y - p) - penalty * w
            h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(h, g)
            w = w + step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        self.w = w
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(x), self.rate)
        z = np.c_[np.ones(len(x)), (x - self.mean) / self.scale]
        return 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
