"""A bounded, repeatable sample of labelled documents, and a small logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfgraph.llm.common import remainder


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, by: int, held_out: int) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` labelled rows of each class, in the order of a hash of the id; rows whose crc32 of the id modulo ``by``
    is ``held_out`` are never taken. The labels that are taken are bounded, so they are broadcast and the texts are not shuffled."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder(F.col("doc_id"), by) != held_out)).groupBy("doc_id").agg(F.max(label).alias("y"))
    order = F.xxhash64("doc_id", F.lit(5))
    some = known.where("y = 1").orderBy(order).limit(per_class).unionByName(known.where("y = 0").orderBy(order).limit(per_class))
    some = some.select(F.col("doc_id").alias("_id"), "y")
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("_id")).drop("_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method; classes weigh the same, as far as both are there."""
    x = np.hstack([x, np.ones((len(x), 1))])
    if len(x) == 0:
        return np.zeros(x.shape[1])
    share = y.mean()
    w = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) if 0 < share < 1 else np.ones(len(y))
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) / len(y) + l2 * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x / len(y) + (l2 + 1e-9) * np.eye(len(beta))
        move = np.linalg.solve(hess, grad)
        beta -= move * min(1.0, 5 / max(np.abs(move).max(), 1e-9))
        if np.abs(move).max() < 1e-6:
            break
    return beta
