"""Projection of vectors on their two principal axes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def principal(vectors: DataFrame) -> DataFrame:
    """id, x and y of vectors (id, v), all of one length; sums and products are aggregated, so only their fixed-size matrix leaves Spark."""
    first = vectors.select("v").first()
    if first is None:
        return vectors.select("id", F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    size = len(first["v"])
    # each task sums its own outer products
    def outer(batches):
        import pyarrow as pa

        total, count, mean = np.zeros((size, size)), 0, np.zeros(size)
        for batch in batches:
            m = np.array(batch.column(0).to_pylist(), float).reshape(-1, size)
            total, mean, count = total + m.T @ m, mean + m.sum(axis=0), count + len(m)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()]), pa.array([mean.tolist()]), pa.array([count])], names=["p", "s", "n"])

    sums = vectors.select("v").mapInArrow(outer, "p array<double>, s array<double>, n long")
    add = lambda c, k: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(k)])
    parts = sums.select(F.posexplode("p").alias("i", "w")).groupBy("i").agg(F.sum("w").alias("w")).collect()
    row = sums.agg(add("s", size).alias("s"), F.sum("n").alias("n")).first()
    mean = np.array(row["s"]) / row["n"]
    cov = np.zeros(size * size)
    for r in parts:
        cov[r["i"]] = r["w"]
    _, axes = np.linalg.eigh(cov.reshape(size, size) / row["n"] - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :2].T
    axes = [a * (1 if a[np.abs(a).argmax()] > 0 else -1) for a in axes]

    def dot(axis: np.ndarray) -> Column:
        return sum(((F.get("v", F.lit(i)) - float(mean[i])) * float(w) for i, w in enumerate(axis)), F.lit(0.0))

    placed = vectors.select("id", *[dot(a).alias(m) for a, m in zip(axes, "xy", strict=False)])
    ends = placed.agg(*[f(m).alias(f"{f.__name__}_{m}") for m in "xy" for f in (F.min, F.max)]).first()
    scale = lambda m: F.lit(0.5) if ends[f"max_{m}"] == ends[f"min_{m}"] else (F.col(m) - ends[f"min_{m}"]) / (ends[f"max_{m}"] - ends[f"min_{m}"])
    return placed.select("id", *[F.round(scale(m), 6).alias(m) for m in "xy"])
