"""Aggregations over moments of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def effective_dimension(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """(n, eff_dim): (trace C)^2 / |C|^2 of the centred vectors of the most frequent width, null for fewer than 3.

    C is the covariance.  Each batch adds up its own first and second moments, so a partition ships one row of
    d + d^2 sums whatever its number of vectors; no eigenvalues are needed.
    """
    width = vectors.select(F.size(vec_col).alias("w")).filter("w > 0").groupBy("w").count().orderBy(F.desc("count"), "w").first()
    w = width.w if width else 0

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, np.zeros(w), np.zeros((w, w))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(-1, w)
            n, s, ss = n + len(x), s + x.sum(0), ss + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([ss.ravel().tolist()])], names=["n", "s", "ss"])

    def total(table: pa.Table) -> pa.Table:
        n = sum(table.column("n").to_pylist())
        eff = None
        if n >= 3:
            s, ss = np.sum(table.column("s").to_pylist(), axis=0), np.sum(table.column("ss").to_pylist(), axis=0).reshape(w, w)
            c = ss - np.outer(s, s) / n
            norm = (c * c).sum()
            eff = round(float(np.trace(c) ** 2 / norm), 3) if norm > 0 else None
        return pa.table([pa.array([n], pa.int64()), pa.array([eff], pa.float64())], names=["n", "eff_dim"])

    rows = vectors.filter(F.size(vec_col) == w).select(F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInArrow(moments, "n bigint, s array<double>, ss array<double>").groupBy(F.lit(1).alias("one")).applyInArrow(total, "n bigint, eff_dim double")
