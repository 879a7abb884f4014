"""Text kernels over DataFrames, by Arrow batches; no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def flat_map(df: DataFrame, cols: list[str], fn: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """One call of ``fn`` per row with the columns' values; each tuple it returns is a row of the schema."""
    names = [x.strip().split()[0] for x in schema.split(",")]
    types = [_ARROW[x.strip().split()[1]] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for values in zip(*(batch.column(i).to_pylist() for i in range(len(cols)))):
                for row in fn(*values):
                    for col, v in zip(out, row):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return df.select(*[F.col(c) for c in cols]).mapInArrow(run, StructType.fromDDL(schema))


def decay_grid(rows: DataFrame, key: str, ts: str, bases: list[float], growths: list[float], gain: float = 1.0) -> DataFrame:
    """(key, base, growth, strength, last): each key's events replayed in time order for every pair of parameters.

    The strength grows by gain * (1 - retrievability) at each event.  A key's events are folded in order by one
    aggregate expression over the sorted array, so there is one shuffle for all parameters.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.lit(g).alias("growth")) for b in bases for g in growths])).alias("g")
    days = rows.filter(F.col(ts).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.unix_micros(F.col(ts).cast("timestamp")) / 86_400_000_000.0)).alias("days"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("t"))

    def step(acc, day):  # noqa: ANN001, ANN202
        half = F.col("g.base") * F.pow(F.col("g.growth"), acc.s)
        r = F.when(acc.t.isNull(), 0.0).otherwise(F.exp(-(day - acc.t) * 0.6931471805599453 / half))
        return F.struct((acc.s + F.when(acc.t.isNull(), 0.0).otherwise(gain * (1 - r))).alias("s"), day.alias("t"))

    return days.select(key, "days", grid).select(key, F.col("g.base").alias("base"), F.col("g.growth").alias("growth"), F.round(F.aggregate("days", zero, step).s, 6).alias("strength"))
