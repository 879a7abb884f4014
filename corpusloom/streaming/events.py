"""Streaming forms of the event operators: duplicates, bursts, strikes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def seen_once(stream: DataFrame, key: str, ts: str, window: str = "30 days") -> DataFrame:
    """The first sighting of each key within the window; state is dropped as the watermark passes."""
    return stream.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])


def bursts(stream: DataFrame, key: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): a burst is given out once no event came for ``gap``; the event-time form of a debounce."""
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return s.select(key, "start", "end", "n")


def strikes(stream: DataFrame, key: str, ts: str, failed: str, limit: int = 3) -> DataFrame:
    """(key, fails, blocked) after each batch that touches a key: failures since its last success.  State is one integer per key."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fails = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(ts, kind="stable")
        for bad in rows[failed]:
            fails = fails + 1 if bad else 0
        state.update((int(fails),))
        yield pd.DataFrame({key: [k[0]], "fails": [int(fails)], "blocked": [bool(fails >= limit)]})

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(key, ts, failed)
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, fails int, blocked boolean", "fails int", "update", GroupStateTimeout.NoTimeout)
