"""Claims and their evidence: consolidation and the tuning of a knob."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST, STEP, CAP = 0.5, 0.1, 0.9


def consolidate(evidence: DataFrame, first: float = FIRST, step: float = STEP, cap: float = CAP) -> DataFrame:
    """(claim_id, confidence, insights, echoes, revisions) of rows (claim_id, insight, grounded_on array).

    A different insight raises the confidence by a step up to the cap; the same insight again only refreshes its entry,
    and one that was grounded on the claim itself adds evidence without a raise.  As the order doesn't matter for the sum
    of equal steps, this is an aggregation with partial sums, however many rows a claim has.
    """
    once = evidence.groupBy("claim_id", "insight").agg(F.count("*").alias("n"), F.min(F.coalesce(F.array_contains("grounded_on", F.col("claim_id")), F.lit(False)).cast("int")).alias("echo"))
    per = once.groupBy("claim_id").agg(F.count("*").alias("insights"), F.sum("echo").alias("echoes"), F.sum(F.col("n") - 1).alias("revisions"))
    raised = F.least(F.lit(cap), first + step * (F.col("insights") - F.col("echoes")))
    return per.select("claim_id", F.round(raised, 4).alias("confidence"), "insights", "echoes", "revisions")


@dataclass(frozen=True)
class Knob:
    """A number that is moved in damped steps to keep a metric within a band."""

    default: float
    low: float
    high: float
    band: tuple[float, float]
    danger: float
    step: float = 0.2
    least: int = 5
    worse_when_high: bool = True

    def clamp(self, v: float) -> float:
        return min(self.high, max(self.low, v))

    def move(self, now: float, metric: float | None, samples: int, before: float | None = None, due: bool = True) -> tuple[str, float]:
        """(action, value).  ``before``: the value before a last step upwards, which is taken back in danger."""
        if metric is None or samples < self.least:
            return "insufficient", now
        if before is not None and (metric >= self.danger if self.worse_when_high else metric <= self.danger):
            return "rollback", self.clamp(before)
        if not due:
            return "cooldown", now
        above, below = metric > self.band[1], metric < self.band[0]
        down, up = (above, below) if self.worse_when_high else (below, above)
        new = self.clamp(now * (1 - self.step if down else 1 + self.step if up else 1))
        return ("hold", now) if new == now else ("down" if down else "up", new)
