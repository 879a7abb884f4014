"""Forgetting curves: half-life, retrievability, states with hysteresis."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE_DAYS, GROWTH = 21.0, 1.8
DEMOTE_FADING, DEMOTE_DORMANT, PROMOTE_FADING, PROMOTE_ACTIVE = 0.5, 0.2, 0.3, 0.6


def half_life(s: Column, base: float = BASE_DAYS, growth: float = GROWTH) -> Column:
    return F.lit(base) * F.pow(F.lit(growth), F.greatest(F.lit(0.0), s))


def retrievability(s: Column, reinforced: Column, now: Column, base: float = BASE_DAYS, growth: float = GROWTH) -> Column:
    """exp(-days ln 2 / half-life); 1 for an unknown time, days are never negative."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(reinforced)) / 86_400_000_000.0)
    return F.when(reinforced.isNull(), F.lit(1.0)).otherwise(F.exp(-days * math.log(2) / half_life(s, base, growth)))


def next_status(status: Column, r: Column) -> Column:
    return (
        F.when(status == "falsified", "falsified")
        .when(status == "dormant", F.when(r > PROMOTE_ACTIVE, "active").when(r > PROMOTE_FADING, "fading").otherwise("dormant"))
        .when(status == "fading", F.when(r > PROMOTE_ACTIVE, "active").when(r < DEMOTE_DORMANT, "dormant").otherwise("fading"))
        .otherwise(F.when(r < DEMOTE_DORMANT, "dormant").when(r < DEMOTE_FADING, "fading").otherwise("active"))
    )
