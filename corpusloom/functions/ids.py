"""Cleaning of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(c: Column | str) -> Column:
    """Trimmed and in lower case; null for null or blank."""
    t = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(t != "", t)
