"""Checks of request parameters (P21), as columns of texts; a value that is no good becomes null and has a reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
DEFAULT_DAYS, MOST_DAYS, DEFAULT_CONFIDENCE = 30, 3650, 0.5
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _bare(raw: Column) -> Column:
    return F.trim(F.coalesce(raw, F.lit("")))


def days(raw: Column) -> Column:
    """Days back: 30 where none are given, 3650 at most."""
    n = F.when(_bare(raw).rlike("^[+-]?[0-9]{1,18}$"), _bare(raw).try_cast("long"))
    return F.when(_bare(raw) == "", F.lit(DEFAULT_DAYS)).when(n > 0, F.least(n, F.lit(MOST_DAYS)).cast("int"))


def confidence(raw: Column) -> Column:
    """Least confidence: 0.5 where none is given, else between 0 and 1."""
    v = _bare(raw).try_cast("double")
    return F.when(_bare(raw) == "", F.lit(DEFAULT_CONFIDENCE)).when((v >= 0) & (v <= 1), v)


def fault(days_raw: Column, confidence_raw: Column) -> Column:
    """The first reason to refuse a request, or null."""
    return F.when(days(days_raw).isNull(), "days must be a positive integer").when(confidence(confidence_raw).isNull(), "min_confidence must be between 0 and 1")


def listed(raw: Column) -> Column:
    """Parts between commas, trimmed, blank ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def time_of(raw: Column) -> Column:
    """A time with its zone, or null."""
    shaped = F.regexp_extract(raw, r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$", 0)
    return F.when(shaped != "", F.try_to_timestamp(raw))
