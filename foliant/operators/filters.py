"""Filters of the archive; an argument that is None leaves its filter out of the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def live(df: DataFrame, include_deleted: bool | str = False) -> DataFrame:
    """Rows that aren't deleted, or all for True or the text 'true' in any case."""
    return df if str(include_deleted).lower() == "true" else df.where(F.col("deleted_at").isNull())


def equal(df: DataFrame, **wanted) -> DataFrame:
    for name, x in wanted.items():
        if x is not None:
            df = df.where(F.col(name) == value(x))
    return df


def between(df: DataFrame, name: str, start=None, end=None) -> DataFrame:
    """Closed on both sides; either may be open."""
    if start is not None:
        df = df.where(F.col(name) >= value(start))
    if end is not None:
        df = df.where(F.col(name) <= value(end))
    return df


def contains(df: DataFrame, search: str | None, *names: str) -> DataFrame:
    """Any of the columns holds the text, whatever the case; signs have no special meaning and nulls never match."""
    if not search:
        return df
    found = F.lit(False)
    for n in names:
        found = found | F.coalesce(F.contains(F.lower(F.col(n)), F.lit(search.lower())), F.lit(False))
    return df.where(found)


def on_page(df: DataFrame, page: int | None) -> DataFrame:
    """Traces whose span of pages holds the page."""
    return df if page is None else df.where(value(page).between(F.col("start_page"), F.col("end_page")))


def same_reason(a: Column, b: Column) -> Column:
    """Null and empty are the same reason."""
    return F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))


def status_filter(df: DataFrame, status: str | None) -> DataFrame:
    from ..model import BOOK_STATUSES

    if status in (None, "", "ALL"):
        return df
    if status not in BOOK_STATUSES:
        raise ValueError(f"VALIDATION_ERROR: unknown status {status!r}")
    return df.where(F.col("status") == status)
