"""Pages of ordered rows: of one tenant by a top-k, of all tenants at once by a rank inside each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SIZE, LARGEST_SIZE = 20, 100


def page_arguments(page=None, size=None) -> tuple[int, int]:
    """Whole numbers from 1, the size up to 100; anything else falls back to page 1 and 20 rows."""

    def whole(x, default: int) -> int:
        try:
            n = int(x)
        except (TypeError, ValueError):
            return default
        return n if n >= 1 else default

    return whole(page, 1), min(whole(size, DEFAULT_SIZE), LARGEST_SIZE)


def page_of(df: DataFrame, order: list[Column], page=None, size=None, per: str | None = None) -> DataFrame:
    """Rows of one page in a total order.

    Without ``per`` the plan is a TakeOrderedAndProject; with it, the same page of every value of ``per``, by a rank
    whose filter Spark pushes below the shuffle as a group limit.
    """
    number, size = page_arguments(page, size)
    skip = (number - 1) * size
    if per is None:
        return df.orderBy(*order).offset(skip).limit(size) if skip else df.orderBy(*order).limit(size)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(per).orderBy(*order)))
    return ranked.where((F.col("_rank") > skip) & (F.col("_rank") <= skip + size)).drop("_rank")


def pages_needed(total: Column, size: int) -> Column:
    return F.ceil(total / size).cast("bigint")
