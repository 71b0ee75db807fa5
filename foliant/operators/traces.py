"""The three kinds of traces as one relation, and what is counted over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Archive

SHARED = ["id", "user_id", "book_id", "version", "created_at", "updated_at", "deleted_at"]
LOGGED, LOGGED_ACTIONS = ["DOG_EAR", "ANNOTATION", "REREAD_MARK"], ["CREATED", "UPDATED", "RESTORED"]


def tagged(archive: Archive) -> DataFrame:
    """All traces with ``type``, its place in the listing order, the span of pages and the text.

    A filter on ``type`` is a filter on a literal in each branch, so that the optimizer removes the others.
    """
    marks = [
        archive.dog_ears.select(*SHARED, F.lit("DOG_EAR").alias("type"), F.lit(0).alias("type_order"), F.col("page_number").alias("start_page"), F.col("page_number").alias("end_page"), F.col("reason").alias("body")),
        archive.annotations.select(*SHARED, F.lit("ANNOTATION").alias("type"), F.lit(1).alias("type_order"), "start_page", "end_page", F.col("content").alias("body")),
        archive.reread_marks.select(*SHARED, F.lit("REREAD_MARK").alias("type"), F.lit(2).alias("type_order"), F.col("page_number").alias("start_page"), F.col("page_number").alias("end_page"), F.col("reason").alias("body")),
    ]
    return reduce(DataFrame.unionByName, marks)


def newest_first() -> list[Column]:
    """Ties of time keep the kinds' order and then go by id."""
    return [F.desc("created_at"), F.asc("type_order"), F.asc("id")]


def by_page() -> list[Column]:
    return [F.asc("start_page"), F.desc("created_at"), F.asc("type_order"), F.asc("id")]


def counts_by_book(archive: Archive) -> DataFrame:
    """Live dog-ears, annotations, reread marks and reflections of each book, in one shuffle of partial counts."""
    live = [
        df.where("deleted_at IS NULL").select("book_id", F.lit(kind).alias("kind"))
        for kind, df in (("dog_ears", archive.dog_ears), ("annotations", archive.annotations), ("reread_marks", archive.reread_marks), ("reflections", archive.completion_reflections))
    ]
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("dog_ears", "annotations", "reread_marks", "reflections")]
    return reduce(DataFrame.union, live).groupBy("book_id").agg(*kinds)


def last_traces(events: DataFrame) -> DataFrame:
    """When a trace was last made, changed or restored, from the log: traces deleted since still count."""
    own = events.where(F.col("entity_type").isin(LOGGED) & F.col("action").isin(LOGGED_ACTIONS) & F.col("book_id").isNotNull())
    return own.groupBy("book_id").agg(F.max("occurred_at").alias("last_trace_at"))


def furthest_pages(archive: Archive) -> DataFrame:
    """The furthest page with a live trace of each book that has one."""
    return tagged(archive).where("deleted_at IS NULL").groupBy("book_id").agg(F.max("end_page").alias("max_page"))
