"""Rows that break the archive's constraints, and its stores' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Archive
from ..operators import filters as f
from ..operators.traces import tagged
from .reads import max_trace_pages


def dog_ear_conflicts(archive: Archive) -> DataFrame:
    """Pages with more than one live dog-ear."""
    return f.live(archive.dog_ears).groupBy("book_id", "page_number").agg(F.count("*").alias("n")).where("n > 1")


def round_conflicts(archive: Archive) -> DataFrame:
    """Rounds with more than one live reflection."""
    return f.live(archive.completion_reflections).groupBy("book_id", "completion_round").agg(F.count("*").alias("n")).where("n > 1")


def orphan_live_traces(archive: Archive) -> DataFrame:
    """Live traces of books that are deleted or missing."""
    alive = f.live(archive.books).select(F.col("id").alias("book_id"))
    return f.live(tagged(archive)).join(alive, "book_id", "left_anti").select("id", "book_id", "type")


def page_count_violations(archive: Archive) -> DataFrame:
    return max_trace_pages(archive).where("page_count IS NOT NULL AND max_page > page_count")


def email_conflicts(users: DataFrame) -> DataFrame:
    return users.groupBy("email").agg(F.count("*").alias("n")).where("n > 1")


def status_history(events: DataFrame) -> DataFrame:
    """Status changes of each book with the time spent since the last one: a replay of the log (beyond the original)."""
    changes = events.where("action = 'STATUS_CHANGED' AND book_id IS NOT NULL")
    w = Window.partitionBy("book_id").orderBy("occurred_at", "id")
    before = F.lag("occurred_at").over(w)
    return changes.select("id", "book_id", "occurred_at", before.alias("previous_at"), F.row_number().over(w).cast("bigint").alias("change_no"))


def valid_sessions(archive: Archive, now) -> DataFrame:
    """Sessions that let their person in at a moment."""
    from ..functions.rules import session_valid

    people = archive.users.select(F.col("id").alias("user_id"), "status", "deleted_at")
    rows = archive.sessions.join(people, "user_id")
    ok = session_valid(F.col("revoked_at"), F.col("expires_at"), F.col("status"), F.col("deleted_at"), f.value(now))
    return rows.where(ok).select("id", "user_id", "expires_at")
