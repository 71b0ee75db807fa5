"""The archive's read endpoints as plans.

``tenant`` narrows a plan to one person (an equality that reaches the scan); without it the same page is made for every
person, or every book, at once.  Bad parameters raise before a plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..model import ACTIVITY_ACTIONS, ACTIVITY_ENTITY_TYPES, TRACE_TYPES, Archive
from ..operators import filters as f
from ..operators.paging import page_of
from ..operators.traces import by_page, counts_by_book, furthest_pages, last_traces, newest_first, tagged

BOOK_COLUMNS = ["id", "version", "title", "author", "publisher", "publication_year", "isbn", "page_count", "cover_url", "status", "created_at", "updated_at"]
EXPORT_ROWS, BOOK_EVENTS = 100_000, 100


def _known(name: str, x: str | None, allowed: list[str]) -> None:
    if x is not None and x not in allowed:
        raise ValueError(f"VALIDATION_ERROR: unknown {name} {x!r}")


def public_users(users: DataFrame) -> DataFrame:
    return users.select("id", "email", "created_at", "updated_at")


def books_where(archive: Archive, tenant=None, status: str | None = None, search: str | None = None) -> DataFrame:
    return f.contains(f.status_filter(f.equal(f.live(archive.books), user_id=tenant), status), search, "title", "author")


def list_books(archive: Archive, tenant=None, status=None, search=None, page=None, size=None) -> DataFrame:
    """A page of books, the last edited first, with counts of live traces and the time of the last trace.

    Children are narrowed to the page's books before they are counted: the optimizer would not push that key set down.
    """
    rows = books_where(archive, tenant, status, search)
    rows = page_of(rows, [F.desc("updated_at"), F.desc("id")], page, size, None if tenant is not None else "user_id")
    wanted = rows.select(F.col("id").alias("book_id"))
    narrowed = lambda df: df.join(wanted, "book_id", "left_semi")
    children = counts_by_book(Archive(**{**vars(archive), **{n: narrowed(getattr(archive, n)) for n in ("dog_ears", "annotations", "reread_marks", "completion_reflections")}}))
    latest = last_traces(narrowed(archive.activity_events))
    joined = rows.join(children, rows.id == children.book_id, "left").drop(children.book_id).join(latest, rows.id == latest.book_id, "left").drop(latest.book_id)
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("dog_ears", "annotations", "reread_marks")]
    shown = joined.select("user_id", *BOOK_COLUMNS, *counts, (F.coalesce("reflections", F.lit(0)) > 0).alias("has_reflection"), "last_trace_at")
    # Joins keep no order: a single page, of 100 rows at most, is put in order again.
    return shown if tenant is None else shown.orderBy(F.desc("updated_at"), F.desc("id"))


def book_totals(archive: Archive, tenant=None, status=None, search=None) -> DataFrame:
    return books_where(archive, tenant, status, search).groupBy("user_id").agg(F.count("*").alias("total"))


def book_detail(archive: Archive, tenant=None, book=None) -> DataFrame:
    """Live books with their counts and live reflections, the latest first, as a nested array."""
    rows = f.equal(f.live(archive.books), user_id=tenant, id=book)
    own = f.equal(f.live(archive.completion_reflections), user_id=tenant, book_id=book)
    item = F.struct("completed_at", "created_at", "id", "completion_round", "mood_tags", F.coalesce("reflection", F.lit("")).alias("text"))
    nested = own.groupBy("book_id").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"))
    names = ("dog_ears", "annotations", "reread_marks", "completion_reflections")
    counts = counts_by_book(Archive(**{**vars(archive), **{n: f.equal(getattr(archive, n), user_id=tenant, book_id=book) for n in names}}))
    joined = rows.join(counts, rows.id == counts.book_id, "left").drop(counts.book_id).join(nested, rows.id == nested.book_id, "left").drop(nested.book_id)
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("dog_ears", "annotations", "reread_marks")]
    return joined.select("user_id", *BOOK_COLUMNS, *numbers, F.coalesce("items", F.array()).alias("reflections"))


def reflections(archive: Archive, tenant=None, book=None) -> DataFrame:
    """Live reflections with their ``place`` in the list of their book, the last round first; a single list is in order."""
    rows = f.equal(f.live(archive.completion_reflections), user_id=tenant, book_id=book)
    text = F.coalesce("reflection", F.lit("")).alias("text")
    latest = [F.desc("completion_round"), F.asc("id")]
    place = F.row_number().over(Window.partitionBy("book_id").orderBy(*latest)).alias("place")
    shown = rows.select("id", "user_id", "book_id", "version", "completion_round", "mood_tags", text, "completed_at", "editable_until", "created_at", "updated_at", place)
    return shown if book is None else shown.orderBy("place")


def traces(
    archive: Archive, tenant=None, book=None, kind: str | None = None, keyword: str | None = None, on: int | None = None,
    start=None, end=None, page=None, size=None, order: list[Column] | None = None, paged: bool = True,
) -> DataFrame:
    """Live traces of a book, or of every book, newest first; all matches with ``paged=False``."""
    rows = traces_where(archive, tenant, book, kind, keyword, on, start, end)
    return page_of(rows, order or newest_first(), page, size, None if book is not None else "book_id") if paged else rows


def traces_where(archive: Archive, tenant=None, book=None, kind: str | None = None, keyword: str | None = None, on: int | None = None, start=None, end=None) -> DataFrame:
    _known("type", kind, TRACE_TYPES)
    if on is not None and on < 1:
        raise ValueError("VALIDATION_ERROR: pages count from 1")
    rows = f.equal(f.live(tagged(archive)), user_id=tenant, book_id=book, type=kind)
    return f.contains(f.on_page(f.between(rows, "created_at", start, end), on), keyword, "body")


def trace_totals(archive: Archive, **wanted) -> DataFrame:
    """How many traces of each book the pages of :func:`traces` hold together."""
    return traces_where(archive, **wanted).groupBy("book_id").agg(F.count("*").alias("total"))


def traces_by_page(archive: Archive, **wanted) -> DataFrame:
    """Traces in page order with the texts shown for them; the archive's own columns stay inside."""
    return _shown(traces(archive, **{"order": by_page(), **wanted}))


def traces_in_page_order(archive: Archive, **wanted) -> DataFrame:
    """All that :func:`traces_by_page` pages through, with the ``place`` of each trace in its book."""
    rows = traces(archive, **wanted, paged=False)
    return _shown(rows.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy(*by_page()))), "place")


def _shown(rows: DataFrame, *more: str) -> DataFrame:
    shown = [labels.trace_range(F.col("start_page"), F.col("end_page")).alias("range_text"), labels.trace_body(F.col("type"), F.col("body")).alias("body_text"), labels.label(labels.TRACES, F.col("type")).alias("type_label")]
    return rows.select("id", "book_id", "version", "type", "start_page", "end_page", "created_at", "updated_at", *shown, *more)


def timeline_where(archive: Archive, tenant=None, book=None, entity: str | None = None, action: str | None = None, start=None, end=None) -> DataFrame:
    _known("entityType", entity, ACTIVITY_ENTITY_TYPES)
    _known("action", action, ACTIVITY_ACTIONS)
    rows = f.equal(archive.activity_events, user_id=tenant, book_id=book, entity_type=entity, action=action)
    return f.between(rows, "occurred_at", start, end)


def timeline(archive: Archive, page=None, size=None, per: str | None = "user_id", paged: bool = True, **wanted) -> DataFrame:
    """A page of events, newest first, with the title of the book even if that is deleted; all with ``paged=False``.

    The page is cut before the join, so that only its rows look for a title.
    """
    rows = timeline_where(archive, **wanted)
    if paged:
        rows = page_of(rows, [F.desc("occurred_at"), F.desc("id")], page, size, None if wanted.get("tenant") is not None else per)
    titles = archive.books.select(F.col("id").alias("book_id"), "title")
    title = F.coalesce("title", F.lit(labels.DELETED_BOOK)).alias("book_title")
    shown = rows.join(titles, "book_id", "left").select("id", "user_id", "book_id", title, "entity_type", "entity_id", "action", F.col("payload_json").alias("payload"), "occurred_at")
    return shown.orderBy(F.desc("occurred_at"), F.desc("id")) if paged and (wanted.get("tenant") is not None or per is None) else shown


def next_rounds(archive: Archive) -> DataFrame:
    """The next round of each live book: rounds of deleted reflections are never used again."""
    used = archive.completion_reflections.groupBy("book_id").agg(F.max("completion_round").alias("last_round"))
    rows = f.live(archive.books).join(used, F.col("id") == used.book_id, "left")
    return rows.select(F.col("id").alias("book_id"), (F.coalesce("last_round", F.lit(0)) + 1).cast("int").alias("next_round"))


def latest_live_rounds(archive: Archive) -> DataFrame:
    return f.live(archive.completion_reflections).groupBy("book_id").agg(F.max("completion_round").alias("latest_round"))


def max_trace_pages(archive: Archive) -> DataFrame:
    """The furthest live trace of every live book, 0 without one."""
    far = furthest_pages(archive)
    rows = f.live(archive.books).join(far, F.col("id") == far.book_id, "left")
    return rows.select("id", "user_id", "page_count", F.coalesce("max_page", F.lit(0)).alias("max_page"))


def export_counts(archive: Archive, include_deleted: bool | str = False) -> DataFrame:
    """Rows that each person's export would hold; events are never filtered."""
    kinds = {"books": archive.books, "dog_ears": archive.dog_ears, "annotations": archive.annotations, "reread_marks": archive.reread_marks, "reflections": archive.completion_reflections}
    parts = [f.live(df, include_deleted).select("user_id", F.lit(k).alias("kind")) for k, df in kinds.items()]
    parts.append(archive.activity_events.select("user_id", F.lit("events").alias("kind")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    counts = rows.groupBy("user_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in [*kinds, "events"]), F.count("*").alias("total"))
    return counts


def export_guard(archive: Archive, limit: int = EXPORT_ROWS, include_deleted: bool | str = False) -> DataFrame:
    """Null, or the code by which an export of more than ``limit`` rows is refused."""
    code = F.when(F.col("total") > limit, F.lit("EXPORT_TOO_LARGE"))
    return export_counts(archive, include_deleted).select("user_id", "total", code.alias("reject_code"))


def export_archive(archive: Archive, exported_at, include_deleted: bool | str = False, limit: int = EXPORT_ROWS) -> DataFrame:
    """``user_id, file_name, document``: one JSON document for each person whose export is allowed.

    A person without rows gets a document of empty arrays.
    """
    guarded = export_guard(archive, limit, include_deleted)
    refused = guarded.where("reject_code IS NOT NULL").select("user_id")
    allowed = guarded.where("reject_code IS NULL").select("user_id")
    users = archive.users.join(refused, F.col("id") == refused.user_id, "left_anti")
    at = f.value(exported_at)
    for name, df, when in (("books", archive.books, "created_at"), ("dogEars", archive.dog_ears, "created_at"), ("annotations", archive.annotations, "created_at"), ("rereadMarks", archive.reread_marks, "created_at"), ("reflections", archive.completion_reflections, "created_at"), ("activityEvents", archive.activity_events, "occurred_at")):
        rows = (df if name == "activityEvents" else f.live(df, include_deleted)).join(allowed, "user_id", "left_semi")
        # A person's rows are at most ``limit``, so that the array is bounded.
        item = F.struct(F.col(when).alias("_at"), F.col("id").alias("_id"), F.struct(*df.columns).alias("row"))
        nested = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(item)).getField("row").alias(name))
        users = users.join(nested, users.id == nested.user_id, "left").drop(nested.user_id).withColumn(name, F.coalesce(name, F.from_json(F.lit("[]"), nested.schema[name].dataType)))
    user = F.struct("id", "email", F.col("created_at").alias("createdAt"), F.col("updated_at").alias("updatedAt"))
    names = ["books", "dogEars", "annotations", "rereadMarks", "reflections", "activityEvents"]
    whole = F.struct(F.lit(1).alias("schemaVersion"), at.alias("exportedAt"), F.lit(str(include_deleted).lower() == "true").alias("includeDeleted"), user.alias("user"), *names)
    file_name = F.concat(F.lit("reading-archive-"), labels.file_date(at), F.lit(".json"))
    return users.select(F.col("id").alias("user_id"), file_name.alias("file_name"), F.to_json(whole, {"pretty": "true", "ignoreNullFields": "false"}).alias("document"))
