"""Queries over whole tables for every reading operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels, rules
from .functions import text as tx
from .operators import filters as f
from .operators.paging import pages_needed
from .operators.traces import counts_by_book, last_traces
from .plans import audits, reads, writes
from .sources.fixtures import archive, sql_with
from .streaming import log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "1998-09-02 12:00:00"


def query(sql: str | None, *views: str):
    """Register a query with its SQL over the views; None where SQL can't express the result."""

    def register(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = (sql_with(*views) if views else "") + sql
        return make

    return register


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _ntz(text: str) -> F.Column:
    return F.lit(text).cast("timestamp_ntz")


TIMELINE = """
SELECT e.id, e.user_id, e.book_id, coalesce(b.title, '已删除书目') AS book_title, entity_type, entity_id, action,
       payload_json AS payload, occurred_at
FROM (SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY occurred_at DESC, id DESC) AS rn FROM r_events WHERE {where}) AS e
LEFT JOIN r_books AS b ON b.id = e.book_id WHERE rn > {skip} AND rn <= {last}"""


@query(TIMELINE.format(per="user_id", skip=0, last=20, where="occurred_at BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-12-31 23:59:59'"), "r_events", "r_books")
def timeline_range(spark, sf_dir):
    return reads.timeline(archive(spark, sf_dir), start=_ntz("2024-01-02 00:00:00"), end=_ntz("2024-12-31 23:59:59"))


@query(TIMELINE.format(per="book_id", skip=0, last=100, where="book_id IS NOT NULL"), "r_events", "r_books")
def timeline_by_book(spark, sf_dir):
    a = archive(spark, sf_dir)
    a = type(a)(**{**vars(a), "activity_events": a.activity_events.where("book_id IS NOT NULL")})
    return reads.timeline(a, per="book_id", size=reads.BOOK_EVENTS)


@query(TIMELINE.format(per="user_id", skip=1, last=2, where="entity_type = 'ANNOTATION' AND action = 'UPDATED'"), "r_events", "r_books")
def timeline_by_entity_action(spark, sf_dir):
    return reads.timeline(archive(spark, sf_dir), entity="ANNOTATION", action="UPDATED", page=2, size=1)


@query(TIMELINE.format(per="user_id", skip=0, last=9223372036854775807, where="entity_type = 'ANNOTATION' AND action = 'UPDATED'"), "r_events", "r_books")
def timeline_by_entity_action_all(spark, sf_dir):
    """Every such event of every person; timeline_by_entity_action is a page of them."""
    return reads.timeline(archive(spark, sf_dir), entity="ANNOTATION", action="UPDATED", paged=False)


TRACE_COLUMNS = "id, user_id, book_id, version, created_at, updated_at, deleted_at, type, type_order, start_page, end_page, body"
TRACES = f"""
, t AS (SELECT id, user_id, book_id, version, created_at, updated_at, deleted_at, type, CAST(type_order AS INT) AS type_order, start_page, end_page,
               CASE WHEN type = 'ANNOTATION' THEN coalesce(body, '') ELSE body END AS body FROM r_traces WHERE deleted_at IS NULL)
SELECT {TRACE_COLUMNS} FROM t WHERE """


@query(TRACES.replace("SELECT id, user_id, book_id, version, created_at, updated_at, deleted_at, type, type_order", "SELECT id, user_id, book_id, version, created_at, updated_at, deleted_at, type, type_order").replace(" FROM t WHERE ", " FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY created_at DESC, type_order, id) AS rn FROM t) WHERE rn <= 5"), "r_traces")
def traces_merged(spark, sf_dir):
    return reads.traces(archive(spark, sf_dir), size=5)


@query(TRACES + "true", "r_traces")
def traces_merged_all(spark, sf_dir):
    """Every live trace of every book; traces_merged is a page of them."""
    return reads.traces(archive(spark, sf_dir), paged=False)


@query(TRACES + "start_page <= 20 AND end_page >= 20", "r_traces")
def traces_on_page(spark, sf_dir):
    return reads.traces(archive(spark, sf_dir), on=20, paged=False)


@query(TRACES + "contains(lower(body), 'ring')", "r_traces")
def traces_keyword(spark, sf_dir):
    return reads.traces(archive(spark, sf_dir), keyword="RING", paged=False)


@query(TRACES + "type = 'REREAD_MARK' AND created_at >= TIMESTAMP '1995-01-01 00:00:00'", "r_traces")
def traces_by_type(spark, sf_dir):
    return reads.traces(archive(spark, sf_dir), kind="REREAD_MARK", start=_ntz("1995-01-01 00:00:00"), paged=False)


@query("""
SELECT id, book_id, version, type, start_page, end_page, created_at, updated_at,
       CASE WHEN start_page = end_page THEN concat('第 ', start_page, ' 页') ELSE concat('第 ', start_page, '–', end_page, ' 页') END AS range_text,
       CASE WHEN type = 'ANNOTATION' THEN coalesce(body, '') ELSE coalesce(nullif(body, ''), '未填写原因') END AS body_text,
       CASE type WHEN 'DOG_EAR' THEN '折角' WHEN 'ANNOTATION' THEN '批注' ELSE '重读页' END AS type_label
FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY start_page, created_at DESC, type_order, id) AS rn FROM r_traces WHERE deleted_at IS NULL)
WHERE rn <= 3""", "r_traces")  # fmt: skip
def traces_page_order(spark, sf_dir):
    return reads.traces_by_page(archive(spark, sf_dir), size=3)


@query("""
SELECT id, book_id, version, type, start_page, end_page, created_at, updated_at,
       CASE WHEN start_page = end_page THEN concat('第 ', start_page, ' 页') ELSE concat('第 ', start_page, '–', end_page, ' 页') END AS range_text,
       CASE WHEN type = 'ANNOTATION' THEN coalesce(body, '') ELSE coalesce(nullif(body, ''), '未填写原因') END AS body_text,
       CASE type WHEN 'DOG_EAR' THEN '折角' WHEN 'ANNOTATION' THEN '批注' ELSE '重读页' END AS type_label,
       row_number() OVER (PARTITION BY book_id ORDER BY start_page, created_at DESC, type_order, id) AS place
FROM r_traces WHERE deleted_at IS NULL""", "r_traces")  # fmt: skip
def traces_page_order_all(spark, sf_dir):
    """Every live trace of every book with its place in page order; traces_page_order is a page of them."""
    return reads.traces_in_page_order(archive(spark, sf_dir))


COUNTS = """
, c AS (SELECT book_id, count(*) FILTER (type = 'DOG_EAR') AS dog_ears, count(*) FILTER (type = 'ANNOTATION') AS annotations,
               count(*) FILTER (type = 'REREAD_MARK') AS reread_marks FROM r_traces WHERE deleted_at IS NULL GROUP BY 1),
  n AS (SELECT book_id, count(*) AS reflections FROM r_reflections WHERE deleted_at IS NULL GROUP BY 1),
  g AS (SELECT book_id, max(occurred_at) AS last_trace_at FROM r_events WHERE entity_type IN ('DOG_EAR', 'ANNOTATION', 'REREAD_MARK')
        AND action IN ('CREATED', 'UPDATED', 'RESTORED') AND book_id IS NOT NULL GROUP BY 1)"""
BOOK = """b.user_id, b.id, b.version, title, author, NULL::VARCHAR AS publisher, NULL::SMALLINT AS publication_year, NULL::VARCHAR AS isbn,
       page_count, NULL::VARCHAR AS cover_url, status, b.created_at, b.updated_at, coalesce(dog_ears, 0) AS dog_ears,
       coalesce(annotations, 0) AS annotations, coalesce(reread_marks, 0) AS reread_marks"""


@query(COUNTS + f"""
SELECT {BOOK}, coalesce(reflections, 0) > 0 AS has_reflection, last_trace_at
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id DESC) AS rn FROM r_books WHERE deleted_at IS NULL
      AND (contains(lower(title), '1') OR contains(lower(author), '1'))) AS b
LEFT JOIN c ON c.book_id = b.id LEFT JOIN n ON n.book_id = b.id LEFT JOIN g ON g.book_id = b.id WHERE rn <= 12""", "r_books", "r_traces", "r_reflections", "r_events")  # fmt: skip
def books_list_page(spark, sf_dir):
    return reads.list_books(archive(spark, sf_dir), search="1", size=12)


TENANT = "7"


@query(COUNTS + f"""
SELECT {BOOK}, coalesce(reflections, 0) > 0 AS has_reflection, last_trace_at
FROM (SELECT * FROM r_books WHERE deleted_at IS NULL AND user_id = '{TENANT}' ORDER BY updated_at DESC, id DESC LIMIT 20) AS b
LEFT JOIN c ON c.book_id = b.id LEFT JOIN n ON n.book_id = b.id LEFT JOIN g ON g.book_id = b.id""", "r_books", "r_traces", "r_reflections", "r_events")  # fmt: skip
def books_list_of_tenant(spark, sf_dir):
    return reads.list_books(archive(spark, sf_dir), tenant=TENANT)


@query(TIMELINE.format(per="user_id", skip=0, last=20, where=f"user_id = '{TENANT}'"), "r_events", "r_books")
def timeline_of_tenant(spark, sf_dir):
    return reads.timeline(archive(spark, sf_dir), tenant=TENANT)


@query(TRACES + f"user_id = '{TENANT}'", "r_traces")
def traces_of_tenant(spark, sf_dir):
    return reads.traces(archive(spark, sf_dir), tenant=TENANT, paged=False)


@query(COUNTS + f"\nSELECT {BOOK} FROM r_books AS b LEFT JOIN c ON c.book_id = b.id WHERE deleted_at IS NULL AND b.id = '34'", "r_books", "r_traces", "r_reflections", "r_events")
def book_by_id(spark, sf_dir):
    return reads.book_detail(archive(spark, sf_dir), book="34").drop("reflections")


@query("\nSELECT book_id, count(*) AS total FROM r_traces WHERE deleted_at IS NULL AND contains(lower(body), 'ring') GROUP BY 1", "r_traces")
def trace_totals(spark, sf_dir):
    return reads.trace_totals(archive(spark, sf_dir), keyword="RING")


@query("\nSELECT user_id, count(*) AS total FROM r_books WHERE deleted_at IS NULL AND status = 'READING' GROUP BY 1", "r_books")
def books_list_total(spark, sf_dir):
    return reads.book_totals(archive(spark, sf_dir), status="READING")


@query("\nSELECT user_id, CAST(ceil(count(*) / 12.0) AS BIGINT) AS pages FROM r_books WHERE deleted_at IS NULL GROUP BY 1", "r_books")
def pages_needed_by_user(spark, sf_dir):
    return reads.book_totals(archive(spark, sf_dir)).select("user_id", pages_needed(F.col("total"), 12).alias("pages"))


@query(COUNTS + f"""
, j AS (SELECT book_id, string_agg(concat_ws('/', completion_round, tag_1, CASE WHEN tag_2 <> tag_1 THEN tag_2 END, coalesce(reflection, '')), ';' ORDER BY completed_at DESC, created_at DESC, id DESC) AS reflections
        FROM r_reflections WHERE deleted_at IS NULL GROUP BY 1)
SELECT {BOOK}, coalesce(j.reflections, '') AS reflections FROM r_books AS b
LEFT JOIN c ON c.book_id = b.id LEFT JOIN j ON j.book_id = b.id WHERE deleted_at IS NULL""", "r_books", "r_traces", "r_reflections", "r_events")  # fmt: skip
def book_detail(spark, sf_dir):
    item = lambda r: F.concat_ws("/", r["completion_round"].cast("string"), r["mood_tags"], r["text"])
    return reads.book_detail(archive(spark, sf_dir)).withColumn("reflections", F.array_join(F.transform("reflections", item), ";"))


@query("""
SELECT id, user_id, book_id, version, completion_round, CASE WHEN tag_1 = tag_2 THEN tag_1 ELSE concat(tag_1, ',', tag_2) END AS mood_tags,
       coalesce(reflection, '') AS text, completed_at, editable_until, created_at, updated_at,
       CAST(row_number() OVER (PARTITION BY book_id ORDER BY completion_round DESC, id) AS INT) AS place FROM r_reflections WHERE deleted_at IS NULL""", "r_reflections")  # fmt: skip
def reflections_list(spark, sf_dir):
    return reads.reflections(archive(spark, sf_dir)).withColumn("mood_tags", F.array_join("mood_tags", ","))


@query(COUNTS + "\nSELECT book_id, last_trace_at FROM g", "r_traces", "r_reflections", "r_events")
def last_trace_at(spark, sf_dir):
    return last_traces(archive(spark, sf_dir).activity_events)


@query(COUNTS + """
SELECT book_id, coalesce(dog_ears, 0) AS dog_ears, coalesce(annotations, 0) AS annotations, coalesce(reread_marks, 0) AS reread_marks,
       coalesce(reflections, 0) AS reflections FROM c FULL JOIN n USING (book_id)""", "r_traces", "r_reflections", "r_events")  # fmt: skip
def trace_counts(spark, sf_dir):
    return counts_by_book(archive(spark, sf_dir))


FAR = """
, m AS (SELECT b.id, b.user_id, b.page_count, coalesce(max(t.end_page), 0) AS max_page FROM r_books AS b
        LEFT JOIN r_traces AS t ON t.book_id = b.id AND t.deleted_at IS NULL WHERE b.deleted_at IS NULL GROUP BY ALL)
SELECT id, user_id, page_count, max_page FROM m"""


@query(FAR, "r_books", "r_traces")
def max_trace_page(spark, sf_dir):
    return reads.max_trace_pages(archive(spark, sf_dir))


@query(FAR + " WHERE max_page > page_count", "r_books", "r_traces")
def page_count_violations(spark, sf_dir):
    return audits.page_count_violations(archive(spark, sf_dir))


@query("""
SELECT b.id AS book_id, CAST(coalesce(max(completion_round), 0) + 1 AS INT) AS next_round FROM r_books AS b
LEFT JOIN r_reflections AS r ON r.book_id = b.id WHERE b.deleted_at IS NULL GROUP BY 1""", "r_books", "r_reflections")
def next_round(spark, sf_dir):
    return reads.next_rounds(archive(spark, sf_dir))


@query("\nSELECT book_id, max(completion_round) AS latest_round FROM r_reflections WHERE deleted_at IS NULL GROUP BY 1", "r_reflections")
def latest_live_round(spark, sf_dir):
    return reads.latest_live_rounds(archive(spark, sf_dir))


EXPORT = """
, k AS (SELECT user_id, 'books' AS kind FROM r_books WHERE deleted_at IS NULL UNION ALL
        SELECT user_id, type FROM r_traces WHERE deleted_at IS NULL UNION ALL
        SELECT user_id, 'reflections' FROM r_reflections WHERE deleted_at IS NULL UNION ALL SELECT user_id, 'events' FROM r_events)
, x AS (SELECT user_id, count(*) FILTER (kind = 'books') AS books, count(*) FILTER (kind = 'DOG_EAR') AS dog_ears,
               count(*) FILTER (kind = 'ANNOTATION') AS annotations, count(*) FILTER (kind = 'REREAD_MARK') AS reread_marks,
               count(*) FILTER (kind = 'reflections') AS reflections, count(*) FILTER (kind = 'events') AS events, count(*) AS total
        FROM k GROUP BY 1)"""


@query(EXPORT + "\nSELECT * FROM x", "r_books", "r_traces", "r_reflections", "r_events")
def export_counts(spark, sf_dir):
    return reads.export_counts(archive(spark, sf_dir))


@query(EXPORT.replace(" WHERE deleted_at IS NULL", "") + "\nSELECT * FROM x", "r_books", "r_traces", "r_reflections", "r_events")
def export_counts_with_deleted(spark, sf_dir):
    return reads.export_counts(archive(spark, sf_dir), include_deleted="TRUE")


@query(EXPORT + """
SELECT u.id AS user_id, coalesce(books, 0) AS books, coalesce(dog_ears, 0) AS dog_ears, coalesce(annotations, 0) AS annotations, coalesce(reread_marks, 0) AS reread_marks,
       coalesce(reflections, 0) AS reflections, coalesce(events, 0) AS events, 'reading-archive-1998-09-02.json' AS file_name, email
FROM r_users AS u LEFT JOIN x ON x.user_id = u.id WHERE coalesce(total, 0) <= 60""", "r_books", "r_traces", "r_reflections", "r_events", "r_users")  # fmt: skip
def export_documents(spark, sf_dir):
    """What the exported documents hold, read from their JSON."""
    rows = reads.export_archive(archive(spark, sf_dir), now(), limit=60)
    names = {"books": "books", "dogEars": "dog_ears", "annotations": "annotations", "rereadMarks": "reread_marks", "reflections": "reflections", "activityEvents": "events"}
    counts = [F.json_array_length(F.get_json_object("document", f"$.{k}")).cast("bigint").alias(c) for k, c in names.items()]
    return rows.select("user_id", *counts, "file_name", F.get_json_object("document", "$.user.email").alias("email"))


@query(EXPORT + "\nSELECT user_id, total, CASE WHEN total > 60 THEN 'EXPORT_TOO_LARGE' END AS reject_code FROM x", "r_books", "r_traces", "r_reflections", "r_events")
def export_guard(spark, sf_dir):
    return reads.export_guard(archive(spark, sf_dir), limit=60)


@query(None)
def export_archive(spark, sf_dir):
    return reads.export_archive(archive(spark, sf_dir), now())


@query("\nSELECT book_id, start_page AS page_number, count(*) AS n FROM r_traces WHERE type = 'DOG_EAR' AND deleted_at IS NULL GROUP BY 1, 2 HAVING count(*) > 1", "r_traces")
def dog_ear_conflicts(spark, sf_dir):
    return audits.dog_ear_conflicts(archive(spark, sf_dir))


@query("\nSELECT book_id, completion_round, count(*) AS n FROM r_reflections WHERE deleted_at IS NULL GROUP BY 1, 2 HAVING count(*) > 1", "r_reflections")
def round_conflicts(spark, sf_dir):
    return audits.round_conflicts(archive(spark, sf_dir))


@query("""
SELECT id, book_id, type FROM r_traces WHERE deleted_at IS NULL AND book_id NOT IN (SELECT id FROM r_books WHERE deleted_at IS NULL)""", "r_traces", "r_books")  # fmt: skip
def orphan_live_traces(spark, sf_dir):
    return audits.orphan_live_traces(archive(spark, sf_dir))


@query("""
SELECT id AS asked_id, first_id AS found_id, coalesce(body, '') = coalesce(first_body, '') AS idempotent FROM (
  SELECT id, body, first_value(id) OVER w AS first_id, first_value(body) OVER w AS first_body FROM r_traces
  WHERE type = 'DOG_EAR' AND deleted_at IS NULL WINDOW w AS (PARTITION BY book_id, start_page ORDER BY created_at, id))
WHERE id <> first_id""", "r_traces")  # fmt: skip
def dog_ear_idempotency(spark, sf_dir):
    """Every live dog-ear beside the oldest on its page: the same again, or another reason."""
    ears = f.live(archive(spark, sf_dir).dog_ears)
    first = ears.groupBy("book_id", "page_number").agg(F.min_by(F.struct("id", "reason"), F.struct("created_at", "id")).alias("first"))
    pairs = ears.join(first, ["book_id", "page_number"]).where("id <> first.id")
    return pairs.select(F.col("id").alias("asked_id"), F.col("first.id").alias("found_id"), f.same_reason(F.col("reason"), F.col("first.reason")).alias("idempotent"))


@query("""
SELECT id, book_id, occurred_at, lag(occurred_at) OVER w AS previous_at, row_number() OVER w AS change_no FROM r_events
WHERE action = 'STATUS_CHANGED' AND book_id IS NOT NULL WINDOW w AS (PARTITION BY book_id ORDER BY occurred_at, id)""", "r_events")  # fmt: skip
def status_history(spark, sf_dir):
    return audits.status_history(archive(spark, sf_dir).activity_events)


@query(f"""
SELECT s.id, s.user_id, expires_at FROM r_sessions AS s JOIN r_users AS u ON u.id = s.user_id
WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '{NOW}' AND status = 'ACTIVE' AND deleted_at IS NULL""", "r_sessions", "r_users")  # fmt: skip
def session_validity(spark, sf_dir):
    return audits.valid_sessions(archive(spark, sf_dir), now())


@query("\nSELECT id, email, created_at, updated_at FROM r_users", "r_users")
def public_users(spark, sf_dir):
    return reads.public_users(archive(spark, sf_dir).users)


@query(f"""
SELECT id, TIMESTAMP '{NOW}' - deleted_at <= INTERVAL '24' HOUR AND deleted_at IS NOT NULL AS restorable FROM r_traces WHERE deleted_at IS NOT NULL""", "r_traces")  # fmt: skip
def restore_window(spark, sf_dir):
    a = archive(spark, sf_dir)
    rows = reads.tagged(a).where("deleted_at IS NOT NULL")
    return rows.select("id", rules.restore_open(F.col("deleted_at"), now()).alias("restorable"))


@query(f"\nSELECT id, TIMESTAMP '{NOW}' <= editable_until AS editable FROM r_reflections", "r_reflections")
def edit_window(spark, sf_dir):
    return archive(spark, sf_dir).completion_reflections.select("id", rules.edit_open(F.col("editable_until"), now()).alias("editable"))


# Writes over whole tables.  Requests are made from the tables themselves.


def _requests(df: DataFrame, **columns) -> DataFrame:
    """A request for each row of ``df`` (``id``, ``user_id``), named after it."""
    kinds = {
        "version": "int", "given": "array<string>", "book_id": "string", "title": "string", "author": "string", "publisher": "string",
        "publication_year": "int", "isbn": "string", "page_count": "int", "cover_url": "string", "status": "string", "reflection_id": "string",
        "mood_tags": "array<string>", "text": "string", "completed_at": "timestamp_ntz", "page_number": "int", "start_page": "int", "end_page": "int",
        "reason": "string", "content": "string",
    }
    fields = [columns.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]
    return df.select(columns.get("request_id", F.col("id")).alias("request_id"), "user_id", now().alias("at"), columns.get("id", F.col("id")).alias("id"), *fields)


def _effects(outcome: writes.Outcome, table: str, *columns: str) -> DataFrame:
    """Changed rows and refusals of a batch as one relation."""
    changed = outcome.rows[table].select("id", *columns, F.lit(None).cast("string").alias("reject_code"))
    refused = outcome.rejects.select(F.col("request_id").alias("id"), "reject_code")
    return changed.unionByName(refused, allowMissingColumns=True)


@query("""
SELECT entity_type, count(*) AS events, count(DISTINCT book_id) AS books FROM (
  SELECT 'BOOK' AS entity_type, id AS book_id FROM r_books WHERE deleted_at IS NULL AND status = 'ABANDONED'
  UNION ALL SELECT type, book_id FROM r_traces WHERE deleted_at IS NULL AND book_id IN (SELECT id FROM r_books WHERE deleted_at IS NULL AND status = 'ABANDONED')
  UNION ALL SELECT 'COMPLETION_REFLECTION', book_id FROM r_reflections WHERE deleted_at IS NULL AND book_id IN (SELECT id FROM r_books WHERE deleted_at IS NULL AND status = 'ABANDONED'))
GROUP BY 1""", "r_books", "r_traces", "r_reflections")  # fmt: skip
def cascade_delete_effects(spark, sf_dir):
    a = archive(spark, sf_dir)
    outcome = writes.delete_books(a, _requests(a.books.where("status = 'ABANDONED' AND deleted_at IS NULL")))
    return outcome.events.groupBy("entity_type").agg(F.count("*").alias("events"), F.countDistinct("book_id").alias("books"))


@query("""
SELECT id, CASE WHEN ok THEN 'READING' END AS status, CASE WHEN ok THEN 2 END AS version,
       CASE WHEN deleted_at IS NOT NULL THEN 'NOT_FOUND' WHEN NOT ok THEN 'INVALID_STATUS_TRANSITION' END AS reject_code
FROM (SELECT *, deleted_at IS NULL AND status <> 'ABANDONED' AS ok FROM r_books WHERE deleted_at IS NOT NULL OR status <> 'READING')""", "r_books")  # fmt: skip
def change_status_effects(spark, sf_dir):
    a = archive(spark, sf_dir)
    return _effects(writes.change_status(a, _requests(a.books, status=F.lit("READING"))), "books", "status", "version")


@query(f"""
SELECT b.id, CAST(coalesce(max(completion_round), 0) + 1 AS INT) AS completion_round, TIMESTAMP '{NOW}' + INTERVAL '7' DAY AS editable_until
FROM r_books AS b LEFT JOIN r_reflections AS r ON r.book_id = b.id
WHERE b.deleted_at IS NULL AND b.status IN ('READING', 'PAUSED') AND b.created_at <= TIMESTAMP '{NOW}' + INTERVAL '5' MINUTE GROUP BY 1""", "r_books", "r_reflections")  # fmt: skip
def finish_books_effects(spark, sf_dir):
    a = archive(spark, sf_dir)
    asked = _requests(a.books, status=F.lit("READ"), reflection_id=F.col("id"), mood_tags=F.array(F.lit("CALM")))
    return writes.change_status(a, asked).rows["completion_reflections"].select("id", "completion_round", "editable_until")


@query("""
SELECT b.id, CASE WHEN coalesce(m, 0) <= 45 THEN 45 END AS page_count, CASE WHEN coalesce(m, 0) <= 45 THEN 2 END AS version,
       CASE WHEN coalesce(m, 0) > 45 THEN 'PAGE_COUNT_TOO_SMALL' END AS reject_code
FROM r_books AS b LEFT JOIN (SELECT book_id, max(end_page) AS m FROM r_traces WHERE deleted_at IS NULL GROUP BY 1) AS t ON t.book_id = b.id
WHERE b.deleted_at IS NULL""", "r_books", "r_traces")  # fmt: skip
def update_books_effects(spark, sf_dir):
    a = archive(spark, sf_dir)
    asked = _requests(f.live(a.books), page_count=F.lit(45), given=F.array(F.lit("page_count")))
    return _effects(writes.update_books(a, asked), "books", "page_count", "version")


@query("""
, q AS (SELECT t.id, t.book_id, t.start_page, b.page_count, b.id IS NOT NULL AS found FROM r_traces AS t
        LEFT JOIN r_books AS b ON b.id = t.book_id AND b.deleted_at IS NULL AND b.user_id = t.user_id WHERE t.type = 'ANNOTATION'),
  e AS (SELECT DISTINCT book_id, start_page FROM r_traces WHERE type = 'DOG_EAR' AND deleted_at IS NULL),
  d AS (SELECT q.*, CASE WHEN NOT found THEN 'NOT_FOUND' WHEN start_page > page_count THEN 'VALIDATION_ERROR' WHEN e.book_id IS NOT NULL THEN 'DOG_EAR_EXISTS' END AS code
        FROM q LEFT JOIN e USING (book_id, start_page)),
  k AS (SELECT *, row_number() OVER (PARTITION BY book_id, start_page, code IS NULL ORDER BY id) AS rn FROM d)
SELECT id, CASE WHEN code IS NULL THEN start_page END AS page_number, code AS reject_code FROM k WHERE code IS NOT NULL OR rn = 1""", "r_traces", "r_books")  # fmt: skip
def create_dog_ears_effects(spark, sf_dir):
    """A second request for a page, with the same reason, is the same again and changes nothing."""
    a = archive(spark, sf_dir)
    asked = _requests(a.annotations, book_id=F.col("book_id"), page_number=F.col("start_page"), reason=F.lit("a reason of its own"))
    return _effects(writes.create_traces(a, asked, writes.DOG_EARS), "dog_ears", "page_number")


@query("""
SELECT t.id, CASE WHEN ok THEN t.start_page END AS start_page, CASE WHEN ok THEN 40 END AS end_page, CASE WHEN ok THEN 2 END AS version,
       CASE WHEN NOT ok THEN CASE WHEN found THEN 'VALIDATION_ERROR' ELSE 'NOT_FOUND' END END AS reject_code
FROM (SELECT t.*, b.id IS NOT NULL AS found, b.id IS NOT NULL AND t.start_page <= 40 AND coalesce(b.page_count, 40) >= 40 AS ok
      FROM r_traces AS t LEFT JOIN r_books AS b ON b.id = t.book_id AND b.deleted_at IS NULL WHERE t.type = 'ANNOTATION' AND t.deleted_at IS NULL) AS t""", "r_traces", "r_books")  # fmt: skip
def update_annotations_effects(spark, sf_dir):
    a = archive(spark, sf_dir)
    asked = _requests(f.live(a.annotations), end_page=F.lit(40), given=F.array(F.lit("end_page")))
    return _effects(writes.update_traces(a, asked, writes.ANNOTATIONS), "annotations", "start_page", "end_page", "version")


@query(f"""
SELECT id, CASE WHEN deleted_at IS NULL THEN TIMESTAMP '{NOW}' END AS deleted_at, CASE WHEN deleted_at IS NOT NULL THEN 'NOT_FOUND' END AS reject_code
FROM r_traces WHERE type = 'REREAD_MARK'""", "r_traces")  # fmt: skip
def delete_marks_effects(spark, sf_dir):
    a = archive(spark, sf_dir)
    return _effects(writes.delete_traces(a, _requests(a.reread_marks), writes.REREAD_MARKS), "reread_marks", "deleted_at")


@query(f"""
SELECT t.id, CASE WHEN code IS NULL THEN 2 END AS version, code AS reject_code FROM (
  SELECT t.id, CASE WHEN t.deleted_at IS NULL THEN 'NOT_FOUND' WHEN TIMESTAMP '{NOW}' - t.deleted_at > INTERVAL '24' HOUR THEN 'RESTORE_WINDOW_EXPIRED'
                    WHEN b.id IS NULL OR b.deleted_at IS NOT NULL THEN 'BOOK_DELETED' END AS code
  FROM r_traces AS t LEFT JOIN r_books AS b ON b.id = t.book_id WHERE t.type = 'ANNOTATION') AS t""", "r_traces", "r_books")  # fmt: skip
def restore_annotations_effects(spark, sf_dir):
    a = archive(spark, sf_dir)
    return _effects(writes.restore_traces(a, _requests(a.annotations), writes.ANNOTATIONS), "annotations", "version")


@query(f"""
SELECT r.id, CASE WHEN code IS NULL THEN 'SAD' END AS mood, code AS reject_code FROM (
  SELECT r.id, CASE WHEN r.deleted_at IS NOT NULL OR b.id IS NULL OR b.deleted_at IS NOT NULL THEN 'NOT_FOUND'
                    WHEN editable_until < TIMESTAMP '{NOW}' THEN 'EDIT_WINDOW_EXPIRED' END AS code
  FROM r_reflections AS r LEFT JOIN r_books AS b ON b.id = r.book_id) AS r""", "r_reflections", "r_books")  # fmt: skip
def update_reflections_effects(spark, sf_dir):
    a = archive(spark, sf_dir)
    asked = _requests(a.completion_reflections, mood_tags=F.array(F.lit("SAD"), F.lit("SAD")), given=F.array(F.lit("mood_tags")))
    return _effects(writes.update_reflections(a, asked), "completion_reflections", "mood_tags").withColumn("mood", F.array_join("mood_tags", ",")).drop("mood_tags")


@query(f"""
, d AS (SELECT r.*, b.status, b.id IS NOT NULL AND r.deleted_at IS NULL AND editable_until >= TIMESTAMP '{NOW}' AS ok
        FROM r_reflections AS r LEFT JOIN r_books AS b ON b.id = r.book_id AND b.deleted_at IS NULL),
  l AS (SELECT book_id, max(completion_round) AS latest FROM d WHERE deleted_at IS NULL AND NOT ok GROUP BY 1)
SELECT book_id AS id, 'READING' AS status FROM d LEFT JOIN l USING (book_id) WHERE ok AND status = 'READ'
GROUP BY book_id HAVING max(completion_round) > max(coalesce(latest, 0))""", "r_reflections", "r_books")  # fmt: skip
def delete_reflections_effects(spark, sf_dir):
    a = archive(spark, sf_dir)
    return writes.delete_reflections(a, _requests(a.completion_reflections)).rows["books"].select("id", "status")


@query(f"""
, c AS (SELECT r.id, r.book_id, completion_round, b.id AS b, b.deleted_at AS gone, status, r.deleted_at, editable_until,
               coalesce(max(CASE WHEN r.deleted_at IS NULL THEN completion_round END) OVER (PARTITION BY r.book_id), 0) AS latest
        FROM r_reflections AS r LEFT JOIN r_books AS b ON b.id = r.book_id),
  d AS (SELECT id, book_id, CASE WHEN deleted_at IS NULL THEN 'NOT_FOUND' WHEN editable_until < TIMESTAMP '{NOW}' THEN 'EDIT_WINDOW_EXPIRED'
               WHEN b IS NULL OR gone IS NOT NULL THEN 'BOOK_DELETED' WHEN status <> 'READING' OR latest > completion_round THEN 'RESTORE_CONFLICT' END AS code FROM c),
  k AS (SELECT *, row_number() OVER (PARTITION BY book_id, code IS NULL ORDER BY id) AS rn FROM d)
SELECT id, CASE WHEN code IS NULL AND rn = 1 THEN 2 END AS version, CASE WHEN code IS NULL AND rn > 1 THEN 'RESTORE_CONFLICT' ELSE code END AS reject_code FROM k""", "r_reflections", "r_books")  # fmt: skip
def restore_reflections_effects(spark, sf_dir):
    a = archive(spark, sf_dir)
    # Live reflections are asked about too, and count as the book's live rounds all the same.
    asked = _requests(a.completion_reflections)
    return _effects(writes.restore_reflections(a, asked), "completion_reflections", "version")


@query("""
SELECT entity_type, coalesce(CASE entity_type WHEN 'BOOK' THEN '书目' WHEN 'DOG_EAR' THEN '折角' WHEN 'ANNOTATION' THEN '批注' WHEN 'REREAD_MARK' THEN '重读页' ELSE '完成感受' END) AS entity_label,
       CASE action WHEN 'CREATED' THEN '创建' WHEN 'UPDATED' THEN '修改' WHEN 'DELETED' THEN '删除' WHEN 'RESTORED' THEN '恢复' ELSE '状态变化' END AS action_label,
       strftime(occurred_at + INTERVAL '8' HOUR, '%Y/%m/%d') AS local_day, count(*) AS n FROM r_events GROUP BY 1, 2, 3, 4""", "r_events")  # fmt: skip
def activity_by_local_day(spark, sf_dir):
    events = archive(spark, sf_dir).activity_events
    shown = [labels.label(labels.ENTITIES, F.col("entity_type")).alias("entity_label"), labels.label(labels.ACTIONS, F.col("action")).alias("action_label")]
    day = labels.local_date(F.col("occurred_at").cast("timestamp"), "Asia/Shanghai").alias("local_day")
    return events.select("entity_type", *shown, day).groupBy("entity_type", "entity_label", "action_label", "local_day").agg(F.count("*").alias("n"))


@query(f"""
SELECT s.id, CASE WHEN expires_at - TIMESTAMP '{NOW}' < INTERVAL '29' DAY THEN TIMESTAMP '{NOW}' + INTERVAL '30' DAY ELSE expires_at END AS expires_at
FROM r_sessions AS s WHERE revoked_at IS NULL AND expires_at > TIMESTAMP '{NOW}'""", "r_sessions")  # fmt: skip
def rolled_sessions(spark, sf_dir):
    a = archive(spark, sf_dir)
    sessions = a.sessions.withColumn("token_hash", F.col("id"))
    a = type(a)(**{**vars(a), "sessions": sessions})
    return writes.rolled_sessions(a, sessions.select("token_hash", now().alias("at"))).select("id", "expires_at")


@query(f"""
SELECT id, CASE WHEN deleted THEN NULL ELSE 'DELETED' END AS status, CASE WHEN deleted THEN 'UNAUTHENTICATED' END AS reject_code
FROM (SELECT id, status = 'DELETED' AS deleted FROM r_users)""", "r_users")  # fmt: skip
def delete_account_effects(spark, sf_dir):
    a = archive(spark, sf_dir)
    return _effects(writes.delete_accounts(a, _requests(a.users.withColumn("user_id", F.col("id")))), "users", "status")


@query("""
SELECT window_start, user_id, count(*) AS n FROM (SELECT time_bucket(INTERVAL '15' MINUTE, occurred_at, TIMESTAMP '1970-01-01') AS window_start, entity_id AS user_id FROM r_events)
GROUP BY 1, 2 HAVING count(*) > 1""", "r_events")  # fmt: skip
def rate_limit_windows(spark, sf_dir):
    requests = archive(spark, sf_dir).activity_events.select(F.col("entity_id").alias("user_id"), F.col("occurred_at").alias("at"))
    return log.over_limit(requests, ["user_id"], (1, "15 minutes")).select(F.col("window.start").alias("window_start"), "user_id", "n")
