"""Queries that run single rules over columns of whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import labels, rules
from .functions import text as tx
from .queries import archive, query
from .sources.fixtures import view

#: A number for each book, in both engines.
KEY = "CAST(id AS BIGINT)"


def _books(spark, sf_dir, **columns):
    """``id`` and inputs of a rule, written as SQL that both engines run, for every book."""
    return view(spark, sf_dir, "r_books").selectExpr("id", *(f"{e} AS {c}" for c, e in columns.items()))


def _sql(result: str, inputs: dict[str, str], more: str = "") -> str:
    own = ", ".join(f"{e} AS {c}" for c, e in inputs.items())
    return f"\n, q AS (SELECT id, {own} FROM r_books){more} SELECT id, {result} FROM q"


def rule(name: str, result: str, inputs: dict[str, str], check) -> None:
    """Register ``check`` over the inputs of every book as ``result``, an SQL expression with its alias."""

    def make(spark, sf_dir):
        rows = _books(spark, sf_dir, **inputs)
        return rows.select("id", check(*(F.col(c) for c in inputs)).alias(result.rsplit(" AS ", 1)[1]))

    make.__name__ = name
    query(_sql(result, inputs), "r_books")(make)


STATUSES = ["TO_READ", "READING", "READ", "PAUSED", "ABANDONED"]
NEXT = "CASE CAST(floor(CAST(id AS BIGINT) / 5) AS BIGINT) % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATUSES)) + " END"
rule("status_transition_check", """CASE WHEN a = b THEN CASE WHEN a = 'READ' THEN 'STATUS_UNCHANGED' END
 WHEN (a, b) IN (('TO_READ','READING'),('TO_READ','ABANDONED'),('READING','PAUSED'),('READING','READ'),('READING','ABANDONED'),
 ('PAUSED','READING'),('PAUSED','READ'),('PAUSED','ABANDONED'),('READ','READING')) THEN NULL ELSE 'INVALID_STATUS_TRANSITION' END AS reject_code""",
     {"a": "status", "b": NEXT}, rules.transition_reject)

TAG = "CASE CAST(floor({} / {}) AS BIGINT) % 5 WHEN 0 THEN 'MOVED' WHEN 1 THEN 'CALM' WHEN 2 THEN 'SAD' WHEN 3 THEN 'EMPTY' ELSE 'GLAD' END"
TAGS = {f"t{i}": TAG.format(KEY, 5**i) for i in range(4)}
DISTINCT = "concat_ws(',', t0, CASE WHEN t1 <> t0 THEN t1 END, CASE WHEN t2 NOT IN (t0, t1) THEN t2 END, CASE WHEN t3 NOT IN (t0, t1, t2) THEN t3 END)"
rule("mood_tags_distinct", f"{DISTINCT} AS tags", TAGS, lambda *t: F.array_join(rules.mood_tags(F.array(*t)), ","))
rule("mood_tag_check", f"length({DISTINCT}) - length(replace({DISTINCT}, ',', '')) <= 2 AND 'GLAD' NOT IN (t0, t1, t2, t3) AS valid", TAGS, lambda *t: rules.mood_tags_valid(F.array(*t)))
rule("mood_toggle_check", "CASE WHEN t1 = t0 THEN '' ELSE concat(t0, ',', t1) END AS tags", {"t0": TAGS["t0"], "t1": TAGS["t1"]}, lambda a, b: F.array_join(rules.toggle_tag(F.array(a), b), ","))

# Ten digits with a check character, right for about one in eleven; dashes and a small x are cleaned away.
ISBN = "concat(substring(lpad(id, 9, '0'), 1, 3), '-', substring(lpad(id, 9, '0'), 4, 6), CASE WHEN CAST(id AS BIGINT) % 11 = 10 THEN 'x' ELSE CAST(CAST(id AS BIGINT) % 11 AS STRING) END)"
DIGITS = " + ".join(f"{10 - i} * CAST(substring(lpad(id, 9, '0'), {i + 1}, 1) AS INT)" for i in range(9))
rule("isbn_clean", "upper(replace(given, '-', '')) AS cleaned", {"given": ISBN}, tx.clean_isbn)
rule("isbn_check", f"({DIGITS} + CAST(id AS BIGINT) % 11) % 11 = 0 AS valid", {"given": ISBN}, lambda t: tx.isbn_valid(tx.clean_isbn(t)))
EAN = "concat('978', lpad(id, 9, '0'), CAST(CAST(id AS BIGINT) % 10 AS STRING))"
EAN_SUM = " + ".join(f"{1 + 2 * ((i + 3) % 2)} * CAST(substring(lpad(id, 9, '0'), {i + 1}, 1) AS INT)" for i in range(9))
rule("isbn13_check", f"(38 + {EAN_SUM} + CAST(id AS BIGINT) % 10) % 10 = 0 AS valid", {"given": EAN}, tx.isbn_valid)

PADDED = "concat(' 　', replace(title, ' ', '  '), '  ', CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'é' ELSE '' END, '\t')"
TRIMMED = "nfc_normalize(regexp_replace(t, '^[\\s　 ]+|[\\s　 ]+$', '', 'g'))"
rule("text_normalise", f"{TRIMMED} AS normalised", {"t": PADDED}, tx.normalise)
rule("short_text", "CASE WHEN length(trim(regexp_replace(t, '[\\s　 ]+', ' ', 'g'))) > 12 THEN concat(trim(regexp_replace(t, '[\\s　 ]+', ' ', 'g'))[:12], '…') ELSE trim(regexp_replace(t, '[\\s　 ]+', ' ', 'g')) END AS short", {"t": PADDED}, lambda t: tx.short_text(t, 12))
rule("event_summary_check", "coalesce(trim(t)[:120], '') AS summary", {"t": f"CASE WHEN {KEY} % 7 = 0 THEN NULL ELSE concat(' ', repeat(title, CAST({KEY} % 11 AS INT))) END"}, tx.event_summary)
rule("empty_to_null_check", "CASE WHEN t <> '' THEN t END AS result", {"t": f"CASE {KEY} % 3 WHEN 0 THEN '' WHEN 1 THEN title END"}, tx.empty_to_null)
rule("title_bounds_check", "t IS NULL OR length(t) BETWEEN 1 AND 300 AS valid", {"t": f"CASE WHEN {KEY} % 5 = 0 THEN author ELSE repeat('x', CAST({KEY} % 400 AS INT)) END"}, lambda t: rules.within("title", t))
rule("content_bounds_check", "length(t) BETWEEN 1 AND 5000 AS valid", {"t": f"repeat('x', CAST({KEY} % 7000 AS INT))"}, lambda t: rules.within("content", t))
rule("reason_bounds_check", "length(t) <= 500 AS valid", {"t": f"repeat('x', CAST({KEY} % 700 AS INT))"}, lambda t: rules.within("dog_ear_reason", t))
rule("uuid_check", "coalesce(regexp_full_match(t, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-8][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}'), false) AS valid",
     {"t": f"CASE WHEN {KEY} % 9 = 0 THEN NULL ELSE concat(lpad(id, 8, 'A'), '-3b12-', CAST({KEY} % 10 AS STRING), 'fef-', CAST({KEY} % 10 AS STRING), '1e0-5d2c7a1b6f00', CASE WHEN {KEY} % 4 = 0 THEN '0' ELSE '' END) END"}, tx.uuid_valid)
rule("url_check", "coalesce(regexp_matches(t, '^[hH][tT][tT][pP][sS]?://[^\\s/?#]'), false) AS valid",
     {"t": f"CASE {KEY} % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('https://covers.example.org/', id) WHEN 2 THEN concat('HTTP://', id) WHEN 3 THEN concat('ftp://', id) ELSE concat('http:///', id) END"}, tx.url_valid)
rule("normalise_email_check", "lower(trim(t)) AS email", {"t": "concat(' ', upper(replace(title, ' ', '.')), '@Example.ORG ')"}, tx.normalise_email)
rule("token_hash_check", "sha256(t) AS result", {"t": "concat('token-', id)"}, tx.token_hash)
rule("year_check", "y IS NULL OR y BETWEEN 1000 AND 1998 AS valid", {"y": f"CASE WHEN {KEY} % 6 = 0 THEN NULL ELSE CAST(900 + {KEY} % 1300 AS INT) END"}, lambda y: rules.year_valid(y, F.lit("1998-09-02 12:00:00").cast("timestamp_ntz")))
rule("page_count_check", "n IS NULL OR n BETWEEN 1 AND 100000 AS valid", {"n": f"CASE WHEN {KEY} % 6 = 0 THEN NULL ELSE CAST({KEY} % 7 * 20000 AS INT) END"}, rules.page_count_valid)
rule("optional_date_check", "CASE WHEN t = 'soon' THEN 'VALIDATION_ERROR' END AS reject_code", {"t": f"CASE {KEY} % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'soon' ELSE concat('2026-01-', lpad(CAST(1 + {KEY} % 28 AS STRING), 2, '0')) END"}, rules.optional_date_reject)
rule("file_date_check", "strftime(moment, '%Y-%m-%d') AS day", {"moment": "updated_at"}, labels.file_date)


@query("""
SELECT t.id, start_page >= 1 AND start_page <= end_page AND (page_count IS NULL OR end_page <= page_count) AS valid
FROM r_traces AS t JOIN r_books AS b ON b.id = t.book_id""", "r_traces", "r_books")  # fmt: skip
def page_range_check(spark, sf_dir):
    rows = view(spark, sf_dir, "r_traces").join(view(spark, sf_dir, "r_books").selectExpr("id AS book_id", "page_count"), "book_id")
    return rows.select("id", rules.page_range_valid(F.col("start_page"), F.col("end_page"), F.col("page_count")).alias("valid"))


#: A payload for every trace: of one page, of two, of a cascade, with a text, or of a status change.
PAYLOAD = """CASE start_page % 6 WHEN 0 THEN concat('{{"pageNumber": ', start_page, '}}') WHEN 1 THEN concat('{{"startPage": ', start_page, ', "endPage": ', end_page, '}}')
 WHEN 2 THEN '{{"cascade": true}}' WHEN 3 THEN concat('{{"summary": "s', start_page, '", "completionRound": 2}}') WHEN 4 THEN '{{}}'
 ELSE '{{"previousStatus": "READING", "nextStatus": "READ"}}' END""".replace("{{", "{").replace("}}", "}")
SUMMARY = """
SELECT id, CASE start_page % 6 WHEN 0 THEN concat('第 ', start_page, ' 页') WHEN 1 THEN concat('第 ', start_page, '–', end_page, ' 页')
 WHEN 2 THEN '{}' WHEN 3 THEN {} WHEN 4 THEN '' ELSE '{}' END AS summary FROM r_traces"""


def _payloads(spark, sf_dir, shown):
    return view(spark, sf_dir, "r_traces").selectExpr("id", f"{PAYLOAD} AS payload").select("id", shown(F.col("payload")).alias("summary"))


@query(SUMMARY.format("", "concat('s', start_page)", "READING → READ"), "r_traces")
def timeline_payload_summary_page(spark, sf_dir):
    return _payloads(spark, sf_dir, labels.timeline_summary)


@query(SUMMARY.format("随书目删除", "''", ""), "r_traces")
def timeline_payload_summary_detail(spark, sf_dir):
    return _payloads(spark, sf_dir, labels.detail_summary)


@query("""
SELECT id, strftime(occurred_at + INTERVAL '8' HOUR, '%Y/%m/%d %H:%M') AS shown,
       CAST(CAST(occurred_at AS DATE) AS TIMESTAMP) - INTERVAL '8' HOUR AS day_start,
       CAST(CAST(occurred_at AS DATE) AS TIMESTAMP) + INTERVAL '16' HOUR - INTERVAL '1' MILLISECOND AS day_end FROM r_events""", "r_events")  # fmt: skip
def local_times(spark, sf_dir):
    """Local time of each event, and the instants between which its date is a day in Shanghai."""
    events = archive(spark, sf_dir).activity_events
    start, end = labels.local_day(F.col("occurred_at").cast("date"), "Asia/Shanghai")
    shown = labels.local_time(F.col("occurred_at").cast("timestamp"), "Asia/Shanghai").alias("shown")
    return events.select("id", shown, start.cast("timestamp_ntz").alias("day_start"), end.cast("timestamp_ntz").alias("day_end"))
