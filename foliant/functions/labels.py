"""Names shown for values, and the texts made of traces and event payloads."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts shown to readers.
MOODS = {"MOVED": "被触动", "CALM": "平静", "JOYFUL": "喜悦", "SAD": "难过", "ANGRY": "愤怒", "CONFUSED": "困惑", "RELIEVED": "释然", "EMPTY": "空落", "CHANGED": "被改变"}
STATUSES = {"TO_READ": "想读", "READING": "阅读中", "READ": "已读完", "PAUSED": "暂时搁置", "ABANDONED": "停止阅读"}
TRACES = {"DOG_EAR": "折角", "ANNOTATION": "批注", "REREAD_MARK": "重读页"}
ACTIONS = {"CREATED": "创建", "UPDATED": "修改", "DELETED": "删除", "RESTORED": "恢复", "STATUS_CHANGED": "状态变化", "COMPLETED": "读完"}
ENTITIES = {"BOOK": "书目", **TRACES, "COMPLETION_REFLECTION": "完成感受"}
DELETED_BOOK, NO_REASON, WITH_BOOK = "已删除书目", "未填写原因", "随书目删除"
NO_DATE, NO_TIME = "未设置", "尚未记录"


def label(names: dict[str, str], value: Column) -> Column:
    """The name of a value, or the value where it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*map(F.lit, chain(*names.items()))), value), value)


def one_page(page: Column) -> Column:
    return F.concat(F.lit("第 "), page.cast("string"), F.lit(" 页"))


def page_span(start: Column, end: Column) -> Column:
    return F.concat(F.lit("第 "), start.cast("string"), F.lit("–"), end.cast("string"), F.lit(" 页"))


def trace_range(start: Column, end: Column) -> Column:
    return F.when(start == end, one_page(start)).otherwise(page_span(start, end))


def trace_body(kind: Column, body: Column) -> Column:
    """An annotation's text, or a reason with a stand-in where it is null or empty."""
    return F.when(kind == "ANNOTATION", body).otherwise(F.coalesce(F.nullif(body, F.lit("")), F.lit(NO_REASON)))


def _number(payload: Column, key: str) -> Column:
    """A key's value if it is a JSON number."""
    raw = F.get_json_object(payload, f"$.{key}")
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant"))
    return F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), raw)


def _string(payload: Column, key: str) -> Column:
    value = F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "string"))


def _common(payload: Column) -> Column:
    page, start, end = (_number(payload, k) for k in ("pageNumber", "startPage", "endPage"))
    tags = F.try_variant_get(F.try_parse_json(payload), "$.moodTags", "array<string>")
    moods = F.array_join(F.transform(tags, lambda t: label(MOODS, t)), "、")
    return F.coalesce(F.when(page.isNotNull(), one_page(page)), F.when(start.isNotNull(), page_span(start, F.coalesce(end, start))), moods)


def timeline_summary(payload: Column) -> Column:
    """Page, else range, else moods, else status change, else summary, else nothing."""
    before, after = _string(payload, "previousStatus"), _string(payload, "nextStatus")
    change = F.when(before.isNotNull() & after.isNotNull(), F.concat(before, F.lit(" → "), after))
    return F.coalesce(_common(payload), change, _string(payload, "summary"), F.lit(""))


def detail_summary(payload: Column) -> Column:
    """Page, else range, else moods, else a note that the row went with its book, else nothing."""
    cascade = F.coalesce(F.try_variant_get(F.try_parse_json(payload), "$.cascade", "boolean"), F.lit(False))
    return F.coalesce(_common(payload), F.when(cascade, F.lit(WITH_BOOK)), F.lit(""))


def local_date(at: Column, zone: str) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), "yyyy/MM/dd"), F.lit(NO_DATE))


def local_time(at: Column, zone: str) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), "yyyy/MM/dd HH:mm"), F.lit(NO_TIME))


def local_day(day: Column, zone: str) -> tuple[Column, Column]:
    """First and last millisecond of a local day, as instants."""
    start = F.to_utc_timestamp(day.cast("timestamp"), zone)
    after = F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)
    return start, after - F.expr("INTERVAL '0.001' SECOND")


def file_date(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")
