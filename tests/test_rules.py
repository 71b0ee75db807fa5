"""Boundary rows of each rule."""

import datetime as dt
import unicodedata

import pytest
from pyspark.sql import functions as F

from foliant.functions import labels, rules
from foliant.functions import text as tx
from foliant.operators import filters
from foliant.operators.paging import page_arguments, page_of

NOW = dt.datetime(2026, 9, 24, 12)


def values(spark, column, schema, rows):
    names = [c.split()[0] for c in schema.split(", ")]
    frame = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in frame.select(column(*map(F.col, names))).collect()]


@pytest.mark.parametrize(
    "current, new, code",
    [
        ("READING", "READ", None), ("READ", "READING", None), ("TO_READ", "READ", "INVALID_STATUS_TRANSITION"),
        ("ABANDONED", "READING", "INVALID_STATUS_TRANSITION"), ("READ", "READ", "STATUS_UNCHANGED"), ("PAUSED", "PAUSED", None),
    ],
)
def test_transitions(spark, current, new, code):
    assert values(spark, rules.transition_reject, "a string, b string", [(current, new)]) == [code]


def test_pages(spark):
    rows = [(42, 44, 300), (44, 42, 300), (42, 301, 300), (42, 301, None), (0, 1, 300), (300, 300, 300), (None, 3, 9)]
    assert values(spark, rules.page_range_valid, "a int, b int, c int", rows) == [True, False, False, True, False, True, False]
    assert values(spark, rules.page_valid, "a int, c int", [(1, None), (301, 300), (0, 300), (None, 3)]) == [True, False, False, False]


def test_tags(spark):
    rows = [(["MOVED", "MOVED", "CALM"],), ([],), (["SAD", "CALM", "MOVED", "EMPTY"],), (["GLAD"],), (None,)]
    assert values(spark, rules.mood_tags_valid, "t array<string>", rows) == [True, False, False, False, False]
    assert values(spark, rules.mood_tags, "t array<string>", rows[:1]) == [["MOVED", "CALM"]]
    clicks = [(["SAD"], "CALM"), (["SAD", "CALM"], "SAD"), (["SAD", "CALM", "MOVED"], "EMPTY")]
    assert values(spark, rules.toggle_tag, "t array<string>, x string", clicks) == [["SAD", "CALM"], ["CALM"], ["SAD", "CALM", "MOVED"]]


def test_windows(spark):
    ms, day = dt.timedelta(milliseconds=1), dt.timedelta(days=1)
    deleted = [(NOW - day / 2, NOW), (NOW - 2 * day, NOW), (NOW - day, NOW), (NOW - day - ms, NOW), (None, NOW)]
    assert values(spark, rules.restore_open, "a timestamp, b timestamp", deleted) == [True, False, True, False, False]
    until = [(NOW + day / 2, NOW), (NOW - day, NOW), (NOW, NOW), (NOW - ms, NOW)]
    assert values(spark, rules.edit_open, "a timestamp, b timestamp", until) == [True, False, True, False]
    done = [(NOW, NOW - day, NOW), (NOW - 2 * day, NOW - day, NOW), (NOW + dt.timedelta(minutes=5), NOW, NOW), (NOW + dt.timedelta(minutes=5) + ms, NOW, NOW)]
    assert values(spark, rules.completed_at_valid, "a timestamp, b timestamp, c timestamp", done) == [True, False, True, False]
    sessions = [(None, NOW + ms, "ACTIVE", None, NOW), (None, NOW, "ACTIVE", None, NOW), (NOW, NOW + day, "ACTIVE", None, NOW), (None, NOW + day, "DELETED", None, NOW)]
    assert values(spark, rules.session_valid, "a timestamp, b timestamp, c string, d timestamp, e timestamp", sessions) == [True, False, False, False]
    rolled = [(NOW + 29 * day, NOW), (NOW + 29 * day - ms, NOW)]
    assert values(spark, rules.session_extension, "a timestamp, b timestamp", rolled) == [NOW + 29 * day, NOW + 30 * day]


def test_texts(spark):
    cases = ["  一段\n  文字  ", "　padded ", "été", "", None, "﻿x "]
    want = [None if c is None else unicodedata.normalize("NFC", c).strip(" \t\n\r\x0b\x0c 　﻿ ") for c in cases]
    assert values(spark, tx.normalise, "t string", cases) == want
    assert values(spark, lambda t: tx.short_text(t, 20), "t string", cases[:1]) == ["一段 文字"]
    assert values(spark, lambda t: tx.short_text(t, 4), "t string", ["123456", "1234"]) == ["1234…", "1234"]
    assert values(spark, tx.units, "t string", ["a😀b", ""]) == [4, 0]
    long = "a" * 119 + "😀tail"
    assert values(spark, tx.event_summary, "t string", [long, None, "b" * 200]) == ["a" * 119, "", "b" * 120]
    assert values(spark, tx.normalise_email, "t string", [" A@B.Org "]) == ["a@b.org"]
    isbn = ["0306406152", "9780306406157", "030640615X", "080442957X", "9780306406158", "x", None]
    assert values(spark, tx.isbn_valid, "t string", isbn) == [True, True, False, True, False, False, None]
    assert values(spark, tx.url_valid, "t string", ["https://a.org/x", "HTTP://b", "ftp://c", "https://", None]) == [True, True, False, False, False]
    assert values(spark, tx.uuid_valid, "t string", ["7f9c24e8-3b12-4fef-91e0-5d2c7a1b6f00", "7f9c24e8", None]) == [True, False, False]
    assert values(spark, tx.token_hash, "t string", ["a"])[0].startswith("ca978112ca1bbdca")


def test_bounds_and_dates(spark):
    assert values(spark, lambda t: rules.within("title", t), "t string", ["", "x", "x" * 301, None]) == [False, True, False, True]
    assert values(spark, rules.page_count_valid, "n int", [0, 1, 100_000, 100_001, None]) == [False, True, True, False, True]
    assert values(spark, rules.year_valid, "y int, n timestamp", [(999, NOW), (1000, NOW), (2026, NOW), (2027, NOW)]) == [False, True, True, False]
    dates = ["2026-01-02T03:04:05Z", "", None, "soon"]
    assert values(spark, rules.optional_date_reject, "t string", dates) == [None, None, None, "VALIDATION_ERROR"]
    assert values(spark, rules.optional_date, "t string", dates)[0] == dt.datetime(2026, 1, 2, 3, 4, 5)


def test_labels(spark):
    assert values(spark, lambda s: labels.label(labels.STATUSES, s), "s string", ["READ", "other"]) == ["已读完", "other"]
    assert values(spark, labels.trace_range, "a int, b int", [(3, 3), (3, 5)]) == ["第 3 页", "第 3–5 页"]
    assert values(spark, labels.trace_body, "k string, b string", [("DOG_EAR", ""), ("DOG_EAR", None), ("ANNOTATION", "")]) == ["未填写原因", "未填写原因", ""]
    at = [dt.datetime(2026, 1, 1, 20), None]
    assert values(spark, lambda t: labels.local_date(t, "Asia/Shanghai"), "t timestamp", at) == ["2026/01/02", "未设置"]
    assert values(spark, lambda t: labels.local_time(t, "Asia/Shanghai"), "t timestamp", at) == ["2026/01/02 04:00", "尚未记录"]
    days = spark.createDataFrame([(dt.date(2026, 1, 2),)], "d date").select(*labels.local_day(F.col("d"), "Asia/Shanghai")).first()
    assert days[0] == dt.datetime(2026, 1, 1, 16) and days[1] == dt.datetime(2026, 1, 2, 15, 59, 59, 999000)


def test_paging(spark):
    assert page_arguments() == page_arguments("x", 0) == page_arguments(-1, None) == (1, 20)
    assert page_arguments("3", 500) == (3, 100)
    df = spark.createDataFrame([(u, i) for u in "ab" for i in range(5)], "u string, i int")
    assert sorted(page_of(df, [F.asc("i")], 2, 2, per="u").collect()) == [("a", 2), ("a", 3), ("b", 2), ("b", 3)]
    assert [r.i for r in page_of(df.where("u = 'a'"), [F.desc("i")], 3, 2).collect()] == [0]


def test_filters(spark):
    df = spark.createDataFrame([("100% Wool", None), ("other", "W_ol"), ("x", "woOl")], "title string, author string")
    assert {r.title for r in filters.contains(df, "wool", "title", "author").collect()} == {"100% Wool", "x"}
    assert filters.contains(df, "%", "title").count() == 1 and filters.contains(df, "_", "author").count() == 1
    with pytest.raises(ValueError, match="VALIDATION_ERROR"):
        filters.status_filter(df, "LOST")
