"""Write transforms on hand-written states."""

import datetime as dt
import json
from dataclasses import fields

import pytest

from foliant.model import SCHEMAS, Archive
from foliant.plans import audits, reads, writes

NOW = dt.datetime(2026, 9, 24, 12)
DAY = dt.timedelta(days=1)
OLD = NOW - 30 * DAY
U = "00000000-0000-4000-8000-%012d"


def frame(spark, table, rows):
    names = [c.strip().split()[0] for c in SCHEMAS[table].split(", ")]
    base = {"version": 1, "created_at": OLD, "updated_at": OLD, "user_id": "u"}
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], SCHEMAS[table])


@pytest.fixture(scope="module")
def archive(spark):
    tables = {
        "users": [{"id": "u", "email": "u@x.org", "status": "ACTIVE"}],
        "sessions": [{"id": "s", "token_hash": "h", "expires_at": NOW + DAY}, {"id": "r", "token_hash": "g", "expires_at": NOW + DAY, "revoked_at": OLD}],
        "books": [
            {"id": "b", "title": "B", "page_count": 300, "status": "READING"}, {"id": "done", "title": "D", "status": "READ"},
            {"id": "gone", "title": "G", "status": "READING", "deleted_at": NOW - DAY}, {"id": "other", "user_id": "v", "title": "O", "status": "READING"},
        ],
        "dog_ears": [
            {"id": "d1", "book_id": "b", "page_number": 42, "reason": "why"}, {"id": "d2", "book_id": "b", "page_number": 43},
            {"id": "d3", "book_id": "b", "page_number": 42, "deleted_at": NOW - DAY}, {"id": "d4", "book_id": "b", "page_number": 50, "deleted_at": NOW - DAY},
            {"id": "d5", "book_id": "b", "page_number": 51, "deleted_at": NOW - DAY - dt.timedelta(milliseconds=1)},
            {"id": "d6", "book_id": "gone", "page_number": 5, "deleted_at": NOW - DAY},
        ],
        "annotations": [{"id": "a1", "book_id": "b", "start_page": 10, "end_page": 60, "content": "note"}],
        "reread_marks": [{"id": "m1", "book_id": "b", "page_number": 42, "reason": None}],
        "completion_reflections": [
            {"id": "c1", "book_id": "done", "completion_round": 1, "mood_tags": ["CALM"], "completed_at": OLD, "editable_until": NOW},
            {"id": "c2", "book_id": "b", "completion_round": 4, "mood_tags": ["SAD"], "completed_at": OLD, "editable_until": NOW + DAY, "deleted_at": NOW - 3 * DAY},
            {"id": "c3", "book_id": "b", "completion_round": 2, "mood_tags": ["SAD"], "completed_at": OLD, "editable_until": NOW - DAY},
        ],
        "activity_events": [],
    }
    return Archive(**{f.name: frame(spark, f.name, tables[f.name]) for f in fields(Archive)})


REQUEST = (
    "request_id string, user_id string, at timestamp, id string, version int, given array<string>, book_id string, title string, author string, publisher string, "
    "publication_year int, isbn string, page_count int, cover_url string, status string, reflection_id string, mood_tags array<string>, text string, "
    "completed_at timestamp, page_number int, start_page int, end_page int, reason string, content string, email string"
)


def run(spark, archive, write, rows, *args):
    names = [c.split()[0] for c in REQUEST.split(", ")]
    full = [{"user_id": "u", "at": NOW, "request_id": f"q{i}", **r} for i, r in enumerate(rows)]
    outcome = write(archive, spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], REQUEST), *args)
    events = sorted((r.entity_type, r.action, r.entity_id, r.payload_json) for r in outcome.events.collect())
    return outcome, events, {r.request_id: r.reject_code for r in outcome.rejects.collect()}


def test_create_books(spark, archive):
    rows = [
        {"id": U % 1, "title": "  Tea　", "isbn": "0-306-40615-2", "author": ""}, {"id": U % 2, "title": " "}, {"id": U % 3, "title": "x", "status": "READ"},
        {"id": U % 4, "title": "x", "isbn": "030640615X"}, {"id": U % 5, "title": "x", "cover_url": "ftp://x"}, {"id": "short", "title": "x"}, {"id": U % 6, "title": "y", "page_count": 0},
    ]
    outcome, events, rejects = run(spark, archive, writes.create_books, rows)
    (book,) = outcome.rows["books"].collect()
    assert (book.title, book.isbn, book.author, book.status, book.version) == ("Tea", "0306406152", None, "TO_READ", 1)
    assert rejects == {f"q{i}": "VALIDATION_ERROR" for i in range(1, 7)}
    assert events == [("BOOK", "CREATED", U % 1, '{"bookTitle":"Tea","status":"TO_READ"}')]


def test_update_books(spark, archive):
    rows = [
        {"id": "b", "given": ["page_count"], "page_count": 59}, {"id": "b", "given": ["page_count"], "page_count": 60, "version": 1},
        {"id": "b", "given": ["title"], "title": "late"}, {"id": "b", "given": ["title"], "title": "x", "version": 7}, {"id": "gone", "given": ["title"], "title": "x"},
        {"id": "other", "given": ["title"], "title": "x"}, {"id": "done", "given": []}, {"id": "done", "given": ["status"], "status": "READING"},
    ]
    outcome, events, rejects = run(spark, archive, writes.update_books, rows)
    (book,) = outcome.rows["books"].collect()
    assert (book.id, book.page_count, book.version, book.updated_at, book.title) == ("b", 60, 3, NOW, "late")
    assert rejects == {"q0": "PAGE_COUNT_TOO_SMALL", "q3": "STALE_WRITE", "q4": "NOT_FOUND", "q5": "NOT_FOUND", "q7": "VALIDATION_ERROR"}
    assert events == [("BOOK", "UPDATED", "b", f'{{"bookTitle":"{t}","previousStatus":"READING"}}') for t in ("B", "late")]


def test_requests_for_one_row_take_effect_in_turn(spark, archive):
    rows = [{"id": U % 1, "title": "one"}, {"id": U % 1, "title": "two"}, {"id": U % 2, "title": " "}, {"id": U % 2, "title": "three"}]
    outcome, events, rejects = run(spark, archive, writes.create_books, rows)
    assert sorted(r.title for r in outcome.rows["books"].collect()) == ["one", "three"] and len(events) == 2
    assert rejects == {"q1": "DUPLICATE_RESOURCE", "q2": "VALIDATION_ERROR"}
    rows = [{"id": "b", "status": "PAUSED"}, {"id": "b", "status": "ABANDONED", "version": 2}, {"id": "b", "status": "READING"}]
    outcome, events, rejects = run(spark, archive, writes.change_status, rows)
    (book,) = outcome.rows["books"].collect()
    assert (book.status, book.version, rejects) == ("ABANDONED", 3, {"q2": "INVALID_STATUS_TRANSITION"})
    assert [json.loads(e[3])["previousStatus"] for e in events] == ["PAUSED", "READING"]


def test_finish_a_book(spark, archive):
    rows = [{"id": "b", "status": "READ", "reflection_id": "new", "mood_tags": ["SAD", "SAD", "CALM"], "text": " fin "}]
    outcome, events, rejects = run(spark, archive, writes.change_status, rows)
    (reflection,) = outcome.rows["completion_reflections"].collect()
    assert (reflection.completion_round, reflection.mood_tags, reflection.reflection, reflection.editable_until) == (5, ["SAD", "CALM"], "fin", NOW + 7 * DAY)
    assert outcome.rows["books"].collect()[0].status == "READ" and not rejects
    assert [json.loads(e[3]) for e in events] == [{"previousStatus": "READING", "nextStatus": "READ", "completionRound": 5}, {"moodTags": ["SAD", "CALM"], "completionRound": 5}]
    after = writes.applied(archive, outcome)
    assert after.completion_reflections.count() == 4 and {r.next_round for r in reads.next_rounds(after).where("book_id = 'b'").collect()} == {6}


@pytest.mark.parametrize(
    "row, code",
    [
        ({"id": "b", "status": "READ"}, "COMPLETION_REQUIRED"), ({"id": "b", "status": "READ", "mood_tags": []}, "VALIDATION_ERROR"),
        ({"id": "b", "status": "READ", "mood_tags": ["SAD"], "completed_at": OLD - DAY}, "VALIDATION_ERROR"), ({"id": "b", "status": "TO_READ"}, "INVALID_STATUS_TRANSITION"),
        ({"id": "done", "status": "READ", "mood_tags": ["SAD"]}, "STATUS_UNCHANGED"), ({"id": "b", "status": "READING"}, None), ({"id": "b", "status": "PAUSED"}, None),
    ],
)
def test_status_rules(spark, archive, row, code):
    outcome, events, rejects = run(spark, archive, writes.change_status, [row])
    assert rejects == ({"q0": code} if code else {})
    assert len(events) == outcome.rows["books"].count() == (row["status"] == "PAUSED")


def test_delete_book_cascades(spark, archive):
    outcome, events, rejects = run(spark, archive, writes.delete_books, [{"id": "b"}, {"id": "b"}, {"id": "gone"}])
    assert rejects == {"q1": "NOT_FOUND", "q2": "NOT_FOUND"}
    assert [e[2] for e in events if e[3] == '{"cascade":true}'] == ["a1", "c3", "d1", "d2", "m1"] and len(events) == 6
    assert len({r.id for r in outcome.events.collect()}) == 6
    after = writes.applied(archive, outcome)
    assert audits.orphan_live_traces(after).count() == 0 and reads.traces(after, book="b").count() == 0


def test_create_traces(spark, archive):
    rows = [
        {"id": "n1", "book_id": "b", "page_number": 42, "reason": " why "}, {"id": "n2", "book_id": "b", "page_number": 42, "reason": "else"}, {"id": "n3", "book_id": "b", "page_number": 43, "reason": ""},
        {"id": "n4", "book_id": "b", "page_number": 301}, {"id": "n5", "book_id": "b", "page_number": 50}, {"id": "n6", "book_id": "b", "page_number": 50, "reason": ""}, {"id": "n8", "book_id": "b", "page_number": 50, "reason": "x"}, {"id": "n7", "book_id": "gone", "page_number": 1},
    ]
    outcome, events, rejects = run(spark, archive, writes.create_traces, rows, writes.DOG_EARS)
    assert [r.id for r in outcome.rows["dog_ears"].collect()] == ["n5"] and len(events) == 1
    assert rejects == {"q1": "DOG_EAR_EXISTS", "q3": "VALIDATION_ERROR", "q6": "DOG_EAR_EXISTS", "q7": "NOT_FOUND"}
    rows = [{"id": "k1", "book_id": "b", "start_page": 44, "end_page": 42, "content": "x"}, {"id": "k2", "book_id": "b", "start_page": 10, "end_page": 12, "content": "x" * 130}, {"id": "k3", "book_id": "b", "start_page": 1, "end_page": 1, "content": " "}]
    outcome, events, rejects = run(spark, archive, writes.create_traces, rows, writes.ANNOTATIONS)
    assert rejects == {"q0": "VALIDATION_ERROR", "q2": "VALIDATION_ERROR"} and json.loads(events[0][3]) == {"startPage": 10, "endPage": 12, "summary": "x" * 120}
    outcome, _, rejects = run(spark, archive, writes.create_traces, [{"id": "r1", "book_id": "b", "page_number": 42}, {"id": "r2", "book_id": "b", "page_number": 42}], writes.REREAD_MARKS)
    assert outcome.rows["reread_marks"].count() == 2 and not rejects


def test_update_and_delete_traces(spark, archive):
    rows = [{"id": "d1", "given": ["page_number"], "page_number": 43}, {"id": "d2", "given": ["page_number", "reason"], "page_number": 70, "reason": "r"}, {"id": "d3", "given": ["reason"]}, {"id": "d1", "given": []}, {"id": "d1", "given": ["page_number"], "page_number": 70}]
    outcome, events, rejects = run(spark, archive, writes.update_traces, rows, writes.DOG_EARS)
    assert rejects == {"q0": "DOG_EAR_EXISTS", "q2": "NOT_FOUND", "q3": "VALIDATION_ERROR", "q4": "DOG_EAR_EXISTS"}
    assert [(r.id, r.page_number, r.reason, r.version) for r in outcome.rows["dog_ears"].collect()] == [("d2", 70, "r", 2)]
    outcome, events, rejects = run(spark, archive, writes.update_traces, [{"id": "a1", "given": ["end_page"], "end_page": 301}, {"id": "a1", "given": ["content"], "content": "new"}], writes.ANNOTATIONS)
    assert rejects == {"q0": "VALIDATION_ERROR"} and events == [("ANNOTATION", "UPDATED", "a1", '{"startPage":10,"endPage":60}')]
    outcome, events, rejects = run(spark, archive, writes.delete_traces, [{"id": "d1", "version": 2}, {"id": "d1", "version": 1}, {"id": "d1"}, {"id": "d3"}], writes.DOG_EARS)
    assert rejects == {"q0": "STALE_WRITE", "q2": "NOT_FOUND", "q3": "NOT_FOUND"} and events == [("DOG_EAR", "DELETED", "d1", '{"pageNumber":42}')]


def test_restore_traces(spark, archive):
    outcome, events, rejects = run(spark, archive, writes.restore_traces, [{"id": f"d{i}"} for i in (1, 3, 4, 5, 6)], writes.DOG_EARS)
    assert rejects == {"q0": "NOT_FOUND", "q1": "DOG_EAR_EXISTS", "q3": "RESTORE_WINDOW_EXPIRED", "q4": "BOOK_DELETED"}
    assert [(r.id, r.deleted_at, r.version) for r in outcome.rows["dog_ears"].collect()] == [("d4", None, 2)]


def test_reflections(spark, archive):
    rows = [{"id": "c1", "given": ["text"], "text": "é" * 130}, {"id": "c3", "given": ["text"], "text": "x"}, {"id": "c1", "given": ["mood_tags"], "mood_tags": ["GLAD"]}]
    outcome, events, rejects = run(spark, archive, writes.update_reflections, rows)
    assert rejects == {"q1": "EDIT_WINDOW_EXPIRED", "q2": "VALIDATION_ERROR"}
    assert json.loads(events[0][3]) == {"completionRound": 1, "moodTags": ["CALM"], "summary": "é" * 120}
    outcome, events, rejects = run(spark, archive, writes.delete_reflections, [{"id": "c1"}])
    assert outcome.rows["books"].collect()[0].status == "READING" and len(events) == 2 and "reflection_deleted" in events[0][3]
    after = writes.applied(archive, outcome)
    outcome, events, rejects = run(spark, after, writes.restore_reflections, [{"id": "c1"}, {"id": "c2"}, {"id": "c3"}])
    assert rejects == {"q2": "NOT_FOUND"} and {r.id: r.status for r in outcome.rows["books"].collect()} == {"done": "READ", "b": "READ"}
    late = run(spark, archive, writes.restore_reflections, [{"id": "c2", "at": NOW + 2 * DAY}])[2]
    assert late == {"q0": "EDIT_WINDOW_EXPIRED"}


def test_people(spark, archive):
    outcome, _, rejects = run(spark, archive, writes.register_users, [{"id": "n", "email": " New@X.org"}, {"id": "m", "email": "new@x.org"}, {"id": "o", "email": "U@x.org"}, {"id": "p", "email": "no"}])
    assert rejects == {"q1": "EMAIL_EXISTS", "q2": "EMAIL_EXISTS", "q3": "VALIDATION_ERROR"} and outcome.rows["users"].first().email == "new@x.org"
    outcome, _, rejects = run(spark, archive, writes.delete_accounts, [{"user_id": "u"}, {"user_id": "nobody"}])
    after = writes.applied(archive, outcome)
    assert rejects == {"q1": "UNAUTHENTICATED"} and audits.valid_sessions(archive, NOW).count() == 1 and audits.valid_sessions(after, NOW).count() == 0
    uses = spark.createDataFrame([("h", NOW)], "token_hash string, at timestamp")
    assert writes.rolled_sessions(archive, uses).first().expires_at == NOW + 30 * DAY
