"""Every reading query against its SQL in DuckDB."""

import os

import duckdb
import pytest

from foliant import queries, rule_queries, write_queries  # noqa: F401
from foliant.operators.traces import tagged
from foliant.plans import reads
from foliant.sources.fixtures import archive

SF = os.environ.get("FOLIANT_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return None if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: [(x is not None, x or "") for x in r]
    want = sorted(([plain(x) for x in r] for r in found.fetchall()), key=key)
    assert sorted(([plain(x) for x in r] for r in got.select(*names).collect()), key=key) == want


def test_entry_point_without_the_llm_folders(monkeypatch):
    import builtins
    import importlib
    import sys

    for m in [m for m in sys.modules if m == "__spark_entry__" or m == "corpus_pipeline" or m.startswith("foliant.llm")]:
        monkeypatch.delitem(sys.modules, m)
    real = builtins.__import__

    def without(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith(("corpus_pipeline", "foliant.llm")):
            raise ModuleNotFoundError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", without)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) == set(queries.ORACLE_SQL)
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_every_live_trace_and_event_appears(spark):
    a = archive(spark, SF)
    live = {r.id for r in tagged(a).where("deleted_at IS NULL").select("id").collect()}
    for name in ("traces_page_order_all", "traces_merged_all"):
        got = [r.id for r in queries.QUERIES[name](spark, SF).select("id").collect()]
        assert len(got) == len(live) and set(got) == live
    edited = a.activity_events.where("entity_type = 'ANNOTATION' AND action = 'UPDATED'").count()
    assert queries.QUERIES["timeline_by_entity_action_all"](spark, SF).count() == edited


@pytest.fixture
def without_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_single_pages_are_in_order(spark, without_broadcasts):
    a = archive(spark, SF)
    tenant = a.books.groupBy("user_id").count().orderBy("count", ascending=False).first().user_id
    books = [(r.updated_at, r.id) for r in reads.list_books(a, tenant=tenant).collect()]
    assert len(books) > 3 and books == sorted(books, reverse=True)
    reader = a.activity_events.groupBy("user_id").count().orderBy("count", ascending=False).first().user_id
    events = [(r.occurred_at, r.id) for r in reads.timeline(a, tenant=reader).collect()]
    assert len(events) > 1 and events == sorted(events, reverse=True)
    book = a.completion_reflections.groupBy("book_id").count().orderBy("count", ascending=False).first().book_id
    rounds = [r.completion_round for r in reads.reflections(a, book=book).collect()]
    assert rounds == sorted(rounds, reverse=True)


def test_totals_are_those_of_the_pages(spark):
    a = archive(spark, SF)
    book = a.annotations.groupBy("book_id").count().orderBy("count", ascending=False).first().book_id
    total = reads.trace_totals(a, book=book).first().total
    assert total == reads.traces(a, book=book, paged=False).count()


def test_a_person_without_rows_gets_an_export(spark):
    import json

    a = archive(spark, SF)
    a = type(a)(**{n: df if n in ("users", "sessions") else df.limit(0) for n, df in vars(a).items()})
    one = reads.export_archive(a, queries.now()).first()
    document = json.loads(one.document)
    assert [document[k] for k in ("books", "dogEars", "annotations", "rereadMarks", "reflections", "activityEvents")] == [[]] * 6
    assert reads.export_archive(a, queries.now()).count() == a.users.count()
