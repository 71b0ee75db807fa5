import datetime as dt
import json

from pyspark.sql import functions as F

from foliant.model import SCHEMAS, Archive
from foliant.plans import reads
from foliant.sources import documents
from foliant.sources.fixtures import archive
from foliant.streaming import log

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2026, 1, 1)


def test_round_trip_and_health(spark, tmp_path):
    empty = Archive.empty(spark)
    empty.write(str(tmp_path))
    again = Archive.read(spark, str(tmp_path))
    assert again.books.dtypes == empty.books.dtypes and documents.seed(again.users) == 0
    assert documents.health(spark).collect() == [(1,)] and reads.list_books(again).collect() == []


def test_requests(spark, tmp_path):
    lines = ['{"request_id": "1", "id": "b", "title": null, "at": "2026-01-01T00:00:00Z"}', "[1]", "nonsense", '{"request_id": "2", "page_count": 7}']
    (tmp_path / "r.json").write_text("\n".join(lines))
    got = documents.read_requests(spark, str(tmp_path / "r.json"), "request_id string, id string, at timestamp, title string, page_count int").collect()
    assert [(r.request_id, r.given, r.reject_code) for r in got] == [("1", ["title"], None), (None, [], "VALIDATION_ERROR"), (None, [], "VALIDATION_ERROR"), ("2", ["page_count"], None)]


def test_exports(spark, tmp_path):
    a = archive(spark, SF)
    out = reads.export_archive(a, F.lit(NOW)).where("user_id = '7'")
    (row,) = out.collect()
    found = json.loads(row.document)
    want = {"books": a.books, "dogEars": a.dog_ears, "annotations": a.annotations, "rereadMarks": a.reread_marks, "reflections": a.completion_reflections}
    for name, df in want.items():
        ids = [r.id for r in df.where("user_id = '7' AND deleted_at IS NULL").orderBy("created_at", "id").collect()]
        assert [x["id"] for x in found[name]] == ids, name
    assert (found["schemaVersion"], found["includeDeleted"], found["user"]["id"]) == (1, False, "7") and "\n" in row.document
    assert row.file_name == "reading-archive-2026-01-01.json"
    documents.write_exports(out, f"{tmp_path}/x")
    text = next((tmp_path / "x").rglob("part-*.txt")).read_text()
    assert json.loads(text) == found
    assert reads.export_archive(a, F.lit(NOW), limit=3).where("user_id = '7'").isEmpty()


def test_streams(spark, tmp_path):
    day = dt.datetime(2026, 1, 1)
    rows = [(str(i % 5), "u", "b", "DOG_EAR", "d", "CREATED", "{}", day + dt.timedelta(hours=i % 5)) for i in range(8)]
    rows.append(("9", "u", "b", "BOOK", "b", "UPDATED", "{}", day + dt.timedelta(days=9)))
    spark.createDataFrame(rows, SCHEMAS["activity_events"]).write.parquet(f"{tmp_path}/in")
    stream = log.trace_activity(log.event_stream(spark, f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("activity").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.user_id, r.entity_type, r.n) for r in spark.table("activity").collect()] == [("u", "DOG_EAR", 5)]


def test_rate_limits(spark):
    t = dt.datetime(2026, 1, 1)
    rows = [("ip", "a@x", t + dt.timedelta(minutes=i)) for i in range(11)] + [("ip", "b@x", t + dt.timedelta(minutes=2 * i)) for i in range(12)]
    over = log.over_limit(spark.createDataFrame(rows, "ip string, email string, at timestamp"), ["ip", "email"], log.LOGIN_LIMIT)
    assert [(r.email, r.n) for r in over.collect()] == [("a@x", 11)]


def test_plans(spark):
    """Filters and columns reach the scan; other branches of a union go; a page is a top-k."""
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    a = archive(spark, SF)
    one = text(reads.traces(a, book="7", kind="REREAD_MARK"))
    assert "TakeOrderedAndProject" in one and one.count("lineitem.parquet") == 1 and "EqualTo(l_orderkey" not in one.split("PushedFilters")[0]
    assert "WindowGroupLimit" in text(reads.timeline(a))
    assert "c_acctbal" not in text(a.users.select("id"))
