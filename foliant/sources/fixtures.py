"""The archive's tables derived from the order tables that tests and benchmarks come with.

Each view is one SELECT that Spark and DuckDB both run; names in braces are tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Archive

VIEWS = {
    "r_users": """
SELECT CAST(c_custkey AS STRING) AS id, concat(lower(replace(c_name, '#', '.')), '@example.org') AS email,
       CASE WHEN c_acctbal < 0 THEN 'DELETED' ELSE 'ACTIVE' END AS status,
       TIMESTAMP_NTZ '1992-01-01 00:00:00' AS created_at, TIMESTAMP_NTZ '1992-01-01 00:00:00' AS updated_at,
       CASE WHEN c_acctbal < 0 THEN TIMESTAMP_NTZ '1998-01-01 00:00:00' END AS deleted_at
FROM {customer}""",
    "r_sessions": """
SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS user_id, o_orderpriority AS token_hash,
       o_orderdate + INTERVAL '1' DAY * CAST(30 + o_orderkey % 5 AS INT) AS expires_at, o_orderdate AS created_at,
       CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate + INTERVAL '2' DAY END AS revoked_at
FROM {orders}""",
    "r_books": """
SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS user_id, CAST(1 AS INT) AS version, p_name AS title,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE p_brand END AS author,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(40 + o_orderkey % 20 AS INT) END AS page_count,
       CASE o_orderkey % 5 WHEN 0 THEN 'TO_READ' WHEN 1 THEN 'READING' WHEN 2 THEN 'READ' WHEN 3 THEN 'PAUSED' ELSE 'ABANDONED' END AS status,
       o_orderdate AS created_at, o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 90 AS INT) AS updated_at,
       CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL '100' DAY END AS deleted_at
FROM {orders} JOIN {part} ON p_partkey = o_orderkey % 200""",
    "r_traces": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), CAST(l_shipdate AS DATE),
                 CAST(round(l_discount * 100) AS INT), CAST(round(l_tax * 100) AS INT), l_returnflag, l_linestatus) AS id,
       CAST(o_custkey AS STRING) AS user_id, CAST(l_orderkey AS STRING) AS book_id, CAST(1 AS INT) AS version,
       CASE l_returnflag WHEN 'A' THEN 'DOG_EAR' WHEN 'N' THEN 'ANNOTATION' ELSE 'REREAD_MARK' END AS type,
       CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS type_order,
       CAST(l_quantity AS INT) AS start_page,
       CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS INT) + l_linenumber - 1 ELSE CAST(l_quantity AS INT) END AS end_page,
       CASE WHEN l_returnflag <> 'N' AND l_linenumber % 2 = 0 THEN NULL ELSE p_name END AS body,
       l_shipdate AS created_at, l_shipdate AS updated_at,
       CASE WHEN l_linestatus = 'F' AND l_linenumber % 3 = 0 THEN l_shipdate + INTERVAL '30' DAY END AS deleted_at
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey""",
    "r_reflections": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT), CAST(l_shipdate AS DATE),
                 CAST(round(l_discount * 100) AS INT), CAST(round(l_tax * 100) AS INT), l_linestatus) AS id,
       CAST(o_custkey AS STRING) AS user_id, CAST(l_orderkey AS STRING) AS book_id, CAST(1 AS INT) AS version,
       l_linenumber AS completion_round,
       CASE WHEN l_partkey % 3 = 0 THEN 'MOVED' ELSE 'CALM' END AS tag_1, CASE WHEN l_suppkey % 3 = 0 THEN 'MOVED' ELSE 'SAD' END AS tag_2,
       CASE WHEN l_linenumber = 2 THEN NULL ELSE l_linestatus END AS reflection,
       l_shipdate AS completed_at, l_shipdate + INTERVAL '7' DAY AS editable_until, l_shipdate AS created_at, l_shipdate AS updated_at,
       CASE WHEN l_suppkey % 4 = 0 THEN l_shipdate + INTERVAL '3' DAY END AS deleted_at
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_returnflag = 'R' AND l_linenumber <= 2""",
    "r_events": """
SELECT CAST(event_id AS STRING) AS id, CAST(o_custkey AS STRING) AS user_id,
       CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id AS STRING) END AS book_id,
       CASE e.user_id % 5 WHEN 0 THEN 'BOOK' WHEN 1 THEN 'DOG_EAR' WHEN 2 THEN 'ANNOTATION' WHEN 3 THEN 'REREAD_MARK' ELSE 'COMPLETION_REFLECTION' END AS entity_type,
       CAST(e.user_id AS STRING) AS entity_id,
       CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'click' THEN 'UPDATED' WHEN 'error' THEN 'DELETED' WHEN 'view' THEN 'RESTORED' ELSE 'STATUS_CHANGED' END AS action,
       props AS payload_json, ts AS occurred_at
FROM {events} AS e JOIN {orders} ON o_orderkey = event_id""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"\{(\w+)\}", VIEWS[name])}
    return spark.sql(VIEWS[name], **tables)


def archive(spark: SparkSession, sf_dir: str) -> Archive:
    get = lambda name: view(spark, sf_dir, name)
    missing = {"publisher": "string", "publication_year": "smallint", "isbn": "string", "cover_url": "string"}
    traces = get("r_traces")
    own = ["id", "user_id", "book_id", "version"]
    times = ["created_at", "updated_at", "deleted_at"]
    mark = lambda kind: traces.where(F.col("type") == kind).select(*own, F.col("start_page").alias("page_number"), F.col("body").alias("reason"), *times)
    notes = traces.where("type = 'ANNOTATION'").select(*own, "start_page", "end_page", F.coalesce("body", F.lit("")).alias("content"), *times)
    rounds = get("r_reflections").withColumn("mood_tags", F.array_distinct(F.array("tag_1", "tag_2"))).drop("tag_1", "tag_2")
    return Archive(
        users=get("r_users"),
        sessions=get("r_sessions"),
        books=get("r_books").withColumns({c: F.lit(None).cast(t) for c, t in missing.items()}),
        dog_ears=mark("DOG_EAR"),
        annotations=notes,
        reread_marks=mark("REREAD_MARK"),
        completion_reflections=rounds,
        activity_events=get("r_events"),
    )


def sql_with(*names: str) -> str:
    """The views as common table expressions for an SQL engine that has the tables by name."""
    parts = [f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in names]
    return "WITH " + ", ".join(parts).replace("TIMESTAMP_NTZ '", "TIMESTAMP '")
