"""The archive's tables, their columns and their vocabularies."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

# The vocabularies of the archive.
BOOK_STATUSES = ["TO_READ", "READING", "READ", "PAUSED", "ABANDONED"]
MOOD_TAGS = ["MOVED", "CALM", "JOYFUL", "SAD", "ANGRY", "CONFUSED", "RELIEVED", "EMPTY", "CHANGED"]
TRACE_TYPES = ["DOG_EAR", "ANNOTATION", "REREAD_MARK"]
ACTIVITY_ACTIONS = ["CREATED", "UPDATED", "DELETED", "RESTORED", "STATUS_CHANGED", "COMPLETED"]
ACTIVITY_ENTITY_TYPES = ["BOOK", *TRACE_TYPES, "COMPLETION_REFLECTION"]
USER_STATUSES = ["ACTIVE", "DELETED"]

_OWN = "id STRING, user_id STRING, book_id STRING, version INT"
_TIMES = "created_at TIMESTAMP, updated_at TIMESTAMP, deleted_at TIMESTAMP"
_MARK = f"{_OWN}, page_number INT, reason STRING, {_TIMES}"

#: Password hashes exist in the model but are never loaded for analysis.
SCHEMAS = {
    "users": f"id STRING, email STRING, status STRING, {_TIMES}",
    "sessions": "id STRING, user_id STRING, token_hash STRING, expires_at TIMESTAMP, created_at TIMESTAMP, revoked_at TIMESTAMP",
    "books": f"id STRING, user_id STRING, version INT, title STRING, author STRING, publisher STRING, publication_year SMALLINT, isbn STRING, page_count INT, cover_url STRING, status STRING, {_TIMES}",
    "dog_ears": _MARK,
    "annotations": f"{_OWN}, start_page INT, end_page INT, content STRING, {_TIMES}",
    "reread_marks": _MARK,
    "completion_reflections": f"{_OWN}, completion_round INT, mood_tags ARRAY<STRING>, reflection STRING, completed_at TIMESTAMP, editable_until TIMESTAMP, {_TIMES}",
    "activity_events": "id STRING, user_id STRING, book_id STRING, entity_type STRING, entity_id STRING, action STRING, payload_json STRING, occurred_at TIMESTAMP",
}


@dataclass(frozen=True)
class Archive:
    """The eight tables."""

    users: DataFrame
    sessions: DataFrame
    books: DataFrame
    dog_ears: DataFrame
    annotations: DataFrame
    reread_marks: DataFrame
    completion_reflections: DataFrame
    activity_events: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> Archive:
        """Tables stored as Parquet under ``path``, one folder each."""
        return Archive(**{f.name: spark.read.schema(SCHEMAS[f.name]).parquet(f"{path}/{f.name}") for f in fields(Archive)})

    def write(self, path: str) -> None:
        """Store every table, sorted by tenant within files so that a tenant's rows share few row groups."""
        for f in fields(Archive):
            rows: DataFrame = getattr(self, f.name)
            key = "user_id" if "user_id" in rows.columns else "id"
            rows.sortWithinPartitions(key).write.parquet(f"{path}/{f.name}")

    @staticmethod
    def empty(spark: SparkSession) -> Archive:
        return Archive(**{f.name: spark.createDataFrame([], SCHEMAS[f.name]) for f in fields(Archive)})
