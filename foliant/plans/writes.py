"""The archive's writes as batch transforms: requests and tables in, changed rows, events and refusals out.

Each request has ``request_id``, ``user_id`` and ``at`` (its moment), ``id`` where it names a row, ``version`` where it
expects one, and the fields of its body; ``given`` lists the fields that an update sets.  A refusal carries the code of
the first rule that fails.  Where several requests of a batch name one row, they take effect one after another, by time
and request, as under the row locks of a live store: each sees what the earlier ones left, and a stated version must be
the one of that moment.  :func:`merged` applies the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as tx
from ..model import BOOK_STATUSES, Archive
from ..operators.traces import furthest_pages

EVENT = ["id", "user_id", "book_id", "entity_type", "entity_id", "action", "payload_json", "occurred_at"]


@dataclass(frozen=True)
class Outcome:
    """New versions of rows by table, the events written, and ``request_id, reject_code`` of refused requests."""

    rows: dict[str, DataFrame]
    events: DataFrame
    rejects: DataFrame


def merged(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with the rows put in place of those with their ids."""
    kept = table.join(rows.select("id"), "id", "left_anti").select(table.columns)
    return kept.unionByName(rows.select(table.columns))


def applied(archive: Archive, outcome: Outcome) -> Archive:
    tables = {name: merged(getattr(archive, name), rows) for name, rows in outcome.rows.items()}
    events = archive.activity_events.unionByName(outcome.events.select(archive.activity_events.columns))
    return Archive(**{**vars(archive), **tables, "activity_events": events})


def in_turn(*per: str):
    """A write whose requests for one row take effect in turn: round k holds the k-th request of every row.

    A batch has as many rounds as its busiest row has requests, one as a rule.  A later round reads the tables as the
    earlier ones left them; where the session has a checkpoint folder, lineage is cut there between rounds.
    """

    def decorate(write: Callable[..., Outcome]) -> Callable[..., Outcome]:
        @wraps(write)
        def whole(archive: Archive, requests: DataFrame, *more) -> Outcome:
            turn = F.row_number().over(Window.partitionBy(*per).orderBy("at", "request_id"))
            queued = requests.withColumn("_turn", turn)
            rounds = queued.agg(F.max("_turn")).first()[0] or 1
            if rounds == 1:
                return write(archive, requests, *more)
            outcomes = []
            for k in range(1, rounds + 1):
                outcomes.append(_cut(write(archive, queued.where(F.col("_turn") == k).drop("_turn"), *more)))
                archive = applied(archive, outcomes[-1])
            return reduce(_then, outcomes)

        return whole

    return decorate


def _cut(outcome: Outcome) -> Outcome:
    if not outcome.events.sparkSession.sparkContext.getCheckpointDir():
        return outcome
    return Outcome({n: df.checkpoint() for n, df in outcome.rows.items()}, outcome.events.checkpoint(), outcome.rejects.checkpoint())


def _then(first: Outcome, second: Outcome) -> Outcome:
    rows = {n: merged(df, second.rows[n]) if n in second.rows else df for n, df in first.rows.items()}
    rows |= {n: df for n, df in second.rows.items() if n not in rows}
    return Outcome(rows, first.events.unionByName(second.events), first.rejects.unionByName(second.rejects))


def event(entity: str, action: str, entity_id: Column, number: int = 0, **payload) -> Column:
    """An event of the request at hand; its id follows from the request, so that a retry writes the same one."""
    body = F.to_json(F.struct(*(v.alias(k) for k, v in payload.items())), {"ignoreNullFields": "false"}) if payload else F.lit("{}")
    return F.struct(
        F.concat_ws("/", "request_id", F.lit(number)).alias("id"), F.col("user_id").alias("user_id"), F.col("_book").alias("book_id"),
        F.lit(entity).alias("entity_type"), entity_id.alias("entity_id"), F.lit(action).alias("action"), body.alias("payload_json"),
        F.col("at").alias("occurred_at"),
    )


def _decided(rows: DataFrame, checks: list[tuple[Column, str]], per: Column | None = None) -> DataFrame:
    """``rows`` with ``reject_code``; checks run in order, then only the first request for ``per`` passes."""
    codes = [F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for bad, code in checks]
    rows = rows.withColumn("reject_code", F.coalesce(*codes, F.lit(None).cast("string")))
    if per is None:
        return rows
    rows = rows.withColumn("_per", per)
    first = F.row_number().over(Window.partitionBy("_per", F.col("reject_code").isNull()).orderBy("at", "request_id"))
    stale = F.when(F.col("reject_code").isNull() & F.col("_per").isNotNull() & (first > 1), F.lit("STALE_WRITE"))
    return rows.withColumn("reject_code", F.coalesce("reject_code", stale)).drop("_per")


def _rejects(decided: DataFrame) -> DataFrame:
    return decided.where("reject_code IS NOT NULL").select("request_id", "reject_code")


def _events(rows: DataFrame, *events: Column) -> DataFrame:
    """The events of the rows; those that are null aren't written."""
    return rows.select(F.explode(F.array_compact(F.array(*events))).alias("e")).select(*(f"e.{c}" for c in EVENT))


def _renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(prefix + c) for c in df.columns))


def _stale() -> Column:
    return F.col("version").isNotNull() & (F.col("version") != F.col("t_version"))


def _set(name: str, new: Column) -> Column:
    """An update's value where it is given, else the stored one."""
    return F.when(F.array_contains("given", name), new).otherwise(F.col(f"t_{name}"))


def _text(name: str) -> Column:
    """Normalised text of a field; empty becomes null."""
    return tx.empty_to_null(tx.normalise(tx.empty_to_null(F.col(name))))


def _version_up() -> Column:
    return (F.col("t_version") + 1).cast("int")


@in_turn("id")
def create_books(archive: Archive, requests: DataFrame) -> Outcome:
    """Requests carry the new ``id`` and the book's fields; a book can't begin as finished."""
    isbn = tx.empty_to_null(tx.clean_isbn(F.col("isbn")))
    rows = requests.withColumns({"isbn": isbn, "status": F.coalesce("status", F.lit("TO_READ")), "_book": F.col("id")})
    title = tx.normalise(F.col("title"))
    bad = (
        ~tx.uuid_valid(F.col("id")) | ~F.col("status").isin([s for s in BOOK_STATUSES if s != "READ"]) | title.isNull() | ~rules.within("title", title)
        | ~_book_fields_valid()
    )
    decided = _decided(rows, [(bad, "VALIDATION_ERROR")])
    taken = archive.books.select("id").withColumn("_taken", F.lit(True))
    decided = decided.join(taken, "id", "left").withColumn("reject_code", F.coalesce("reject_code", F.when(F.col("_taken"), F.lit("DUPLICATE_RESOURCE"))))
    good = decided.where("reject_code IS NULL").withColumns({"title": title, "author": _text("author"), "publisher": _text("publisher")})
    new = good.select(
        "id", "user_id", F.lit(1).alias("version"), "title", "author", "publisher", "publication_year", "isbn", "page_count", "cover_url", "status",
        F.col("at").alias("created_at"), F.col("at").alias("updated_at"), F.lit(None).cast(good.schema["at"].dataType).alias("deleted_at"),
    )
    created = event("BOOK", "CREATED", F.col("id"), bookTitle=F.col("title"), status=F.col("status"))
    return Outcome({"books": new}, _events(good, created), _rejects(decided))


def _book_fields_valid() -> Column:
    isbn, cover = F.col("isbn"), F.col("cover_url")
    return (
        rules.within("author", F.col("author")) & rules.within("publisher", F.col("publisher")) & rules.page_count_valid(F.col("page_count"))
        & rules.year_valid(F.col("publication_year"), F.col("at")) & F.coalesce(tx.isbn_valid(isbn), F.lit(True)) & (cover.isNull() | tx.url_valid(cover))
    )


def _with_books(archive: Archive, requests: DataFrame) -> DataFrame:
    """Requests with the live book that their person owns as t_ columns; ``t_id`` is null where there is none."""
    books = _renamed(archive.books.where("deleted_at IS NULL"), "t_")
    on = (requests.id == books.t_id) & (requests.user_id == books.t_user_id)
    return requests.join(books, on, "left").withColumn("_book", F.col("id"))


def _book_row(rows: DataFrame, archive: Archive, **new: Column) -> DataFrame:
    """The stored books with some columns new, the version one up and the edit time moved."""
    new = {"version": _version_up(), "updated_at": F.col("at"), **new}
    return rows.select(*((new[c] if c in new else F.col(f"t_{c}")).alias(c) for c in archive.books.columns))


@in_turn("id")
def update_books(archive: Archive, requests: DataFrame) -> Outcome:
    """A status can't be set here; a request that gives no field changes nothing."""
    rows = _with_books(archive, requests.withColumn("isbn", tx.empty_to_null(tx.clean_isbn(F.col("isbn")))))
    far = furthest_pages(archive).select(F.col("book_id").alias("id"), "max_page")
    rows = rows.join(far, "id", "left").withColumn("title", tx.normalise(F.col("title")))
    sets = lambda c: F.array_contains("given", c)
    bad = ~_book_fields_valid() | (sets("title") & (F.col("title").isNull() | ~rules.within("title", F.col("title")))) | sets("status")
    small = sets("page_count") & (F.col("page_count") < F.coalesce("max_page", F.lit(0)))
    checks = [(bad, "VALIDATION_ERROR"), (F.col("t_id").isNull(), "NOT_FOUND"), (_stale(), "STALE_WRITE"), (small, "PAGE_COUNT_TOO_SMALL")]
    decided = _decided(rows, checks, F.when(F.size("given") > 0, F.col("id")))
    good = decided.where("reject_code IS NULL AND size(given) > 0")
    plain = {c: _set(c, F.col(c)) for c in ("title", "publication_year", "isbn", "page_count", "cover_url")}
    new = _book_row(good, archive, **plain, author=_set("author", _text("author")), publisher=_set("publisher", _text("publisher")))
    title = F.coalesce(F.when(sets("title"), F.col("title")), tx.normalise(F.col("t_title")))
    updated = event("BOOK", "UPDATED", F.col("id"), bookTitle=title, previousStatus=F.col("t_status"))
    return Outcome({"books": new}, _events(good, updated), _rejects(decided))


@in_turn("id")
def change_status(archive: Archive, requests: DataFrame) -> Outcome:
    """``status`` and, to finish a book, ``reflection_id``, ``mood_tags``, ``text`` and ``completed_at`` (else the moment).

    The round is one more than any that the book ever had, deleted ones included.
    """
    rows = _with_books(archive, requests)
    rounds = archive.completion_reflections.groupBy(F.col("book_id").alias("id")).agg(F.max("completion_round").alias("_last"))
    rows = rows.join(rounds, "id", "left").withColumns({"_done": F.coalesce("completed_at", "at"), "_round": (F.coalesce("_last", F.lit(0)) + 1).cast("int")})
    finishing = (F.col("status") == "READ") & (F.col("t_status") != "READ")
    checks = [
        (~F.col("status").isin(BOOK_STATUSES) | F.col("status").isNull() | ~rules.within("reflection", F.col("text")), "VALIDATION_ERROR"),
        (F.col("t_id").isNull(), "NOT_FOUND"),
        (_stale(), "STALE_WRITE"),
    ]
    code = rules.transition_reject(F.col("t_status"), F.col("status"))
    checks += [(code == c, c) for c in ("STATUS_UNCHANGED", "INVALID_STATUS_TRANSITION")]
    checks += [
        (finishing & F.col("mood_tags").isNull(), "COMPLETION_REQUIRED"),
        (finishing & ~rules.mood_tags_valid(F.col("mood_tags")), "VALIDATION_ERROR"),
        (finishing & ~rules.completed_at_valid(F.col("_done"), F.col("t_created_at"), F.col("at")), "VALIDATION_ERROR"),
    ]
    decided = _decided(rows, checks, F.when(F.col("status") != F.col("t_status"), F.col("id")))
    good = decided.where("reject_code IS NULL AND status <> t_status").withColumn("mood_tags", rules.mood_tags(F.col("mood_tags")))
    done = good.where("status = 'READ'")
    nothing = F.lit(None).cast(good.schema["at"].dataType)
    reflection = done.select(
        F.col("reflection_id").alias("id"), "user_id", F.col("id").alias("book_id"), F.lit(1).alias("version"), F.col("_round").alias("completion_round"),
        "mood_tags", _text("text").alias("reflection"), F.col("_done").alias("completed_at"), (F.col("at") + rules.interval(rules.EDIT_WINDOW)).alias("editable_until"),
        F.col("at").alias("created_at"), F.col("at").alias("updated_at"), nothing.alias("deleted_at"),
    )
    before, after = F.col("t_status"), F.col("status")
    plain = event("BOOK", "STATUS_CHANGED", F.col("id"), previousStatus=before, nextStatus=after)
    finished = event("BOOK", "STATUS_CHANGED", F.col("id"), previousStatus=before, nextStatus=after, completionRound=F.col("_round"))
    completed = event("COMPLETION_REFLECTION", "COMPLETED", F.col("reflection_id"), 1, moodTags=F.col("mood_tags"), completionRound=F.col("_round"))
    events = _events(good.where("status <> 'READ'"), plain).union(_events(done, finished, completed))
    return Outcome({"books": _book_row(good, archive, status=after), "completion_reflections": reflection}, events, _rejects(decided))


CHILDREN = {"dog_ears": "DOG_EAR", "annotations": "ANNOTATION", "reread_marks": "REREAD_MARK", "completion_reflections": "COMPLETION_REFLECTION"}


@in_turn("id")
def delete_books(archive: Archive, requests: DataFrame) -> Outcome:
    """Deletes the book with its live traces and reflections, with an event for each."""
    decided = _decided(_with_books(archive, requests), [(F.col("t_id").isNull(), "NOT_FOUND"), (_stale(), "STALE_WRITE")], F.col("id"))
    good = decided.where("reject_code IS NULL")
    changed = {"books": _book_row(good, archive, deleted_at=F.col("at"))}
    events = [_events(good, event("BOOK", "DELETED", F.col("id"), bookTitle=F.col("t_title")))]
    for name, entity in CHILDREN.items():
        table = getattr(archive, name)
        gone = good.select("request_id", "user_id", "at", F.col("id").alias("_book"))
        own = _renamed(table.where("deleted_at IS NULL"), "t_").join(gone, F.col("t_book_id") == F.col("_book"))
        new = {"version": _version_up(), "updated_at": F.col("at"), "deleted_at": F.col("at")}
        changed[name] = own.select(*((new[c] if c in new else F.col(f"t_{c}")).alias(c) for c in table.columns))
        cascade = event(entity, "DELETED", F.col("t_id"), cascade=F.lit(True))
        events.append(_events(own, cascade).withColumn("id", F.concat_ws("/", "id", "entity_id")))
    return Outcome(changed, reduce(DataFrame.unionByName, events), _rejects(decided))


@dataclass(frozen=True)
class Kind:
    """What tells the three kinds of traces apart."""

    table: str
    entity: str
    pages: tuple[str, ...]
    text: str
    bounds: str

    def payload(self, prefix: str = "") -> dict[str, Column]:
        names = {"page_number": "pageNumber", "start_page": "startPage", "end_page": "endPage"}
        return {names[p]: F.col(prefix + p) for p in self.pages}

    def pages_valid(self, page_count: Column) -> Column:
        first, last = F.col(self.pages[0]), F.col(self.pages[-1])
        return rules.page_range_valid(first, last, page_count)


DOG_EARS = Kind("dog_ears", "DOG_EAR", ("page_number",), "reason", "dog_ear_reason")
ANNOTATIONS = Kind("annotations", "ANNOTATION", ("start_page", "end_page"), "content", "content")
REREAD_MARKS = Kind("reread_marks", "REREAD_MARK", ("page_number",), "reason", "reread_reason")


def create_traces(archive: Archive, requests: DataFrame, kind: Kind) -> Outcome:
    """Requests carry the new ``id``, ``book_id``, pages and text.

    A dog-ear on a page that has one is the same again if the reasons agree, and then changes nothing; else it is
    refused.  Of several new dog-ears of a batch for one page the first is made, and the others are held against it.
    """
    return _create_dog_ears(archive, requests, kind) if kind is DOG_EARS else _create_traces(archive, requests, kind)


def _create_traces(archive: Archive, requests: DataFrame, kind: Kind) -> Outcome:
    table = getattr(archive, kind.table)
    books = archive.books.where("deleted_at IS NULL").select(F.col("id").alias("_book"), F.col("user_id").alias("_owner"), F.col("page_count").alias("_page_count"))
    rows = requests.join(books, (F.col("book_id") == F.col("_book")) & (F.col("user_id") == F.col("_owner")), "left")
    body = tx.normalise(F.col("content")) if kind.text == "content" else _text("reason")
    rows = rows.withColumn(kind.text, body)
    bad = ~rules.within(kind.bounds, F.col(kind.text)) | (F.col(kind.text).isNull() if kind.text == "content" else F.lit(False))
    checks = [(bad, "VALIDATION_ERROR"), (F.col("_book").isNull(), "NOT_FOUND"), (~kind.pages_valid(F.col("_page_count")), "VALIDATION_ERROR")]
    if kind is DOG_EARS:
        # The index of a live store holds one; among several the oldest is asked.
        there = table.where("deleted_at IS NULL").groupBy(F.col("book_id").alias("_b"), F.col("page_number").alias("_p"))
        there = there.agg(F.min_by("reason", F.struct("created_at", "id")).alias("_reason"), F.lit(True).alias("_taken"))
        rows = rows.join(there, (F.col("book_id") == F.col("_b")) & (F.col("page_number") == F.col("_p")), "left")
        same = F.coalesce("_reason", F.lit("")) == F.coalesce("reason", F.lit(""))
        rows = rows.withColumn("idempotent", F.coalesce(F.col("_taken") & same, F.lit(False)))
        checks.append((F.col("_taken") & ~F.col("idempotent"), "DOG_EAR_EXISTS"))
        decided = _decided(rows, checks, F.when(~F.col("idempotent"), F.concat_ws("/", "book_id", "page_number")))
        decided = decided.withColumn("reject_code", F.when(F.col("reject_code") == "STALE_WRITE", "DOG_EAR_EXISTS").otherwise(F.col("reject_code")))
    else:
        decided = _decided(rows.withColumn("idempotent", F.lit(False)), checks)
    good = decided.where("reject_code IS NULL AND NOT idempotent")
    nothing = F.lit(None).cast(good.schema["at"].dataType)
    new = good.select("id", "user_id", "book_id", F.lit(1).alias("version"), *kind.pages, kind.text, F.col("at").alias("created_at"), F.col("at").alias("updated_at"), nothing.alias("deleted_at"))
    extra = {"summary" if kind is ANNOTATIONS else "reason": tx.event_summary(F.col(kind.text))}
    return Outcome({kind.table: new}, _events(good, event(kind.entity, "CREATED", F.col("id"), **kind.payload(), **extra)), _rejects(decided))


_create_dog_ears = in_turn("book_id", "page_number")(_create_traces)


def _with_rows(archive: Archive, requests: DataFrame, table: str, deleted: bool = False) -> DataFrame:
    """Requests with their person's row (t_) and its book (b_); ``t_id`` is null where there is none of that state."""
    own = _renamed(getattr(archive, table).where(f"deleted_at IS {'NOT ' * deleted}NULL"), "t_")
    books = _renamed(archive.books.select("id", "status", "page_count", "version", "deleted_at"), "b_")
    rows = requests.join(own, (F.col("id") == F.col("t_id")) & (F.col("user_id") == F.col("t_user_id")), "left")
    return rows.join(books, F.col("t_book_id") == F.col("b_id"), "left").withColumn("_book", F.col("t_book_id"))


def _row(rows: DataFrame, archive: Archive, table: str, **new: Column) -> DataFrame:
    new = {"version": _version_up(), "updated_at": F.col("at"), **new}
    return rows.select(*((new[c] if c in new else F.col(f"t_{c}")).alias(c) for c in getattr(archive, table).columns))


def _page_taken(archive: Archive, rows: DataFrame) -> DataFrame:
    """``rows`` with ``_others``: live dog-ears of other ids on the page in ``page_number``."""
    live = archive.dog_ears.where("deleted_at IS NULL").select(F.col("id").alias("o_id"), F.col("book_id").alias("o_book"), F.col("page_number").alias("o_page"))
    on = (F.col("_book") == F.col("o_book")) & (F.col("page_number") == F.col("o_page")) & (F.col("id") != F.col("o_id"))
    taken = rows.join(live, on, "left_semi").select("request_id").withColumn("_others", F.lit(True))
    return rows.join(taken, "request_id", "left")


@in_turn("id")
def update_traces(archive: Archive, requests: DataFrame, kind: Kind) -> Outcome:
    rows = _with_rows(archive, requests, kind.table)
    body = tx.normalise(F.col("content")) if kind.text == "content" else _text("reason")
    rows = rows.withColumns({p: _set(p, F.col(p)) for p in kind.pages} | {kind.text: _set(kind.text, body)})
    bad = (F.size("given") == 0) | ~rules.within(kind.bounds, F.col(kind.text)) | (F.col(kind.text).isNull() & F.lit(kind.text == "content") & F.col("t_id").isNotNull())
    checks = [(bad, "VALIDATION_ERROR"), (F.col("t_id").isNull() | F.col("b_deleted_at").isNotNull() | F.col("b_id").isNull(), "NOT_FOUND"), (_stale(), "STALE_WRITE"), (~kind.pages_valid(F.col("b_page_count")), "VALIDATION_ERROR")]
    if kind is DOG_EARS:
        rows = _page_taken(archive, rows)
        checks.append((F.col("_others") & (F.col("page_number") != F.col("t_page_number")), "DOG_EAR_EXISTS"))
    decided = _decided(rows, checks, F.col("id"))
    if kind is DOG_EARS:  # two dog-ears of a batch may aim at one free page
        decided = _first_on_page(decided, F.col("page_number") != F.col("t_page_number"))
    good = decided.where("reject_code IS NULL")
    extra = {} if kind is ANNOTATIONS else {"reason": tx.event_summary(F.col("reason"))}
    updated = event(kind.entity, "UPDATED", F.col("id"), **kind.payload(), **extra)
    return Outcome({kind.table: _row(good, archive, kind.table, **{c: F.col(c) for c in (*kind.pages, kind.text)})}, _events(good, updated), _rejects(decided))


def _first_on_page(decided: DataFrame, moving: Column) -> DataFrame:
    contender = F.col("reject_code").isNull() & moving
    first = F.row_number().over(Window.partitionBy("_book", "page_number", contender).orderBy("at", "request_id"))
    return decided.withColumn("_place", first).withColumn("reject_code", F.when(contender & (F.col("_place") > 1), F.lit("DOG_EAR_EXISTS")).otherwise(F.col("reject_code")))


@in_turn("id")
def delete_traces(archive: Archive, requests: DataFrame, kind: Kind) -> Outcome:
    rows = _with_rows(archive, requests, kind.table)
    decided = _decided(rows, [(F.col("t_id").isNull(), "NOT_FOUND"), (_stale(), "STALE_WRITE")], F.col("id"))
    good = decided.where("reject_code IS NULL")
    deleted = event(kind.entity, "DELETED", F.col("id"), **kind.payload("t_"))
    return Outcome({kind.table: _row(good, archive, kind.table, deleted_at=F.col("at"))}, _events(good, deleted), _rejects(decided))


@in_turn("id")
def restore_traces(archive: Archive, requests: DataFrame, kind: Kind) -> Outcome:
    """Within a day of the deletion, if the book is live and, for a dog-ear, its page still free."""
    rows = _with_rows(archive, requests, kind.table, deleted=True)
    checks = [
        (F.col("t_id").isNull(), "NOT_FOUND"),
        (~rules.restore_open(F.col("t_deleted_at"), F.col("at")), "RESTORE_WINDOW_EXPIRED"),
        (F.col("b_deleted_at").isNotNull() | F.col("b_id").isNull(), "BOOK_DELETED"),
    ]
    if kind is DOG_EARS:
        rows = _page_taken(archive, rows.withColumn("page_number", F.col("t_page_number")))
        checks.append((F.col("_others"), "DOG_EAR_EXISTS"))
    decided = _decided(rows, checks, F.col("id"))
    if kind is DOG_EARS:
        decided = _first_on_page(decided, F.lit(True))
    good = decided.where("reject_code IS NULL")
    restored = event(kind.entity, "RESTORED", F.col("id"), **kind.payload("t_"))
    gone = F.lit(None).cast(good.schema["at"].dataType)
    return Outcome({kind.table: _row(good, archive, kind.table, deleted_at=gone)}, _events(good, restored), _rejects(decided))


@in_turn("id")
def update_reflections(archive: Archive, requests: DataFrame) -> Outcome:
    """``mood_tags`` and ``text`` as given, until the edit window closes."""
    rows = _with_rows(archive, requests, "completion_reflections")
    sets = lambda c: F.array_contains("given", c)
    checks = [
        ((F.size("given") == 0) | (sets("text") & ~rules.within("reflection", F.col("text"))), "VALIDATION_ERROR"),
        (F.col("t_id").isNull() | F.col("b_deleted_at").isNotNull() | F.col("b_id").isNull(), "NOT_FOUND"),
        (~rules.edit_open(F.col("t_editable_until"), F.col("at")), "EDIT_WINDOW_EXPIRED"),
        (_stale(), "STALE_WRITE"),
        (sets("mood_tags") & ~rules.mood_tags_valid(F.col("mood_tags")), "VALIDATION_ERROR"),
    ]
    decided = _decided(rows, checks, F.col("id"))
    good = decided.where("reject_code IS NULL").withColumns({
        "mood_tags": F.when(sets("mood_tags"), rules.mood_tags(F.col("mood_tags"))).otherwise(F.col("t_mood_tags")),
        "text": F.when(sets("text"), _text("text")).otherwise(F.col("t_reflection")),
    })
    summary = F.coalesce(tx.first_units(F.col("text"), 120), F.lit(""))
    updated = event("COMPLETION_REFLECTION", "UPDATED", F.col("id"), completionRound=F.col("t_completion_round"), moodTags=F.col("mood_tags"), summary=summary)
    new = _row(good, archive, "completion_reflections", mood_tags=F.col("mood_tags"), reflection=F.col("text"))
    return Outcome({"completion_reflections": new}, _events(good, updated), _rejects(decided))


def _latest_other(archive: Archive, rows: DataFrame) -> DataFrame:
    """``rows`` with ``_latest``: the last live round of the book among the reflections that aren't asked about."""
    live = archive.completion_reflections.where("deleted_at IS NULL").select(F.col("id").alias("o_id"), F.col("book_id").alias("o_book"), "completion_round")
    live = live.join(rows.select(F.col("t_id").alias("o_id")), "o_id", "left_anti")
    latest = live.groupBy("o_book").agg(F.max("completion_round").alias("_latest"))
    return rows.join(latest, F.col("_book") == F.col("o_book"), "left").withColumn("_latest", F.coalesce("_latest", F.lit(0)))


def _book_change(rows: DataFrame, archive: Archive, status: str) -> DataFrame:
    """The books of the rows in a new status."""
    asked = rows.select(F.col("_book").alias("id"), "at").groupBy("id").agg(F.min("at").alias("at"))
    books = _renamed(archive.books, "t_").join(asked, F.col("t_id") == F.col("id"))
    return _book_row(books, archive, status=F.lit(status))


@in_turn("id")
def delete_reflections(archive: Archive, requests: DataFrame) -> Outcome:
    """A finished book without a live round as late as the deleted one goes back to reading."""
    rows = _with_rows(archive, requests, "completion_reflections")
    checks = [
        (F.col("t_id").isNull() | F.col("b_deleted_at").isNotNull() | F.col("b_id").isNull(), "NOT_FOUND"),
        (~rules.edit_open(F.col("t_editable_until"), F.col("at")), "EDIT_WINDOW_EXPIRED"),
        (_stale(), "STALE_WRITE"),
    ]
    decided = _decided(rows, checks, F.col("id"))
    good = _latest_other(archive, decided.where("reject_code IS NULL"))
    first = F.row_number().over(Window.partitionBy("_book").orderBy(F.desc("t_completion_round"), "at", "request_id")) == 1
    good = good.withColumn("_back", first & (F.col("b_status") == "READ") & (F.col("_latest") < F.col("t_completion_round")))
    deleted = event("COMPLETION_REFLECTION", "DELETED", F.col("id"), completionRound=F.col("t_completion_round"))
    back = event("BOOK", "STATUS_CHANGED", F.col("_book"), 1, previousStatus=F.lit("READ"), nextStatus=F.lit("READING"), reason=F.lit("reflection_deleted"))
    new = {"completion_reflections": _row(good, archive, "completion_reflections", deleted_at=F.col("at")), "books": _book_change(good.where("_back"), archive, "READING")}
    return Outcome(new, _events(good, deleted, F.when(F.col("_back"), back)), _rejects(decided))


@in_turn("id")
def restore_reflections(archive: Archive, requests: DataFrame) -> Outcome:
    """Inside the edit window, if the book is being read and has no later live round; the book is finished again."""
    rows = _latest_other(archive, _with_rows(archive, requests, "completion_reflections", deleted=True))
    checks = [
        (F.col("t_id").isNull(), "NOT_FOUND"),
        (~rules.edit_open(F.col("t_editable_until"), F.col("at")), "EDIT_WINDOW_EXPIRED"),
        (F.col("b_deleted_at").isNotNull() | F.col("b_id").isNull(), "BOOK_DELETED"),
        ((F.col("b_status") != "READING") | (F.col("_latest") > F.col("t_completion_round")), "RESTORE_CONFLICT"),
    ]
    decided = _decided(rows, checks, F.col("_book"))
    decided = decided.withColumn("reject_code", F.when(F.col("reject_code") == "STALE_WRITE", "RESTORE_CONFLICT").otherwise(F.col("reject_code")))
    good = decided.where("reject_code IS NULL")
    restored = event("COMPLETION_REFLECTION", "RESTORED", F.col("id"), completionRound=F.col("t_completion_round"))
    again = event("BOOK", "STATUS_CHANGED", F.col("_book"), 1, previousStatus=F.lit("READING"), nextStatus=F.lit("READ"), reason=F.lit("reflection_restored"))
    gone = F.lit(None).cast(good.schema["at"].dataType)
    new = {"completion_reflections": _row(good, archive, "completion_reflections", deleted_at=gone), "books": _book_change(good, archive, "READ")}
    return Outcome(new, _events(good, restored, again), _rejects(decided))


def register_users(archive: Archive, requests: DataFrame) -> Outcome:
    """``id`` and ``email`` of new people; hashing a password is no matter for this engine."""
    rows = requests.withColumns({"email": tx.normalise_email(F.col("email")), "_book": F.lit(None).cast("string")})
    taken = archive.users.select("email").distinct().withColumn("_taken", F.lit(True))
    rows = rows.join(taken, "email", "left")
    decided = _decided(rows, [(~F.col("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$") | F.col("email").isNull(), "VALIDATION_ERROR"), (F.col("_taken"), "EMAIL_EXISTS")], F.col("email"))
    decided = decided.withColumn("reject_code", F.when(F.col("reject_code") == "STALE_WRITE", "EMAIL_EXISTS").otherwise(F.col("reject_code")))
    good = decided.where("reject_code IS NULL")
    new = good.select("id", "email", F.lit("ACTIVE").alias("status"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"), F.lit(None).cast(good.schema["at"].dataType).alias("deleted_at"))
    return Outcome({"users": new}, archive.activity_events.limit(0), _rejects(decided))


def delete_accounts(archive: Archive, requests: DataFrame) -> Outcome:
    """Marks people deleted and revokes their sessions; their books stay as they are."""
    own = _renamed(archive.users, "t_")
    rows = requests.join(own, F.col("user_id") == F.col("t_id"), "left")
    decided = _decided(rows, [(F.col("t_id").isNull() | (F.col("t_status") == "DELETED"), "UNAUTHENTICATED")], F.col("user_id"))
    good = decided.where("reject_code IS NULL")
    set_to = {"status": F.lit("DELETED"), "deleted_at": F.col("at"), "updated_at": F.col("at")}
    users = good.select(*((set_to[c] if c in set_to else F.col(f"t_{c}")).alias(c) for c in archive.users.columns))
    open_ = archive.sessions.where("revoked_at IS NULL").join(good.select("user_id", "at"), "user_id")
    sessions = open_.withColumn("revoked_at", F.col("at")).select(archive.sessions.columns)
    return Outcome({"users": users, "sessions": sessions}, archive.activity_events.limit(0), _rejects(decided))


def rolled_sessions(archive: Archive, uses: DataFrame, ttl_days: int = 30) -> DataFrame:
    """Sessions with expiries moved by their last use (``token_hash``, ``at``)."""
    last = uses.groupBy("token_hash").agg(F.max("at").alias("at"))
    rows = archive.sessions.join(last, "token_hash")
    moved = rows.where(F.col("revoked_at").isNull() & (F.col("expires_at") > F.col("at")))
    return moved.withColumn("expires_at", rules.session_extension(F.col("expires_at"), F.col("at"), ttl_days)).select(archive.sessions.columns)
