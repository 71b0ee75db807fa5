"""Validation rules; each gives a boolean, or a reject code that is null where the input is accepted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import MOOD_TAGS
from .text import units

# The status changes that are allowed, and the windows and bounds of the archive.
TRANSITIONS = {
    "TO_READ": ["READING", "ABANDONED"],
    "READING": ["PAUSED", "READ", "ABANDONED"],
    "PAUSED": ["READING", "READ", "ABANDONED"],
    "READ": ["READING"],
    "ABANDONED": [],
}
RESTORE_WINDOW, EDIT_WINDOW = "24 hours", "7 days"
FUTURE_SLACK = "5 minutes"
BOUNDS = {"title": (1, 300), "author": (0, 300), "publisher": (0, 300), "content": (1, 5000), "dog_ear_reason": (0, 500), "reread_reason": (0, 1000), "reflection": (0, 5000)}
PAGE_COUNT, FIRST_YEAR = (1, 100_000), 1000


def interval(text: str) -> Column:
    n, unit = text.split()
    return F.expr(f"INTERVAL '{n}' {unit.rstrip('s').upper()}")


def within(field: str, text: Column) -> Column:
    """Whether a text's length is inside the bounds of a field; a null counts as absent and passes."""
    low, high = BOUNDS[field]
    return F.coalesce(units(text).between(low, high), F.lit(True))


def page_count_valid(n: Column) -> Column:
    return F.coalesce(n.between(*PAGE_COUNT), F.lit(True))


def year_valid(year: Column, now: Column) -> Column:
    return F.coalesce(year.between(F.lit(FIRST_YEAR), F.year(now)), F.lit(True))


def page_valid(page: Column, page_count: Column) -> Column:
    """A whole number from 1, and not beyond the book's pages where these are known."""
    return F.coalesce((page >= 1) & (page_count.isNull() | (page <= page_count)), F.lit(False))


def page_range_valid(start: Column, end: Column, page_count: Column) -> Column:
    return F.coalesce((start >= 1) & (start <= end) & (page_count.isNull() | (end <= page_count)), F.lit(False))


def transition_reject(current: Column, new: Column) -> Column:
    """Null if allowed; a change to the same status is a no-op, but a book can't be finished twice in a row."""
    allowed = F.lit(False)
    for status, following in TRANSITIONS.items():
        if following:
            allowed = allowed | ((current == status) & new.isin(following))
    same = F.when(current == "READ", F.lit("STATUS_UNCHANGED"))
    return F.when(current == new, same).when(~allowed, F.lit("INVALID_STATUS_TRANSITION"))


def mood_tags(tags: Column) -> Column:
    """Distinct tags in the order given."""
    return F.array_distinct(tags)


def mood_tags_valid(tags: Column) -> Column:
    own = mood_tags(tags)
    return F.coalesce(F.size(own).between(1, 3) & F.forall(own, lambda t: t.isin(MOOD_TAGS)), F.lit(False))


def toggle_tag(tags: Column, tag: Column) -> Column:
    """A picker's tags after a click: taken out, or put last while there are fewer than three."""
    without = F.filter(tags, lambda t: t != tag)
    return F.when(F.array_contains(tags, tag), without).when(F.size(tags) < 3, F.array_append(tags, tag)).otherwise(tags)


def restore_open(deleted_at: Column, now: Column) -> Column:
    return F.coalesce(now - deleted_at <= interval(RESTORE_WINDOW), F.lit(False))


def edit_open(editable_until: Column, now: Column) -> Column:
    return now <= editable_until


def completed_at_valid(completed_at: Column, book_created_at: Column, now: Column) -> Column:
    return (completed_at >= book_created_at) & (completed_at <= now + interval(FUTURE_SLACK))


def session_valid(revoked_at: Column, expires_at: Column, status: Column, user_deleted_at: Column, now: Column) -> Column:
    return revoked_at.isNull() & (expires_at > now) & (status == "ACTIVE") & user_deleted_at.isNull()


def session_extension(expires_at: Column, now: Column, ttl_days: int = 30) -> Column:
    """The new expiry of a session in use: it rolls on once a day of its time to live has gone."""
    whole = interval(f"{ttl_days} days")
    return F.when(expires_at - now < whole - interval("24 hours"), now + whole).otherwise(expires_at)


def optional_date(text: Column) -> Column:
    """ISO 8601 only; absent or empty means none."""
    return F.try_to_timestamp(F.nullif(text, F.lit("")))


def optional_date_reject(text: Column) -> Column:
    wanted = F.nullif(text, F.lit(""))
    return F.when(wanted.isNotNull() & F.try_to_timestamp(wanted).isNull(), F.lit("VALIDATION_ERROR"))
