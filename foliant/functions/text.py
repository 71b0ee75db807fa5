"""Text rules: normal form, trimming, lengths, summaries, ISBN, identifiers and addresses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that the archive trims and collapses (white space and line ends of ECMAScript).
WHITE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def _nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import unicodedata

    for batch in batches:
        yield pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in batch.to_pylist()], pa.string())


_nfc.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def nfc(text: Column) -> Column:
    """Unicode normal form C, which Spark has no function for; texts of ASCII are in it and don't go to Python."""
    plain = text.rlike(r"^\p{ASCII}*$")
    return F.coalesce(F.when(plain, text), F.arrow_udf(_nfc, "string")(F.when(~plain, text)))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def normalise(text: Column) -> Column:
    return trim(nfc(text))


def normalise_email(text: Column) -> Column:
    return F.lower(normalise(text))


def units(text: Column) -> Column:
    """Length in UTF-16 code units, by which the archive's bounds count."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def first_units(text: Column, n: int) -> Column:
    """The longest beginning of at most ``n`` UTF-16 units that splits no character."""
    start = F.substring(text, 1, n)
    fitted = F.aggregate(F.split(start, ""), F.lit(""), lambda kept, c: F.when(units(F.concat(kept, c)) <= n, F.concat(kept, c)).otherwise(kept))
    return F.when(units(start) <= n, start).otherwise(fitted)


def event_summary(text: Column) -> Column:
    """First 120 units of the normalised text; null becomes empty."""
    return F.coalesce(first_units(normalise(text), 120), F.lit(""))


def short_text(text: Column, length: int = 100) -> Column:
    """White space collapsed and trimmed; longer texts are cut and end in an ellipsis."""
    flat = trim(F.regexp_replace(text, f"[{WHITE}]+", " "))
    return F.when(units(flat) > length, F.concat(first_units(flat, length), F.lit("…"))).otherwise(flat)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def clean_isbn(text: Column) -> Column:
    return F.upper(F.regexp_replace(text, "[- ]", ""))


def isbn_valid(text: Column) -> Column:
    """Check digit of a cleaned ISBN-10 or ISBN-13, any prefix; null stays null."""

    def weighted(weight) -> Column:
        digits = F.transform(F.split(text, ""), lambda c, i: weight(i) * F.when(c == "X", 10).otherwise(F.try_to_number(c, F.lit("9")).cast("int")))
        return F.aggregate(digits, F.lit(0), lambda total, x: total + x)

    ten = F.when(text.rlike("^[0-9]{9}[0-9X]$"), weighted(lambda i: 10 - i) % 11 == 0)
    thirteen = F.when(text.rlike("^[0-9]{13}$"), weighted(lambda i: 1 + 2 * (i % 2)) % 10 == 0)
    return F.when(text.isNotNull(), F.coalesce(ten, thirteen, F.lit(False)))


def uuid_valid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID), F.lit(False))


def url_valid(text: Column) -> Column:
    """An http or https address with a host."""
    return F.coalesce(text.rlike(r"^(?i:https?)://[^\s/?#]+"), F.lit(False))


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)
