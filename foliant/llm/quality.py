"""Quality rules with an n-gram perplexity band for each language.

A modified Kneser-Ney model over the bytes of whole texts (order 5, across words) is counted by Spark over all
documents.  White space is one space, digits are one digit, and runs of one sign count once; nothing else is folded, so
that every script keeps its letters.  The n-grams are kept as 64-bit hashes in sorted arrays with their probabilities
and back-off weights, and looked up by binary search.  Of a corpus with more n-grams than workers hold, Spark computes the
probabilities; the most frequent n-grams go to the workers, and what a text has of others is joined with theirs.  A
document's perplexity is that of a byte, over all its bytes.

A language's band lies around its median.  Each side is as wide as a number of robust deviations of the documents on
that side, and gets narrower with the root of the number of words, as deviations do.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import kept, materialise, texts
from .units import buffers, portions

ORDER, BITS, SPACE = 5, 8, 32
#: Base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
SYMBOLS, WHITE = "#*$%&|<>", " \t\n\r\x0b\x0c"
#: Widths of a band below and above its middle in robust deviations, the least deviation (nats a byte at one word), and
#: the length in words from which bands get no narrower.
BELOW, ABOVE, LEAST, LONG = 5.0, 2.5, 0.05, 1000
#: Distinct n-grams that a counting task holds.
HELD = 1_000_000
#: N-grams that workers hold, over all languages (12 bytes each).  Where a corpus has more, texts find the probabilities
#: of those below a least count, the least power of two that is enough, by a join.
MAX_GRAMS = 1 << 22
#: Bytes of text handled at a time, about a hundred times which a worker needs for the arrays of their n-grams, and texts
#: whose words are counted at a time.
PORTION, TEXTS = 1 << 18, 500
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"

#: What str.split() takes for white space besides.
OTHER_WHITE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

_BYTE = np.arange(256)
FOLDED = np.where((_BYTE >= 9) & (_BYTE <= 13), SPACE, np.where((_BYTE >= 48) & (_BYTE <= 57), 48, _BYTE)).astype(np.uint8)
#: Bytes of which a run counts once: white space, and signs of ASCII.
ONCE = (_BYTE < 128) & ~np.isin(_BYTE, list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of the folded texts, one text after another, and where each text ends.

    A text is as if spaces stood before it.
    """
    data, ends = buffers(pc.fill_null(column.cast(pa.string()), ""))
    data = FOLDED[data]
    before = np.r_[np.uint8(SPACE), data[:-1]] if len(data) else data
    before[ends[:-1][ends[:-1] < len(data)]] = SPACE
    keep = (data != before) | ~ONCE[data]
    own, ends = data[keep].astype(np.int64), np.r_[0, np.cumsum(keep)][ends]
    place = np.arange(len(own)) - np.repeat(ends[:-1], np.diff(ends))
    key = own.copy()
    for back in range(1, ORDER):
        earlier = np.r_[np.zeros(back, np.int64), own][: len(own)]
        key |= np.where(place >= back, earlier, SPACE) << (BITS * back)
    return key, ends


def gram_hash(lang: int, order: int, key: np.ndarray) -> np.ndarray:
    """64-bit hash of an n-gram of a language (splitmix64 over all that tells them apart; no two collide)."""
    x = key.astype(np.uint64) | np.uint64(order << 40) | np.uint64(lang << 44)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more."""
    n1, n2, n3, n4 = (int((counts == i).sum()) for i in (1, 2, 3, 4))
    if not (n1 and n2):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0, *(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))])


@dataclass(frozen=True)
class Perplexity:
    """Sorted hashes with log probabilities of n-grams, and with log back-off weights of their contexts.

    ``longest`` marks the n-grams of the highest order.
    """

    langs: dict[str, int]
    hashes: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray
    longest: np.ndarray
    #: Tells models apart in a worker.
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def build(names: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray) -> Perplexity:
        """From distinct (place of the language in ``names``, n-gram) with their counts."""
        tables: list[list[np.ndarray]] = [[], [], [], [], []]
        for index in range(len(names)):
            own = lang == index
            top, counts = key[own], n[own]
            order = np.argsort(top)
            levels = [(top[order], counts[order])]
            for k in range(ORDER - 1, 0, -1):  # in how many contexts of one symbol more a shorter gram occurs
                levels.insert(0, np.unique(levels[0][0] & ((1 << BITS * k) - 1), return_counts=True))
            lower_keys, lower = np.zeros(1, np.int64), np.array([1 / (1 << BITS)])
            for k, (grams_k, counts_k) in enumerate(levels, 1):
                cut = discounts(counts_k)[np.minimum(counts_k, 3)]
                context, at = np.unique(grams_k >> BITS, return_inverse=True)
                total, held = np.bincount(at, counts_k), np.bincount(at, cut)
                suffix = grams_k & ((1 << BITS * (k - 1)) - 1)
                below = lower[np.searchsorted(lower_keys, suffix)] if k > 1 else lower[0]
                p = (counts_k - cut) / total[at] + held[at] / total[at] * below
                for table, values in zip(tables, (gram_hash(index, k, grams_k), np.log(p), gram_hash(index, k, context), np.log(held / total), np.full(len(p), k == ORDER)), strict=True):
                    table.append(values)
                lower_keys, lower = grams_k, p
        hashes, logp, contexts, backoff, longest = (np.concatenate(t) if t else np.zeros(0) for t in tables)
        i, j = np.argsort(hashes), np.argsort(contexts)
        return Perplexity({x: i for i, x in enumerate(names)}, hashes[i], logp[i].astype(np.float32), contexts[j], backoff[j].astype(np.float32), longest[i].astype(bool))

    @staticmethod
    def of_longest(names: list[str], lang: np.ndarray, key: np.ndarray, logp: np.ndarray) -> Perplexity:
        """From known log probabilities of (place of the language in ``names``, n-gram); there is nothing to back off to."""
        hashes = np.concatenate([np.zeros(0, np.uint64), *(gram_hash(i, ORDER, key[lang == i]) for i in range(len(names)))])
        values = np.concatenate([np.zeros(0), *(logp[lang == i] for i in range(len(names)))])
        i = np.argsort(hashes)
        return Perplexity({x: i for i, x in enumerate(names)}, hashes[i], values[i].astype(np.float32), np.zeros(0, np.uint64), np.zeros(0, np.float32), np.ones(len(i), bool))

    def short(self) -> Perplexity:
        """Less all that only n-grams unknown to it need."""
        none = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        return Perplexity(self.langs, self.hashes[self.longest], self.logp[self.longest], *none, np.zeros(0, bool))

    def known(self, lang: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Negative log probability of each n-gram that it holds, 0 of the others, and whether it holds them."""
        i, hit = self._find(self.hashes, gram_hash(self.langs.get(lang, len(self.langs)), ORDER, keys))
        out = np.zeros(len(keys))
        out[hit] = -self.logp[i[hit]]
        return out, hit

    def _find(self, table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, wanted), max(len(table) - 1, 0))
        return at, (table[at] == wanted if len(table) else np.zeros(len(wanted), bool))

    def losses(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """Negative log probability of each n-gram's last byte after the others."""
        index = self.langs.get(lang, len(self.langs))
        logp, open_ = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(ORDER, 0, -1):
            own = keys[open_] & ((1 << BITS * k) - 1)
            i, hit = self._find(self.hashes, gram_hash(index, k, own))
            logp[open_[hit]] += self.logp[i[hit]]
            open_, own = open_[~hit], own[~hit]
            i, hit = self._find(self.contexts, gram_hash(index, k, own >> BITS))
            logp[open_[hit]] += self.backoff[i[hit]]
        logp[open_] -= BITS * np.log(2)
        return -logp


def split(text: str) -> list[str]:
    """Words of a text: runs of characters other than the six ASCII white space characters."""
    return [w.decode() for w in text.encode().split()] if OTHER_WHITE.search(text) else text.split()


def language(lang: Column) -> Column:
    """Code of two or three small letters, or ``und``."""
    code = F.regexp_extract(F.lower(lang.cast("string")), "^([a-z]{2,3})(?![a-z])", 1)
    return F.coalesce(F.when(code != "", code), F.lit("und"))


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text."""
    seen: set[str] = set()
    doubled = 0
    for line in text.split("\n"):
        if line in seen:
            doubled += 1
        elif line.strip(WHITE):
            seen.add(line)
    repeated = 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        again = np.fromiter((often[w] > 1 for w in windows), bool, len(windows))
        covered = np.zeros(len(words) + 1, np.int64)
        np.add.at(covered, np.flatnonzero(again), 1)
        np.add.at(covered, np.flatnonzero(again) + WINDOW, -1)
        repeated = int((np.cumsum(covered) > 0).sum())
    return len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), doubled, repeated


def base_failed(n_words, n_repeat_words):
    """Works on numbers and on columns."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _by_language(langs: pa.Array, text: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Language, rows, n-grams and ends of the texts of each language of a batch, in portions."""
    for lang in pc.unique(langs).to_pylist():
        rows = np.flatnonzero(pc.equal(langs, lang).to_numpy(zero_copy_only=False))
        batch = pa.RecordBatch.from_arrays([pa.array(rows), text.take(pa.array(rows))], names=["row", "text"])
        for some in portions(batch, PORTION):
            yield lang, some.column(0).to_numpy(), *grams(some.column(1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, n = map(np.concatenate, zip(*parts, strict=True))
        codes, distinct = pd.factorize(key)
        return distinct, np.bincount(codes, n).astype(np.int64)

    def emptied() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            key, n = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(key), pa.array(n)], names=["lang", "key", "n"])
        held.clear()

    for batch in batches:
        for lang, _, key, _ in _by_language(batch.column(0), batch.column(1)):
            codes, distinct = pd.factorize(key)
            held.setdefault(lang, []).append((distinct, np.bincount(codes, minlength=len(distinct))))
            size += len(distinct)
            if size > HELD:
                for name, parts in held.items():
                    held[name] = [summed(parts)]
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > HELD // 2:
                    yield from emptied()
                    size = 0
    yield from emptied()


def count_grams(docs: DataFrame) -> DataFrame:
    """``lang, key, n``: the n-grams of every document, counted by language."""
    rows = docs.select(language(F.col("lang")), "text").mapInArrow(_count, "lang string, key long, n long")
    return rows.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _discounted(level: DataFrame) -> DataFrame:
    """``level`` (``lang, key, n``) with the discount ``cut`` of each count, as :func:`discounts` gives them."""
    n1, n2, n3, n4 = (F.col(f"_n{i}") for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, F.when(n3 > 0, 3 - 4 * y * n4 / n3).otherwise(1.5)]
    fit_ = (n1 > 0) & (n2 > 0)
    cuts = [F.when(fit_, F.least(F.greatest(d, F.lit(0.05)), F.lit(i + 0.95))).otherwise(0.5).alias(f"_cut{i + 1}") for i, d in enumerate(raw)]
    sizes = level.groupBy("lang").agg(*(F.count_if(F.col("n") == i).alias(f"_n{i}") for i in (1, 2, 3, 4)))
    own = level.join(F.broadcast(sizes.select("lang", *cuts)), "lang")  # a row a language
    return own.select("lang", "key", "n", F.when(F.col("n") == 1, F.col("_cut1")).when(F.col("n") == 2, F.col("_cut2")).otherwise(F.col("_cut3")).alias("cut"))


def probabilities(counted: DataFrame) -> DataFrame:
    """``lang, key, n, logp``: the model of :meth:`Perplexity.build` for the longest n-grams, from all of them, in Spark.

    A context has 256 n-grams at most.
    """
    levels = [counted]
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("key").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("key")
        levels.insert(0, materialise(levels[0].groupBy("lang", shorter).agg(F.count("*").alias("n")), f"{k}-grams"))
    below = None
    for k, level in enumerate(levels, 1):
        context = Window.partitionBy("lang", F.shiftright("key", BITS))
        own = _discounted(level).withColumns({"total": F.sum("n").over(context), "held": F.sum("cut").over(context)})
        if below is None:
            own = own.withColumn("lower", F.lit(1 / (1 << BITS)))
        else:
            own = own.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)))
            own = own.join(below.select("lang", F.col("key").alias("suffix"), F.col("p").alias("lower")), ["lang", "suffix"])
        p = (F.col("n") - F.col("cut")) / F.col("total") + F.col("held") / F.col("total") * F.col("lower")
        below = materialise(own.select("lang", "key", "n", p.alias("p")), f"{k}-gram-probabilities")
    return below.select("lang", "key", "n", F.log("p").cast("float").alias("logp"))


def _collected(table: DataFrame, value: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, and for each n-gram the place of its language, itself and a value."""
    rows = table.select("lang", "key", value).toArrow()
    if not rows.num_rows:
        return [], np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    return lang.dictionary.to_pylist(), lang.indices.to_numpy(), rows.column("key").to_numpy(), rows.column(value).to_numpy()


def fit(docs: DataFrame, most: int = MAX_GRAMS) -> tuple[Perplexity, DataFrame | None]:
    """The model of all documents, and ``lang, key, logp`` of the n-grams that it doesn't hold, if there are more than ``most``.

    All of a document's n-grams are in one or the other.  At most ``most`` of them come to the driver.
    """
    counted = materialise(count_grams(docs), "n-grams")
    sizes = counted.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()  # 63 rows at most
    if sum(r["count"] for r in sizes) <= most:
        return Perplexity.build(*_collected(counted, "n")), None
    least = 0
    while sum(r["count"] for r in sizes if r.power >= least) > most:
        least += 1
    scored = probabilities(counted)
    model = Perplexity.of_longest(*_collected(scored.where(F.col("n") >= 1 << least), "logp"))
    return model, scored.where(F.col("n") < 1 << least).select("lang", "key", "logp")


def train(docs: DataFrame, most: int = MAX_GRAMS) -> Perplexity:
    """What workers hold of the model of all documents."""
    return fit(docs, most)[0]


MEASURED = f"struct<{BASE.replace(' long', ': bigint')}, loss: double, size: bigint, rest: array<bigint>>"
MEASURED_NAMES = [*(x.split()[0] for x in BASE.split(", ")), "loss", "size", "rest"]
#: Name of the measures beside a table's own columns.
OWN = "_foliant_measured"


def _measure(model: Perplexity) -> Column:
    """Base counts of a text, the loss of its bytes, their number, and the n-grams that the model doesn't hold, with repeats."""

    def measured(own: Perplexity, langs: pa.Array, text: pa.Array) -> pa.StructArray:
        loss, size = np.zeros(len(text)), np.zeros(len(text), np.int64)
        rest, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lang, rows, key, ends in _by_language(langs, text):
            codes, distinct = pd.factorize(key)
            values, hit = own.known(lang, distinct)
            sums = np.r_[0, np.cumsum(values[codes])]
            loss[rows], size[rows] = np.diff(sums[ends]), np.diff(ends)
            if not hit.all():
                missed = np.flatnonzero(~hit[codes])
                rest.append(key[missed])
                places.append(rows[np.searchsorted(ends, missed, "right") - 1])
        base = [base_counts(t, split(t)) for t in texts(text)]
        columns = [pa.array(c, pa.int64()) for c in zip(*base, strict=True)] or [pa.array([], pa.int64())] * 5
        at = np.concatenate(places)
        bounds = np.r_[0, np.cumsum(np.bincount(at, minlength=len(text)))].astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(rest)[np.argsort(at, kind="stable")]))
        return pa.StructArray.from_arrays([*columns, pa.array(loss), pa.array(size), listed], names=MEASURED_NAMES)

    def measure(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        own = kept(("quality", model.name), lambda: model)
        for langs, text in batches:
            parts = [measured(own, langs.slice(i, TEXTS), text.slice(i, TEXTS)) for i in range(0, max(1, len(text)), TEXTS)]
            yield pa.concat_arrays(parts)

    measure.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(measure, MEASURED)(language(F.col("lang")), F.col("text"))


def _measured(docs: DataFrame, most: int, *without: str, **options) -> DataFrame:
    """``docs`` less some columns, written with their measures in ``OWN`` and a language code in ``OWN_lang``."""
    model, rest = fit(docs, most)
    rows = docs.withColumns({OWN: _measure(model.short()), f"{OWN}_lang": language(F.col("lang"))}).drop(*without)
    if rest is None:
        return materialise(rows, "measured", **options)
    row = f"{OWN}_row"
    rows = materialise(rows.withColumn(row, F.monotonically_increasing_id()), "measured", **options)
    found = rows.select(row, F.col(f"{OWN}_lang").alias("lang"), F.explode(f"{OWN}.rest").alias("key")).join(rest, ["lang", "key"])
    more = materialise(found.groupBy(row).agg(F.sum(-F.col("logp").cast("double")).alias("more")), "more-losses")
    loss = F.col(f"{OWN}.loss") + F.coalesce("more", F.lit(0.0))
    return rows.join(more, row, "left").withColumn(OWN, F.col(OWN).withField("loss", loss)).drop(row, "more")


def _root(n_words: Column) -> Column:
    """Root of the number of words, between 1 and that of a long text."""
    return F.sqrt(F.greatest(F.lit(1), F.least(n_words, F.lit(LONG))))


def _median(x: str) -> Column:
    """Lower median, the same in every run: values are counted on a grid, which bounds their number, and not sketched."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY round({x}, 5))")


def _verdicts(rows: DataFrame, below: float, above: float) -> DataFrame:
    """``rows``, which hold measures in ``OWN`` and a language code in ``OWN_lang``, with bounds and verdict in ``OWN``.

    A band comes from all documents of its language that pass the base rules.  There is one row for each language code,
    of which there are at most 26**2 + 26**3 + 1.
    """
    m = lambda name: F.col(f"{OWN}.{name}")
    code, x = F.col(f"{OWN}_lang"), F.when(m("size") > 0, m("loss") / m("size"))
    failed = base_failed(m("n_words"), m("n_repeat_words"))
    own = rows.where(~failed).select(code.alias("_code"), F.round(x, 5).alias("_x"), _root(m("n_words")).alias("_root"))
    middle = own.groupBy("_code").agg(_median("_x").alias("_middle"))
    off = "(_x - _middle) * _root"
    sides = [_median(f"CASE WHEN {off} {s} 0 THEN abs({off}) END").alias(n) for s, n in (("<", "_low"), (">", "_high"))]
    spread = own.join(F.broadcast(middle), "_code").groupBy("_code", "_middle").agg(*sides)
    wide = [(w * F.greatest(1.4826 * F.coalesce(n, F.lit(0.0)), F.lit(LEAST))).alias(n) for w, n in ((below, "_low"), (above, "_high"))]
    bands = materialise(spread.select("_code", "_middle", *wide), "bands")
    low, high = (F.col("_middle") - F.col("_low") / _root(m("n_words"))), (F.col("_middle") + F.col("_high") / _root(m("n_words")))
    inside = F.coalesce(x.between(low, high), F.lit(True))
    verdict = F.struct(*(m(n).alias(n) for n in MEASURED_NAMES[:5]), failed.alias("base_failed"), F.exp(x).alias("perplexity"), F.exp(low).alias("lower"), F.exp(high).alias("upper"), (~failed & inside).alias("kept"))
    return rows.join(F.broadcast(bands), code == F.col("_code"), "left").withColumn(OWN, verdict)


def quality_verdicts(docs: DataFrame, below: float = BELOW, above: float = ABOVE, most: int = MAX_GRAMS) -> DataFrame:
    """Counts, perplexity, band and verdict for every row of ``docs`` (``doc_id``, ``text``, ``lang``; others ignored).

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, perplexity, lower, upper,
    kept``.  A null text has no words and fails the base rules; its perplexity is null, as that of an empty one.
    Documents without a known language code share a model of their own.  A language without any document that passes
    the base rules has no band and rejects nothing more.  Repeated rows are all counted and all returned; an empty table
    gives an empty one.
    """
    docs = docs.select("doc_id", "text", "lang")
    judged = _verdicts(_measured(docs, most, "text", "lang"), below, above)
    names = [*MEASURED_NAMES[:5], "base_failed", "perplexity", "lower", "upper", "kept"]
    return judged.select("doc_id", *(f"{OWN}.{n}" for n in names))


def drop_low_quality(docs: DataFrame, below: float = BELOW, above: float = ABOVE, most: int = MAX_GRAMS) -> DataFrame:
    """``docs``, with all its columns, less the rows that :func:`quality_verdicts` doesn't keep.

    The documents are written once with their measures, so that each text is scored once.
    """
    judged = _verdicts(_measured(docs, most, compression="zstd"), below, above)
    return judged.where(f"{OWN}.kept").select(docs.columns)
