"""Phrase collocations by dynamic itemset counting.

The corpus is dealt into shards that are scanned in a cycle, one per step.  All
lengths are counted in the same scans: words from the first step on, a longer
phrase from the step after both its subphrases - all words but the last, all but
the first - have reached ``least`` occurrences.  A phrase is counted for one full
cycle, so its count is exact wherever in the cycle it began; the scans end when no
phrase is being counted.

What the tasks need for that is which phrases have reached the threshold before
this step, and before the step one cycle ago.  Both are bit filters of a fixed
size; bits are only ever added, so a phrase that passes is counted in whole shards
and for exactly one cycle.  A phrase that passes by chance gets its exact count as
well and falls below the threshold in the end: the filters save work and decide
nothing.

Texts are lower-cased (A-Z only), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and
those into words at blanks and tabs.  Everything is per language.  Words are
counted as they are written, longer phrases as rows of 64-bit word numbers, which
are digests of language and word; two frequent words with one number end the job.
Tasks add up their own counts before anything moves, so a frequent phrase is a row per task.

* null text: empty; null language: ``und``; bytes that are no UTF-8 count as U+FFFD.
* ``lang`` is the only column used beside the text and the id; rows that repeat count again.
* a phrase of the longest length has no longer one to be part of.
* counts up to 10^15 are multiplied exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_dir
from .common import slices, steps
from .shingles import mix

#: Bytes of text that are cut into words at once, and words that a task holds before it passes their counts on.
PIECE, TOKENS = 1 << 20, 3 << 19
#: Places looked up in a filter at once.
_STEP = 1 << 18
_BREAK, _BLANK = ord("."), ord(" ")
_TABLE = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
_ODD = (np.arange(1, 16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Bytes as random numbers, and the factor from one byte of a word to the next.
_BYTES, _FACTOR = mix(np.arange(1, 257, dtype=np.uint64)), 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_FACTOR, -1, 1 << 64)


@dataclass(frozen=True)
class Counting:
    """``words`` in a phrase at most, ``least`` occurrences, ``shards`` of a cycle, bits of a filter (a power of two)."""

    words: int = 3
    least: int = 10
    shards: int = 2
    bits: int = 1 << 26


def _powers(factor: int, n: int) -> np.ndarray:
    x = np.full(n, factor, np.uint64)
    x[:1] = 1
    return np.cumprod(x, dtype=np.uint64)


def words_of(data: bytes, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all words of a text, where they begin and end, and whether the next word is in the same piece.

    ``data`` is lower-cased and translated; a word's number is a polynomial in
    its bytes, taken from running sums over the text.
    """
    cells = np.frombuffer(data, np.uint8)
    ends = cells == _BREAK
    gap = np.concatenate([[True], ends | (cells == _BLANK), [True]])
    start, stop = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    if not len(start):
        return np.empty(0, np.uint64), start, stop, np.empty(0, bool)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[cells] * _powers(_FACTOR, len(cells)))])
    numbers = mix((sums[stop] - sums[start]) * _powers(_INVERSE, len(cells))[start] + (stop - start).astype(np.uint64) + np.uint64(seed))
    piece = np.cumsum(ends, dtype=np.int32)[start]
    return np.maximum(numbers, 1), start, stop, np.append(piece[1:] == piece[:-1], False)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of a filter for each hash."""
    mask = np.uint64(bits - 1)
    return hashes & mask, (hashes >> np.uint64(32)) * np.uint64(0x85EBCA6B) >> np.uint64(7) & mask


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    one, two = _places(hashes, len(bitmap) * 64)
    bit = lambda at: bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
    return (bit(one) & bit(two)).astype(bool)


def phrase_hashes(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases given by their words' numbers, one column for each word."""
    total = np.full(len(columns[0]), len(columns), np.uint64)
    for k, c in enumerate(columns):
        total += c * _ODD[k]
    return mix(total)


class Accumulator:
    """Words of one language in one task, until their counts are passed on."""

    def __init__(self, lang: bytes, words: int, count_words: bool, now: np.ndarray | None, before: np.ndarray | None):
        self.lang, self.words, self.count_words, self.now, self.before = lang, words, count_words, now, before
        self.seed = xxhash.xxh64_intdigest(lang)
        self.reset()

    def reset(self) -> None:
        self.waiting: list[bytes] = []
        self.parts: list[tuple] = []
        self.size = self.held = 0

    def add(self, raw: bytes) -> None:
        """A whole text; short ones are cut into words together."""
        self.waiting.append(raw.lower().translate(_TABLE))
        self.size += len(raw) + 1
        if self.size >= PIECE:
            self._cut()

    def _cut(self) -> None:
        data = b".".join(self.waiting)
        numbers, start, stop, joined = words_of(data, self.seed)
        # The words as they are written are needed only while words are counted.
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        self.parts.append((numbers, joined, *((data, start.astype(kind), stop.astype(kind)) if self.count_words else ())))
        self.waiting, self.size = [], 0
        self.held += len(numbers)

    def counts(self):
        """(words as written or None, columns of their numbers, counts) for every length; then start anew."""
        self._cut()
        numbers = np.concatenate([p[0] for p in self.parts])
        joined = np.concatenate([p[1] for p in self.parts])[:-1]
        coded = None
        if self.count_words and len(numbers):
            distinct, first, codes = np.unique(numbers, return_index=True, return_inverse=True)
            coded = (distinct, codes)
            yield pa.array(self._written(first), pa.binary()), [distinct], np.bincount(codes)
        self.parts = []
        if self.words > 1 and self.now is not None:
            # Whether the phrase of the length before has reached the threshold, now and a cycle ago.
            reached, old = self._passed([numbers], np.ones(len(numbers), bool), np.ones(len(numbers), bool))
            for length in range(2, self.words + 1):
                active, done = reached[:-1] & reached[1:], old[:-1] & old[1:]
                if length == 2:
                    active, done = active & joined, done & joined
                at = np.flatnonzero(active & ~done)
                if len(at):
                    # Few phrases have codes of their own, many share those of all words.
                    if coded is None and 2 * length * len(at) > len(numbers):
                        coded = np.unique(numbers, return_inverse=True)
                    few = 2 * length * len(at) <= len(numbers)
                    names, codes = np.unique(np.stack([numbers[at + k] for k in range(length)]), return_inverse=True) if few else coded
                    columns, n = _tally([codes[k] if few else codes[at + k] for k in range(length)], len(names).bit_length())
                    yield None, [names[c] for c in columns], n
                if length < self.words:
                    reached, old = self._passed([numbers[k : len(active) + k] for k in range(length)], active, done)
        self.reset()

    def _written(self, places: np.ndarray) -> list[bytes]:
        begin = np.cumsum([0, *(len(p[0]) for p in self.parts)])
        own = np.searchsorted(begin, places, side="right") - 1
        out = []
        for part, at in zip(own.tolist(), (places - begin[own]).tolist()):
            _, _, data, start, stop = self.parts[part]
            out.append(data[start[at] : stop[at]])
        return out

    def _passed(self, columns: list[np.ndarray], active: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the active phrases those that have reached the threshold, now and a cycle ago."""
        reached, old = np.zeros_like(active), np.zeros_like(active)
        places = np.flatnonzero(active)
        for start in range(0, len(places), _STEP):
            at = places[start : start + _STEP]
            hashes = phrase_hashes([c[at] for c in columns])
            reached[at] = passes(self.now, hashes)
            if self.before is not None:
                old[at] = done[at] & reached[at] & passes(self.before, hashes)
        return reached, old


def _tally(codes: list[np.ndarray], bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of codes of so many bits and how often each occurs; rows are packed without loss."""
    key, spent, maps = codes[0], bits, []
    for c in codes[1:]:
        if spent + bits > 63:
            values, key = np.unique(key, return_inverse=True)
            maps.append(values)
            spent = len(values).bit_length()
        key = key << bits | c
        spent += bits
        maps.append(None)
    values, n = np.unique(key, return_counts=True)
    out = []
    for m in reversed(maps):
        if m is None:
            out.append(values & ((1 << bits) - 1))
            values = values >> bits
        else:
            values = m[values]
    return [values, *reversed(out)], n


def _columns(words: int) -> list[str]:
    return [f"w{k}" for k in range(1, words + 1)]


def _scan(docs: DataFrame, counting: Counting, count_words: bool, now, before) -> DataFrame:
    """(lang, word, w1, w2, ..., n) added up within tasks; the filters are broadcast variables of a fixed size, or None."""
    names = _columns(counting.words)

    def run(batches):
        of: dict[bytes, Accumulator] = {}

        def flushed():
            for a in of.values():
                for word, columns, n in a.counts():
                    for at in range(0, len(n), 1 << 16):
                        m = len(n[at : at + (1 << 16)])
                        nothing = pa.nulls(m, pa.binary())
                        ids = [pa.array(c[at : at + m].view(np.int64)) for c in columns]
                        ids += [pa.array(np.zeros(m, np.int64))] * (counting.words - len(ids))
                        yield pa.RecordBatch.from_arrays(
                            [nothing if word is None else pa.array([a.lang] * m, pa.binary()), nothing if word is None else word.slice(at, m), *ids,
                             pa.array(n[at : at + m].astype(np.int64))], ["lang", "word", *names, "n"])
            of.clear()

        for batch in slices(batches):
            for langs, raws in steps([batch.select(["lang", "_cw_text"])], 16):
                for lang, raw in zip(langs, raws):
                    a = of.get(lang)
                    if a is None:
                        a = of[lang] = Accumulator(lang, counting.words, count_words, now and now.value, before and before.value)
                    a.add(raw)
                if sum(x.held + x.size // 8 for x in of.values()) >= TOKENS:
                    yield from flushed()
        yield from flushed()

    return docs.mapInArrow(run, f"lang binary, word binary, {', '.join(f'{c} long' for c in names)}, n long")


def _bits(reached: DataFrame, names: list[str], bits: int) -> np.ndarray:
    """Filter of the phrases; at most one row per 64 bits reaches the driver, whatever their number."""

    def run(batches):
        for batch in batches:
            columns = [batch.column(c).to_numpy().view(np.uint64) for c in names]
            size = sum((c != 0).astype(int) for c in columns)
            at = np.concatenate([np.concatenate(_places(phrase_hashes([c[size == n] for c in columns[:n]]), bits)) for n in range(1, len(names) + 1)])
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["at", "bit"])

    out = np.zeros(bits // 64, np.uint64)
    found = reached.select(*names).mapInArrow(run, "at long, bit long").groupBy("at").agg(F.expr("bit_or(bit)").alias("bit")).toArrow()
    out[found["at"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return out


def frequent(docs: DataFrame, counting: Counting = Counting(), id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (w1, w2, ..., f) of all lengths, frequent words (lang, word, w1), and the number of words (lang, n)."""
    spark = docs.sparkSession
    names, shards = _columns(counting.words), counting.shards
    raw = F.make_valid_utf8(F.coalesce(F.col(text), F.lit(""))).cast("binary")
    own = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).cast("binary").alias("lang"),
                      F.pmod(F.xxhash64(F.col(id_col), raw), F.lit(shards)).alias("_cw_shard"), raw.alias("_cw_text"))
    filters: list = []
    bitmap = np.zeros(counting.bits // 64, np.uint64)
    totals = words = sizes = None
    done: list[DataFrame] = []
    step = 0
    while True:
        now = filters[-1] if filters else None
        before = filters[step - shards - 1] if step > shards else None
        if step >= shards and np.array_equal(now.value, before.value if before else np.zeros_like(bitmap)):
            break
        found = _scan(own.filter(F.col("_cw_shard") == step % shards).drop("_cw_shard"), counting, step < shards, now, before).withColumn("since", F.lit(step))
        if totals is not None:
            found = found.unionByName(totals)
        path = scratch_dir(spark, f"phrases{step}")
        keys = ["lang", "word", *names]
        # Tasks have added up their own counts; what is left rarely repeats within a task.
        found.repartition(*keys).groupBy(*keys).agg(F.sum("n").alias("n"), F.min("since").alias("since")).write.option("parquet.enable.dictionary", "false").parquet(path)
        totals = spark.read.parquet(path)
        bitmap = bitmap | _bits(totals.filter((F.col("n") >= counting.least) & (F.col(names[-1]) == 0)), names, counting.bits)
        filters.append(spark.sparkContext.broadcast(bitmap))
        is_word = F.col("word").isNotNull()
        if step == shards - 1:
            sizes = totals.filter(is_word).groupBy("lang").agg(F.sum("n").alias("n"))
            words = totals.filter(is_word & (F.col("n") >= counting.least)).select("lang", "word", "w1")
        # Words are complete after one cycle; another phrase at the latest one cycle after it was first met.
        over = F.when(is_word, F.lit(step >= shards - 1)).otherwise(F.col("since") <= step - shards + 1)
        done.append(totals.filter(over & (F.col("n") >= counting.least)))
        totals = totals.filter(~over)
        step += 1
    every = totals.filter(F.col("n") >= counting.least)
    for d in done:
        every = every.unionByName(d)
    return every.select(*names, F.col("n").alias("f")), words, sizes


def _floor_ratio(a: Column, below: Column, above: Column) -> Column:
    """floor(1000000 * a * a / (below * above)) in whole numbers."""
    whole = lambda c: c.cast("decimal(15,0)")
    top = (whole(a) * whole(a) * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, (whole(below) * whole(above)).cast("decimal(31,0)"))


def collocations(docs: DataFrame, counting: Counting = Counting(), covered: int = 50, top: int = 2000,
                 id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of every language.

    A phrase inside a longer one that has at least ``covered`` hundredths of its
    occurrences is dropped.
    """
    found, words, sizes = frequent(docs, counting, id_col, text, lang)
    names = _columns(counting.words)
    found, words = cut_lineage(found), cut_lineage(words)
    twice = words.groupBy("w1").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).collect()
    if twice:
        raise ArithmeticError("two frequent words have the same number")
    size = sum((F.col(w) != 0).cast("int") for w in names)
    ids = F.slice(F.array(*names), F.lit(1), F.col("size"))

    def spread(of: Column) -> list[Column]:
        """The numbers of a phrase as columns, zeros behind them."""
        return [F.coalesce(F.get(of, F.lit(k)), F.lit(0).cast("long")).alias(w) for k, w in enumerate(names)]

    candidates = found.filter("w2 <> 0").withColumn("size", size).select(*names, "size", F.col("f").alias("a"))
    cut = candidates.select(*[F.col(w).alias(f"p{w}") for w in names], "size", "a", ids.alias("ids"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    kept = [f"p{w}" for w in names] + ["size", "a", "k"]
    heads = cut.select(*kept, "ids", *spread(F.slice("ids", F.lit(1), F.col("k")))).join(found.withColumnRenamed("f", "l"), names).drop(*names)
    both = heads.select(*kept, "l", *spread(F.slice("ids", F.col("k") + 1, F.col("size") - F.col("k")))).join(found.withColumnRenamed("f", "r"), names).drop(*names)
    best = both.groupBy(*[F.col(f"p{w}").alias(w) for w in names], "a").agg(
        F.min(F.struct(_floor_ratio(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("best"))
    inner = candidates.filter("size > 2").select("a", "size", ids.alias("ids"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("k"))
    inner = inner.select("a", "ids", "k", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("k") + 1)).alias("at"))
    longest = inner.select("a", *spread(F.slice("ids", F.col("at"), F.col("k")))).groupBy(*names).agg(F.max("a").alias("_cw_longer"))
    left = best.join(longest, names, "left").filter(F.col("_cw_longer").isNull() | (100 * F.col("_cw_longer") < covered * F.col("a")))
    # Words as they are written; the first one tells the language.
    named = left.join(words.withColumnRenamed("word", "_cw_1"), "w1")
    for k, w in enumerate(names[1:], 2):
        named = named.join(words.select(F.col("w1").alias(w), F.col("word").alias(f"_cw_{k}")), w, "left")
    phrase = F.concat_ws(" ", *[F.col(f"_cw_{k}").cast("string") for k in range(1, len(names) + 1)])
    named = named.select("lang", phrase.alias("phrase"), "a", "best.l", "best.r", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(F.col("lang").cast("string").alias("lang"), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
