"""Phrase collocations by SON partitioning.

Documents are dealt to ``shards`` by a hash. A phrase that occurs ``least`` times in a
language occurs at least ``least * n_shard / n`` times in some shard, where ``n`` counts
the language's words. So every shard is mined completely at that lowered support, the
locally frequent phrases are united, and the union is counted over all documents exactly.

A shard is not a task: its counts are an aggregation spread over all tasks, so a shard
may be many times a task's memory and the lowered support stays above one however large
the input is. Inside a shard phrases grow by length: a pair is counted where both
words are locally frequent, longer ones where all their pairs are. What is locally
frequent goes to the tasks as a bit table of fixed size (``filter_bits``); a false hit
costs a row and never a result, as counts decide.

Phrases travel as 64-bit hashes with counts until the last pass, which counts them by
their own text. Counts are combined in the task, then before the shuffle, so a frequent
phrase is one row a task.

Scoring is exact: products in decimals of up to 28 digits. Ranking takes the best of
each hashed part of a language first, so no task ranks a whole language.

Defined cases: null text is empty, null ``lang`` is ``und``; repeated rows all count; an
empty table gives no phrase. Words and pieces are bytes between ASCII marks, A-Z in lower
case. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marts.llm.arrays import LOWER, mix, powers, ranges, text_slices, words
from marts.llm.workers import ship
from marts.session import new_folder

SHARDS = 8
#: Bits of a cell's number that hold its shard; the others hold its language's hash.
SHARD_BITS = 8
LEAST = 30
LONGEST = 4
TOP = 2000
#: Size of the bit table sent to tasks, as a power of two: 4 MB.
FILTER_BITS = 25
#: Occurrences that a task gathers before it counts them.
GATHERED = 600_000
#: Rows and bytes of text that are worked on at once.
ROWS, BYTES = 1_000, 1 << 19
#: Rows sent from a task at once.
SENT = 1 << 16
#: Parts of a language that are ranked by themselves first.
RANK_PARTS = 64

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 32]] = True
_CUT = np.zeros(256, dtype=bool)
_CUT[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True


class _Slice:
    """Words of some texts: their lower-case bytes joined by single blanks, and which
    of them follow each other in a piece."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray) -> None:
        low, high, first = words(~(_BLANK | _CUT)[values], offsets)
        size = high - low
        self.n = len(low)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size
        self.text = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
        self.text[ranges(self.start, size)] = LOWER[values[ranges(low, size)]]
        cuts = np.zeros(len(values) + 1, dtype=np.int64)
        np.cumsum(_CUT[values], out=cuts[1:])
        at = cuts[low]
        self.joined = (at[1:] == at[:-1]) & (self.row[1:] == self.row[:-1])
        up, self._down = powers(len(self.text) + 1)
        self._sums = np.zeros(len(self.text) + 1, dtype=np.uint64)
        np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * up[: len(self.text)], out=self._sums[1:])

    def runs(self, length: int) -> np.ndarray:
        """Words that start a phrase of ``length`` words."""
        if self.n < length:
            return np.zeros(0, np.int64)
        ok = np.ones(self.n - length + 1, dtype=bool)
        for j in range(length - 1):
            ok &= self.joined[j : j + len(ok)]
        return np.flatnonzero(ok)

    def hashes(self, at: np.ndarray, length: int, salts: np.ndarray) -> np.ndarray:
        start, end = self.start[at], self.end[at + length - 1]
        h = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40)) ^ salts[self.row[at]])


def _mixed(cell: np.ndarray) -> np.ndarray:
    """Spreads cells over the high bits; in :func:`_cell_key` the same in Spark's terms."""
    return cell ^ (cell << np.uint64(SHARD_BITS + 32))


def _cell_key() -> Column:
    return F.col("g").bitwiseXOR(F.col("cell")).bitwiseXOR(F.shiftleft("cell", SHARD_BITS + 32))


def _has(bits: np.ndarray, keys: np.ndarray, log2: int) -> np.ndarray:
    at = keys >> np.uint64(64 - log2)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _bit_table(keys: DataFrame, log2: int) -> np.ndarray:
    """One bit for each value of the column ``k``: at most ``2 ** (log2 - 6)`` rows come back."""
    at = F.shiftrightunsigned("k", 64 - log2)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    rows = keys.select(F.shiftright(at, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    found = rows.toArrow()
    out = np.zeros(1 << (log2 - 6), dtype=np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _slices(batches: Iterator[pa.RecordBatch]):
    """Words of slices of rows, with the cell (language and shard) of each row."""
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        cell = batch["cell"].to_numpy().view(np.uint64)
        for first, values, offsets in text_slices(batch["text"], BYTES):
            part = _Slice(values, offsets)
            if part.n:
                yield part, cell[first : first + len(offsets) - 1]


def _language(cell: np.ndarray) -> np.ndarray:
    return cell >> np.uint64(SHARD_BITS)


def _local_counts(lengths: tuple[int, ...], shipped, log2: int):
    """Counts of phrases by cell; ``shipped``: bits of the locally frequent parts (words for
    pairs, pairs for longer phrases), none for words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value if shipped is not None else None
        gathered: list[tuple[np.ndarray, np.ndarray]] = []
        for part, cell in _slices(batches):
            salt = _language(cell)
            if bits is not None:
                n = 1 if lengths == (2,) else 2
                known = np.zeros(part.n, dtype=bool)
                at = part.runs(n)
                g = part.hashes(at, n, salt)
                known[at[_has(bits, g ^ _mixed(cell[part.row[at]]), log2)]] = True
            for length in lengths:
                at = part.runs(length)
                if bits is not None:
                    for j in range(length - n + 1):
                        at = at[known[at + j]]
                gathered.append((part.hashes(at, length, salt), cell[part.row[at]]))
            if sum(len(x[0]) for x in gathered) >= GATHERED:
                yield from _sent(_counted(gathered))
                gathered = []
        if gathered:
            yield from _sent(_counted(gathered))

    return task


def _counted(gathered: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    g, cell = (np.concatenate(x) for x in zip(*gathered, strict=True))
    # The language is in the hash already; the cell keeps equal phrases of two shards apart.
    _, at, count = np.unique(g ^ mix(cell), return_index=True, return_counts=True)
    columns = {"cell": cell[at].view(np.int64), "g": g[at].view(np.int64), "c": count}
    return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def _sent(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, SENT):
        yield batch.slice(at, SENT)


def _global_counts(longest: int, shipped, log2: int):
    """Counts of the candidates in ``shipped``'s bits, by their text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        kept: list[tuple] = []
        size = 0
        for part, cell in _slices(batches):
            salt = _language(cell)
            known = np.ones(part.n, dtype=bool)  # starts of candidates one word shorter
            for length in range(1, longest + 1):
                at = part.runs(length)
                if length > 1:
                    at = at[known[at] & known[at + 1]]
                g = part.hashes(at, length, salt)
                hit = _has(bits, g, log2)
                at, g = at[hit], g[hit]
                known = np.zeros(part.n, dtype=bool)
                known[at] = True
                _, one, count = np.unique(g, return_index=True, return_counts=True)
                at = at[one]
                low, high = part.start[at], part.end[at + length - 1]
                kept.append((g[one], count, salt[part.row[at]], length, _texts(part.text, low, high)))
                size += len(one)
            if size >= GATHERED // 4:
                yield from _sent(_joined(kept))
                kept, size = [], 0
        if kept:
            yield from _sent(_joined(kept))

    return task


def _texts(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    size = high - low
    offsets = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=offsets[1:])
    data = values[ranges(low, size)]
    return pa.Array.from_buffers(
        pa.large_string(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    ).cast(pa.string())


def _joined(kept: list[tuple]) -> pa.RecordBatch:
    g = np.concatenate([x[0] for x in kept])
    count = np.concatenate([x[1] for x in kept])
    _, one, back = np.unique(g, return_index=True, return_inverse=True)
    total = np.zeros(len(one), dtype=np.int64)
    np.add.at(total, back, count)
    language = np.concatenate([x[2] for x in kept])
    lengths = np.concatenate([np.full(len(x[0]), x[3], dtype=np.int32) for x in kept])
    return pa.record_batch(
        {
            "language": pa.array(language[one].view(np.int64)),
            "length": pa.array(lengths[one]),
            "phrase": pa.concat_arrays([x[4] for x in kept]).take(pa.array(one)),
            "c": pa.array(total),
        }
    )


def mine_phrases(
    spark: SparkSession,
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    shards: int = SHARDS,
    least: int = LEAST,
    longest: int = LONGEST,
    filter_bits: int = FILTER_BITS,
) -> tuple[DataFrame, DataFrame]:
    """``(lang, length, phrase, f)`` of every phrase of one to ``longest`` words that occurs
    ``least`` times, and ``(lang, n)``, the words of each language."""
    if not (0 < shards <= 1 << SHARD_BITS and least > 0 and longest >= 3 and 8 <= filter_bits <= 34):
        raise ValueError("shards and least must be positive, longest at least 3, filter_bits 8 to 34")
    ship(spark)
    name = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    language = F.shiftrightunsigned(F.xxhash64(name), SHARD_BITS)
    shard = F.pmod(F.xxhash64(F.col(text)), F.lit(shards))
    rows = docs.select(F.shiftleft(language, SHARD_BITS).bitwiseOR(shard).alias("cell"), F.col(text).alias("text"))
    send = spark.sparkContext.broadcast

    def written(df: DataFrame, name: str) -> DataFrame:
        folder = new_folder(spark, f"phrases-{name}")
        df.write.parquet(folder)
        return spark.read.parquet(folder)

    def counted(lengths: tuple[int, ...], bits) -> DataFrame:
        counts = rows.mapInArrow(_local_counts(lengths, bits, filter_bits), "cell long, g long, c long")
        return counts.groupBy("cell", "g").agg(F.sum("c").alias("c"))

    first = written(counted((1,), None), "words")
    sizes = first.groupBy("cell").agg(F.sum("c").alias("own"))
    sizes = sizes.withColumn("language", F.shiftrightunsigned("cell", SHARD_BITS))
    names = docs.select(name.alias("lang"), language.alias("language")).distinct()
    totals = written(
        sizes.groupBy("language").agg(F.sum("own").alias("n")).join(names, "language"), "totals"
    )
    support = written(sizes.join(totals, "language").select("cell", "own", "n"), "sizes")
    wide = lambda c: F.col(c).cast("decimal(20,0)")

    def frequent(counts: DataFrame) -> DataFrame:
        """c >= least * own / n, the support lowered to the shard's part."""
        enough = wide("c") * wide("n") >= wide("own") * F.lit(least).cast("decimal(10,0)")
        return counts.join(support, "cell").where(enough).select("cell", "g")

    local = frequent(first)
    union = [local.select("g")]
    for lengths in ((2,), tuple(range(3, longest + 1))):
        bits = send(_bit_table(local.select(_cell_key().alias("k")), filter_bits))
        local = written(frequent(counted(lengths, bits)), f"local-{lengths[0]}")
        bits.unpersist()
        union.append(local.select("g"))
    candidates = union[0].unionAll(union[1]).unionAll(union[2]).select(F.col("g").alias("k"))
    bits = send(_bit_table(candidates, filter_bits))
    found = rows.mapInArrow(
        _global_counts(longest, bits, filter_bits), "language long, length int, phrase string, c long"
    )
    # A false hit of the bit table occurs fewer than `least` times, like all that no shard proposed.
    found = found.groupBy("language", "length", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    found = found.join(totals.drop("n"), "language").select("lang", "length", "phrase", "f")
    found = written(found, "found")
    bits.unpersist()
    return found, totals.select("lang", "n")


def collocations(
    spark: SparkSession,
    docs: DataFrame,
    *,
    text: str = "text",
    lang: str = "lang",
    shards: int = SHARDS,
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    filter_bits: int = FILTER_BITS,
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``, each language's first ``top``."""
    found, totals = mine_phrases(
        spark, docs, text=text, lang=lang, shards=shards, least=least, longest=longest, filter_bits=filter_bits
    )
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    token = F.split("phrase", " ")
    part = lambda low, n: F.array_join(F.slice(token, low, n), " ")

    # Dropped: phrases inside a longer one that has four fifths of their occurrences.
    inside = F.expr(
        "flatten(transform(sequence(2, length - 1), m -> transform(sequence(1, length - m + 1), "
        "i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    longer = (
        found.where("length > 2")
        .select("lang", F.explode(inside).alias("phrase"), "f")
        .groupBy("lang", "phrase")
        .agg(F.max("f").alias("longer"))
    )
    kept = (
        found.where("length > 1")
        .join(longer, ["lang", "phrase"], "left")
        .where(F.col("longer").isNull() | (wide("longer") * 100 < wide("f") * 80))
        .select("lang", "length", "phrase", F.col("f").alias("a"))
    )
    cuts = kept.select(
        "lang", "phrase", "a", "length", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k")
    ).select(
        "lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"),
        part(F.col("k") + 1, F.col("length")).alias("tail"),
    )
    count = lambda name, as_: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(as_))
    cuts = cuts.join(count("head", "l"), ["lang", "head"]).join(count("tail", "r"), ["lang", "tail"])
    score = F.expr(
        "(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)))"
        " div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"
    )
    best = (
        cuts.withColumn("score", score)
        .groupBy("lang", "phrase", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = lambda df, *by: df.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    ).where(F.col("rank") <= top)
    some = ranked(best.withColumn("part", F.pmod(F.hash("phrase"), F.lit(RANK_PARTS))), "lang", "part")
    return ranked(some.drop("rank", "part"), "lang").join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
