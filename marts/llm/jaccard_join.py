"""Exact self join of documents by Jaccard similarity of word shingles, as components.

Two documents link if they share at least 80 of 100 of their distinct five-word
shingles. The result names each document's component, so a link is looked for only
between documents that are not connected yet.

Documents of natural text are at distance one from all but their own near copies, so
no choice of pivot documents over the whole table separates them: every document would
be a boundary document of every region. Regions are therefore made in two steps, both
exact.

* **Pivot shingles.** Shingles have one total order. A document's prefix are its
  ``n - ceil(0.8 n) + 1`` first ones; linked documents share a shingle in their
  prefixes, and the first one they share leaves room for the overlap they need. A
  region is a pivot shingle with the documents that have it in their prefix. Regions of
  up to ``SMALL`` documents give their candidate pairs. Where a region is larger, its
  shingle goes to the end of the order (a bit in ``BITS`` says so, which is a rule on
  the shingle's hash and so the same for all), and its documents are dealt out again.
* **Pivot documents.** Regions that stay large hold documents that consist of frequent
  shingles: large families of near copies. The most shared document of a family is its
  pivot and is compared to all others first. What is not connected then is divided by
  pivots: Voronoi cells in the Hamming distance of parity sketches (a metric that never
  exceeds the sets' symmetric difference), documents within the triangle inequality's
  window of a border belong to both sides, and large cells are divided again. A region of
  more than ``BLOCK`` documents is dealt out to tasks first: blocks of those outside its largest
  component against blocks of all, each task with cells of its own.

Candidates are pruned by the sketches (a sound bound) and verified on the whole
shingle sets. Equal sets are one row from the start.

Scale: texts are read and hashed once; the sorted hashes of every set are written beside its
id (eight bytes a shingle, once for the copies among ``SEEN`` sets of a task), and all later steps read those.
Texts and hashes go to Python in batches of bounded bytes and are worked on in slices.
They shuffle only for pairs that the sketches leave open, texts never. A pivot shingle's rows are read
as a sorted stream, a third of all documents in one region are at most about a
hundredth of the rows. Filters that go to all tasks have a fixed size, ``BITS`` bits; what they
let through by chance costs time only. Shingles are 64-bit hashes, sets 64-bit digests
that are checked against a second one (a clash takes another seed).

Defined cases: null text and texts without words have no shingles and are linked with
nothing; with fewer than five words the whole sequence is the only shingle; ``doc_id``
may repeat (rows are told apart by their set, a null id has no component); an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marts.llm.arrays import BLANK, LOWER, shingles, text_slices
from marts.llm.components import connected_components
from marts.llm.workers import ship, small_batches
from marts.operators.merge import free_name
from marts.session import new_folder

SIZE = 5
SMALL = 64
LEVELS = 4
BITS = 22
SKETCH_BITS = 8192
CELL = 512
CELL_PIVOTS = 8
#: Bytes of hashes after which a task passes its rows on, and of text that it hashes at once.
HELD_BYTES = 1 << 20
TEXT_BYTES = 1 << 19
#: Rows with their text that a task passes on at once.
PASSED_ROWS = 1_024
#: Sets whose hashes a task knows to be written; beyond it the memory starts anew.
SEEN = 50_000
#: Rows of a region that one task takes; larger regions are dealt out, none is left out.
BLOCK = 16_384


def overlap_needed(a, b):
    """Shared shingles that a link between sets of these sizes takes: 100 i >= 80 u."""
    return -(-4 * (a + b) // 9)


def prefix_length(n):
    return n - -(-4 * n // 5) + 1


def text_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each text with its sorted distinct shingle hashes."""
    for first, data, offsets in text_slices(column, TEXT_BYTES):
        h, bounds, _ = shingles(LOWER[data], ~BLANK[data], offsets, SIZE)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            yield first + i, np.unique(h[a:b])


def set_id(s: np.ndarray, seed: int) -> int:
    return np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes(), seed))).item()


def sketch(s: np.ndarray) -> bytes:
    """Parities of the set's hashes in a power of two of cells, about four a shingle."""
    size = 64
    while size < min(4 * len(s), SKETCH_BITS):
        size *= 2
    cell = ((s >> np.uint64(24)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch_bytes: bytes, size: int) -> np.ndarray:
    """A sketch brought to ``size`` bytes, 64-bit words."""
    x = np.frombuffer(sketch_bytes, dtype=np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


class BitFilter:
    """A set of hashes of which only some bits are kept; never misses a member."""

    def __init__(self, hashes: DataFrame | None = None) -> None:
        self.bits = np.zeros(1 << (BITS - 3), dtype=np.uint8)
        if hashes is not None:
            self.add(hashes)

    def add(self, hashes: DataFrame) -> None:
        """Of the first column; at most ``2 ** BITS`` numbers come to the driver."""
        (name,) = hashes.columns
        bit = F.col(name).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("bit")
        found = hashes.select(bit).distinct().toArrow()["bit"].to_numpy()
        np.bitwise_or.at(self.bits, found >> 3, (1 << (found & 7)).astype(np.uint8))

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bit = (hashes & hashes.dtype.type((1 << BITS) - 1)).astype(np.int64)
        return (self.bits[bit >> 3] >> (bit & 7)) & 1 == 1


def _set_rows(seed: int):
    """Every row's set by id, second digest and size; its hashes with the first of a task's copies."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            rows, held, low = [], 0, 0
            for i, s in text_sets(batch["text"]):
                if len(done) > SEEN:
                    done.clear()
                own = set_id(s, seed) if len(s) else None
                first = own is not None and own not in done
                done.add(own)
                rows.append((own, set_id(s, seed + 1_000_003), len(s), s.tobytes() if first else None))
                held += s.nbytes if first else 0
                if held > HELD_BYTES or i + 1 == batch.num_rows:
                    sid, check, n, hashes = zip(*rows, strict=True)
                    yield pa.record_batch(
                        {
                            "doc_id": batch["doc_id"].slice(low, len(rows)),
                            "sid": pa.array(sid, pa.int64()),
                            "other": pa.array(check, pa.int64()),
                            "n": pa.array(n, pa.int64()),
                            "hashes": pa.array(hashes, pa.binary()),
                        }
                    )
                    rows, held, low = [], 0, i + 1

    return task


def set_table(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, int]:
    """``(doc_id, sid, n, hashes)`` of every row, and the seed for which equal ids mean equal sets.

    ``hashes`` are a set's sorted shingle hashes, eight bytes each; null where another row
    of the same set has them.
    """
    schema = "doc_id long, sid long, other long, n long, hashes binary"
    for seed in itertools.count():
        folder = new_folder(spark, "sets")
        with small_batches(spark):
            rows.mapInArrow(_set_rows(seed), schema).write.parquet(folder)
        sets = spark.read.parquet(folder)
        clash = sets.groupBy("sid").agg(
            (F.min("other") != F.max("other")).alias("c1"), (F.min("n") != F.max("n")).alias("c2")
        )
        if clash.where("sid is not null and (c1 or c2)").isEmpty():
            return sets.select("doc_id", "sid", "n", "hashes"), seed


def _prefix_rows(later: BitFilter, only: BitFilter | None):
    """(h, sid, size and position) of the prefix under the order (later or not, hash)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["sid"].to_numpy()
            rows = np.arange(len(ids)) if only is None else np.flatnonzero(only.has(ids))
            h, size, lengths = [], [], []
            for i in rows.tolist():
                s = np.frombuffer(batch["hashes"][i].as_buffer(), dtype=np.uint64)
                m = prefix_length(len(s))
                last = later.has(s)
                if last.any():
                    s = np.concatenate((s[~last], s[last]))
                h.append(s[:m])
                size.append(len(s))
                lengths.append(m)
            if h:
                m = np.array(lengths)
                position = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                yield pa.record_batch(
                    {
                        "h": np.concatenate(h).view(np.int64),
                        "sid": np.repeat(ids[rows], m),
                        "np": (np.repeat(np.array(size), m) << 32) | position,
                    }
                )

    return task


def _region_pairs(small: int):
    """Candidate pairs of small regions and the rows of large ones, from a sorted stream."""

    def pairs(sid: np.ndarray, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, p = packed >> 32, packed & 0xFFFFFFFF
        i, j = np.triu_indices(len(sid), 1)
        fits = np.minimum(n[i] - p[i], n[j] - p[j]) >= overlap_needed(n[i], n[j])
        i, j = i[fits], j[fits]
        return np.minimum(sid[i], sid[j]), np.maximum(sid[i], sid[j])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        h, sid, packed = none, none, none
        large: int | None = None  # the large region at hand, given out as it comes
        for batch in itertools.chain(batches, (None,)):
            if batch is not None:
                if not batch.num_rows:
                    continue
                h = np.concatenate((h, batch["h"].to_numpy()))
                sid = np.concatenate((sid, batch["sid"].to_numpy()))
                packed = np.concatenate((packed, batch["np"].to_numpy()))
            # Copies of a set have one row for each task that saw them.
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
            h, sid, packed = h[new], sid[new], packed[new]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else none
            ends = np.append(starts[1:], len(h))
            a, b, rows = [none], [none], [none]
            keep = 0 if batch is None else 1
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > small or large == h[s]:
                    large = int(h[s])
                    # The last row stays, to recognise a repeated one.
                    rows.append(np.arange(s, e - (1 if keep and e == len(h) else 0)))
                elif keep and e == len(h):
                    pass
                elif e - s > 1:
                    x, y = pairs(sid[s:e], packed[s:e])
                    a.append(x)
                    b.append(y)
            at = np.concatenate(rows)
            if sum(map(len, a)) or len(at):
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.record_batch(
                    {
                        "h": pa.array(
                            np.concatenate((np.zeros(len(a), np.int64), h[at])),
                            mask=np.concatenate((np.ones(len(a), bool), np.zeros(len(at), bool))),
                        ),
                        "a": np.concatenate((a, sid[at])),
                        "b": np.concatenate((b, sid[at])),
                    }
                )
            if keep and len(starts):
                tail = len(h) - 1 if large == h[-1] else int(starts[-1])
                h, sid, packed = h[tail:], sid[tail:], packed[tail:]

    return task


def _chosen_sets(only: BitFilter, *, sketches: bool):
    """The sets of the filter, with their sketches or with their hashes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = batch.filter(pa.array(only.has(batch["sid"].to_numpy())))
            if sketches:
                bits = [sketch(np.frombuffer(x.as_buffer(), dtype=np.uint64)) for x in taken["hashes"]]
                taken = taken.set_column(2, "sketch", pa.array(bits, pa.binary()))
            yield taken

    return task


def _sketch_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch["n_a"].to_numpy() + batch["n_b"].to_numpy()
        far = np.zeros(len(n), dtype=np.int64)
        for i, (x, y) in enumerate(zip(batch["s_a"].to_pylist(), batch["s_b"].to_pylist(), strict=True)):
            size = min(len(x), len(y))
            far[i] = np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()
        yield batch.select(["a", "b"]).filter(pa.array(9 * far <= n))


def _exact_filter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for a, b in zip(batch["h_a"], batch["h_b"], strict=True):
            x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            linked.append(shared >= overlap_needed(len(x), len(y)))
        yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))


class _Join:
    """One run of the join: every row's set, and the sets with their hashes."""

    def __init__(self, spark: SparkSession, rows: DataFrame) -> None:
        self.spark = spark
        sets, _ = set_table(spark, rows)
        self.sets = sets.drop("hashes")
        self.hashed = sets.where("hashes is not null").select("sid", "n", "hashes")

    def written(self, df: DataFrame, name: str) -> DataFrame:
        folder = new_folder(self.spark, name)
        with small_batches(self.spark):
            df.write.parquet(folder)
        return self.spark.read.parquet(folder)

    def regions(self, later: BitFilter, only: BitFilter | None) -> DataFrame:
        prefixes = self.hashed.mapInArrow(_prefix_rows(later, only), "h long, sid long, np long")
        order = ("h", "np", "sid")
        return self.written(
            prefixes.repartition("h")
            .sortWithinPartitions(*order)
            .mapInArrow(_region_pairs(SMALL), "h long, a long, b long"),
            "regions",
        )

    def candidates(self) -> tuple[DataFrame, DataFrame | None]:
        """Pairs of small regions, and the rows (h, sid) of those that stay large."""
        later, only = BitFilter(), None
        pairs, dense = None, None
        for level in range(LEVELS):
            found = self.regions(later, only)
            own = found.where("h is null").select("a", "b")
            pairs = own if pairs is None else pairs.unionByName(own)
            large = found.where("h is not null").select("h", F.col("a").alias("sid"))
            shingle = large.select("h").distinct()
            if shingle.isEmpty():
                break
            marked = _marked(large, later)
            stay = large if level == LEVELS - 1 else marked.where("marked").drop("marked")
            again = marked.where("not marked").drop("marked")
            dense = stay if dense is None else dense.unionByName(stay)
            if level < LEVELS - 1:
                if again.isEmpty():
                    break
                only = BitFilter(again.select("sid"))
                grown = BitFilter()
                grown.bits = later.bits.copy()
                grown.add(again.select("h"))
                later = grown
        return pairs.distinct(), dense

    def linked(self, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The pairs that are links, and the candidates' sketches.

        Hashes are sent only of sets in a pair that the sketches leave open.
        """
        pairs = self.written(pairs, "pairs")
        sketches = self.chosen(pairs, "sketch")
        side = lambda s: sketches.select(
            F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}")
        )
        near = (
            pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_sketch_filter, "a long, b long")
        )
        near = self.written(near, "near")
        sets = self.chosen(near, "hashes")
        whole = lambda s: sets.select(F.col("sid").alias(s), F.col("hashes").alias(f"h_{s}"))
        exact = (
            near.join(whole("a"), "a").join(whole("b"), "b").mapInArrow(_exact_filter, "a long, b long")
        )
        return self.written(exact, "exact"), sketches

    def chosen(self, pairs: DataFrame, column: str) -> DataFrame:
        """``(sid, n, column)`` of the sets in ``pairs`` (and of those that the filter lets through)."""
        ids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid")))
        task = _chosen_sets(BitFilter(ids), sketches=column == "sketch")
        found = self.hashed.mapInArrow(task, f"sid long, n long, {column} binary")
        return self.written(found.dropDuplicates(["sid"]), f"chosen-{column}")

    def links(self) -> DataFrame:
        pairs, dense = self.candidates()
        if dense is None or dense.isEmpty():
            return self.linked(pairs)[0]
        # The pivot of a large region is the document that most large regions share.
        dense = self.written(dense.distinct(), "dense")
        shares = dense.groupBy("sid").agg(F.count(F.lit(1)).alias("w"))
        pivots = dense.join(shares, "sid").groupBy("h").agg(F.max(F.struct("w", "sid")).alias("p"))
        star = dense.join(pivots.select("h", F.col("p.sid").alias("pivot")), "h").select(
            F.least("sid", "pivot").alias("a"), F.greatest("sid", "pivot").alias("b")
        )
        links, sketches = self.linked(pairs.unionByName(star.where("a <> b")).distinct())
        # Between documents of a large region that are not connected yet, the join by
        # pivot documents finds every pair that the sketches leave open.
        comp = connected_components(self.spark, links)
        open_rows = (
            dense.join(comp.withColumnRenamed("id", "sid"), "sid", "left")
            .select("h", "sid", F.coalesce("component", "sid").alias("comp"))
        )
        # All large regions of a document: a pair is given out by its least common one.
        homes = dense.groupBy("sid").agg(F.collect_list("h").alias("homes"))
        region = _blocks(open_rows).join(sketches, "sid").join(homes, "sid")
        rest = region.groupBy("h", "few", "many").applyInArrow(_cell_pairs, "a long, b long").distinct()
        rest = self.written(rest, "cells")
        if rest.isEmpty():
            return links
        return links.unionByName(self.linked(rest)[0])


def _marked(large: DataFrame, later: BitFilter) -> DataFrame:
    """Rows with whether their shingle is among the later ones already."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch(
                [*batch.columns, pa.array(later.has(batch["h"].to_numpy()))], names=["h", "sid", "marked"]
            )

    return large.mapInArrow(task, "h long, sid long, marked boolean")


#: Places of a row in a task of a region: the region is whole, or it was dealt out and the
#: row is one of the open ones to compare, one of the largest component, or another open one.
_WHOLE, _OPEN, _LARGEST, _OTHER = range(4)


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows ``(h, sid, comp)`` of regions that are not connected, dealt out to tasks.

    A region of up to ``BLOCK`` rows is one task. In others nothing is open inside the
    largest component: blocks of the rows outside it meet blocks of all rows.
    """
    sizes = rows.groupBy("h", "comp").agg(F.count(F.lit(1)).alias("size"))
    regions = (
        sizes.groupBy("h")
        .agg(F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("all"))
        .where("all > top.size")
        .select(
            "h",
            F.col("top.comp").alias("largest"),
            F.ceil(F.col("all") / BLOCK).cast("int").alias("n_many"),
            F.ceil((F.col("all") - F.col("top.size")) / BLOCK).cast("int").alias("n_few"),
        )
    )
    many = F.pmod(F.xxhash64("sid"), F.col("n_many")).cast("int")
    few = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("n_few")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = rows.join(regions, "h")
    outside = F.col("comp") != F.col("largest")
    place = F.when(F.col("n_many") == 1, _WHOLE).when(outside, _OTHER).otherwise(_LARGEST)
    # Each row once for every block of open rows; open rows also for every block of all.
    as_many = dealt.select("h", "sid", "comp", place.alias("place"), every("n_few").alias("few"), many.alias("many"))
    as_few = dealt.where(outside & (F.col("n_many") > 1)).select(
        "h", "sid", "comp", F.lit(_OPEN).alias("place"), few.alias("few"), every("n_many").alias("many")
    )
    return as_many.unionByName(as_few)


_CELL_WORDS = 16


def _cell_pairs(region: pa.Table) -> pa.Table:
    """Open pairs of a region's task: not connected, and not ruled out by size or sketch."""
    sid, comp, n, place = (region[c].to_numpy() for c in ("sid", "comp", "n", "place"))
    h = region["h"][0].as_py()
    homes = [set(x) for x in region["homes"].to_pylist()]
    bits = np.zeros((len(sid), _CELL_WORDS), dtype=np.uint64)
    words = np.zeros(len(sid), dtype=np.int64)
    for i, s in enumerate(region["sketch"].to_pylist()):
        x = folded(s, 8 * _CELL_WORDS)
        words[i] = len(x)
        bits[i, : len(x)] = x
    out: set[tuple[int, int]] = set()
    # Linked sets' sketches have one width, or one twice the other's: compared at the less.
    for width in np.unique(words).tolist():
        rows = np.flatnonzero((words == width) | (words == 2 * width))
        view = bits[rows, :width].copy()
        if 2 * width <= _CELL_WORDS:
            view ^= bits[rows, width : 2 * width]
        for i, j in metric_pairs(view, n[rows], comp[rows]):
            # Two open rows meet again the other way round, pairs of one place in another task.
            first, second = sorted((rows[i], rows[j]), key=lambda x: place[x])
            if place[first] == _WHOLE:
                pass
            elif place[first] != _OPEN or place[second] == _OPEN:
                continue
            elif place[second] == _OTHER and sid[first] > sid[second]:
                continue
            if min(homes[rows[i]] & homes[rows[j]]) == h:
                a, b = sid[rows[i]], sid[rows[j]]
                out.add((min(a, b), max(a, b)))
    return pa.table(
        {
            "a": pa.array([x for x, _ in out], pa.int64()),
            "b": pa.array([y for _, y in out], pa.int64()),
        }
    )


def metric_pairs(bits: np.ndarray, n: np.ndarray, comp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of different components with Hamming distance within a ninth of their sizes' sum."""
    work = [np.arange(len(n))]
    while work:
        rows = work.pop()
        names, counts = np.unique(comp[rows], return_counts=True)
        if len(names) < 2:
            continue
        cells = _cells(bits, rows, 2 * int(n[rows].max()) // 9) if len(rows) > CELL else None
        if cells is not None:
            work += cells
            continue
        # Nothing is open inside the largest component.
        most = comp[rows] == names[counts.argmax()]
        few, many = rows[~most], rows[most]
        for k, row in enumerate(few.tolist()):
            others = np.concatenate((few[k + 1 :], many))
            others = others[comp[others] != comp[row]]
            far = np.bitwise_count(bits[others] ^ bits[row]).sum(axis=1, dtype=np.int64)
            for j in others[9 * far <= n[others] + n[row]].tolist():
                yield row, j


def _cells(bits: np.ndarray, rows: np.ndarray, reach: int) -> list[np.ndarray] | None:
    """Voronoi cells of far-apart pivots, each with the rows whose partners may be in it.

    A partner within ``reach`` of a row in cell p is nearer to p than to its own pivot
    but for twice the reach. None if the cells would not be smaller.
    """
    distance = []
    pivot = rows[0]
    for _ in range(CELL_PIVOTS):
        distance.append(np.bitwise_count(bits[rows] ^ bits[pivot]).sum(axis=1, dtype=np.int64))
        pivot = rows[int(np.min(distance, axis=0).argmax())]
    table = np.array(distance)
    inside = table <= table.min(axis=0) + 2 * reach
    sizes = inside.sum(axis=1)
    if sizes.max() > 0.8 * len(rows) or sizes.sum() > 4 * len(rows):
        return None
    return [rows[cell] for cell in inside if cell.sum() > 1]


def near_components(
    spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``."""
    ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    join = _Join(spark, rows)
    comp = connected_components(spark, join.links()).withColumnRenamed("id", "sid")
    least = join.sets.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("least"))
    labels = least.join(comp, "sid", "left").select(
        "sid", "least", F.coalesce("component", "sid").alias("component")
    )
    named = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    # A hot set is one row in ``labels``: adaptive execution splits the other side.
    labels = labels.join(named, "component").select("sid", "component_id")
    return join.sets.join(labels, "sid", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def drop_near_copies(
    spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each component of ``docs``: the one with the least id, null ids last.

    A row is told by its id and text, so rows that share an id are judged each by its own
    text, and of repeated rows one stays. Rows without a word are linked with nothing and
    all stay. Only rows that may be dropped or repeated shuffle with their text: a
    filter of fixed size lets all others pass where they are.
    """
    names = (free_name(n, docs.columns) for n in ("_row", "_worded", "_gone", "_gone_id"))
    row, worded, gone, gone_id = names
    number = F.col(key).cast("long")
    body = F.coalesce(F.col(text), F.lit(""))
    told = docs.select(
        "*",
        F.xxhash64(number, body).alias(row),
        F.coalesce(body.rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias(worded),
    )
    found = near_components(spark, told, key=row, text=text).where("n_shingles > 0")
    found = found.groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count(F.lit(1)).alias("n"))
    ids = told.where(F.col(worded)).select(F.col(row).alias("doc_id"), number.alias("id")).distinct()
    # Of a hot component's rows each task sends the least only.
    place = F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")
    placed = ids.join(found, "doc_id").select("doc_id", "id", "component", "n", place.alias("place"))
    folder = new_folder(spark, "near-rows")
    placed.write.parquet(folder)
    placed = spark.read.parquet(folder)
    first = placed.groupBy("component").agg(F.min("place").alias("first"))
    judged = placed.join(first, "component").select(
        F.col("doc_id").alias(gone), F.col("id").alias(gone_id), (F.col("place") != F.col("first")).alias("drop"), "n"
    )
    folder = new_folder(spark, "dropped")
    judged.where("drop OR n > 1").write.parquet(folder)
    marked = spark.read.parquet(folder)
    suspects = BitFilter(marked.select(F.col(gone).alias("doc_id")))
    at, has_word = len(docs.columns), len(docs.columns) + 1

    def chosen(suspect: bool):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                open_ = suspects.has(batch.column(at).to_numpy())
                open_ &= batch.column(has_word).to_numpy(zero_copy_only=False)
                taken = pa.array(open_ == suspect)
                for low in range(0, batch.num_rows, PASSED_ROWS):
                    yield batch.slice(low, PASSED_ROWS).filter(taken.slice(low, PASSED_ROWS))

        return told.mapInArrow(task, told.schema)

    checked = chosen(True)
    same = (F.col(row) == F.col(gone)) & number.eqNullSafe(F.col(gone_id))
    left = checked.join(marked.where("drop").select(gone, gone_id), same, "left_anti")
    left = left.withColumn(gone_id, number).dropDuplicates([row, gone_id])
    return chosen(False).select(*docs.columns).unionByName(left.select(*docs.columns))
