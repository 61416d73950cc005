"""Prefix trie of conversations from sorted neighbours and union-find.

A conversation is a sequence of turns (role, text). Every distinct sequence of first
``d`` turns is a node; its members are the conversations that start with it.

Turns become 16-byte digests; a conversation's key is its digests, one after the
other. Conversations are range-sorted by (key, id), copies next to each other, and the
common depth of neighbours is the length of their keys' common prefix. Each range is
one task: union-find takes the edges between neighbours in descending depth, and every
merge of components creates a branching node (copies merge at their own full depth).
Nodes between two branching nodes have the members of the lower one.

A range's forest is contracted to the nodes that may reach into another range: the
prefixes of its first and last key. All others are final where they are made. The
contracted nodes of all ranges meet by the digest of their path. Counts add up; what
two ranges both counted (a node that the range before also has, a last leaf that the
next range extends) is taken off with the common depth of the two keys at each border.

Scale: one shuffle of 20 bytes a turn and no text. Copies of one conversation spread
over ranges like any other rows, and a hot first turn is just a node that many ranges
have: one contracted row from each. A range holds its keys in memory, so it is as large
as a shuffle partition. Members that end at a node are sent as one text per range
and hashed as a sorted stream, never gathered. One conversation is one value: its
digests (16 bytes a turn) have to fit a row.

Defined cases: null role and text are empty; turns are ordered by turn (null first),
equal ones by digest, and repeated rows stay; rows with a null conversation id belong
to no conversation and are left out; a conversation without turns is a member of the
root; an empty table gives no node. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain, islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marts.llm.workers import ship
from marts.session import new_folder

WIDTH = 16

_NODES = (
    "kind string, part int, path binary, parent binary, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, weight long, own long, ends string, "
    "on_first boolean, on_last boolean, key binary, before array<long>"
)
_SCHEMA = pa.schema(
    [("kind", pa.string()), ("part", pa.int32()), ("path", pa.binary()), ("parent", pa.binary())]
    + [(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children")]
    + [(c, pa.int64()) for c in ("n_leaves", "weight", "own")]
    + [("ends", pa.string()), ("on_first", pa.bool_()), ("on_last", pa.bool_())]
    + [("key", pa.binary()), ("before", pa.list_(pa.int64()))]
)


def turn_sequences(
    conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``(conv_id, turns)``: turns as an ordered array of ``(digest, chars)``."""
    empty = F.lit("")
    who, said = F.coalesce(F.col(role), empty), F.coalesce(F.col(text), empty)
    # The length in front keeps ("a", "bc") and ("ab", "c") apart.
    digest = F.unhex(F.md5(F.concat(F.length(who).cast("string"), F.lit(":"), who, said).cast("binary")))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.struct(
            F.col(turn).isNotNull().alias("has"),
            F.col(turn).alias("turn"),
            digest.alias("digest"),
            F.length(said).cast("int").alias("chars"),
        ).alias("row"),
    )
    ordered = F.transform(F.sort_array(F.collect_list("row")), lambda t: F.struct(t["digest"], t["chars"]))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def with_shared_heads(sequences: DataFrame, group: int, shared: Column, most: int) -> DataFrame:
    """Rebuild each conversation: the first ``shared`` (at most ``most``) turns of its group's
    first conversation, ``conv_id - conv_id % group``, then its own behind its first ``shared``."""
    heads = sequences.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head")
    )
    none = F.slice("turns", 1, 0)
    count = shared.cast("int")
    return (
        sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
        .join(heads, "base", "left")
        .select(
            "conv_id",
            F.concat(
                F.slice(F.coalesce("head", none), F.lit(1), count),
                F.slice("turns", count + 1, F.size("turns")),
            ).alias("turns"),
        )
    )


def _common(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    low, high = 0, n // WIDTH  # a[:low] equal, a[:high] not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low * WIDTH : mid * WIDTH] == b[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid
    return low


class _Forest:
    """Compressed trie of one sorted range of keys, by union-find over neighbours."""

    def __init__(self, keys: list[bytes]) -> None:
        n = len(keys)
        self.depth = [len(k) // WIDTH for k in keys]
        self.low, self.high = list(range(n)), list(range(1, n + 1))  # rows of a node
        self.children: list[list[int]] = [[] for _ in range(n)]
        edges = [_common(keys[i], keys[i + 1]) for i in range(n - 1)]
        leader, top = list(range(n)), list(range(n))

        def find(i: int) -> int:
            while leader[i] != i:
                leader[i] = leader[leader[i]]
                i = leader[i]
            return i

        for i in sorted(range(n - 1), key=lambda i: (-edges[i], i)):
            a, b, d = find(i), find(i + 1), edges[i]
            x, y = top[a], top[b]
            if self.depth[x] == d:  # deeper or equal parts only: the node is there already
                if self.depth[y] == d:
                    self.children[x] += self.children[y]
                else:
                    self.children[x].append(y)
                node = x
            elif self.depth[y] == d:
                self.children[y].insert(0, x)
                node = y
            else:
                node = len(self.depth)
                self.depth.append(d)
                self.low.append(0)
                self.high.append(0)
                self.children.append([x, y])
            self.low[node], self.high[node] = self.low[x], self.high[y]
            leader[b] = a
            top[a] = node
        self.root = top[find(0)] if n else -1


def _range_nodes(part: int, ids: list[int], keys: list[bytes], chars: list[list[int]]) -> Iterator[dict]:
    """All nodes of a range: final ones, and contracted ones along its two borders."""
    forest = _Forest(keys)
    first, last = keys[0], keys[-1]
    order, todo = [], [(forest.root, -1)]
    while todo:
        node, above = todo.pop()
        order.append((node, above))
        todo += [(c, node) for c in forest.children[node]]
    order.reverse()  # children first
    size = len(forest.depth)
    smallest, leaves, weight, own = [0] * size, [0] * size, [0] * size, [0] * size
    ends: list[list[int]] = [[] for _ in range(size)]
    for node, _ in order:
        at, bytes_here = forest.low[node], forest.depth[node] * WIDTH
        while at < forest.high[node] and len(keys[at]) == bytes_here:
            ends[node].append(ids[at])
            at += 1
        smallest[node] = min(ends[node][:1] + [smallest[c] for c in forest.children[node]])
    for node, above in order:
        below, key, sizes = forest.children[node], keys[forest.low[node]], chars[forest.low[node]]
        n, d = forest.high[node] - forest.low[node], forest.depth[node]
        start = forest.depth[above] if above >= 0 else -1
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        weight[node], own[node] = sum(weight[c] for c in below), sum(own[c] for c in below)
        to_first, to_last = _common(key, first), _common(key, last)
        kept = max(to_first, to_last)
        paths = _paths(key, start, min(d, kept)) if kept >= start else {}
        for at in range(d, start, -1):
            if at:
                weight[node] += n * sizes[at - 1]
                own[node] += sizes[at - 1]
            border = at <= kept
            held = at and at - 1 <= kept  # another range may have the parent
            ending = ",".join(map(str, ends[node])) if at == d else ""
            yield {
                "kind": "border" if border else "final",
                "part": part,
                "path": paths[at] if border else None,
                "parent": paths[at - 1] if held else None,
                "conv_id": smallest[node],
                "depth": at,
                # The node one turn up is in the same chain, or the branching node above.
                "parent_conv_id": None if not at or held else smallest[node if at - 1 > start else above],
                "n_convs": n,
                "n_children": len(below) if at == d else 1,
                "n_leaves": leaves[node],
                "weight": weight[node],
                "own": own[node],
                "ends": (ending or None) if border else hashlib.sha256(ending.encode()).hexdigest(),
                "on_first": at <= to_first,
                "on_last": at <= to_last,
            }


def _paths(key: bytes, low: int, high: int) -> dict[int, bytes]:
    """Digests of the first ``d`` turns for ``d`` from ``low`` (0 if less) to ``high``."""
    low = max(low, 0)
    h = hashlib.md5(key[: low * WIDTH])
    out = {low: h.digest()}
    for d in range(low + 1, high + 1):
        h.update(key[(d - 1) * WIDTH : d * WIDTH])
        out[d] = h.digest()
    return out


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int] = []
    keys: list[bytes] = []
    chars: list[list[int]] = []
    for batch in batches:
        ids += batch["conv_id"].to_pylist()
        keys += batch["key"].to_pylist()
        chars += batch["chars"].to_pylist()
    if not ids:
        return
    part = TaskContext.get().partitionId()
    before = [0, *accumulate(chars[0])]
    # The range's borders: its first key with the characters along it, and its last key.
    borders = [
        {"kind": "first", "part": part, "key": keys[0], "before": before},
        {"kind": "last", "part": part, "key": keys[-1]},
    ]
    rows = chain(borders, _range_nodes(part, ids, keys, chars))
    while some := list(islice(rows, 10_000)):
        yield pa.RecordBatch.from_pylist(some, schema=_SCHEMA)


def _stream_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per path of its sorted pieces, which arrive as a stream."""
    now, h = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for path, piece in zip(batch["path"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if path != now:
                if h is not None:
                    done.append((now, h.hexdigest()))
                now, h = path, hashlib.sha256(piece.encode())
            else:
                h.update(b"," + piece.encode())
        yield _digests(done)
    if h is not None:
        yield _digests([(now, h.hexdigest())])


def _digests(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "path": pa.array([r[0] for r in rows], pa.binary()),
            "ends_sha256": pa.array([r[1] for r in rows], pa.string()),
        }
    )


def trie_nodes(spark: SparkSession, sequences: DataFrame) -> DataFrame:
    """Every node of the trie of ``sequences(conv_id, turns array<(digest, chars)>)``.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the
    root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256`` (of the members that end here, ascending, comma-joined).
    """
    ship(spark)
    keyed = sequences.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("key"),
        F.transform("turns", lambda t: t["chars"]).alias("chars"),
    )
    folder = new_folder(spark, "trie")
    # Written for every reader below: ranges must not be cut anew for each of them.
    (
        keyed.repartitionByRange("key", "conv_id")
        .sortWithinPartitions("key", "conv_id")
        .mapInArrow(_mine, _NODES)
        .write.parquet(folder)
    )
    made = spark.read.parquet(folder)
    merged = _merged_borders(made)
    folder = new_folder(spark, "trie-borders")
    merged.write.parquet(folder)
    merged = spark.read.parquet(folder)
    above = merged.select(F.col("path").alias("parent"), F.col("conv_id").alias("above"))
    rows = (
        made.where("kind = 'final'")
        .select(*(c for c in merged.columns if c not in ("ends_sha256", "path")), F.col("ends").alias("ends_sha256"))
        .unionByName(merged.drop("path"))
    )
    shown = lambda df, parent: df.select(
        "conv_id",
        "depth",
        parent.alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("weight") - F.col("own")).alias("saved_tokens"),
        "ends_sha256",
    )
    joined = shown(rows.where("parent is not null").join(above, "parent"), F.col("above"))
    return joined.unionByName(shown(rows.where("parent is null"), F.col("parent_conv_id")))


def _merged_borders(made: DataFrame) -> DataFrame:
    """The contracted nodes of all ranges, each once."""
    # Where two ranges meet: one row a range.
    lasts = made.where("kind = 'last'").select("part", F.col("key").alias("last"))
    line = Window.orderBy("part")
    edges = made.where("kind = 'first'").select("part", F.col("key").alias("first"), "before").join(lasts, "part")
    edges = edges.select(
        "part", "before", "last", F.lag("last").over(line).alias("left"), F.lead("first").over(line).alias("right"), "first"
    ).select(
        "part",
        "before",
        # The depth down to which the range before has the first key's nodes.
        F.when(F.col("left").isNull(), -1).otherwise(_depth_in_common("left", "first")).alias("seen"),
        # The last key's leaf is none if the next range has it again or goes on from it.
        F.coalesce(F.startswith("right", "last"), F.lit(False)).alias("goes_on"),
    )
    upto = lambda d: F.element_at("before", d.cast("int") + 1)
    less = lambda when, n: F.when(when, n).otherwise(0)
    seen, depth = F.col("seen"), F.col("depth")
    twice = upto(seen) - upto(F.greatest(depth - 1, F.lit(0)))
    border = made.where("kind = 'border'")
    merged = (
        border.drop("before")
        .join(edges, "part")
        .select(
            "path",
            "parent",
            "conv_id",
            "depth",
            "n_convs",
            (F.col("n_children") - less(F.col("on_first") & (depth < seen), 1)).alias("n_children"),
            (F.col("n_leaves") - less(F.col("on_last") & F.col("goes_on"), 1)).alias("n_leaves"),
            "weight",
            (F.col("own") - less(F.col("on_first") & (depth <= seen), twice)).alias("own"),
        )
        .groupBy("path")
        .agg(
            F.min("parent").alias("parent"),
            F.min("conv_id").alias("conv_id"),
            F.min("depth").alias("depth"),
            F.lit(None).cast("long").alias("parent_conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "weight", "own")),
        )
    )
    pieces = border.where("ends is not null").select("path", "part", "ends")
    hashed = (
        pieces.repartition("path")
        .sortWithinPartitions("path", "part")
        .mapInArrow(_stream_ends, "path binary, ends_sha256 string")
    )
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256))
    return merged.join(hashed, "path", "left").withColumn("ends_sha256", digest)


def _depth_in_common(a: str, b: str) -> Column:
    """Turns that two keys have in common at their start."""
    one = lambda key, d: F.substring(F.col(key), (d - 1) * WIDTH + 1, F.lit(WIDTH))
    n = (F.least(F.octet_length(a), F.octet_length(b)) / WIDTH).cast("int")
    same = F.transform(F.sequence(F.lit(1), n + 1), lambda d: (d <= n) & (one(a, d) == one(b, d)))
    return (F.array_position(same, False) - 1).cast("int")
