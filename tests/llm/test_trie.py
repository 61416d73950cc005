"""The conversation trie against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marts.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, path string, part int, key string, ends int"


def brute(rows, group=100):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((t is not None, t or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - c % group, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        parts = [below(x) for x in children[node]]
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        return sum(x[0] for x in parts) or 1, saved + sum(x[1] for x in parts)

    out = []
    for node, m in members.items():
        ends = sorted(c for c in m if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(m), len(node), parent, len(m), len(children[node]), *below(node), digest))
    return sorted(out, key=repr)


def trie(spark, rows):
    given = spark.createDataFrame([(*r, "x", 1, "x", 1) for r in rows], TURNS).repartition(3)
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    rebuilt = prefix_trie.with_shared_heads(prefix_trie.turn_sequences(given), 100, shared, most=5)
    return sorted((tuple(r) for r in prefix_trie.trie_nodes(spark, rebuilt).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("ranges", [1, 23])
def test_every_node_equals_brute_force(spark, seed, ranges):
    """Copies, prefixes of each other, one hot first turn, ties and nulls, over many ranges."""
    rnd = random.Random(seed)
    texts = [["", "x", "yé", None], ["same"], ["a", "b"], ["long " * 50, "hot", "hot", "hot"]][seed]
    rows = [
        (c, rnd.choice([t, t, None]), rnd.choice(["user", None]), rnd.choice(texts))
        for c in range(250)
        if c % 7
        for t in range(rnd.choice([1, 2, 3, 9]))
    ]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_tables(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "x")]) == []
    repeated = [(3, 0, "user", "x")] * 3 + [(100, None, None, None), (100, 0, "user", "x")]
    assert trie(spark, repeated) == brute(repeated)
    # No base and fewer turns than are shared: a member of the root without turns.
    alone = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    assert [r[:5] for r in trie(spark, [(alone, 0, "user", "x")])] == [(alone, 0, None, 1, 0)]


def test_common_prefixes():
    a = bytes(range(64))
    assert prefix_trie._common(a, a) == 4
    assert prefix_trie._common(a[:32], a) == 2
    assert prefix_trie._common(a[:31] + b"x" + a[32:], a) == 1
    assert prefix_trie._common(b"", a) == 0
