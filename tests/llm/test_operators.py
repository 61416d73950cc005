"""The corpus operators against brute force, on small tables with all odd cases."""

from __future__ import annotations

import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marts.llm import (
    chat,
    decontaminate,
    exact_dedup,
    jaccard_join,
    language_id,
    packing,
    pii,
    queries,
    substring_repeats,
    tokens,
    trees,
    warc,
    workers,
)
from marts.llm.components import connected_components
from marts.llm.suffix_array import join_texts, repeated_starts, suffix_array
from marts.llm.tokens import WordTokenizer

DOCS = "doc_id long, text string, lang string, leaks string, base int, h string"


def docs(spark, texts, ids=None, lang="en"):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang, "clash", 1, "clash") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# -- op1


def turns_of(data):
    out = {}
    for conv, turn, role, text in data:
        out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in out.items()}


def test_chat_windows_hold_every_turn_once(spark):
    rng = random.Random(1)
    odd = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\s> [ROLE]", "", None, "é漢 \U0001f600\n", "\\[/\\ROLE]"]
    data = [(1, 0, "system", "be [INST] kind"), (2, None, None, None), (3, 5, "assistant", "a")]
    data += [(4, i, rng.choice(["user", "assistant", "tool"]), rng.choice(odd)) for i in range(200)]
    data += [(1, i, ("user", "assistant")[i % 2], "word " * rng.randint(0, 40)) for i in range(1, 90)]
    data += [(5, 1, "user", "same"), (5, 1, "user", "same"), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(4)
    windows = chat.chat_windows(df, budget=200, history=40, reserve=60).cache()
    got = {r.conv_id: r for r in chat.read_back(windows).collect()}
    want = turns_of(data)
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in turns))
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(learnt), sha(learnt))
    # Within the budget, but for turns that alone are longer than the reserve.
    assert windows.where("conv_id in (1, 4) and n_tokens > 200").count() == 0
    later = windows.where("conv_id = 1 and window > 0").collect()
    assert later and all(r.text.startswith("<s>[ROLE]system[/ROLE]be [\\INST] kind</s>") for r in later)
    assert any(r.new_at > len("<s>[ROLE]system[/ROLE]be [\\INST] kind</s>") for r in later)


def test_chat_windows_keep_the_budget_with_long_turns(spark):
    rng = random.Random(7)
    data, system, turns = [], {}, {}
    given = [(1300, [254, 504]), (0, [100, 150, 1904]), (1280, [40] * 9 + [700, 40, 740])]
    given += [
        (rng.choice([0, 5, 300, 1279, 1300]), [rng.randint(4, rng.choice([60, 600, 1900])) for _ in range(30)])
        for _ in range(12)
    ]
    for conv, (head, sizes) in enumerate(given):
        told = ([("system", head)] if head else []) + [(("user", "assistant")[i % 2], n) for i, n in enumerate(sizes)]
        system[conv], turns[conv] = head, told
        data += [(conv, i, role, f"t{i} " + "w " * (n - chat.MARK_TOKENS - 1)) for i, (role, n) in enumerate(told)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    windows = chat.chat_windows(df).collect()
    repeats = 0
    for w in windows:
        head = system[w.conv_id] if w.window else 0
        new = w.text[w.new_at :].count("</s>")
        if w.n_tokens > chat.BUDGET:
            # One new turn that does not fit beside the system turn, with no history.
            assert new == 1 and w.n_turns == 1 + (head > 0)
        repeats += w.n_turns - new > (head > 0)
    assert repeats > 20
    got = {r.conv_id: r for r in chat.read_back(chat.chat_windows(df)).collect()}
    for conv, told in turns.items():
        assert got[conv].n_turns == len(told)


def test_chat_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.chat_windows(none)).count() == 0


# -- op2


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        out.append((len(t), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), kept))
    return out


@pytest.mark.parametrize("most_variants", [4000, 1])
def test_repeats_match_brute_force(spark, most_variants):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(3)]
    texts = [None, "", "a" * 450, shared[0], text(200), text(200)]
    for _ in range(25):
        texts.append(text(rng.randint(0, 40)) + rng.choice(shared) + text(rng.randint(0, 40)))
    texts += [texts[-1], texts[-2][:300]]
    ids = [*range(len(texts) - 3), None, None, 0]
    df = docs(spark, texts, ids)
    got = substring_repeats.remove_repeats(spark, df, most_variants=most_variants, bucket_bytes=4000)
    got = rows(got.withColumn("n", F.size("spans")), "doc_id", "n_bytes", "n_removed", "n", "kept")
    want = [(i, *x) for i, x in zip(ids, brute_repeats(texts, 200), strict=True)]
    assert [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got] == sorted(want, key=repr)


def test_of_equal_segments_one_is_sent():
    anchor, c1, c2 = (np.array(x) for x in ([7, 7, 7, 9, 7, 7], [1, 1, 2, 1, 1, 2], [5, 5, 5, 5, 5, 6]))
    found = substring_repeats._copies(anchor, c1, c2)
    assert found["copied"].tolist() == [True, False, False, False, False, False]
    assert found["settled"].tolist() == [False, True, False, False, True, False]
    none = np.zeros(0, np.int64)
    assert [len(x) for x in substring_repeats._copies(none, none, none).values()] == [0, 0]


def test_repeats_empty_table(spark):
    assert substring_repeats.remove_repeats(spark, docs(spark, [])).count() == 0


def test_suffix_array_order():
    rng = random.Random(3)
    for alphabet in (b"ab", b"abcd\x00\xf4"):
        for _ in range(50):
            texts = [bytes(rng.choices(alphabet, k=rng.randint(0, 50))) for _ in range(rng.randint(1, 5))]
            text, _ = join_texts(texts)
            raw = text.tobytes()
            order = suffix_array(text, 512).tolist()
            assert sorted(order) == list(range(len(raw)))
            suffix = [raw[i:].ljust(512, b"\0") for i in order]
            assert suffix == sorted(suffix)
            seen = Counter(t[i : i + 8] for t in texts for i in range(len(t) - 7))
            for t, at in zip(texts, repeated_starts(texts, 8), strict=True):
                assert at.tolist() == [i for i in range(len(t) - 7) if seen[t[i : i + 8]] > 1]


# -- op3


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return out


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    bits = ["a.b@c.de", "@", "1.2.3.4", ".5", "256.1.1.1", "4111 1111 1111 1111", "-", " ", "+49 (30) 1234567", "x", "9", "é", "+", "a@b", ".c"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 12)))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("1" * 200_000 + "." * 3 + "@" * 1000) == []


def test_pii_query_keeps_base_spans(spark, small):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, small, "documents").collect()}
    found = {r.doc_id: r for r in queries.QUERIES["op3_pii"](spark, small).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        base = brute_base(text)
        assert found[i].base_sha256 == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base))
        spans = set(found[i].spans.split(",")) - {""}
        assert {f"{k}:{s}:{e}" for k, s, e in base} <= spans
        assert found[i].n_email == sum(b[0] == "email" for b in base)


def test_boosted_proposals_learn_and_odd_rows_pass(spark):
    rng = random.Random(5)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    good = [f"call +49 30 {digits(7)} now" for _ in range(300)]
    bad = [f"order {digits(9)} sent" for _ in range(300)]
    table = docs(spark, [*good, *bad, None, "", good[0]])
    model = pii.learn(table)
    assert "phone" in model
    assert pii.added_spans(f"order {digits(9)} sent", [], model) == []
    found = pii.find(table.drop("base"), model)
    assert found.count() == 603 and "h" in found.columns
    assert pii.redact("a@b.cd is +49 1", [("email", 0, 6)]) == "[EMAIL] is +49 1"
    assert pii.find(docs(spark, []), model).count() == 0 and pii.learn(docs(spark, [])) == {}


def test_neighbouring_numbers_are_proposed_and_found(spark):
    two = "7536784127813050 4845168114407329"
    assert {("card", 0, 16), ("card", 17, 33)} <= set(pii.proposals(two))
    near = "+1 (826) 555-4081 190.137.223.204"
    assert ("phone", 0, 17) in pii.proposals(near) and ("ip", 18, 33) in pii.proposals(near)
    assert not [s for s in pii.proposals("1" * 100_000) if s[0] != "email"]
    rng = random.Random(6)
    numbers = ["".join(rng.choices("0123456789", k=16)) for _ in range(4000)]
    table = docs(spark, [f"card {n} paid" for n in numbers])
    model = pii.learn(table)
    assert pii.base_spans(two) == []
    assert {("card", 0, 16), ("card", 17, 33)} <= set(pii.added_spans(two, [], model))


def test_all_rows_are_learnt_from(spark):
    """Proposals of a label that only one text in a thousand holds, and copies, which count once."""
    rng = random.Random(7)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    plain = [f"nothing here {i}" for i in range(30_000)]
    good = [f"call +49 30 {digits(7)} now" for _ in range(30)]
    bad = [f"order {digits(9)} sent" for _ in range(30)]
    assert "phone" in pii.learn(docs(spark, [*plain, *good, *bad]))
    assert pii.learn(docs(spark, [good[0]] * 200 + [bad[0]] * 200)) == {}


def test_boosted_trees_do_not_depend_on_the_layout(spark):
    rng = random.Random(8)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    texts = [f"call +49 30 {digits(7)} now" for _ in range(60)] + [f"order {digits(9)} sent" for _ in range(60)]
    one, other = (pii.learn(docs(spark, t).repartition(k)) for t, k in ((texts, 1), (texts[::-1], 7)))
    assert one.keys() == other.keys() == {"phone"}
    x = np.array([pii.features(t, s) for t in texts for s in pii.proposals(t)])
    assert (one["phone"][0].probability(x) == other["phone"][0].probability(x)).all()
    assert one["phone"][1] == other["phone"][1]


def test_counted_quantiles_are_those_of_the_rows():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 60, 5000) / 7
    want = np.unique(np.quantile(x, np.linspace(0, 1, trees.BINS)[1:-1]))
    assert np.allclose(trees.quantile_edges(*np.unique(x, return_counts=True)), want)


def test_of_overlapping_numbers_the_fewest_stay():
    near = "+1 (826) 555-4081 190.137.223.204"
    scored = [(s, 0.9) for s in pii.proposals(near)]
    assert pii._fewest(near, pii.base_spans(near), scored) == [("phone", 0, 17)]
    scored = [(s, 0.95 if s == ("phone", 0, 12) else 0.9) for s in pii.proposals(near)]
    kept = pii._fewest(near, pii.base_spans(near), scored)
    assert ("phone", 0, 12) in kept
    assert all(any(a <= i < b for _, a, b in kept) for i in (13, 14, 15, 16))


# -- op4


@pytest.mark.parametrize("clash", [False, True])
def test_exact_groups(spark, clash):
    rng = random.Random(6)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(3000))
    texts = [None, "", "a", "a ", long, long, long[:-1], "A", "a", long.replace("alpha", "omega", 1), long]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 5]
    df = docs(spark, texts, ids)
    if clash:  # a hash with eight values: identifiers need their ordinals
        coarse = lambda c: F.pmod(F.xxhash64(c), F.lit(8))
        recipes = exact_dedup.recipes(spark, df, chunk_hash=coarse)
        groups = recipes.groupBy("recipe").agg(F.collect_set("text_sha256").alias("s"))
        assert groups.where("size(s) <> 1").isEmpty()
        assert groups.count() == len({t or "" for t in texts})
        return
    got = exact_dedup.exact_groups(spark, df)
    by = {}
    for i, t in zip(ids, texts, strict=True):
        by.setdefault(t or "", []).append(i)
    want = sorted((i, max(by[t or ""]), len(by[t or ""]), sha(t or "")) for i, t in zip(ids, texts, strict=True))
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == want
    assert got.where("kept").count() == len(by)
    kept = exact_dedup.drop_copies(spark, df)
    assert kept.columns == df.columns and sorted(r.text or "" for r in kept.collect()) == sorted(by)
    assert exact_dedup.exact_groups(spark, docs(spark, [])).count() == 0


def test_chunks_join_to_the_text(spark):
    texts = ["", "x" * 10_000, "one two three " * 900, "é漢\n" * 3000]
    df = docs(spark, texts).select("text", exact_dedup.chunks(F.col("text")).alias("c"))
    for r in df.collect():
        assert "".join(r.c) == r.text and all(len(c) <= exact_dedup.MAX_CHARS for c in r.c)


# -- op5


def brute_leaks(texts, items):
    word = lambda t: re.findall(rb"[0-9A-Za-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()))
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = []
    for d, t in texts:
        for i, x in items:
            w = word(x or "")
            if w:
                k = min(5, len(w))
                q = grams(w, k)
                shared = len(q & grams(word(t or ""), k))
                if 100 * shared >= 80 * len(q):
                    out.append((d, i, len(q), shared))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_leaks_match_brute_force(spark, block_bytes):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
    items = [(i, text(rng.randint(1, 30))) for i in range(20)] + [(30, None), (31, ""), (32, "..."), (0, "x y")]
    texts = [None, "", text(5)]
    for _ in range(60):
        w = rng.choice(items[:20])[1].split(" ")
        if rng.random() < 0.5:
            w[rng.randrange(len(w))] = "zz"
        texts.append(f"{text(rng.randint(0, 40))} {'*** '.join(w).upper()}!! {text(rng.randint(0, 400))}")
    df = spark.createDataFrame(items, "item_id long, text string")
    marked = decontaminate.mark_leaks(docs(spark, texts), df, block_bytes=block_bytes)
    assert set(marked.columns) == set(docs(spark, []).columns)
    got = rows(marked.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*"), "*")
    assert sorted(got) == brute_leaks(list(enumerate(texts)), items)
    assert decontaminate.mark_leaks(docs(spark, []), df).count() == 0
    assert decontaminate.mark_leaks(docs(spark, ["a"]), df.limit(0)).where("size(leaks) > 0").count() == 0


def test_items_without_an_id_are_compared_too(spark):
    text = " ".join(f"w{i}" for i in range(30))
    items = spark.createDataFrame([(None, text), (3, text), (None, None)], "item_id long, text string")
    got = decontaminate.mark_leaks(docs(spark, [f"a b {text} c", "clean words only"]), items)
    found = {r.doc_id: [x.item_id for x in r.leaks] for r in got.collect()}
    assert found == {0: [None, 3], 1: []}


def test_decontamination_query(spark, small):
    texts = [(r.doc_id, r.text) for r in queries.table(spark, small, "documents").collect()]
    items = [(r.item_id, r.text) for r in queries.table(spark, small, "benchmark").collect()]
    got = queries.QUERIES["op5_decontamination"](spark, small)
    assert sorted(tuple(r) for r in got.collect()) == brute_leaks(texts, items)


# -- op6


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return sorted((i, len(s), find(i)) for i, s in enumerate(sets))


@pytest.mark.parametrize("small_region", [64, 3])
def test_jaccard_components_match_brute_force(spark, monkeypatch, small_region):
    monkeypatch.setattr(jaccard_join, "SMALL", small_region)
    monkeypatch.setattr(jaccard_join, "CELL", 16)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    passage = rng.choices(words, k=60)
    texts = [None, "", "  \n", "a", "A", "a b", "a  B", "a b c d e", "a b c d e"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(4, 120))
        for _ in range(rng.choice([1, 2, 3])):
            x = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                x[rng.randrange(len(x))] = rng.choice(words)
            texts.append(" ".join(passage + x if rng.random() < 0.5 else x))
    family = rng.choices(words, k=120)
    for _ in range(70):
        x = list(family)
        for _ in range(rng.choice([1, 2, 3])):
            x[rng.randrange(len(x))] = rng.choice(words)
        texts.append(" ".join(x))
    got = jaccard_join.near_components(spark, docs(spark, texts))
    assert rows(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components(texts), key=repr)


def test_jaccard_empty_and_kept_rows(spark):
    assert jaccard_join.near_components(spark, docs(spark, [])).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    df = docs(spark, [text, text + " x", None, None, "other"], [3, 1, 5, None, 7])
    kept = jaccard_join.drop_near_copies(spark, df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 5, 7]


def test_hashes_of_a_set_are_written_once_a_task(monkeypatch):
    texts = pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array(["a b c d e f", "x"])})
    written = lambda: [
        h is not None for b in jaccard_join._set_rows(0)(iter([texts, texts])) for h in b["hashes"].to_pylist()
    ]
    assert written() == [True, True, False, False]
    monkeypatch.setattr(jaccard_join, "SEEN", 0)
    assert written()[:2] == [True, True]


def test_wide_rows_reach_python_in_small_batches(spark):
    join = jaccard_join._Join(spark, docs(spark, ["a b c d e f"]).select("doc_id", "text"))
    wide = spark.range(0, 6000, 1, 1).selectExpr("repeat('x', 4000) AS text")
    sizes = lambda batches: (pa.record_batch({"size": pa.array([b.nbytes])}) for b in batches)
    before = spark.conf.get(workers._BATCH_CONF)
    got = [r.size for r in join.written(wide.mapInArrow(sizes, "size long"), "sizes").collect()]
    assert sum(got) > 6000 * 4000 and max(got) < 1.1 * workers.BATCH_BYTES
    assert spark.conf.get(workers._BATCH_CONF) == before


def test_near_copies_are_told_by_id_and_text(spark):
    a = " ".join(f"w{i}" for i in range(40))
    b = " ".join(f"v{i}" for i in range(40))
    given = [(3, a), (5, a + " x"), (5, b), (7, None), (7, None), (8, " \n"), (8, " \n"), (9, "lone"), (9, "lone")]
    given += [(None, b + " y"), (None, b), (None, "z " + b), (None, "alone now")]
    schema = "doc_id long, text string, _gone string, _row int, _id string, _sha string, doc_ID2 string"
    df = spark.createDataFrame([(*r, "x", 1, "x", "x", "x") for r in given], schema).repartition(3)
    kept = jaccard_join.drop_near_copies(spark, df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    want = [(3, a), (5, b), (7, None), (7, None), (8, " \n"), (8, " \n"), (9, "lone"), (None, "alone now")]
    assert got == sorted(want, key=repr)
    exact = exact_dedup.drop_copies(spark, df)
    assert exact.columns == df.columns and exact.count() == len({t or "" for _, t in given})


@pytest.mark.parametrize("sizes", [(1, 60), (20, 25, 23)])
def test_regions_are_dealt_out_to_tasks(spark, monkeypatch, sizes):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    comps = [c for c, n in enumerate(sizes) for _ in range(n)]
    given = [(7, i, c) for i, c in enumerate(comps)] + [(9, 100, 1), (9, 101, 2), (8, 102, 1), (8, 103, 1)]
    dealt = jaccard_join._blocks(spark.createDataFrame(given, "h long, sid long, comp long")).collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault((r.h, r.few, r.many), []).append(r)
    assert {k[0] for k in tasks} == {7, 9}
    assert max(len({r.sid for r in x}) for x in tasks.values()) < len(comps) // 2
    many = [r for r in dealt if r.h == 7 and r.place != jaccard_join._OPEN]
    assert len(many) == len(comps) * -(-(len(comps) - max(sizes)) // 8)
    got = []
    for key, x in tasks.items():
        columns = {c: [getattr(r, c) for r in x] for c in ("h", "sid", "comp", "place")}
        same = {"n": [60] * len(x), "homes": [[r.h] for r in x], "sketch": [bytes(1024)] * len(x)}
        pairs = jaccard_join._cell_pairs(pa.table(columns | same)).to_pylist()
        got += [(p["a"], p["b"]) for p in pairs]
    want = {(i, j) for i, j in itertools.combinations(range(len(comps)), 2) if comps[i] != comps[j]}
    assert len(got) == len(set(got)) and set(got) == want | {(100, 101)}


@pytest.mark.parametrize("small_region", [64, 3])
def test_jaccard_components_with_dealt_regions(spark, monkeypatch, small_region):
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    test_jaccard_components_match_brute_force(spark, monkeypatch, small_region)


def test_metric_cells_lose_no_pair():
    rng = np.random.default_rng(9)
    centre = rng.integers(0, 2**63, size=(6, 4), dtype=np.uint64)
    bits = centre[rng.integers(0, 6, 900)].copy()
    for row in bits:
        for _ in range(rng.integers(0, 12)):
            row[rng.integers(0, 4)] ^= np.uint64(1) << np.uint64(rng.integers(0, 63))
    n, comp = np.full(900, 60), np.arange(900)
    got = {(min(p), max(p)) for p in jaccard_join.metric_pairs(bits, n, comp)}
    far = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2, dtype=np.int64)
    assert got == {(i, j) for i, j in zip(*np.nonzero(9 * far <= 120), strict=True) if i < j}
    assert jaccard_join._cells(bits, np.arange(900), 13) is not None


def test_connected_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7), (300, 1000), (1000, 300)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.component for r in connected_components(spark, df).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100, 300: 300, 1000: 300}
    assert connected_components(spark, df.limit(0)).count() == 0


# -- op7


def brute_language(text, profiles, top):
    letters = [c if c.isalpha() else " " for c in text.lower()]
    s = " " + re.sub(" +", " ", "".join(letters)).strip(" ") + " "
    grams = Counter(s[i : i + k] for k in (1, 2, 3) for i in range(len(s) - k + 1) if s[i : i + k] != " ")
    own = sorted(grams, key=lambda g: (-grams[g], [ord(c) for c in g]))[:top]
    far = {lang: sum(abs(p[g] - i) if g in p else top for i, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (top * len(own))


def test_language_matches_brute_force(spark, small):
    table = queries.table(spark, small, "documents")
    profiles = language_id.language_profiles(table)
    ranks = {}
    for r in profiles.collect():
        points = [r.gram >> 42, (r.gram >> 21) & 0x1FFFFF, r.gram & 0x1FFFFF]
        ranks.setdefault(r.lang, {})["".join(chr(p) for p in points if p)] = r.rank
    found = language_id.identify(table.limit(60), profiles).collect()
    for r in found:
        lang, score = brute_language(r.text, ranks, language_id.TOP)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-9


def test_language_held_out_accuracy_and_odd_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = queries.table(spark, sf, "documents").select("doc_id", "lang")
    held = queries.QUERIES["op7_language_id"](spark, sf).where("held_out").join(truth, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in held)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held)
    profiles = language_id.language_profiles(docs(spark, ["the cat", None, "the dog"]))
    odd = language_id.identify(docs(spark, [None, "", "123 !?", "the " * 50_000]), profiles)
    assert rows(odd, "doc_id", "lang_pred")[:3] == [(0, "und"), (1, "und"), (2, "und")]
    nothing = language_id.language_profiles(docs(spark, ["x"], lang=None))
    assert rows(language_id.identify(docs(spark, ["x"]), nothing), "lang_pred", "score") == [("und", 0.0)]
    assert language_id.identify(docs(spark, []), profiles).count() == 0


# -- op9


def test_warc_round_trip_and_push_down(spark, tmp_path):
    pages = [(1, "http://a/%0A\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", "<p>é</p>"), (4, "u", ""), (None, "n", "z" * 300_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    where = str(tmp_path / "w")
    warc.write_pages(df, where)
    got = {r.page_id: r for r in warc.read_pages(spark, where).collect()}
    assert got[3].record_type == "revisit" and got[3].refers_to == 1 and got[3].payload_bytes == 9
    assert got[4].refers_to == 2 and got[None].record_type == "response"
    assert got[1].payload_digest == warc.payload_digest("<p>é</p>".encode())
    read = spark.read.format("warc").option("path", where).load()
    uri = "http://a/%0A\r\nX: y"
    assert [bytes(r.payload) for r in read.where(F.col("target_uri") == uri).collect()] == ["<p>é</p>".encode()]
    assert read.where("refers_to is null").count() == 3
    empty = str(tmp_path / "e")
    warc.write_pages(df.limit(0), empty)
    assert warc.read_pages(spark, empty).count() == 0


def foreign_record(kind, uri, block, *extra, end="\r\n\r\n"):
    lines = ["WARC/1.0", f"warc-type: {kind}", f"WARC-Target-URI: {uri}", "WARC-Record-ID: <urn:uuid:1>"]
    lines += ["WARC-Date: 2020-01-01T00:00:00Z", *extra, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + end.encode()


FOREIGN = [
    ("warcinfo", "a", b"software: x\r\n\r\n", ()),
    ("response", "http://a/x%20y", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n" + b"WARC/1.0 z" * 30_000,
     ("Content-Type: application/http;\r\n msgtype=response", "WARC-Payload-Digest: sha1:ABC")),
    ("revisit", "b", b"HTTP/1.1 200 OK\r\n\r\n",
     ("Content-Type: application/http", "WARC-Refers-To: <urn:uuid:9>", "WARC-Payload-Digest: md5:1")),
    ("resource", "c", b"", ()),
]


@pytest.mark.parametrize("form", ["plain", "members", "one_member"])
def test_warc_reads_archives_of_other_writers(spark, tmp_path, form):
    raw = [foreign_record(k, u, b, *x) for k, u, b, x in FOREIGN]
    data = {
        "plain": b"".join(raw), "members": b"".join(map(gzip.compress, raw)), "one_member": gzip.compress(b"".join(raw))
    }[form]
    name = "other.warc" if form == "plain" else "other.warc.gz"
    (tmp_path / name).write_bytes(data)
    (tmp_path / f"part-{'0' * 32}.warc.gz").write_bytes(b"of a failed task")
    warc.write_pages(spark.createDataFrame([(7, "http://own/", "own")], "page_id long, url string, html string"), str(tmp_path))
    read = spark.read.format("warc").option("path", str(tmp_path)).option("split_bytes", 1).load()
    got = {r.target_uri: r for r in read.collect()}
    assert len(got) == 5 and bytes(got["http://own/"].payload) == b"own"
    page = got["http://a/x%20y"]
    assert bytes(page.payload) == b"WARC/1.0 z" * 30_000 and page.payload_bytes == 300_000
    assert (page.payload_digest, page.record_date, page.record_id) == ("ABC", "2020-01-01T00:00:00Z", "urn:uuid:1")
    assert (got["b"].payload_bytes, got["b"].refers_to, got["b"].payload_digest) == (None, "urn:uuid:9", "md5:1")
    assert bytes(got["a"].payload) == b"software: x\r\n\r\n" and got["c"].payload_bytes == 0
    assert [r.target_uri for r in read.where("record_type = 'resource'").select("target_uri").collect()] == ["c"]
    assert [r.target_uri for r in read.where("payload_bytes = 300000").collect()] == ["http://a/x%20y"]
    for cut in (len(data) - 9, len(data) - len(raw[-1]) - 12):
        if form == "plain" or cut == len(data) - 9:
            with pytest.raises(ValueError, match="ends inside|no WARC record"):
                list(warc.records(pa.BufferReader(data[:cut]), ["payload"], []))


def test_warc_records_carry_the_mandatory_headers(spark, tmp_path):
    pages = [(1, "http://a/x%20y", "same"), (2, "http://b/\n", "same"), (3, None, ""), (4, "d", "z" * 90)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    warc.write_pages(df, str(tmp_path))
    found = {}
    for file in tmp_path.glob("*.warc.gz"):
        for record in gzip.decompress(file.read_bytes()).split(b"WARC/1.1\r\n")[1:]:
            head, _, block = record.decode().partition("\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.split("\r\n"))
            assert len(block) == int(fields["Content-Length"]) + 4 and block.endswith("\r\n\r\n")
            assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
            found[fields["WARC-Record-ID"]] = (fields, block)
    assert sorted(found) == [f"<urn:page:{i}>" for i in (1, 2, 3, 4)]
    one, two = found["<urn:page:1>"], found["<urn:page:2>"]
    assert one[0]["WARC-Target-URI"] == "http://a/x%20y" and one[1].startswith("HTTP/1.1 200 OK\r\n")
    assert one[0]["WARC-Payload-Digest"] == "sha1:" + warc.payload_digest(b"same")
    assert two[0]["WARC-Target-URI"] == "http://b/%0A" and two[0]["WARC-Refers-To"] == "<urn:page:1>"
    assert two[0]["WARC-Profile"].endswith("/revisit/identical-payload-digest")
    many = str(tmp_path / "many")
    spark.range(300).selectExpr("cast(id as string) record_id", "'resource' record_type", "cast('x' as binary) payload") \
        .write.format("warc").option("path", many).option("max_bytes", 2000).mode("append").save()
    read = spark.read.format("warc").option("path", many).option("split_bytes", 5000).load()
    assert sorted(int(r.record_id) for r in read.collect()) == list(range(300))


def test_warc_reader_skips_what_is_not_wanted(tmp_path):
    class Counted:
        def __init__(self, data):
            self.data, self.at, self.read_bytes = data, 0, 0

        def size(self):
            return len(self.data)

        def seek(self, at):
            self.at = at

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at += len(out)
            self.read_bytes += len(out)
            return out

    body = random.Random(1).randbytes(2_000_000)
    members = [
        warc.record_bytes(
            {"WARC-Type": t, "WARC-Record-ID": t, "WARC-Payload-Digest": "d", "X-Payload-Length": "9"}, body
        )
        for t in ("request", "response")
    ]
    file = Counted(b"".join(members))
    wanted = [("record_type", "in", ("response",))]
    assert list(warc.records(file, ["record_id", "payload"], wanted)) == [("response", body)]
    assert file.read_bytes < len(members[1]) + 200_000


# -- op10


def test_frequent_pieces_stay_known(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_PIECES", 20)
    tokenizer = WordTokenizer(queries.vocabulary())
    asked = []
    piece = tokenizer._piece
    monkeypatch.setattr(tokenizer, "_piece", lambda x: (asked.append(x), piece(x))[1])
    for i in range(50):
        text = "the " + " ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}{'x' * (i // 26)}" for j in range(9))
        (got,) = tokenizer.encode(pa.array([text]))
        assert got.tolist() == tokenizer._tokenizer.encode(text, add_special_tokens=False).ids
        assert len(tokenizer._known) + len(tokenizer._older) <= 60
    assert asked.count(b"the") == 1


def test_packing_is_gapless(spark):
    path = queries.vocabulary()
    rng = random.Random(10)
    odd = ["It's 'Street ''s DON'T", "a1b22", "École ÉÈ ×", "日本 x", "<|endoftext|> hi", "İ ΣΑΣ", None, ""]
    texts = odd + ["".join(rng.choices("ab'strelvdm .1É\n", k=rng.randint(0, 2000))) for _ in range(60)]
    texts += [texts[10]] * 20
    ids = [*range(len(texts) - 1), None]
    got = packing.pack(spark, docs(spark, texts, ids), path).collect()
    tokenizer = WordTokenizer(path)._tokenizer
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in zip(ids, texts, strict=True)}
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == want.keys()
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            part = np.array(want[doc][r.start : r.start + r.length], dtype="<u4")
            assert r.start == at and r.doc_tokens == len(want[doc]) and r.ids_crc32 == zlib.crc32(part)
            assert np.array_equal(np.frombuffer(r.ids, "<u2"), part)
            at += r.length
        assert at == len(want[doc])
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at & (at - 1) == 0 and at <= packing.LENGTH
    assert packing.pack(spark, docs(spark, []), path).count() == 0


def test_added_tokens_are_those_of_the_tokenizer_as_loaded():
    from tokenizers import Tokenizer

    path = queries.vocabulary()
    texts = ["", "a<|endoftext|>b", "x", "", "A <|startoftext|>", "a<|ENDOFTEXT|>b", "<|endof", "text|> É", None, "日<|endoftext|>"]
    loaded = Tokenizer.from_file(path)
    want = [loaded.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[1] == [320, 49407, 321]
    got = WordTokenizer(path).encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in got] == want


def test_hilbert_neighbours_touch():
    for d, bits in ((2, 3), (3, 2), (4, 4)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=d)))
        place = packing.hilbert(points, bits)
        assert sorted(place) == list(range(1 << (bits * d)))
        assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_text_slices_handle_offsets_and_nulls():
    from marts.llm.arrays import text_slices

    column = pa.array(["aa", None, "", "é" * 50, "b"]).slice(1)
    parts = list(text_slices(column, limit=10))
    assert [f for f, _, _ in parts] == [0, 2, 3]
    assert b"".join(d.tobytes() for _, d, _ in parts).decode() == "é" * 50 + "b"
