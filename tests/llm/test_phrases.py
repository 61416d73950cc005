"""Phrase mining against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from marts.llm import phrases

DOCS = "doc_id long, text string, lang string, shard int, g string, phrase string"


def brute(docs, least, top):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    rows = []
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if any(x == lang and len(q) > len(p) and inside(q) and 100 * c >= 80 * a for (x, q), c in f.items()):
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        rows.append((lang, -score, -a, " ".join(p).encode(), left, right))
    out, rank = [], Counter()
    for lang, score, a, p, left, right in sorted(rows):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def mined(spark, docs, **options):
    rows = [(i, *d, 1, "x", "x") for i, d in enumerate(docs)]
    given = spark.createDataFrame(rows, DOCS).repartition(5)
    return sorted(tuple(r) for r in phrases.collocations(spark, given, **options).collect())


def some(seed, n, words):
    rnd = random.Random(seed)
    mark = lambda: rnd.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",x "])
    text = lambda: "".join(rnd.choice(words) + mark() for _ in range(rnd.choice([0, 1, 5, 60])))
    return [(text(), rnd.choice(["en", "en", "en", "fr", None])) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(phrases, "GATHERED", 500)
    words = [["the", "The", "of", "éa", "b c"], ["a", "b"], [f"w{i}" for i in range(30)]][seed]
    docs = some(seed, 200, words) + [(None, "en"), ("", None), ("A b. c", "de")] + [("Hot line of words", "en")] * 90
    for least, shards in ((3, 8), (20, 3), (1, 1)):
        got = mined(spark, docs, least=least, shards=shards, top=25)
        assert got == brute(docs, least, 25)


def test_a_full_bit_table_changes_nothing(spark):
    docs = some(7, 200, [f"w{i}" for i in range(12)])
    assert mined(spark, docs, least=5, filter_bits=8) == brute(docs, 5, phrases.TOP)


def test_odd_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), ("", "en"), (" .,\n", "en")]) == []
    long = "x y " * 20_000
    assert mined(spark, [(long, "en")]) == brute([(long, "en")], 30, 2000)


def test_scores_pass_64_bits(spark):
    expression = (
        "(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0)))"
        " div (cast(a as decimal(20,0)) + cast(a as decimal(20,0)))"
    )
    a = 2**62
    assert spark.sql(f"SELECT {expression} AS s FROM (SELECT {a}L AS a)").first()["s"] == 1000000


def test_wrong_options(spark):
    with pytest.raises(ValueError, match="positive"):
        mined(spark, [], shards=0)
