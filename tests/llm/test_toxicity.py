"""Noisy-or over sentences: held-out accuracy, the located sentences, odd cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from marts.llm import queries, toxicity

DOCS = "doc_id long, text string, toxic int, score string, sentences string"
BAD = ["scum", "vileword", "rotten"]


def made(n, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        lines = [" ".join(f"w{rnd.randrange(400)}" for _ in range(8)).capitalize() + "." for _ in range(rnd.randrange(1, 30))]
        toxic = int(i % 6 == 0)
        if toxic:
            at = rnd.randrange(len(lines))
            lines[at] = lines[at][:-1] + f" {rnd.choice(BAD)} {rnd.choice(BAD)}!"
        out.append((i, " ".join(lines), toxic))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], DOCS).repartition(3)


def test_offending_sentences_are_found_from_document_labels(spark):
    rows = made(900)
    model = toxicity.learn(table(spark, rows[:600]))
    found = {r["doc_id"]: r for r in toxicity.score(table(spark, rows), model).collect()}
    for i, text, toxic in rows[600:]:
        assert (found[i]["score"] >= 0.5) == bool(toxic)
        said = [text[s["start"] : s["end"]] for s in found[i]["sentences"]]
        assert all(any(b in s for b in BAD) for s in said)
        assert bool(said) == bool(toxic)


def test_noisy_or_is_the_document_score():
    texts = ["Foul scum rotten. Fine words here.\nvileword, scum! fine", "fine. fine", ""]
    model = toxicity.fit(pa.array([t for _, t, _ in made(300)]), np.array([x for *_, x in made(300)]))
    values = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    found = toxicity.bags(values, offsets)
    z = model.sentences(found)
    p = 1 / (1 + np.exp(-z))
    assert found.row.tolist() == [0, 0, 0, 0, 1, 1]
    assert p[0] > 0.5 > p[1]
    assert 1 - np.prod(1 - p[:4]) > p[0]


def test_sentences_start_behind_marks():
    text = "Ab. Cd? Ef!\nGh 3.5 Ij。Kl？Mn.Op"
    values = np.frombuffer(text.encode(), np.uint8)
    starts = toxicity.sentence_starts(values, np.array([0, len(values)]))
    cut = [values[a:b].tobytes().decode() for a, b in zip(starts, [*starts[1:], len(values)], strict=True)]
    assert cut == ["Ab. ", "Cd? ", "Ef!\n", "Gh 3.5 Ij。", "Kl？", "Mn.Op"]


def test_odd_cases(spark):
    rows = made(120)
    model = toxicity.learn(table(spark, rows + [(1000, None, 1), (1001, "scum", None), (1002, "", 0)]))
    odd = [(None, "scum rotten!", 1), (5, None, 1), (6, "", 0), (7, " \n.", 0), (8, "scum. " * 50_000, 1), (9, "é" * 9, 0)]
    got = {r["doc_id"]: r for r in toxicity.score(table(spark, odd + odd[:1]), model).collect()}
    assert got[5]["score"] == got[6]["score"] == got[7]["score"] == 0
    assert got[8]["score"] > 0.99 and len(got[8]["sentences"]) == 50_000
    assert got[None]["score"] > 0.5
    assert toxicity.score(table(spark, []), model).count() == 0
    for labels in ([], [(1, "scum", 1)], [(1, "fine", 0), (2, "well", 0)]):
        one = toxicity.learn(table(spark, labels))
        assert [r["score"] for r in toxicity.score(table(spark, odd[:1]), one).collect()] == [0.0]


def test_the_sample_is_bounded_and_ignores_row_order(spark):
    rows = made(400)
    a = toxicity.learn(table(spark, rows), sample_rows=150)
    b = toxicity.learn(table(spark, rows[::-1]), sample_rows=150)
    assert np.array_equal(a.features, b.features) and np.allclose(a.weights, b.weights)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = queries.QUERIES["op12_toxicity"](spark, sf).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in rows)
    assert hit >= 0.8 * sum(r["toxic"] == 1 for r in rows)
    assert hit >= 0.9 * sum(r["predicted"] == 1 for r in rows)
