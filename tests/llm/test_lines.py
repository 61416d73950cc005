from __future__ import annotations

import hashlib
import random
import re

from marts.llm import line_dedup

SCHEMA = "doc_id long, text string, kept int, low string, c1 string, packed string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, None, "x", None) for i, t in rows], SCHEMA)


def _got(df):
    return [(r.doc_id, bytes(r.kept).decode()) for r in line_dedup.drop_repeated_lines(df, least_words=5).collect()]


def _brute(rows):
    """First of equal normalised lines by (doc_id, position), for distinct ids that are not null."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        kept = []
        for line in re.findall(r"[^\n]*\n|[^\n]+", text or ""):
            words = re.findall(r"[^ \t-\r]+", line.lower())
            unit = hashlib.sha256(" ".join(words).encode()).digest()
            if len(words) < 5 or unit not in seen:
                kept.append(line)
            if len(words) >= 5:
                seen.add(unit)
        out[doc_id] = "".join(kept)
    return out


def test_first_line_stays(spark):
    a, b = "one two three four five", "six seven eight nine ten"
    texts = [f"{a}\nshort\n{b}", f"x\n{a.upper()} \nshort\n", None, "", f"{b}\n{b}"]
    df = _frame(spark, enumerate(texts))
    assert dict(_got(df)) == {0: texts[0], 1: "x\nshort\n", 2: "", 3: "", 4: ""}
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_as_brute_force(spark):
    rng = random.Random(3)
    lines = ["É una línea de texto", "É UNA\tlínea  de texto\r", "a b c d", "", " ", "five words in this line here"]
    lines += [" ".join(rng.choices("abcd", k=6)) for _ in range(20)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(30)))) for i in range(60)]
    rows.append((99, "\n".join(rng.choices(lines, k=60_000))))
    rng.shuffle(rows)
    want = _brute(rows)
    assert dict(_got(_frame(spark, rows).repartition(7))) == want


def test_offsets_are_bytes_of_the_input(spark):
    line = "é è ê ë ñ\n"
    df = _frame(spark, [(1, line), (2, f"ü\n{line}ü\n{line}{line}")])
    r = next(r for r in line_dedup.drop_repeated_lines(df, least_words=5).collect() if r.doc_id == 2)
    size = len(line.encode())
    assert [(s.low, s.high) for s in r.spans] == [(3, 3 + size), (6 + size, 6 + 3 * size)]
    assert (r.n_bytes, r.n_removed, bytes(r.kept).decode()) == (6 + 3 * size, 3 * size, "ü\nü\n")


def test_null_ids_rank_first_and_repeated_rows_are_one(spark):
    line = "one two three four five"
    rows = [(None, line), (1, line), (7, "six seven eight nine ten"), (7, "six seven eight nine ten")]
    assert sorted(_got(_frame(spark, rows)), key=str) == sorted(
        [(None, line), (1, ""), (7, rows[2][1]), (7, rows[2][1])], key=str
    )
    assert dict(_got(_frame(spark, [(None, None), (None, "")]))) == {None: ""}


def test_every_line_equal(spark):
    line = "one two three four five\n"
    got = dict(_got(_frame(spark, [(i, line * 5) for i in range(500)])))
    assert got[0] == line and set(v for k, v in got.items() if k) == {""}


def test_short_lines_and_lines_without_blanks_count_on_demand(spark):
    texts = ["and so.\n\n吾輩は猫である。名前はまだ無い\nend", "x\nAND  so.\n\n吾輩は猫である。名前はまだ無い\n \n"]
    got = line_dedup.drop_repeated_lines(_frame(spark, enumerate(texts)), least_words=1).collect()
    assert {r.doc_id: bytes(r.kept).decode() for r in got} == {0: texts[0], 1: "x\n\n \n"}


def _brute_sentences(rows):
    """Like ``_brute`` with sentences of any length as units."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        kept = []
        for line in (text or "").splitlines(keepends=True):
            for piece in re.sub(r"([.!?][ \t\n]+|。[ \t\n]*)", "\\1\0", line).split("\0"):
                unit = " ".join(re.findall(r"[^ \t-\r]+", piece.lower()))
                if not unit or unit not in seen:
                    kept.append(piece)
                seen.add(unit)
        out[doc_id] = "".join(kept)
    return out


def test_sentences_inside_lines(spark):
    a, b = "A passage of some six words here.", "Another one, that is new!"
    texts = [f"x y {a} {b}\nand so.\n", f"New start. {a.upper()} {b} New end.\nAND so.\n"]
    texts += ["吾輩は猫である。名前はまだ無い。\n", "前置き。吾輩は猫である。名前はまだ無い。"]
    got = line_dedup.drop_repeated_sentences(_frame(spark, enumerate(texts))).collect()
    kept = {r.doc_id: bytes(r.kept).decode() for r in got}
    assert kept[1] == f"New start. {a.upper()} New end.\n" and kept[3] == "前置き。"
    assert (kept[0], kept[2]) == (texts[0], texts[2])
    row = next(r for r in got if r.doc_id == 3)
    assert [(s.low, s.high) for s in row.spans] == [(12, len(texts[3].encode()))]


def test_sentences_as_brute_force(spark):
    rng = random.Random(8)
    bits = ["one two. ", "One  two.\t", "é è! ", "3.14 is it? ", "猫。", "end\n", "\n", " ", "a ", "so. "]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(40)))) for i in range(80)]
    got = line_dedup.drop_repeated_sentences(_frame(spark, rows).repartition(7)).collect()
    assert {r.doc_id: bytes(r.kept).decode() for r in got} == _brute_sentences(rows)


def _brute_passages(rows, least):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        pieces = []
        for line in re.findall(r"[^\n]*\n|[^\n]+", text or ""):
            pieces += re.sub(r"([.!?]+[\"')]*[ \t\n]+|。[ \t\n]*)", "\\1\0", line).split("\0")
        words = [re.findall(r"[^ \t-\r]+", p.lower()) for p in pieces]
        gone, run = set(), []
        for i, w in [*((i, w) for i, w in enumerate(words) if w), (-1, None)]:
            if w is not None and tuple(w) in seen:
                run.append(i)
                continue
            if sum(len(words[j]) for j in run) >= least:
                gone |= set(run)
            run = []
            if w is not None:
                seen.add(tuple(w))
        out[doc_id] = "".join(p for i, p in enumerate(pieces) if i not in gone)
    return out


def test_passages_go_and_stock_sentences_stay(spark):
    passage = "One sentence of some seven words here.\nAnd another, of eight words or so. \n\nThe third one has just seven words! "
    stock = "All rights reserved by the owner.\n"
    texts = [f"Start here. {passage}{stock}End.", f"{stock}Other start.\n{passage.upper()}Other end.", f"{stock}New words.\n{stock}"]
    got = line_dedup.drop_repeated_passages(_frame(spark, enumerate(texts))).collect()
    kept = {r.doc_id: bytes(r.kept).decode() for r in got}
    assert kept == {0: texts[0], 1: f"{stock}Other start.\n\nOther end.", 2: texts[2]}
    row = next(r for r in got if r.doc_id == 1)
    assert row.n_removed == sum(s.high - s.low for s in row.spans) == len(passage) - 1


def test_passages_as_brute_force(spark):
    rng = random.Random(4)
    bits = ["one two. ", "One  two.\t", "é è! ", "3.14 is it? ", "猫。", "end\n", "\n", " ", "a ", "so. ", "Wait?! ", "x.\" "]
    rows = [(i, "".join(rng.choices(bits, k=rng.choice([0, 5, 40])))) for i in range(80)]
    rows += [(90 + i, rows[i][1]) for i in range(5)] + [(200, "".join(rng.choices(bits, k=40_000)))]
    for least in (1, 6, 20):
        got = line_dedup.drop_repeated_passages(_frame(spark, rows).repartition(7), least_passage=least).collect()
        assert {r.doc_id: bytes(r.kept).decode() for r in got} == _brute_passages(rows, least)
    assert line_dedup.drop_repeated_passages(_frame(spark, [])).count() == 0


def test_passages_of_odd_rows(spark):
    text = "word " * 30 + ". "
    rows = [(None, text), (3, text), (3, text), (4, None), (5, "")]
    got = line_dedup.drop_repeated_passages(_frame(spark, rows)).collect()
    assert sorted((repr(r.doc_id), r.n_removed) for r in got) == [
        ("3", len(text)), ("3", len(text)), ("4", 0), ("5", 0), ("None", 0)
    ]
