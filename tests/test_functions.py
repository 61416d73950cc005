from __future__ import annotations

from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import functions as F

from marts.functions import document_id, jsonify, normalized_title, strip, text_or_empty


def test_strip_is_pythons_strip(spark):
    # Every character of the basic plane on both sides of a word, and alone.
    texts = []
    for code in list(range(1, 0x3100)) + [0xFEFF, 0x200B]:
        texts.append(f"{chr(code)}a b{chr(code)}")
    texts += ["", "   ", "\t\n", " x", "x　 \x1c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", strip(F.col("t")).alias("s")).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != t.strip()] == []


def test_titles(spark):
    cases = [
        (None, None),
        ("", ""),
        ("  a\t", "TRANSFORMED_a"),
        ("   ", "TRANSFORMED_"),
        (" Film ", "TRANSFORMED_Film"),
    ]
    df = spark.createDataFrame(cases, "title string, wanted string")
    rows = df.select(normalized_title(F.col("title")).alias("got"), "wanted").collect()
    assert all(r.got == r.wanted for r in rows)


def test_text_or_empty(spark):
    df = spark.createDataFrame([(5,), (None,)], "v int")
    assert [r[0] for r in df.select(text_or_empty(F.col("v"))).collect()] == ["5", ""]


def test_jsonify_types(spark):
    df = spark.createDataFrame(
        [
            (
                1,
                Decimal("7.5"),
                date(2024, 2, 29),
                datetime(2024, 1, 2, 3, 4, 5),
                datetime(2024, 1, 2, 3, 4, 5, 120),
                datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc),
                datetime(2024, 1, 2, 3, 4, 5, 500000, tzinfo=timezone.utc),
                "t",
                1.5,
                True,
            ),
            (2, None, None, None, None, None, None, None, None, None),
        ],
        "id int, d decimal(3,1), day date, n0 timestamp_ntz, n1 timestamp_ntz, z0 timestamp, "
        "z1 timestamp, s string, f double, b boolean",
    )
    first, second = jsonify(df).orderBy("id").collect()
    assert tuple(first) == (
        1, 7.5, "2024-02-29", "2024-01-02T03:04:05", "2024-01-02T03:04:05.000120",
        "2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05.500000+00:00", "t", 1.5, True,
    )
    assert tuple(second)[1:] == (None,) * 9


def test_zoned_text_ignores_the_session_zone(spark):
    moments = [
        datetime(2024, 10, 27, 0, 30, tzinfo=timezone.utc),  # repeated hour in Berlin
        datetime(2024, 10, 27, 1, 30, tzinfo=timezone.utc),
        datetime(1950, 1, 1, 0, 0, 0, 1, tzinfo=timezone.utc),
    ]
    df = spark.createDataFrame([(m,) for m in moments], "t timestamp")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert [r.t for r in jsonify(df).collect()] == [m.isoformat() for m in moments]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_document_id(spark):
    df = spark.createDataFrame([(10,), (None,)], "k bigint")
    assert [r[0] for r in df.select(document_id(F.col("k"))).collect()] == ["10", None]
