"""Substring deduplication by line hashing: repeated passages of lines and sentences.

A unit is a sentence inside a line (or, with ``drop_repeated_lines``, a whole line). Its normal
form is lower case with ASCII blanks joined and trimmed. Of equal units in the whole table
the first by (doc_id, position) stays; the others are repeated. ``drop_repeated_passages``
removes maximal runs of repeated units, next to each other in a document, that come to
``least_passage`` words or more: a passage goes as a whole, a stock sentence or a short
line by itself stays. Units without a word neither break a run nor go with it. Removed
spans keep their byte offsets in the input. A sentence that a passage shares only in part (at its
ends, or with an edited word) is not repeated and stays.

Units travel as 128-bit digests and places. The first place of each digest comes from
a minimum that is combined before the shuffle; the join that returns it has one row a
digest on one side, so adaptive execution splits a frequent unit's other side. Runs are
found where a document's repeated units meet its text.

Defined cases: null text is empty; a null ``doc_id`` ranks first; rows equal in id and
text are one document to the ranking and keep the same units; an empty table gives an
empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marts.llm.substring_repeats import _cut, _two
from marts.llm.workers import ship

#: Words that a run of repeated units needs to be a passage.
LEAST_PASSAGE = 20

_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
# A sentence ends behind its mark, closing quotes and blanks; CJK marks need no blank.
_SENTENCE_END = re.compile(
    r"(?<![.!?\u2026])[.!?\u2026]++[\"')\]\u00BB\u201D\u2019]*+[\x20\x09-\x0D]++"
    r"|[\u3002\uFF01\uFF1F]+[\u300D\u300F\u201D\u2019]*[\x20\x09-\x0D]*"
)


def _sentences(text: str) -> list[str]:
    out = []
    for line in _LINE.findall(text):
        at = 0
        for m in _SENTENCE_END.finditer(line):
            out.append(line[at : m.end()])
            at = m.end()
        if at < len(line):
            out.append(line[at:])
    return out


def _units(least_words: int, split: Callable[[str], list[str]]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, row, low, high, place = [], [], [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                at = number = 0
                for unit in split(text):
                    size = len(unit.encode())
                    words = _WORD.findall(unit.lower())
                    number += bool(words)
                    if len(words) >= least_words:
                        place.append(number << 32 | len(words))
                        digests.append(xxhash.xxh3_128_digest(" ".join(words).encode()))
                        row.append(i)
                        low.append(at)
                        high.append(at + size)
                    at += size
            c1, c2 = _two(digests)
            take = pa.array(row, pa.int64())
            yield pa.record_batch(
                {
                    "c1": c1,
                    "c2": c2,
                    "doc_id": batch["doc_id"].take(take),
                    "uid": batch["uid"].take(take),
                    "low": pa.array(low, pa.int64()),
                    "high": pa.array(high, pa.int64()),
                    "place": pa.array(place, pa.int64()),
                }
            )

    return task


def drop_repeated_lines(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_words: int = 1
) -> DataFrame:
    """``(doc_id, kept, n_bytes, n_removed, spans)``, one row per row of ``docs``."""
    if least_words < 1:
        raise ValueError("least_words must be positive")
    return _drop(docs, key, text, _units(least_words, _LINE.findall))


def drop_repeated_sentences(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As ``drop_repeated_lines`` with the sentences inside lines as units, however short.

    Equal lines have equal sentences, so whatever goes as a line of any length goes here too.
    """
    return _drop(docs, key, text, _units(1, _sentences))


def drop_repeated_passages(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_passage: int = LEAST_PASSAGE
) -> DataFrame:
    """As ``drop_repeated_sentences``, for runs of ``least_passage`` words or more only."""
    if least_passage < 1:
        raise ValueError("least_passage must be positive")
    return _drop(docs, key, text, _units(1, _sentences), least_passage)


def _passages(least: int):
    """Cuts the units of runs of ``least`` words."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for units in batch["packed"]:
                if not units.is_valid:
                    packed.append(None)
                    continue
                place = np.asarray(units.values.field("place"), dtype=np.int64)
                order = np.argsort(place)
                number, words = place[order] >> 32, place[order] & 0xFFFFFFFF
                run = np.cumsum(np.diff(number, prepend=number[:1]) > 1)
                total = np.bincount(run, words)
                spans = np.asarray(units.values.field("span"), dtype=np.int64)[order][total[run] >= least]
                packed.append(spans if len(spans) else None)
            columns = {"doc_id": batch["doc_id"], "text": batch["text"]}
            yield pa.record_batch(columns | {"packed": pa.array(packed, pa.list_(pa.int64()))})

    return lambda batches: _cut(runs(batches))


def _drop(docs: DataFrame, key: str, text: str, units_of, least_passage: int = 1) -> DataFrame:
    ship(docs.sparkSession)
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.xxhash64(F.col(key), value).alias("uid"),
        value.alias("text"),
    )
    units = rows.mapInArrow(
        units_of, "c1 long, c2 long, doc_id long, uid long, low long, high long, place long"
    )
    place = F.struct("doc_id", "uid", "low")
    first = (
        units.groupBy("c1", "c2")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n")
    )
    gone = units.join(first, ["c1", "c2"]).where(~place.eqNullSafe(F.col("first")))
    same = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("k1"), F.col("uid").alias("k2")]
    spans = gone.groupBy(*same).agg(
        F.collect_set(
            F.struct("place", F.shiftleft("low", 32).bitwiseOR(F.col("high")).alias("span"))
        ).alias("packed")
    )
    joined = rows.select(*same, "doc_id", "text").join(spans, ["k1", "k2"], "left")
    return joined.select("doc_id", "text", "packed").mapInArrow(
        _passages(least_passage),
        "doc_id long, kept binary, n_bytes long, n_removed long, "
        "spans array<struct<low:bigint,high:bigint>>",
    )
