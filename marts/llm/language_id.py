"""Language identification by rank-order profiles of character n-grams.

A language is its ``top`` most frequent n-grams of one to three characters, in
order of frequency. A text's own most frequent n-grams are compared to each
profile by the out-of-place distance: the sum of rank differences, ``top`` for an
n-gram that the profile lacks. The nearest language wins, the first in
alphabetical order among equals.

Letters are lower-cased; anything else is one blank, so n-grams also see where
words begin and end. Profiles count all training rows: tasks count their own rows,
a shuffle adds up one row per task, language and n-gram. Only the profiles
(``top`` n-grams a language) come to the driver.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows
without text or language teach nothing; repeated rows each count; with nothing to
learn from, every text is ``und``. Other columns of the input are kept untouched;
a column with the name of an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marts.llm.workers import lean, ship

#: N-grams in a profile.
TOP = 300

UNKNOWN = "und"

_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of a text in a dense numbering, and the numbers' code points.

    The dense numbering keeps the order of the code points; number 0 is "nothing".
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.where(letter, points, 32)[keep]
    points = np.concatenate(([32], points, [32])) if points[-1] != 32 else np.concatenate(([32], points))
    seen = np.zeros(int(points.max()) + 1, dtype=bool)
    seen[points] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(len(seen), dtype=np.int64)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    a = number[points]
    m = len(alphabet) + 1
    if m**3 < 2**31:
        a = a.astype(np.int32)
    one = a * (m * m)
    two = one[:-1] + a[1:] * m
    three = two[:-1] + a[2:]
    blank = number[32]
    keys = np.concatenate((one[a != blank], two, three))
    return keys, np.concatenate(([0], alphabet))


def _codes(keys: np.ndarray, alphabet: np.ndarray) -> np.ndarray:
    """N-grams as 63-bit numbers: three code points, zero where there is none."""
    m = len(alphabet)
    keys = keys.astype(np.int64)
    a, b, c = keys // (m * m), keys // m % m, keys % m
    return (alphabet[a] << (2 * _BITS)) | (alphabet[b] << _BITS) | alphabet[c]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def _most_frequent(text: str, top: int) -> np.ndarray:
    """The codes of a text's most frequent n-grams in order; equal counts go by code."""
    keys, alphabet = _grams(text)
    if not len(keys):
        return keys
    keys, counts = _counted(keys)
    order = (counts.astype(np.int64) << 32) - np.arange(len(keys))
    if len(order) > top:
        order = order[np.argpartition(-order, top - 1)[:top]]
    order = np.sort(order)[::-1]
    index = (-order) & 0xFFFFFFFF
    return _codes(keys[index], alphabet)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, dict[int, int]] = {}
    for batch in batches:
        for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
            keys, alphabet = _grams(text)
            if len(keys):
                own = total.setdefault(lang, {})
                keys, counts = _counted(keys)
                for code, n in zip(_codes(keys, alphabet).tolist(), counts.tolist(), strict=True):
                    own[code] = own.get(code, 0) + n
        if sum(map(len, total.values())) > 500_000:
            yield from _count_rows(total)
            total = {}
    yield from _count_rows(total)


def _count_rows(total: dict[str, dict[int, int]]) -> Iterator[pa.RecordBatch]:
    for lang, own in total.items():
        yield pa.record_batch(
            {
                "lang": pa.array([lang] * len(own), pa.string()),
                "gram": pa.array(list(own), pa.int64()),
                "n": pa.array(list(own.values()), pa.int64()),
            }
        )


def language_profiles(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", top: int = TOP
) -> DataFrame:
    """``(lang, rank, gram)`` of the rows that have a text and a language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    ship(docs.sparkSession)
    counts = rows.mapInArrow(lean(_count_task), "lang string, gram long, n long")
    # One n-gram's counts meet in one task, partial sums before; the ranking sees
    # each distinct n-gram of a language once.
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        counts.withColumn("rank", F.row_number().over(order) - 1)
        .where(F.col("rank") < top)
        .select("lang", "rank", "gram")
    )


def identify(
    docs: DataFrame, profiles: DataFrame, *, text: str = "text", top: int = TOP
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (1: same order of n-grams, 0: none in common)."""
    found = profiles.collect()  # at most ``top`` rows a language
    langs = sorted({r.lang for r in found})
    grams = np.array(sorted({r.gram for r in found}), dtype=np.int64)
    ranks = np.full((len(grams) + 1, len(langs)), -1, dtype=np.int64)
    for r in found:
        ranks[np.searchsorted(grams, r.gram), langs.index(r.lang)] = r.rank

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, scores = [], []
            for value in batch.column(batch.schema.get_field_index(text)).to_pylist():
                own = _most_frequent(value, top) if value and langs else ()
                if not len(own):
                    best.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at = np.searchsorted(grams, own)
                at[at == len(grams)] = -1
                at[grams[at] != own] = len(grams)
                rank = ranks[at]
                far = np.abs(rank - np.arange(len(own))[:, None])
                distance = np.where(rank < 0, top, np.minimum(far, top)).sum(axis=0)
                nearest = int(np.argmin(distance))
                best.append(langs[nearest])
                scores.append(1.0 - float(distance[nearest]) / (top * len(own)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()), pa.array(scores, pa.float64())],
                schema=batch.schema.append(pa.field("lang_pred", pa.string())).append(
                    pa.field("score", pa.float64())
                ),
            )

    ship(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    added = T.StructType().add("lang_pred", "string").add("score", "double")
    return docs.mapInArrow(lean(predict), T.StructType([*docs.schema.fields, *added.fields]))


def held_out(key: Column) -> Column:
    """True for the third of the keys that nothing is learnt from; a null key is never held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))
