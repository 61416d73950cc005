"""Toxicity by multiple-instance learning: sentences scored, documents labelled.

A document is a bag of sentences. Each sentence has a probability of its own (logistic,
over hashed word features); the document's is their noisy-or, ``1 - prod(1 - p)``. Only
documents have labels, so the loss is the document's, and its gradient reaches the
sentences through the noisy-or: a toxic document has to have some offending sentence, a
clean one none. What the fitted model finds offending is then located by sentence.

Features of a word (a run of letters, ASCII in lower case): the word, its first four,
five and six bytes, and the pair with the word before it in the sentence.

Fit: on a bounded sample of the labelled rows (``SAMPLE_ROWS`` rows, taken by a hash
of id and text; texts over ``SAMPLE_TEXT_BYTES`` are not learnt from), on the driver. The
``FEATURES`` features whose presence speaks most for the label (log-likelihood ratio,
counted by document) are kept; noisy-or adds up evidence, so what speaks against it is
not. Scoring is one pass over all rows and whole texts, with no shuffle; the model sent
along has at most ``FEATURES`` weights.

Defined cases: null and empty texts have no sentence and score the noisy-or of none, 0;
rows without a label are not learnt from; repeated rows are scored each; without any
labelled row, or with one label only, every score is 0; an empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marts.llm.arrays import LOWER, mix, span_hashes, text_slices, words
from marts.llm.workers import ship

SAMPLE_ROWS = 8_000
#: Bytes of text that the fit works on at once.
SLICE_BYTES = 1 << 20
SAMPLE_TEXT_BYTES = 32 << 10
FEATURES = 4096
LEAST_DOCUMENTS = 3
#: Log-likelihood ratio that a feature needs; chance alone passes it once in some 1 500.
LEAST_GAIN = 5.0
STEPS = 300
RATE = 0.2
RIDGE = 3e-4
#: Log-odds of a sentence without any known feature, at the start of the fit.
START = -7.0
LOCATE = 0.5

_LETTER = np.zeros(256, dtype=bool)
_LETTER[128:] = True
_LETTER[65:91] = True
_LETTER[97:123] = True
_END = np.zeros(256, dtype=bool)
_END[[33, 46, 63]] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PREFIXES = (4, 5, 6)


def sentence_starts(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bytes at which a sentence starts: a text's first byte, what follows ``.``, ``!`` or
    ``?`` and a blank, a line feed, or a CJK mark."""
    n = len(values)
    start = np.zeros(n + 1, dtype=bool)
    start[offsets[:-1]] = True
    if n > 1:
        start[2:] |= (_END[values[:-1]] & _SPACE[values[1:]])
        start[1:] |= values == 10
    if n > 2:
        a, b, c = values[:-2], values[1:-1], values[2:]
        full_stop = (a == 0xE3) & (b == 0x80) & (c == 0x82)
        wide = (a == 0xEF) & (b == 0xBC) & ((c == 0x81) | (c == 0x9F))
        start[3:] |= full_stop | wide
    return np.flatnonzero(start[:n])


@dataclass
class Bags:
    """Sentences of some texts and the hashed features in them."""

    low: np.ndarray  # first byte of each sentence
    row: np.ndarray  # its text
    sentence: np.ndarray  # of each feature
    feature: np.ndarray


def bags(values: np.ndarray, offsets: np.ndarray) -> Bags:
    low = sentence_starts(values, offsets)
    row = np.searchsorted(offsets, low, side="right") - 1
    start, end, _ = words(_LETTER[values], offsets)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Bags(low, row, none, none.astype(np.uint64))
    lower = LOWER[values]
    word = span_hashes(lower, start, end)
    sentence = np.searchsorted(low, start, side="right") - 1
    who, what = [sentence], [word]
    for n in _PREFIXES:
        long = end - start > n
        who.append(sentence[long])
        what.append(mix(span_hashes(lower, start[long], start[long] + n) ^ np.uint64(n)))
    pair = sentence[1:] == sentence[:-1]
    who.append(sentence[1:][pair])
    what.append(mix(word[:-1][pair] * np.uint64(3) ^ word[1:][pair]))
    return Bags(low, row, np.concatenate(who), np.concatenate(what))


@dataclass
class Model:
    """Sorted feature hashes with their weights, and the log-odds without any."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def sentences(self, found: Bags) -> np.ndarray:
        """Log-odds of each sentence; one without a known feature has none (minus infinity)."""
        z = np.full(len(found.low), -np.inf)
        if not len(self.features) or not len(found.feature):
            return z
        sentence, weight = _known(found, self.features)
        total = np.bincount(sentence, self.weights[weight], len(z))
        has = np.bincount(sentence, minlength=len(z)) > 0
        z[has] = total[has] + self.bias
        return z


def _known(found: Bags, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each known feature of each sentence once."""
    at = np.minimum(np.searchsorted(features, found.feature), len(features) - 1)
    hit = features[at] == found.feature
    pairs = np.unique(found.sentence[hit] * len(features) + at[hit])
    return pairs // len(features), pairs % len(features)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Fit on documents and their labels (0 or 1)."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    positive, total = int(labels.sum()), len(labels)
    if not 0 < positive < total:
        return none
    names, everywhere, toxic = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first, values, offsets in text_slices(texts, SLICE_BYTES):
        held.append(_seen(bags(values, offsets), labels[first : first + len(offsets) - 1]))
        if len(held) == 4:
            names, everywhere, toxic = _added([(names, everywhere, toxic), *held])
            held = []
    names, everywhere, toxic = _added([(names, everywhere, toxic), *held])
    gain = _told(toxic, everywhere, positive, total)
    gain[(everywhere < LEAST_DOCUMENTS) | (toxic * total <= everywhere * positive)] = 0
    best = np.argsort(-gain, kind="stable")[:FEATURES]
    features = names[np.sort(best[gain[best] >= LEAST_GAIN])]
    if not len(features):
        return none

    who, what, owner, base = [], [], [], 0
    for first, values, offsets in text_slices(texts, SLICE_BYTES):
        found = bags(values, offsets)
        sentence, feature = _known(found, features)
        kept, local = np.unique(sentence, return_inverse=True)
        who.append(local + base)
        what.append(feature)
        owner.append(found.row[kept] + first)
        base += len(kept)
    return _descend(features, np.concatenate(who), np.concatenate(what), np.concatenate(owner), labels)


def _seen(found: Bags, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of some texts, the documents that have them and the toxic ones among these."""
    doc = found.row[found.sentence]
    order = np.lexsort((found.feature, doc))
    doc, feature = doc[order], found.feature[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])
    names, at = np.unique(feature[new], return_inverse=True)
    return names, np.bincount(at, minlength=len(names)), np.bincount(at, labels[doc[new]], len(names))


def _added(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    count = lambda i: np.bincount(at, np.concatenate([p[i] for p in parts]), len(names))
    return names, count(1), count(2)


def _told(toxic: np.ndarray, everywhere: np.ndarray, positive: int, total: int) -> np.ndarray:
    """Log-likelihood ratio of presence and label."""

    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / expected), 0)

    share = everywhere / total
    clean = everywhere - toxic
    return (
        part(toxic, positive * share)
        + part(clean, (total - positive) * share)
        + part(positive - toxic, positive * np.maximum(1 - share, 1e-9))
        + part(total - positive - clean, (total - positive) * np.maximum(1 - share, 1e-9))
    )


def _descend(features, who, what, owner, labels) -> Model:
    """Adam on the documents' log loss; sentences without a known feature are left out."""
    n = len(owner)
    theta = np.zeros(len(features) + 1)
    theta[-1] = START
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    y = labels.astype(float)
    for step in range(1, STEPS + 1):
        z = np.bincount(who, theta[:-1][what], n) + theta[-1]
        silent = np.bincount(owner, _softplus(z), len(y))  # -log of the chance that no sentence offends
        p = -np.expm1(-silent)
        p_z = 1 / (1 + np.exp(-z))
        pull = np.where(y > 0, -np.exp(-silent) / np.maximum(p, 1e-12), 1.0)
        g_z = pull[owner] * p_z / len(y)
        gradient = np.append(np.bincount(what, g_z[who], len(features)), g_z.sum())
        gradient[:-1] += RIDGE * theta[:-1] / 10
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return Model(features, theta[:-1].copy(), float(theta[-1]))


def learn(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """A model from the labelled rows of ``docs``, or a sample of ``sample_rows`` of them."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).where(
        F.octet_length(text) <= SAMPLE_TEXT_BYTES
    )
    rows = rows.select(
        F.xxhash64(key, text).alias("order"), F.col(text).alias("text"), F.col(label).cast("int").alias("label")
    )
    # Rows under a hash bound, so that no task or driver holds more than about the sample.
    count = rows.count()
    if count > sample_rows:
        share = (sample_rows + 4 * sample_rows**0.5) / count
        if share < 1:
            rows = rows.where(F.col("order") < int(-(2**63) + share * 2**64))
    sample = rows.orderBy("order", "text").limit(sample_rows).toArrow()
    return fit(sample["text"].combine_chunks(), sample["label"].to_numpy().astype(np.int64))


def _score(shipped, locate: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for first, values, offsets in text_slices(batch["text"]):
                found = bags(values, offsets)
                z = model.sentences(found)
                n = len(offsets) - 1
                silent = np.bincount(found.row, _softplus(z), n)
                scores[first : first + n] = -np.expm1(-silent)
                p = 1 / (1 + np.exp(-z))
                ends = np.append(found.low[1:], len(values))
                for i in np.flatnonzero(p >= locate):
                    row = found.row[i]
                    at = values[offsets[row] : found.low[i]].tobytes().decode()
                    said = values[found.low[i] : min(ends[i], offsets[row + 1])].tobytes().decode()
                    spans[first + row].append({"start": len(at), "end": len(at) + len(said), "score": float(p[i])})
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"],
                    "score": pa.array(scores),
                    "sentences": pa.array(spans, _SPANS),
                }
            )

    return task


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def score(
    docs: DataFrame, model: Model, *, key: str = "doc_id", text: str = "text", locate: float = LOCATE
) -> DataFrame:
    """``(doc_id, score, sentences)``; ``sentences`` are the offending ones, by code point,
    with a score of ``locate`` or more."""
    ship(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(
        _score(shipped, locate),
        "doc_id long, score double, sentences array<struct<start:bigint,end:bigint,score:double>>",
    )
