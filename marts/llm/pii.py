"""Personal data: rules find the certain spans, boosted candidates add to them.

Base spans (email, ip, card, phone) follow fixed rules and always stay. High-recall
generators then propose further, overlapping spans around every ``@``, and every group
of digits and join of neighbouring groups. Gradient-boosted trees score a proposal from its format and context, and a
threshold per kind, calibrated on held-out proposals for ``PRECISION``, selects those
that are redacted too.

There are no labelled spans, so the labels are weak: a proposal is positive if it
overlaps a base span of its kind by half of both, or is a card or phone that the rules
would take if its neighbours were not joined to it. All proposals of all rows are learnt
from, copies of a text once; a third of the texts, by hash, is held out for the threshold.
Without enough proposals of both labels a kind adds nothing.

Scale: texts stay where they are; learning shuffles proposals (19 numbers each), counts
them by binned features and sends sums of a bounded number to the driver. Finding is
row-local.

Defined cases: null text is empty; repeated rows get equal results; an empty table
gives an empty result; other columns pass through, those named like an output column
are replaced. Offsets are code points, ends exclusive. All rules run in linear time.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marts.llm.trees import BoostedTrees, boost, counted_rows, quantile_edges
from marts.llm.workers import ship
from marts.session import new_folder

KINDS = ("email", "ip", "card", "phone")

PRECISION = 0.98
LEAST_SPANS = 50
#: Thresholds are multiples of one part of this.
STEPS = 4096

# Fixed patterns of the base rules. Possessive digits and the look-behind only spare
# repeated work; they match the same spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Generators: whatever surrounds an @, and digits with any single separators.
_AROUND = re.compile(r"[^\s@,;<>\"]{1,64}$")
_BEHIND = re.compile(r"[^\s@,;<>\"]{1,255}")
_DIGITS = re.compile(r"\+?[0-9](?:[\x20().\-/]{0,2}[0-9])+")
_GROUP = re.compile(r"\+?[0-9]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", at + 1)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[Span]:
    """The spans of the rules, by kind and then start."""
    out = list(_emails(text))
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


def _numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """Single groups and joins of neighbouring groups of a run with 7 to 19 digits, and their digits.

    Numbers that only a separator parts are one run; every way to part it is proposed.
    """
    for m in _DIGITS.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        for i, (start, _) in enumerate(groups):
            size = 0
            for low, end in groups[i:]:
                size += end - low - (text[low] == "+")
                if size > 19:
                    break
                if size >= 7:
                    yield start, end, size


def proposals(text: str) -> list[Span]:
    """Overlapping spans that might be personal data."""
    out: list[Span] = []
    at = text.find("@")
    while at >= 0:
        before = _AROUND.search(text, max(0, at - 64), at)
        behind = _BEHIND.match(text, at + 1)
        if before and behind:
            out.append(("email", before.start(), behind.end()))
            trimmed = behind.end() - (len(behind[0]) - len(behind[0].rstrip(".:!?)]}'")))
            if at + 1 < trimmed < behind.end():
                out.append(("email", before.start(), trimmed))
        at = text.find("@", at + 1)
    for start, end, size in _numbers(text):
        if text.count(".", start, end) >= 3:
            out.append(("ip", start, end))
        if size >= 15:
            out.append(("card", start, end))
        if size <= 15:
            out.append(("phone", start, end))
    return out


def features(text: str, span: Span) -> list[float]:
    """Format of a span and its context."""
    _, start, end = span
    s = text[start:end]
    digits = [c for c in s if c.isdigit()]
    groups = re.findall(r"[0-9]+", s)
    before, after = text[max(0, start - 16) : start], text[end : end + 16]
    tail = s.rpartition(".")[2]
    return [
        len(s),
        len(digits),
        len(digits) / len(s),
        len(groups),
        max(map(len, groups), default=0),
        s.count("."),
        s.count(" "),
        s.count("-"),
        s.count("(") + s.count(")") + s.count("/"),
        float(s[0] == "+"),
        float("@" in s) + float("." in s.partition("@")[2]),
        float(tail.isalpha() and 2 <= len(tail) <= 6),
        float(sum(not (c.isascii() and (c.isalnum() or c in ".@_%+-")) for c in s)),
        float(all(map(_octet, groups))) if groups else 0.0,
        float(13 <= len(digits) <= 19 and luhn("".join(d for d in digits if d.isascii()))),
        float(before[-1:].isalnum()),
        float(after[:1].isalnum()),
        sum(c.isalpha() for c in before) / max(1, len(before)),
        sum(c.isdigit() for c in before + after) / max(1, len(before) + len(after)),
    ]


def _overlaps(span: Span, base: list[Span], share: float) -> bool:
    kind, start, end = span
    return any(
        k == kind and min(e, end) - max(s, start) >= share * max(e - s, end - start, 1)
        for k, s, e in base
    )


def _alone(text: str, span: Span) -> bool:
    """Whether the rules take a card or phone as it is if nothing stands beside it."""
    kind, start, end = span
    return kind in ("card", "phone") and (kind, 0, end - start) in base_spans(text[start:end])


Model = dict[str, tuple[BoostedTrees, float]]


def _fewest(text: str, base: list[Span], scored: list[tuple[Span, float]]) -> list[Span]:
    """Without number spans whose digits are all in a base span or a better one's.

    Every digit of ``scored`` stays covered. Spans that take in digits of a base span
    come last: they are joins of it with a neighbour.
    """
    taken = bytearray(len(text))
    for kind, start, end in base:
        if kind != "email":
            taken[start:end] = b"\1" * (end - start)
    crossing = {s: 1 in taken[s[1] : s[2]] for s, _ in scored}
    kept = set()
    for s, _ in sorted(scored, key=lambda x: (crossing[x[0]], -x[1], x[0][1] - x[0][2], x[0])):
        kind, start, end = s
        if kind != "email":
            if all(taken[i] for i in range(start, end) if text[i].isdigit()):
                continue
            taken[start:end] = b"\1" * (end - start)
        kept.add(s)
    return [s for s, _ in scored if s in kept]


def added_spans(text: str, base: list[Span], model: Model) -> list[Span]:
    """Proposals that pass their threshold and cover more than base spans and better proposals."""
    out = []
    found = dict.fromkeys(proposals(text))
    for kind in KINDS:
        if kind not in model:
            continue
        # Base spans of a kind do not overlap and are in order.
        spans = [s[1:] for s in base if s[0] == kind]

        def inside(s: Span, spans: list[tuple[int, int]] = spans) -> bool:
            i = bisect_right(spans, s[1], key=lambda b: b[0])
            return i > 0 and s[2] <= spans[i - 1][1]

        own = [s for s in found if s[0] == kind and not inside(s)]
        if own:
            trees, least = model[kind]
            p = trees.probability(np.array([features(text, s) for s in own]))
            out += [(s, x) for s, x in zip(own, p.tolist(), strict=True) if x >= least]
    return _fewest(text, base, out)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every proposal with its weak label, and whether its text is held out."""
    for whole in batches:
        for low in range(0, whole.num_rows, 1024):
            batch = whole.slice(low, 1024)
            out = []
            for h, value in zip(batch["h"].to_pylist(), batch["text"].to_pylist(), strict=True):
                base = base_spans(value)
                for s in dict.fromkeys(proposals(value)):
                    label = _overlaps(s, base, 0.5) or _alone(value, s)
                    out.append((h, *s, h % 3 == 2, int(label), features(value, s)))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.float64()))
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["h", "kind", "start", "end", "held", "positive", "x"])


_LABELLED = "h long, kind string, start long, end long, held boolean, positive long, x array<double>"


def _binned(models: dict[str, BoostedTrees]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = np.array(batch["kind"].to_pylist(), dtype=object)
            bins = np.empty(len(kinds), dtype=object)
            for kind in set(kinds):
                at = np.flatnonzero(kinds == kind)
                x = np.array(batch["x"].take(pa.array(at)).to_pylist())
                bins[at] = [b.tobytes() for b in models[kind].bins(x)]
            yield pa.record_batch(
                [*(batch[c] for c in ("kind", "held", "positive")), pa.array(bins, pa.binary())],
                names=["kind", "held", "positive", "bins"],
            )

    return task


def _steps(models: dict[str, BoostedTrees]):
    """Rows and positive rows by kind and score, in steps."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, bins, n, positive in counted_rows(batch):
                step = np.floor(models[kind].of_bins(bins) * STEPS).astype(np.int64)
                yield pa.record_batch(
                    {"kind": pa.array([kind] * len(n)), "step": step, "n": n, "positive": positive}
                )

    return task


def learn(docs: DataFrame, *, text: str = "text") -> Model:
    """Trees and calibrated threshold per kind, of all proposals of the table.

    Texts that are not held out grow the trees; the threshold is the lowest score from which
    on the others' proposals are right in ``PRECISION`` of the cases, and one half at least.
    """
    spark = docs.sparkSession
    ship(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    folder = new_folder(spark, "proposals")
    # Distinct, so that many copies of one text do not outweigh the others.
    docs.select(F.xxhash64(body).alias("h"), body.alias("text")).mapInArrow(
        _labelled, _LABELLED
    ).distinct().write.parquet(folder)
    found = spark.read.parquet(folder)

    grown = F.when(~F.col("held"), F.col("positive"))
    counts = found.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), F.sum("positive").alias("positive"), F.avg(grown).alias("share")
    )
    enough = [
        r
        for r in counts.collect()
        if r.n >= LEAST_SPANS and min(r.positive, r.n - r.positive) >= LEAST_SPANS // 10 and r.share is not None
    ]
    if not enough:
        return {}
    found = found.where(F.col("kind").isin([r.kind for r in enough]))
    # Spans are of bounded length, so a feature has a bounded number of values.
    values = (
        found.where("not held")
        .select("kind", F.posexplode("x").alias("feature", "value"))
        .groupBy("kind", "feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .toPandas()
        .sort_values(["kind", "feature", "value"])
    )
    edges: dict[str, list[np.ndarray]] = {}
    for (kind, _), own in values.groupby(["kind", "feature"]):
        edges.setdefault(kind, []).append(quantile_edges(own["value"].to_numpy(), own["n"].to_numpy()))
    models = {r.kind: BoostedTrees(edges[r.kind], r.share) for r in sorted(enough)}

    folder = new_folder(spark, "binned")
    found.select("kind", "held", "positive", "x").mapInArrow(
        _binned(models), "kind string, held boolean, positive long, bins binary"
    ).groupBy("kind", "held", "bins").agg(
        F.count(F.lit(1)).alias("n"), F.sum("positive").alias("positive")
    ).write.parquet(folder)
    rows = spark.read.parquet(folder)
    boost(rows.where("not held").select("kind", "bins", "n", "positive"), models)

    scored = (
        rows.where("held")
        .select("kind", "bins", "n", "positive")
        .mapInArrow(_steps(models), "kind string, step long, n long, positive long")
        .groupBy("kind", "step")
        .agg(F.sum("n").alias("n"), F.sum("positive").alias("positive"))
        .collect()
    )
    model: Model = {}
    for kind, trees in models.items():
        n = right = 0
        for r in sorted((r for r in scored if r.kind == kind), key=lambda r: -r.step):
            n, right = n + r.n, right + r.positive
            if 2 * r.step >= STEPS and right >= PRECISION * n:
                model[kind] = (trees, r.step / STEPS)
    return model


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_OUT = "base array<struct<kind:string,start:bigint,end:bigint>>, added array<struct<kind:string,start:bigint,end:bigint>>"


def find(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``added`` spans."""
    ship(docs.sparkSession)
    docs = docs.drop("base", "added")
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(_OUT).fields])
    names = docs.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for value in batch.column(names.index(text)).to_pylist():
                own = base_spans(value) if value else []
                base.append(_rows(own))
                added.append(_rows(added_spans(value, own, model)) if value else [])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(base, pa.list_(_SPAN)), pa.array(added, pa.list_(_SPAN))],
                names=[*names, "base", "added"],
            )

    return docs.mapInArrow(task, schema)


def _rows(spans: list[Span]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e} for k, s, e in spans]


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, joined where they overlap, replaced by ``[KIND]``."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def span_digest(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def base_sha256(spans: list[Span]) -> str:
    return hashlib.sha256(span_digest(spans).encode()).hexdigest()
