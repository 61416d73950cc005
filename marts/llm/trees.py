"""Gradient-boosted trees for a binary label, grown over all rows of a table.

Features are cut into at most ``BINS`` quantile bins; each round fits one tree of
``DEPTH`` levels to the gradients of the logistic loss, all nodes of a level at once.

Several kinds are learnt side by side. Rows with the same bins are one counted row. Each
level of each round is one aggregate over them: tasks score their rows with the trees so far
and sum gradients by node, feature and bin; the driver gets these sums, whose number the
rows do not change. They are whole numbers, so that no order of rows or tasks matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
DEPTH = 3
ROUNDS = 40
RATE = 0.2
LEAST_WEIGHT = 1.0
RIDGE = 1.0
#: Gradients are summed as multiples of one part of this.
UNIT = 1 << 24

Tree = tuple[np.ndarray, np.ndarray, np.ndarray]


def quantile_edges(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Inner borders of ``BINS`` quantile bins of counted values in ascending order."""
    ends = np.cumsum(counts)
    at = np.linspace(0, 1, BINS)[1:-1] * (ends[-1] - 1)
    low = np.floor(at).astype(np.int64)
    a, b = (values[np.searchsorted(ends, i, side="right")] for i in (low, np.minimum(low + 1, ends[-1] - 1)))
    return np.unique(a + (b - a) * (at - low))


class BoostedTrees:
    """Trees over bins: each has its inner nodes' features and last bins on the left, and its leaves."""

    def __init__(self, edges: list[np.ndarray], share: float) -> None:
        self.edges = edges
        share = min(max(share, 1e-4), 1 - 1e-4)
        self.base = float(np.log(share / (1 - share)))
        self.trees: list[Tree] = []

    def bins(self, x: np.ndarray) -> np.ndarray:
        found = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]
        return np.column_stack(found).astype(np.uint8)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.of_bins(self.bins(x))

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        raw = np.full(len(bins), self.base)
        for feature, cut, value in self.trees:
            raw += value[_node(bins, feature, cut, DEPTH) - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-raw))


def _node(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    node = np.zeros(len(bins), dtype=np.int64)
    rows = np.arange(len(bins))
    for _ in range(levels):
        node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
    return node


def counted_rows(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Bins, rows and positive rows of each kind in a batch of ``(kind, bins, n, positive)``."""
    kinds = np.array(batch["kind"].to_pylist(), dtype=object)
    for kind in sorted(set(kinds)):
        at = np.flatnonzero(kinds == kind)
        rows = batch.take(pa.array(at))
        bins = np.frombuffer(b"".join(rows["bins"].to_pylist()), dtype=np.uint8).reshape(len(at), -1)
        yield kind, bins, rows["n"].to_numpy(), rows["positive"].to_numpy()


def _gradients(models: dict[str, BoostedTrees], growing: dict[str, Tree], level: int):
    """Sums of gradients and of their slopes by node of the level, feature and bin."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, bins, n, positive in counted_rows(batch):
                p = models[kind].of_bins(bins)
                node = _node(bins, *growing[kind][:2], level) - (2**level - 1)
                features = bins.shape[1]
                cell = (node[:, None] * features + np.arange(features)) * BINS + bins
                cells, inverse = np.unique(cell.ravel(), return_inverse=True)
                sums = []
                for part in (n * p - positive, n * p * (1 - p)):
                    total = np.zeros(len(cells), dtype=np.int64)
                    np.add.at(total, inverse, np.repeat(np.rint(part * UNIT).astype(np.int64), features))
                    sums.append(total)
                yield pa.record_batch(
                    {"kind": pa.array([kind] * len(cells)), "cell": cells, "g": sums[0], "h": sums[1]}
                )

    return task


def boost(rows: DataFrame, models: dict[str, BoostedTrees]) -> None:
    """Grow the models' trees over all ``rows`` ``(kind, bins, n, positive)`` of their kinds."""
    for _ in range(ROUNDS if models else 0):
        growing = {k: _seedling() for k in models}
        for level in range(DEPTH):
            task = _gradients(models, growing, level)
            sums = (
                rows.mapInArrow(task, "kind string, cell long, g long, h long")
                .groupBy("kind", "cell")
                .agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
                .toArrow()
            )
            for kind, model in models.items():
                own = sums.filter(pa.array(np.array(sums["kind"].to_pylist(), dtype=object) == kind))
                shape = (2**level, len(model.edges), BINS)
                g, h = np.zeros(shape), np.zeros(shape)
                for total, name in ((g, "g"), (h, "h")):
                    total.reshape(-1)[own["cell"].to_numpy()] = own[name].to_numpy() / UNIT
                _split(g, h, model.edges, growing[kind], level)
        for kind, model in models.items():
            model.trees.append(growing[kind])


def _seedling() -> Tree:
    inner = 2**DEPTH - 1
    # Everything goes to the left of a node that is not split.
    return np.zeros(inner, np.int64), np.full(inner, BINS, np.int64), np.zeros(inner + 1)


def _split(g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], tree: Tree, level: int) -> None:
    """Best cut of each node of a level, and the leaves below the last."""
    feature, cut, value = tree
    gl, hl = g.cumsum(2), h.cumsum(2)
    gr, hr = gl[:, :, -1:] - gl, hl[:, :, -1:] - hl
    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (gl + gr) ** 2 / (hl + hr + RIDGE)
    gain[(hl < LEAST_WEIGHT) | (hr < LEAST_WEIGHT)] = 0
    for j, e in enumerate(edges):
        gain[:, j, len(e) :] = 0
    first = 2**level - 1
    for c in range(len(g)):
        j, k = divmod(int(gain[c].argmax()), BINS)
        if gain[c, j, k] <= 1e-9:
            j, k = 0, BINS - 1
        else:
            feature[first + c], cut[first + c] = j, k
        if level == DEPTH - 1:
            value[2 * c] = -RATE * gl[c, j, k] / (hl[c, j, k] + RIDGE)
            value[2 * c + 1] = -RATE * gr[c, j, k] / (hr[c, j, k] + RIDGE)
