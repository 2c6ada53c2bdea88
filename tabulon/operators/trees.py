"""Trees of two classes over binned features, each grown by one process that holds one byte a row and feature.

The method is that of Spark's forests: bins by quantiles, a bootstrap sample a tree, a draw of sqrt(features) a node, Gini gain over
class-weighted rows, a least number of sampled rows a child, and alike sibling leaves merged.
"""

from __future__ import annotations

import numpy as np

BINS = 32
EVERY = 2048  # below so many rows, a node's features are counted one by one


def class_weights(label: np.ndarray) -> np.ndarray:
    """Rows over twice the rows of the class."""
    return len(label) / (2.0 * np.maximum(np.bincount(label, minlength=2), 1))


def cuts(values: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Upper ends of all bins but the last, of sorted distinct values: all midpoints if there are few values, else those nearest to equal weights."""
    middle = (values[1:] + values[:-1]) / 2
    if len(values) <= BINS:
        return middle
    upto = np.cumsum(weight)
    twice = upto[1:] + upto[:-1]
    out, at = [], 0
    for target in upto[-1] * np.arange(1, BINS) / BINS:
        at = max(at, int(np.searchsorted(twice, 2 * target, side="right")))
        if at == len(middle):
            break
        out.append(middle[at])
        at += 1
    return np.array(out)


def binned(column: np.ndarray, label: np.ndarray, fold: np.ndarray, folds: list[int]) -> list[np.ndarray]:
    """For each fold a byte a row: the column's bin, with cuts from the rows of the other folds only."""
    order = np.argsort(column, kind="stable")
    held, y = fold[order], label[order]
    values, first = np.unique(column[order], return_index=True)
    out = []
    for k in folds:
        weight = np.add.reduceat(np.where(held != k, class_weights(label[fold != k])[y], 0.0), first)
        known = weight > 0
        bins = np.searchsorted(cuts(values[known], weight[known]), values, side="left").astype(np.uint8)
        codes = np.empty(len(column), np.uint8)
        codes[order] = np.repeat(bins, np.diff(np.append(first, len(column))))
        out.append(codes)
    return out


def _histograms(codes: list[np.ndarray], chosen: np.ndarray, rows: np.ndarray, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """(features, classes, bins) of sampled rows; of many rows, two features are counted at a time and their shares summed."""
    out = np.empty((len(chosen), 2, BINS))
    paired = len(chosen) // 2 * 2 if len(rows) >= EVERY else 0
    if paired:
        classes = label.take(rows).astype(np.uint16) * np.uint16(BINS * BINS)
        for j in range(0, paired, 2):
            both = codes[chosen[j]].take(rows).astype(np.uint16)
            both *= np.uint16(BINS)
            both += codes[chosen[j + 1]].take(rows)
            both += classes
            counts = np.bincount(both, weight, BINS * BINS * 2).reshape(2, BINS, BINS)
            out[j], out[j + 1] = counts.sum(axis=2), counts.sum(axis=1)
    if paired < len(chosen):
        classes = label.take(rows) * np.uint8(BINS)
        for j in range(paired, len(chosen)):
            out[j] = np.bincount(codes[chosen[j]].take(rows) + classes, weight, BINS * 2).reshape(2, BINS)
    return out


class Grower:
    """Grows trees on ``train`` rows of binned features and adds up their probabilities of label 1 of the ``held`` rows."""

    def __init__(self, codes: list[np.ndarray], label: np.ndarray, train: np.ndarray, held: np.ndarray, depth: int = 8, least: int = 2, per_node: int | None = None) -> None:
        self.codes, self.label, self.train, self.held, self.depth, self.least = codes, label, train, held, depth, least
        self.class_weight = class_weights(label[train])
        self.per_node = per_node or int(np.ceil(np.sqrt(len(codes))))

    def add(self, sums: np.ndarray, rng: np.random.Generator, bootstrap: bool = True) -> None:
        """Adds one tree's probabilities to ``sums``, one a row of the table."""
        n = len(self.train)
        times = np.bincount(rng.integers(0, n, n), minlength=n) if bootstrap else np.ones(n, np.int64)
        taken = np.flatnonzero(times)
        rows, weight = self.train.take(taken), times.take(taken).astype(np.float64)
        total = np.zeros((2 << self.depth, 2))  # sampled rows by node and class; the children of i are 2 i and 2 i + 1
        total[1] = np.bincount(self.label[rows], weight, 2)
        split = np.zeros(2 << self.depth, bool)
        ends: list[tuple[int, np.ndarray]] = []
        level = [(1, rows, weight, self.held)]
        for at in range(self.depth):
            open_ = []
            for node in level:
                if total[node[0]].min() > 0 and total[node[0]].sum() >= 2 * self.least:
                    open_.append(node)
                else:
                    ends.append((node[0], node[3]))
            if not open_:
                break
            drawn = rng.random((len(open_), len(self.codes))).argsort(axis=1)[:, : self.per_node]
            counts = np.stack([_histograms(self.codes, c, r, w, self.label) for c, (_, r, w, _) in zip(drawn, open_)])
            left = counts.cumsum(axis=3)
            right = left[..., -1:] - left
            (l0, l1), (r0, r1) = ((x[:, :, 0] * self.class_weight[0], x[:, :, 1] * self.class_weight[1]) for x in (left, right))
            with np.errstate(divide="ignore", invalid="ignore"):
                pure = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
            pure[(left.sum(axis=2) < self.least) | (right.sum(axis=2) < self.least)] = -1
            flat = pure.reshape(len(open_), -1)
            best = flat.argmax(axis=1)
            whole = np.stack([total[node[0]] for node in open_]) * self.class_weight
            mass = whole.sum(axis=1)
            gain = flat[np.arange(len(open_)), best] - (whole**2).sum(axis=1) / mass
            level = []
            for k, (i, r, w, h) in enumerate(open_):
                if gain[k] <= 1e-12 * mass[k]:
                    ends.append((i, h))
                    continue
                j, b = divmod(int(best[k]), BINS)
                codes = self.codes[drawn[k, j]]
                split[i], total[2 * i], total[2 * i + 1] = True, left[k, j, :, b], right[k, j, :, b]
                low = codes.take(h) <= b
                below, above = h.take(np.flatnonzero(low)), h.take(np.flatnonzero(~low))  # several times faster than h[low]
                if at == self.depth - 1:
                    ends += [(2 * i, below), (2 * i + 1, above)]
                    continue
                low = codes.take(r) <= b
                for child, own, part in ((2 * i, below, np.flatnonzero(low)), (2 * i + 1, above, np.flatnonzero(~low))):
                    level.append((child, r.take(part), w.take(part), own))
        share = total * self.class_weight
        one = share[:, 1] > share[:, 0]
        for i in range((1 << self.depth) - 1, 0, -1):  # siblings of the same class become one leaf, from below
            if split[i] and not split[2 * i] and not split[2 * i + 1] and one[2 * i] == one[2 * i + 1]:
                split[i] = False
        for i, h in ends:
            leaf = i
            while i > 1:
                i >>= 1
                if not split[i]:
                    leaf = i
            sums[h] += share[leaf, 1] / share[leaf].sum()
