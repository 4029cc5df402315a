"""Boosted regression trees of one task's rows, the same trees as Spark ML's.

Spark ML grows a boosted tree level by level, each level a Spark job, so a fit of few
rows takes as long as its thousands of jobs take to start.  Rows that one task holds
anyway need none of them: ``staged_predictions`` does the whole fit where the rows are.
It follows ``GBTRegressor`` (squared loss, variance, continuous features, rows in one
partition) step by step: split candidates, row and feature draws from the same
generators, sums in the same order, the same ties.  ``models.tune`` uses it for folds
up to the rows of one task and Spark ML's distributed fit beyond.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np

U = np.uint64
EPSILON = 2.0 ** -52  # an impurity below it makes a leaf
INVALID = -np.finfo(float).max  # gain of a split that is not allowed
SPLIT_ROWS = 10_000  # split candidates come from about so many rows
NODE_MEMORY = 256 << 20  # a pass over the rows holds the sums of as many nodes as fit in this
AHEAD = 1 << 25  # bytes of random draws made at once


# ---------------------------------------------------------------- generators
def _hashed(words: Sequence[np.ndarray], start: np.ndarray) -> np.ndarray:
    """MurmurHash3 of 32-bit words (held in 64 bits)."""
    low = U(0xFFFFFFFF)
    turned = lambda v, by: ((v << U(by)) | (v >> U(32 - by))) & low
    h = start
    for k in words:
        h = h ^ (turned((k * U(0xCC9E2D51)) & low, 15) * U(0x1B873593)) & low
        h = (turned(h, 13) * U(5) + U(0xE6546B64)) & low
    h = h ^ U(4 * len(words))
    h = ((h ^ (h >> U(16))) * U(0x85EBCA6B)) & low
    h = ((h ^ (h >> U(13))) * U(0xC2B2AE35)) & low
    return h ^ (h >> U(16))


def xorshift_start(seeds: np.ndarray) -> np.ndarray:
    """First states of Spark's XORShiftRandom."""
    raw = np.ascontiguousarray(seeds, dtype=">i8").view("<u4").reshape(*np.shape(seeds), 2).astype(U)
    words = [raw[..., 0], raw[..., 1]]
    low = _hashed(words, np.full(np.shape(seeds), 0x3C074A61, U))
    return (_hashed(words, low) << U(32)) | low


def _stepped(s: np.ndarray) -> np.ndarray:
    s = s ^ (s << U(21))
    s = s ^ (s >> U(35))
    return s ^ (s << U(4))


def _next_double(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = _stepped(s)
    second = _stepped(first)
    bits = ((first & U((1 << 26) - 1)) << U(27)) + (second & U((1 << 27) - 1))
    return second, bits.astype(float) * 2.0 ** -53


def rows_drawn(seeds: np.ndarray, rows: int, rate: float) -> np.ndarray:
    """Which rows each tree sees: (trees, rows)."""
    out = np.empty((rows, len(seeds)), dtype=bool)
    s = xorshift_start(seeds + 1)  # partition 0 of the rows
    for k in range(rows):
        s, x = _next_double(s)
        out[k] = x < rate
    return np.ascontiguousarray(out.T)


def _java_longs(seeds: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` nextLong of java.util.Random: (seeds, count)."""
    step, plus, word = 0x5DEECE66D, 0xB, (1 << 48) - 1
    times, adds, a, c = [], [], 1, 0
    for _ in range(2 * count):
        a, c = a * step & word, (c * step + plus) & word
        times.append(a)
        adds.append(c)
    start = (np.asarray(seeds).astype(U) ^ U(step)) & U(word)
    s = (start[:, None] * np.array(times, U) + np.array(adds, U)) & U(word)
    half = (s >> U(16)).astype(np.uint32).view(np.int32).astype(np.int64)
    return (half[:, ::2] << 32) + half[:, 1::2]


def features_drawn(seeds: np.ndarray, count: int, features: int, per_node: int) -> np.ndarray:
    """The features that the first ``count`` nodes of each tree may split on, in the
    order in which ties are decided: (trees, count, per_node)."""
    kept = np.broadcast_to(np.arange(per_node), (len(seeds), count, per_node)).copy()
    s = xorshift_start(_java_longs(seeds, count))
    for f in range(per_node, features):
        s, x = _next_double(s)
        at = (x * (f + 1)).astype(np.int64)
        tree, node = np.nonzero(at < per_node)
        kept[tree, node, at[tree, node]] = f
    return kept


def _doubles(seed: int) -> Iterator[float]:
    s = xorshift_start(np.array([seed]))
    while True:
        s, x = _next_double(s)
        yield float(x[0])


# ---------------------------------------------------------------- split candidates
def _split_sample(rows: int, share: float, seed: int) -> np.ndarray:
    """Positions of the rows that split candidates are taken from."""
    if share >= 1:
        return np.arange(rows)
    first = int(_stepped(xorshift_start(np.array([seed])))[0]) & 0xFFFFFFFF
    first -= (first >> 31) << 32  # nextInt is signed
    x = _doubles(int(_java_longs(np.array([first]), 1)[0, 0]))
    if share > 0.4:
        return np.flatnonzero([next(x) <= share for _ in range(rows)])
    at, out = -1, []
    while True:
        at += 1 + int(math.log(max(next(x), 5e-11)) / math.log1p(-share))
        if at >= rows:
            return np.array(out, dtype=np.int64)
        out.append(at)


def thresholds(x: np.ndarray, max_bins: int, seed: int) -> list[np.ndarray]:
    """Ascending split candidates of each column: all midpoints where they are few,
    else those nearest to equal shares of the rows."""
    rows = len(x)
    bins = min(max_bins, rows)
    needed = max(bins * bins, SPLIT_ROWS)
    share = needed / rows if needed < rows else 1.0
    expected = share * rows
    sample = x[_split_sample(rows, share, seed)]
    out = []
    for f in range(x.shape[1]):
        known = sample[:, f][sample[:, f] != 0.0]
        values, counts = np.unique(known, return_counts=True)
        if not len(values):
            out.append(np.empty(0))
            continue
        counts = counts.astype(float)
        if expected - len(known) > EPSILON * len(known) * 100:
            at = int(np.searchsorted(values, 0.0))
            values, counts = np.insert(values, at, 0.0), np.insert(counts, at, expected - len(known))
        middle = (values[:-1] + values[1:]) / 2.0
        if len(middle) >= bins:
            stride = expected / bins
            seen, target, keep = counts[0], stride, []
            for k in range(1, len(values)):
                before, seen = seen, seen + counts[k]
                if abs(before - target) < abs(seen - target):
                    keep.append(k - 1)
                    target += stride
            middle = middle[keep]
        out.append(middle)
    return out


def features_per_node(strategy: str, features: int) -> int:
    """A number of features, or a share of them."""
    if strategy.isdigit():
        return min(int(strategy), features)
    return math.ceil(float(strategy) * features)


# ---------------------------------------------------------------- trees
def _variance(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return (squares - total * total / n) / n


def _tree(bins: np.ndarray, label: np.ndarray, seen: np.ndarray, subsets: np.ndarray | None,
          width: int, usable: np.ndarray, depth: int, least_rows: int, least_gain: float) -> np.ndarray:
    """Value of the tree's leaf for every row.  Only the rows ``seen`` grow it."""
    features, rows = bins.shape
    value, slot = np.zeros(rows), np.zeros(rows, dtype=np.int64)
    inside = np.arange(rows)  # rows not in a leaf yet
    nodes, level, drawn = 1, 0, 0
    impurity = number = total = None
    while nodes:
        grow = inside[seen[inside]]
        y, first = label[grow], slot[grow] * width
        weights = None, y, y * y
        sums = np.empty((3, nodes, features, width))
        for f in range(features):
            at = first + bins[f, grow]
            for k, w in enumerate(weights):
                sums[k, :, f] = np.bincount(at, w, nodes * width).reshape(nodes, width)
        n, s, q = np.cumsum(sums, axis=3)
        left = n[..., :-1], s[..., :-1], q[..., :-1]
        right = tuple(a[..., -1:] - b for a, b in zip((n, s, q), left))
        every = np.arange(nodes)
        names = subsets[drawn:drawn + nodes] if subsets is not None else np.broadcast_to(np.arange(features), (nodes, features))
        drawn += nodes
        if level == 0:
            f = next((f for f in names[0] if usable[f]), 0)
            number, total, squares = (np.array([a[0, f, 0] + b[0, f, 0]]) for a, b in zip(left, right))
            impurity = _variance(number, total, squares)
        plain = ~usable[names].any(axis=1)  # nothing to split on: the sums of its own rows
        number[plain], total[plain] = n[plain, names[plain, 0], -1], s[plain, names[plain, 0], -1]
        spread = _variance(*left), _variance(*right)
        both = left[0] + right[0]
        gain = impurity[:, None, None] - left[0] / both * spread[0] - right[0] / both * spread[1]
        allowed = (left[0] >= least_rows) & (right[0] >= least_rows) & ~(gain < least_gain)
        gain = np.where(allowed, gain, INVALID)
        split = gain.argmax(axis=2)
        best = np.take_along_axis(gain, split[..., None], axis=2)[..., 0][every[:, None], names]
        chosen = best.argmax(axis=1)
        feature, best = names[every, chosen], best[every, chosen]
        split = split[every, feature]

        leaf = (best <= 0) | (level == depth)
        here = np.where(number > 0, total / number, 0.0)
        level += 1
        sides = [tuple(a[every, feature, split] for a in (*side, v)) for side, v in zip((left, right), spread)]
        # a node's left and right side at 2 k and 2 k + 1
        number, total = (np.stack([a[k] for a in sides], axis=1).ravel() for k in (0, 1))
        impurity = np.stack([a[3] for a in sides], axis=1).ravel()
        ends = np.repeat(leaf, 2) | (level == depth) | (np.abs(impurity) < EPSILON)
        worth = np.where(np.repeat(leaf, 2), np.repeat(here, 2), total / number)

        mine = slot[inside]
        side = 2 * mine + (bins[feature[mine], inside] > split[mine])
        over = ends[side]
        value[inside[over]] = worth[side[over]]
        inside, side = inside[~over], side[~over]
        last_first = np.flatnonzero(~ends)[::-1]  # nodes wait on a stack
        place = np.zeros(2 * nodes, dtype=np.int64)
        place[last_first] = np.arange(len(last_first))
        slot[inside] = place[side]
        nodes, number, total, impurity = len(last_first), number[last_first], total[last_first], impurity[last_first]
    return value


def fits_one_pass(rows: int, features: int, max_depth: int, max_bins: int) -> bool:
    """Whether the nodes of a level are always grown together (Spark ML splits a level
    whose sums take more memory, which draws features in another order)."""
    return min(2 ** max(0, max_depth - 1), rows) * features * max_bins * 4 * 8 <= NODE_MEMORY


def staged_predictions(x: np.ndarray, y: np.ndarray, held_out: np.ndarray, stages: Sequence[int], trees: int,
                       max_depth: int, learning_rate: float, subsample: float, feature_subset: str, seed: int,
                       max_bins: int = 32, least_rows: int = 1, least_gain: float = 0.0) -> Iterator[tuple[int, np.ndarray]]:
    """Fit ``trees`` trees to the rows (x, y); yield (k, predictions of ``held_out`` by
    the first k trees) for every k in ``stages``."""
    rows, features = x.shape
    if not rows:
        raise ValueError("no rows to fit")
    if not np.isfinite(y).all() or not np.isfinite(x).all():
        raise ValueError("labels and features must not be null, NaN or infinite")
    splits = thresholds(x, max_bins, seed)
    everything = np.concatenate([x, held_out])
    bins = np.stack([np.searchsorted(t, everything[:, f]) for f, t in enumerate(splits)])
    width = max(2, 1 + max(map(len, splits)))
    usable = np.array([len(t) > 0 for t in splits])
    per_node = features_per_node(feature_subset, features)
    nodes = min(2 ** max_depth, 2 * rows)  # of a tree, at most
    ahead = max(1, min(AHEAD // rows, AHEAD // (8 * nodes * per_node)))
    seen = np.zeros(len(everything), dtype=bool)
    prediction, label = np.zeros(len(everything)), y
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(trees):
            if k % ahead == 0:
                seeds = seed + np.arange(k, min(trees, k + ahead), dtype=np.int64)
                bags = rows_drawn(seeds, rows, subsample) if subsample < 1 else np.ones((len(seeds), rows), dtype=bool)
                subsets = features_drawn(seeds, nodes, features, per_node) if per_node < features else [None] * len(seeds)
            seen[:rows] = bags[k % ahead]
            value = _tree(bins, label, seen, subsets[k % ahead], width, usable, max_depth, least_rows, least_gain)
            prediction = prediction + value * learning_rate if k else value
            label = 2.0 * (y - prediction[:rows])
            if k + 1 in stages:
                yield k + 1, prediction[rows:].copy()
