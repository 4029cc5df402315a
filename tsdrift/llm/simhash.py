"""SimHash near-duplicates by vantage-point trees.

Fingerprints at most ``radius`` bits apart are linked; groups are the connected
components.

Trees.  Distances of 64-bit fingerprints crowd around 32, where a tree over
whole fingerprints prunes little.  So the bits are cut into parts, each with a
radius of its own such that the radii plus one sum up to ``radius + 1``: two
fingerprints within ``radius`` bits are within the own radius of some part, or
the misses would sum up to more.  One tree per part then prunes well: a node
has a vantage point v and a bound m, the points within m of v go inside, the
others outside, and a query of radius r goes inside only if d - r <= m and
outside only if d + r > m (triangle bounds on the part's distance).

Shards.  The upper levels are built from a bounded sample of the distinct
fingerprints (about 16 per shard) and sent to all tasks.  Every fingerprint has one home
shard per tree and visits the shards its ball overlaps: a home point inside
visits outside, which finds each separated pair once.  Every shard builds its
own tree over its home points and queries it with homes and visitors; what
remains in a leaf is compared exactly, on all 64 bits.  The sample only steers
balance: every distinct fingerprint is indexed and every overlap is queried, so
the pairs are exact.

Copies share a fingerprint and enter once.  A shard reports a spanning star of
the links it finds, not the pairs, and a leaf does not compare points already
linked to each other, so a large group of near copies costs about its size
times the points outside the group.

Defined cases: a null, empty or blank text has fingerprint zero and is linked
like any other; fewer words than a shingle are one shingle; a bit set in exactly
half of the hashes is 0; repeated rows share a fingerprint; null ids never name a
component unless all its ids are null; an empty table gives no rows; very long
texts are hashed whole.  All columns of the input stay, whatever their names, but
one named ``component_id`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsdrift.llm.common import keyed_rows
from tsdrift.llm.components import components
from tsdrift.session import materialize

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
SHARD_POINTS = 4096
SAMPLE_PER_SHARD = 16
MAX_SAMPLE = 1 << 20  # 8 MB of fingerprints on the driver
LEAF = 48
ALL_BITS = 0xFFFFFFFFFFFFFFFF


def parts(radius: int) -> list[tuple[int, int]]:
    """(bit mask, radius) per tree: radii 1 and a last one of 0 where that fits
    the sum, the wider parts for the wider radii."""
    own = [1] * ((radius + 1) // 2) + [0] * ((radius + 1) % 2)
    weights = [r * 0.28 + 1 for r in own]
    edges = [round(64 * x / sum(weights)) for x in accumulate([0.0, *weights])]
    return [(((1 << b) - (1 << a)), r) for a, b, r in zip(edges, edges[1:], own)]


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """SimHash of one text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b - 1], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1:])], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k:k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """Column of fingerprints (as signed long)."""

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(t, shingle) for t in s], dtype=np.uint64).view(np.int64))

    return run(text)


def distance(a: np.ndarray, b: np.ndarray, mask: int = ALL_BITS) -> np.ndarray:
    return np.bitwise_count((a ^ b) & np.uint64(mask)).astype(np.int64)


class VantageTree:
    """Arrays of nodes: vantage point, bound, children (or -1 and a leaf)."""

    def __init__(self, points: np.ndarray, mask: int, radius: int, leaf_size: int, depth: int = 64):
        self.mask, self.radius = mask, radius
        vantage, bound, inside, outside, leaf = [], [], [], [], []
        self.leaves = 0
        todo = [(np.arange(len(points)), depth, -1, 0)]
        while todo:
            own, levels, parent, side = todo.pop()
            node = len(vantage)
            if parent >= 0:
                (outside if side else inside)[parent] = node
            m = v = 0
            split = None
            if len(own) > leaf_size and levels:
                # candidates for the vantage point: the one with the fewest points near its bound
                best = None
                for c in own[:: max(1, len(own) // 5)][:5]:
                    d = distance(points[own], points[c], mask)
                    cut = int(np.sort(d)[(len(d) - 1) // 2])
                    if cut == d.max():
                        cut = int(d[d < cut].max()) if (d < cut).any() else cut
                    if cut < d.max():
                        near = int(((d > cut - radius) & (d <= cut + radius)).sum()) + abs(2 * int((d <= cut).sum()) - len(d)) // 2
                        if best is None or near < best[0]:
                            best = (near, int(points[c]), cut, d <= cut)
                if best:
                    _, v, m, split = best
            vantage.append(v)
            bound.append(m)
            inside.append(-1)
            outside.append(-1)
            leaf.append(-1)
            if split is None:
                leaf[node] = self.leaves
                self.leaves += 1
            else:
                todo.append((own[split], levels - 1, node, 0))
                todo.append((own[~split], levels - 1, node, 1))
        self.vantage = np.array(vantage, dtype=np.uint64)
        self.bound, self.inside, self.outside, self.leaf = (np.array(x, dtype=np.int64) for x in (bound, inside, outside, leaf))

    def visit(self, points: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, leaf, is home) of every leaf to look at.  ``home`` marks the
        points that live in the tree; the others only query it."""
        at, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        out = []
        while len(at):
            done = self.leaf[node] >= 0
            if done.any():
                out.append((at[done], self.leaf[node[done]], home[done]))
                at, node, home = at[~done], node[~done], home[~done]
            d = distance(points[at], self.vantage[node], self.mask)
            m = self.bound[node]
            here = np.where(home, d <= m, d - self.radius <= m)
            there = np.where(home, d > m, d + self.radius > m)
            guest = home & here & (d + self.radius > m)  # inside: its ball reaches out
            at, node, home = (
                np.concatenate([at[here], at[there], at[guest]]),
                np.concatenate([self.inside[node[here]], self.outside[node[there]], self.outside[node[guest]]]),
                np.concatenate([home[here], home[there], np.zeros(int(guest.sum()), bool)]))
        if not out:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def leaf_stars(fps: np.ndarray, homes: np.ndarray, radius: int) -> list[tuple[int, np.ndarray]]:
    """Links of a leaf as stars (centre, members), positions in ``fps``; at
    least one end of a compared pair is among ``homes``."""
    n = len(fps)
    label = np.arange(n)
    linked = False
    for k in range(0, len(homes), 64):
        chunk = homes[k:k + 64]
        main = np.bincount(label).argmax() if linked else -1
        of_main = label[chunk] == main
        for rows, cand in ((chunk[~of_main], np.arange(n)), (chunk[of_main], np.flatnonzero(label != main))):
            for c in range(0, len(cand) if len(rows) else 0, 1 << 16):
                part = cand[c:c + (1 << 16)]
                near = distance(fps[rows][:, None], fps[part][None, :]) <= radius
                for i in np.flatnonzero(near.any(axis=1)).tolist():
                    found = np.unique(np.append(label[part[near[i]]], label[rows[i]]))
                    if len(found) > 1:
                        label[np.isin(label, found)] = found[0]
                        linked = True
    if not linked:
        return []
    order = np.argsort(label, kind="stable")
    edges = np.flatnonzero(np.r_[True, label[order][1:] != label[order][:-1], True])
    return [(int(order[a]), order[a + 1:b]) for a, b in zip(edges, edges[1:]) if b - a > 1]


def _shard_links(radius: int, cuts: list[tuple[int, int]]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask, own_radius = cuts[int(pdf["tree"].iloc[0])]
        pdf = pdf.sort_values(["home", "fp"])  # the same tree whatever the order of arrival
        fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        home = pdf["home"].to_numpy(bool)
        tree = VantageTree(fps[home], mask, own_radius, LEAF)
        at, leaf, lives = tree.visit(fps, home)
        order = np.lexsort((~lives, leaf))
        at, leaf, lives = at[order], leaf[order], lives[order]
        edges = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True])
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for s, e in zip(edges, edges[1:]):
            some = fps[at[s:e]]
            for centre, members in leaf_stars(some, np.flatnonzero(lives[s:e]), radius):
                a.append(np.full(len(members), some[centre], np.uint64))
                b.append(some[members])
        links = pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})
        return links[links["a"] != links["b"]].drop_duplicates()

    return run


def links(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``points`` (fp, a
    written table) that connect all pairs within ``radius`` bits."""
    cuts = parts(radius)
    total = points.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total / shard_points)))))
    size = min(MAX_SAMPLE, SAMPLE_PER_SHARD << depth)
    rows = points.orderBy(F.xxhash64("fp"), "fp").limit(size).collect()
    sample = np.array([r["fp"] for r in rows], dtype=np.int64).view(np.uint64)
    trees = [VantageTree(sample, mask, r, 1, depth) for mask, r in cuts]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            for k, tree in enumerate(trees):
                at, leaf, lives = tree.visit(fps, np.ones(len(fps), bool))
                yield pd.DataFrame({"tree": np.full(len(at), k, np.int32), "shard": leaf,
                                    "fp": fps[at].view(np.int64), "home": lives})

    placed = points.select("fp").mapInPandas(assign, "tree int, shard long, fp long, home boolean")
    return placed.groupBy("tree", "shard").applyInPandas(_shard_links(radius, cuts), "a long, b long")


def near_duplicates(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (doc_id, fp and any other columns; a written table) with
    component_id: the smallest doc_id reachable over links."""
    rows, least = _grouped(prints, radius)
    keep = [F.col("row").getField(c).alias(c) for c in prints.columns if c.lower() != "component_id"]
    return rows.select(*keep, least.alias("component_id"))


def _grouped(prints: DataFrame, radius: int) -> tuple[DataFrame, Column]:
    """The rows of ``prints`` as ``row`` with their ``component``, and the column of
    its smallest doc_id."""
    points = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    groups = components(materialize(links(points.select("fp"), radius), "fingerprint-links"))
    named = points.join(groups, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "c")
    ids = named.join(names, F.col("component") == F.col("c")).select(F.col("fp").alias("f"), "component_id", "component")
    return prints.select(F.struct("*").alias("row")).join(ids, F.col("row.fp") == F.col("f")), F.col("component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE_WORDS) -> DataFrame:
    """One row of each group: that of the smallest doc_id (null last), then the
    smallest hash of the whole row; of fully equal rows, one.  Only keys are
    written; the chosen rows are found in ``docs`` by the key of their content."""
    keyed = keyed_rows(docs)
    light = materialize(keyed.select(
        "key_a", "key_b", F.col("row.doc_id").alias("doc_id"), fingerprints(F.col("row.text"), shingle).alias("fp")), "near-keys")
    best = _grouped(light, radius)[0].select("component", "row.*").groupBy("component").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("unknown"), F.col("doc_id"), F.col("key_a"), F.col("key_b"))).alias("best"))
    best = best.select(F.col("best.key_a").alias("key_a"), F.col("best.key_b").alias("key_b"))
    copies = light.groupBy("key_a", "key_b").agg(F.count("*").alias("copies"))
    chosen = materialize(best.join(copies, ["key_a", "key_b"]), "near-chosen")
    repeated = materialize(chosen.where("copies > 1"), "near-repeated")
    single = keyed.join(chosen.where("copies = 1"), ["key_a", "key_b"], "left_semi")
    once = keyed.join(repeated, ["key_a", "key_b"], "left_semi").dropDuplicates(["key_a", "key_b"])
    return single.unionByName(once).select("row.*")
