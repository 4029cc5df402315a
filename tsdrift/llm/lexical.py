"""Ranked lexical search of many queries at once, sharing their common parts.

Terms are runs of ASCII letters and digits and of any character beyond ASCII, A-Z in
lower case.  A document's score for an item is the sum over the item's distinct terms
of an integer weight of the term in the document, so any set of terms two items share
contributes the same partial sum to both.

Query-sharing DAG.  Its leaves are the terms of the items.  The pair of nodes that
most items still hold side by side becomes a node of its own, the sum of the two, and
replaces them in these items; this is repeated until no pair is held by two items.
Each node is then materialised once per block of documents, as a row of partial
accumulators, in the order of the DAG, and an item is the sum of the few nodes left to
it.  Sums of integers do not depend on the order, so scores are exact.

Two passes.  The first reads the texts once and writes a small table: the number of
terms of every document and its counts of terms that some item asks for.  From it come
the corpus statistics (documents, all terms, documents per term).  The second scores
all documents, a block at a time, and keeps the best of each item per task; the best
of all tasks are found in two steps, so that no task sees more than a share of them.

Items are worked off in blocks of at most ``ITEMS`` items and ``PAIRS`` term pairs, so
what tasks and the driver hold (terms, the DAG) is bounded, however many items there
are; of an item with more pairs than that alone, the terms fewest items ask for are left
out of the sharing, not out of the sum.

Defined cases: null or empty texts have no term and are never returned; an item without
a term known to the corpus returns nothing; repeated documents and documents without an
id are ranked each (equal scores: ascending id, null last); items with one text have one
result each; a repeated item id is two items; empty tables give no rows; a very long text
is a block of its own.  Other columns are never looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsdrift.llm.bytewords import byte_ranges, byte_table, gathered, split
from tsdrift.session import materialize

BEST = 50
ITEMS = 1024  # items of a block, or fewer:
PAIRS = 1 << 20  # term pairs of its items
CHUNK = 8 << 20  # bytes of text split at a time
BLOCK = 256  # documents scored at a time
SALTS = 64

TABLE = byte_table(byte_ranges((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)))


class Dag:
    """Shared sums of the items' term sets.

    ``nodes`` has (left, right) of every inner node; node ``k`` of them is numbered
    ``leaves + k``, and its parts come before it.  ``roots`` has each item's nodes."""

    def __init__(self, items: list[list[int]], leaves: int):
        self.leaves = leaves
        self.nodes: list[tuple[int, int]] = []
        self.roots = [set(x) for x in items]
        holders: dict[tuple[int, int], set[int]] = defaultdict(set)
        asked = Counter(t for own in self.roots for t in own)
        widest = math.isqrt(2 * PAIRS)
        for k, own in enumerate(self.roots):
            shared = sorted((t for t in own if asked[t] > 1), key=lambda t: (-asked[t], t))[:widest]
            for pair in combinations(sorted(shared), 2):
                holders[pair].add(k)
        queue = [(-len(h), pair) for pair, h in holders.items() if len(h) > 1]
        heapq.heapify(queue)
        while queue:
            n, pair = heapq.heappop(queue)
            now = len(holders[pair])
            if now < 2:
                continue
            if now != -n:  # fewer by now: back into the queue
                heapq.heappush(queue, (-now, pair))
                continue
            node = leaves + len(self.nodes)
            self.nodes.append(pair)
            members = list(holders.pop(pair))
            touched = Counter()
            for k in members:
                own = self.roots[k]
                own -= set(pair)
                for x in own:
                    for old in pair:
                        holders[min(x, old), max(x, old)].discard(k)
                    holders[x, node].add(k)
                    touched[x] += 1
                own.add(node)
            for x, count in touched.items():
                if count > 1:
                    heapq.heappush(queue, (-count, (x, node)))

    def additions(self) -> int:
        return len(self.nodes) + sum(max(0, len(r) - 1) for r in self.roots)

    def evaluate(self, rows: np.ndarray) -> np.ndarray:
        """Item sums from ``rows`` (leaves x documents)."""
        every = np.empty((self.leaves + len(self.nodes), rows.shape[1]), np.int64)
        every[:self.leaves] = rows
        for k, (a, b) in enumerate(self.nodes, self.leaves):
            np.add(every[a], every[b], out=every[k])
        out = np.zeros((len(self.roots), rows.shape[1]), np.int64)
        for k, own in enumerate(self.roots):
            if own:
                np.sum(every[sorted(own)], axis=0, out=out[k])
        return out


def _postings(terms: list[str]):
    """Per document: number of terms, and the asked ones as (term, count)."""
    asked = pa.array(terms, pa.string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in gathered(batches, 1, CHUNK):
            table = table.combine_chunks()
            words, doc, _ = split(pa.concat_arrays(table["text"].chunks), TABLE)
            n = np.bincount(doc, minlength=len(table))
            at = pc.index_in(words, value_set=asked)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            keys, counts = np.unique(doc[known] * len(terms) + at.drop_null().to_numpy().astype(np.int64), return_counts=True)
            ends = pa.array(np.r_[0, np.cumsum(np.bincount(keys // len(terms), minlength=len(table)))].astype(np.int32))
            out = pa.RecordBatch.from_arrays([
                pa.concat_arrays(table["doc_id"].chunks), pa.array(n.astype(np.int64)),
                pa.ListArray.from_arrays(ends, pa.array((keys % len(terms)).astype(np.int32))),
                pa.ListArray.from_arrays(ends, pa.array(counts.astype(np.int64)))], ["doc_id", "n", "terms", "counts"])
            yield out.filter(pc.greater(out.column(1), 0))

    return run


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of every term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _scorer(dag: Dag, weight: np.ndarray, documents: int, length: int, best: int):
    """The best documents per item of a task: item, doc_id, score."""

    def scores(n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n * documents) // length
        rows = np.zeros((dag.leaves, len(n)), np.int64)
        rows[term, doc] = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        return dag.evaluate(rows)

    def reduced(item, ids, score):
        order = sorted(range(len(ids)), key=lambda k: (item[k], -score[k], ids[k] is None, ids[k] if ids[k] is not None else 0))
        item, score = item[order], score[order]
        keep = np.arange(len(item)) - np.searchsorted(item, item) < best
        return item[keep], [ids[order[k]] for k in np.flatnonzero(keep)], score[keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.zeros(len(dag.roots), np.int64)  # a score below it is not among the best
        held = np.empty(0, np.int64), [], np.empty(0, np.int64)
        kind = pa.null()
        for whole in batches:
            kind = whole.schema.field(0).type
            for at in range(0, len(whole), BLOCK):
                batch = whole.slice(at, BLOCK)
                sizes = pc.list_value_length(batch.column(2)).to_numpy()
                got = scores(batch.column(1).to_numpy(), np.repeat(np.arange(len(batch)), sizes),
                             batch.column(2).flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy())
                item, doc = np.nonzero((got > 0) & (got >= floor[:, None]))
                if not len(item):
                    continue
                ids = batch.column(0).to_pylist()
                held = (np.concatenate([held[0], item]), held[1] + [ids[d] for d in doc.tolist()],
                        np.concatenate([held[2], got[item, doc]]))
                if len(held[0]) > 4 * best * len(floor):
                    held = reduced(*held)
                    full = np.bincount(held[0], minlength=len(floor)) >= best
                    low = np.full(len(floor), np.iinfo(np.int64).max)
                    np.minimum.at(low, held[0], held[2])
                    floor[full] = low[full]
        if len(held[0]):
            item, ids, score = reduced(*held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item.astype(np.int32)), pa.array(ids, kind), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _terms(texts: list[str | None]) -> list[list[str]]:
    """Distinct terms of every text, ascending."""
    words, doc, _ = split(pa.array([t or "" for t in texts], pa.string()), TABLE)
    out: list[set[str]] = [set() for _ in texts]
    for d, w in zip(doc.tolist(), words.to_pylist(), strict=True):
        out[d].add(w)
    return [sorted(x) for x in out]


def _search_block(docs: DataFrame, items: list, asked: str, best: int) -> DataFrame | None:
    """Ranks of the documents for one block of items (rows item_id, text)."""
    own = _terms([r["text"] for r in items])
    terms = sorted(set().union(*own)) if own else []
    if not terms:
        return None
    kind = dict(docs.dtypes)["doc_id"]
    found = materialize(docs.select("doc_id", "text").mapInArrow(
        _postings(terms), f"doc_id {kind}, n long, terms array<int>, counts array<long>"), "postings")
    documents, length = found.agg(F.count("*"), F.sum("n")).head()
    if not documents:
        return None
    df = np.zeros(len(terms), np.int64)
    for r in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the block's terms
        df[r["t"]] = r["count"]
    number = {t: k for k, t in enumerate(terms)}
    dag = Dag([[number[t] for t in x] for x in own], len(terms))
    local = found.mapInArrow(_scorer(dag, weights(df, documents), documents, length, best), f"item int, doc_id {kind}, score long")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(SALTS))
    for keys in (["item", salt], ["item"]):
        local = local.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= best)
    names = docs.sparkSession.createDataFrame(
        [(k, r["item_id"]) for k, r in enumerate(items)], f"k int, item_id {asked}")
    return local.join(F.broadcast(names), F.col("item") == F.col("k")).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, queries: DataFrame, best: int = BEST, block: int = ITEMS) -> DataFrame:
    """The ``best`` documents of ``docs`` (doc_id, text) for every row of ``queries``
    (item_id, text): item_id, rank (int), doc_id, score."""
    kind = dict(docs.dtypes)["doc_id"]
    asked = dict(queries.dtypes)["item_id"]
    rows = queries.select(F.col("item_id"), "text").orderBy("item_id", "text").toLocalIterator()
    out = docs.sparkSession.createDataFrame([], f"item_id {asked}, rank int, doc_id {kind}, score long")
    held: list = []
    pairs = 0

    def flush():
        nonlocal out, held, pairs
        got = _search_block(docs, held, asked, best) if held else None
        if got is not None:
            out = out.unionByName(materialize(got, "ranked"))
        held, pairs = [], 0

    for r in rows:
        n = len(_terms([r["text"]])[0])
        if held and (len(held) == block or pairs + n * n // 2 > PAIRS):
            flush()
        held.append(r)
        pairs += n * n // 2
    flush()
    return out
