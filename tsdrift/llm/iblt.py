"""Document fingerprints by invertible Bloom lookup sketches.

A document is the multiset of its paragraph digests: its lines, long ones cut
every ``PIECE_WORDS`` words so that an edit stays local, and the first
``SINGLE_WORDS`` words of the text one by one so that short texts compare too
(the k-th repeat of a digest is a key of its own).  A sketch deals every key into one cell of each of
three tables; a cell holds a count and the XOR of its keys and of their checks.

To compare two versions their sketches are subtracted, cell by cell, so shared
keys vanish, and peeling takes out the others: a cell that holds one key
reveals it, the key leaves its other cells, which may reveal more.  If cells
stay closed, both versions are sketched again, four times as large and with
another seed, until all differing digests are recovered.  Likeness is the share
of keys not in the difference: 1 - |difference| / (|a| + |b|).

The smallest sketch, in base64, is the fingerprint.  All documents of a batch
are sketched and peeled together in arrays.

Defined cases: a null text is the empty one; two texts without words have
likeness 1; equal texts have equal fingerprints.  Ids are whole numbers, as they
must be ascending (other types are cast to long; text that is no number raises);
repeated ids follow each other in the order of their texts, a null id comes
first.  An empty table gives no rows, a very long text is a batch of its own, and
columns other than doc_id and text are never looked at.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_WORDS = 4
SINGLE_WORDS = 12  # words at the start of a text that are pieces of their own
TABLES = 3
CELLS = 24  # of the fingerprint, all tables together
GROWTH = 4
BUCKET_CHARS = 1 << 20
MAX_BUCKETS = 1 << 14  # beyond this many they hold more characters
BATCH_CHARS = 2 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of ``x`` under ``seed``."""
    x = x + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def digests(text: str) -> np.ndarray:
    """Keys of the paragraph pieces of ``text``; repeats get keys of their own."""
    digest = xxhash.xxh3_64_intdigest
    out: list[int] = []
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        single = max(0, min(len(words), SINGLE_WORDS - len(out)))
        out.extend([digest(w) for w in words[:single]])
        out.extend([digest(b" ".join(words[i:i + PIECE_WORDS])) for i in range(single, len(words), PIECE_WORDS)])
    keys = np.array(out, dtype=np.uint64)
    if len(set(out)) < len(out):
        order = np.argsort(keys, kind="stable")
        s = keys[order]
        first = np.r_[True, s[1:] != s[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        repeat = np.empty(len(s), np.uint64)
        repeat[order] = (np.arange(len(s)) - start).astype(np.uint64)
        keys = np.where(repeat > 0, _mix(keys ^ (repeat * _M2), 5), keys)
    return keys


class Sketches:
    """Sketches of many documents side by side; ``cells`` each."""

    def __init__(self, docs: int, cells: int, seed: int = 0):
        self.docs, self.cells, self.seed = docs, cells, seed
        self.count = np.zeros(docs * cells, np.int64)
        self.keys = np.zeros(docs * cells, np.uint64)
        self.checks = np.zeros(docs * cells, np.uint64)

    def _cells(self, doc: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
        width = self.cells // TABLES
        return [doc * self.cells + t * width + (_mix(keys, 11 + self.seed * 8 + t) % np.uint64(width)).astype(np.int64)
                for t in range(TABLES)]

    def add(self, doc: np.ndarray, keys: np.ndarray, sign) -> np.ndarray:
        """Adds ``sign`` of every key; returns the cells it touched."""
        at = np.concatenate(self._cells(doc, keys))
        np.add.at(self.count, at, np.tile(np.broadcast_to(sign, keys.shape), TABLES))
        order = np.argsort(at, kind="stable")
        s = at[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, np.int64)
        if len(first):
            own = order % len(keys)
            self.keys[s[first]] ^= np.bitwise_xor.reduceat(keys[own], first)
            self.checks[s[first]] ^= np.bitwise_xor.reduceat(_mix(keys, 3)[own], first)
        return s[first]

    def minus(self, other: "Sketches") -> "Sketches":
        out = Sketches(0, self.cells, self.seed)
        out.docs = self.docs
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered (document, key, sign) and which documents came out whole."""
        found = []
        at = np.arange(len(self.count))
        while len(at):
            pure = at[np.abs(self.count[at]) == 1]
            pure = pure[self.checks[pure] == _mix(self.keys[pure], 3)]
            if not len(pure):
                break
            doc, keys, sign = pure // self.cells, self.keys[pure], self.count[pure]
            order = np.lexsort((keys, doc))  # a key may show in several cells
            once = order[np.r_[True, (keys[order][1:] != keys[order][:-1]) | (doc[order][1:] != doc[order][:-1])]]
            doc, keys, sign = doc[once], keys[once], sign[once]
            found.append((doc, keys, sign))
            at = self.add(doc, keys, -sign)
        closed = (self.count != 0) | (self.keys != 0) | (self.checks != 0)
        whole = ~closed.reshape(self.docs, self.cells).any(axis=1)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), whole
        return *[np.concatenate(x) for x in zip(*found, strict=True)], whole

    def text(self, doc: int) -> str:
        own = slice(doc * self.cells, (doc + 1) * self.cells)
        parts = (self.count[own].astype("<i4"), self.keys[own].astype("<u8"), (self.checks[own] >> np.uint64(32)).astype("<u4"))
        return base64.b64encode(b"".join(p.tobytes() for p in parts)).decode("ascii")


def sketch(sets: list[np.ndarray], cells: int = CELLS, seed: int = 0) -> Sketches:
    out = Sketches(len(sets), cells, seed)
    if sets:
        out.add(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets), 1)
    return out


def differences(a: list[np.ndarray], b: list[np.ndarray], sa: Sketches | None = None, sb: Sketches | None = None
                ) -> list[np.ndarray]:
    """Recovered keys in which a[i] and b[i] differ.  ``sa`` and ``sb`` are
    their smallest sketches, if at hand."""
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(a)
    todo, cells, seed = np.arange(len(a)), CELLS, 0
    while len(todo):
        left = sa if seed == 0 and sa else sketch([a[i] for i in todo], cells, seed)
        right = sb if seed == 0 and sb else sketch([b[i] for i in todo], cells, seed)
        doc, keys, _, whole = left.minus(right).peel()
        order = np.argsort(doc, kind="stable")
        edges = np.searchsorted(doc[order], np.arange(len(todo) + 1))
        for k in np.flatnonzero(whole).tolist():
            out[todo[k]] = keys[order[edges[k]:edges[k + 1]]]
        todo, cells, seed = todo[~whole], cells * GROWTH, seed + 1
    return out


def likeness(a: list[np.ndarray], b: list[np.ndarray], sa: Sketches | None = None, sb: Sketches | None = None) -> list[float]:
    gone = differences(a, b, sa, sb)
    return [1.0 - len(d) / (len(x) + len(y)) if len(x) + len(y) else 1.0 for x, y, d in zip(a, b, gone, strict=True)]


def _versions(rows: list[tuple]) -> pd.DataFrame:
    """Results of all rows but halos; the row after each is its next document."""
    real = [i for i, r in enumerate(rows) if not r[1]]
    texts = [r[3] for r in rows]
    edited = []
    for i in real:
        k = len(texts[i]) // 4
        edited.append(texts[i][:len(texts[i]) - k] + texts[i + 1][:k])
    own = [digests(t) for t in texts]
    new = [digests(t) for t in edited]
    s_all = sketch(own)
    s_new = sketch(new)

    def rows_of(s: Sketches, at: list[int]) -> Sketches:
        out = Sketches(0, s.cells, s.seed)
        out.docs = len(at)
        cells = (np.array(at, dtype=np.int64)[:, None] * s.cells + np.arange(s.cells)).ravel()
        out.count, out.keys, out.checks = s.count[cells], s.keys[cells], s.checks[cells]
        return out

    here, there = rows_of(s_all, real), rows_of(s_all, [i + 1 for i in real])
    mine = [own[i] for i in real]
    return pd.DataFrame({
        "doc_id": [rows[i][2] for i in real],
        "n_chars": [len(texts[i]) for i in real],
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        "fingerprint": [s_all.text(i) for i in real],
        "edited_fingerprint": [s_new.text(k) for k in range(len(real))],
        "near_edited": likeness(mine, new, here, s_new),
        "near_next": likeness(mine, [own[i + 1] for i in real], here, there),
    })


def _fingerprints(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows: list[tuple] = []
    size = 0
    for pdf in batches:
        for bucket, halo, doc_id, text in zip(pdf["bucket"], pdf["halo"], pdf["doc_id"], pdf["text"], strict=True):
            if halo and rows and rows[-1][1] and rows[-1][0] == bucket:
                continue  # the first of equal ids is the next document
            rows.append((bucket, halo, None if pd.isna(doc_id) else int(doc_id), text))
            size += len(text)
            if size >= BATCH_CHARS and len(rows) > 1 and not halo:
                yield _versions(rows[:-1] + [(*rows[-1][:1], True, *rows[-1][2:])])
                rows, size = rows[-1:], len(text)
    if rows:
        yield _versions(rows)


def with_next(docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """Rows of ``docs`` in ascending order of id (null first, then text), dealt
    into buckets of consecutive ids; the first row of each bucket is also the
    last of the bucket before it (the very first follows the last bucket), as
    ``halo``.  A task streams its buckets in order, so a bucket need not fit in
    memory.  The driver sees the bounds and first ids of the buckets,
    ``MAX_BUCKETS`` numbers each at most."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    chars = keyed.agg(F.sum(F.length("text"))).head()[0] or 0
    parts = min(MAX_BUCKETS, int(chars // bucket_chars) + 1)
    cuts = [k / parts for k in range(1, parts)]
    bounds = np.unique(keyed.agg(F.percentile_approx("key", cuts, 20 * parts)).head()[0] or []) if cuts else []
    bounds = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("long")
    def bucket(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(np.int64), side="right"))

    heads = sorted(keyed.groupBy(bucket("key").alias("bucket")).agg(F.min("key").alias("key")).collect())
    first = np.array([h["key"] for h in heads], dtype=np.int64)  # ascending
    before = np.array([heads[i - 1]["bucket"] for i in range(len(heads))], dtype=np.int64)

    @F.pandas_udf("long")
    def ahead(keys: pd.Series) -> pd.Series:
        """The bucket that ends with this key's row, -1 for most."""
        k = keys.to_numpy(np.int64)
        at = np.searchsorted(first, k)
        hit = first[np.minimum(at, len(first) - 1)] == k
        return pd.Series(np.where(hit, before[np.minimum(at, len(first) - 1)], -1))

    dealt = keyed.withColumn("own", bucket("key")).withColumn("ahead", ahead("key"))
    home = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("halo"))
    guest = F.struct(F.col("ahead").alias("bucket"), F.lit(True).alias("halo"))
    homes = F.explode(F.when(F.col("ahead") >= 0, F.array(home, guest)).otherwise(F.array(home)))
    return dealt.select("doc_id", "text", "key", homes.alias("home")).select("doc_id", "text", "key", "home.*").repartition(
        "bucket").sortWithinPartitions("bucket", "halo", "key", "text")


def versions(docs: DataFrame, bucket_chars: int = BUCKET_CHARS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next."""
    return with_next(docs, bucket_chars).select("doc_id", "text", "bucket", "halo").mapInPandas(
        _fingerprints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double")
