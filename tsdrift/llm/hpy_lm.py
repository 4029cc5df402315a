"""Language-model scores from a hierarchical Pitman-Yor model.

Model.  The context of a token is the ending of the word before it: its last
three bytes (shorter words with the space before them), the first two hashed to
a byte.  Each context is a restaurant; restaurants of endings with the same last
byte share a parent, and those parents share the root, whose base is uniform over
the V + 1 types.  A restaurant with discount d and strength s predicts

    p(w) = (n_w - d t_w + (s + d t) p_parent(w)) / (n + s)

from the customers n_w and tables t_w of dish w; tables are the customers of the
parent.  Contexts number 65,536 at most, whatever the corpus.

Seating.  A Gibbs step takes a dish out of a restaurant and seats its customers
again one by one: given j seated at t tables the next opens a table with
probability a / (j - d t + a), a = (s + d t_rest) p_parent(w), the parent's
prediction without this dish's tables.  The waiting time for the next table is
drawn at once (geometric with a beta-distributed rate, the same law), and the
block draw is corrected by a Metropolis step on the ratio of the normalisers.
Beyond ``SINGLE_TABLES`` tables of one dish, seats are drawn in leaps of 2 % of
the customers seated.

Rounds.  A round starts from the seatings the last one wrote and the tables of
all restaurants summed over them, sweeps every shard, and writes its seatings
again.  After ``ROUNDS`` rounds each further one is a sample.  A sample predicts
from the written seatings and their own sums, so the predictions in a context
sum to one over all shards; they are averaged over the samples.

Work.  Tokens are numbered block by block (about ``BLOCK_TOKENS``); per block
each distinct (word, context) pair travels once, to the shard of its word's
hash.  A shard holds all pairs of its words, so all levels of a dish are seated
in one place; shards only share the customers and tables of each restaurant,
bounded vectors that are summed between rounds; within a round the other shards'
are those of its start.  Shards send the averaged predictions back to the blocks,
which add them up per document.  Draws are seeded by shard and round.

Words are known by a 64-bit hash.  Defined cases: a null or blank text is its
end token; repeated rows count each; without any training text every token is
unknown; an empty table gives no rows; a very long text is a block of its own.  Ids
are whole numbers (other types are cast to long; text that is no number raises).
Columns other than doc_id, text and those ``held_out`` uses are never looked at.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsdrift.session import discard, materialize

CONTEXTS = 1 << 16
BLOCK_TOKENS = 1_000_000
CHUNK_BYTES = 1 << 20
SHARD_CHARS = 4 << 20
STRENGTH = 1.0
ROUNDS = 2  # before the samples'
SWEEPS = 2  # of a round
SAMPLES = 3
SINGLE_TABLES = 256
START = 0  # context of a first token

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + _M[0]
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


_BYTE = _mix(np.arange(256, dtype=np.uint64))
_END = np.uint64(0x5EED0FE11D0C0DE5)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hash and context of every token, and the tokens of every text; A-Z
    lower-cased, the end token last."""
    data = np.frombuffer(b" " + b" ".join(t.lower() for t in texts) + b" ", np.uint8)
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sizes = ends - starts
    first = np.cumsum([1] + [len(t) + 1 for t in texts])
    per = np.diff(np.searchsorted(starts, first))
    at = np.flatnonzero(~space)
    place = np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    power = _mix(np.arange(1000, 1000 + (int(sizes.max()) if len(sizes) else 0), dtype=np.uint64)) | np.uint64(1)
    total = _BYTE[data[at]] * power[place]
    words = _mix(np.add.reduceat(total, np.cumsum(sizes) - sizes)) if len(sizes) else np.empty(0, np.uint64)
    one, two, three = data[ends - 1].astype(np.int64), data[ends - 2].astype(np.int64), data[np.maximum(ends - 3, 0)].astype(np.int64)
    two, three = np.where(sizes > 1, two, 32), np.where(sizes > 2, three, 32)
    own = one * 256 + ((two * 167 + three * 59 + (two ^ three)) & 255)
    n = len(texts)
    out = np.empty(len(words) + n, np.uint64)
    context = np.full(len(words) + n, START, np.uint16)
    text = np.repeat(np.arange(n), per)
    where = np.arange(len(words)) + text
    out[where] = words
    out[np.cumsum(per) + np.arange(n)] = _END
    context[where + 1] = own  # the next token is in the same text: the end token at the latest
    return out, context, per + 1


def _release() -> None:
    """Freed memory back to the system: workers live on for the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte: small numbers leave planes of zeros, which
    the table's compression removes."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


PART = ("kind string, block long, shard long, doc_ids array<long>, held array<boolean>, sizes binary, tokens binary, "
        "words binary, pairs binary, contexts binary, counts binary")


def _blocks(shift: int):
    """Documents to blocks: one row with the tokens as pair numbers, and a row
    per shard with the block's pairs of that shard's words."""

    def block(number: int, ids: list, held: list, parts: list) -> Iterator[dict]:
        words, contexts, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        distinct, word = np.unique(words, return_inverse=True)
        del words
        pairs, pair = np.unique(word * CONTEXTS + contexts, return_inverse=True)
        del word, contexts
        training = np.repeat(~np.array(held, bool), sizes)
        counts = np.bincount(pair[training], minlength=len(pairs))
        uses = np.bincount(pair, minlength=len(pairs))
        order = np.argsort(-uses, kind="stable")  # frequent pairs get small numbers
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs))
        yield {"kind": "tokens", "block": number, "doc_ids": ids, "held": held, "sizes": sizes.astype("<u4").tobytes(),
               "tokens": _planes(rank[pair]), "pairs": _planes(order)}
        del pair, training, uses, order, rank
        owner = pairs // CONTEXTS
        per = np.bincount(owner, minlength=len(distinct))
        shards = (distinct >> np.uint64(64 - shift)).astype(np.int64) if shift else np.zeros(len(distinct), np.int64)
        edges = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1], True])
        first = np.r_[0, np.cumsum(per)]
        for a, b in zip(edges, edges[1:]):
            p, q = first[a], first[b]
            yield {"kind": "pairs", "block": number, "shard": int(shards[a]), "words": distinct[a:b].astype("<u8").tobytes(),
                   "pairs": per[a:b].astype("<u4").tobytes(), "contexts": (pairs[p:q] % CONTEXTS).astype("<u2").tobytes(),
                   "counts": counts[p:q].astype("<u4").tobytes()}

    names = [c.split()[0] for c in PART.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame([[r.get(c) for c in names] for r in rows], columns=names).astype({"shard": "Int64"})

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        ids, held, parts, total = [], [], [], 0
        chunk, size = [], 0
        for pdf in batches:
            for d, h, t in zip(pdf["doc_id"], pdf["held_out"], pdf["text"], strict=True):
                ids.append(None if pd.isna(d) else int(d))
                held.append(bool(h))
                chunk.append(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"")
                size += len(chunk[-1])
                if size >= CHUNK_BYTES:
                    parts.append(tokens(chunk))
                    total += len(parts[-1][0])
                    chunk, size = [], 0
                    if total >= BLOCK_TOKENS:
                        done = frame(list(block(number, ids, held, parts)))
                        number += 1
                        ids, held, parts, total = [], [], [], 0
                        yield done
                        del done
                        _release()
        if chunk:
            parts.append(tokens(chunk))
        if parts:
            yield frame(list(block(number, ids, held, parts)))
            parts.clear()
        _release()

    return run


SHARD = ("shard long, words binary, contexts binary, customers binary, word_counts binary, blocks array<long>, "
         "block_words array<binary>, block_per array<binary>, block_pairs array<binary>, "
         "s_context array<int>, s_customers array<long>, s_dishes array<long>, facts array<long>")
SEATED = ("shard long, words binary, contexts binary, customers binary, word_counts binary, blocks array<long>, "
          "block_words array<binary>, block_per array<binary>, block_pairs array<binary>, "
          "seats array<binary>, weights array<binary>, samples array<binary>, s_index array<int>, s_tables array<long>")


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """All blocks' pairs of a shard as one list of distinct pairs, with what
    leads back to the blocks and the shard's share of the statistics."""
    pdf = pdf.sort_values("block")
    words = [np.frombuffer(x, "<u8") for x in pdf["words"]]
    per = [np.frombuffer(x, "<u4").astype(np.int64) for x in pdf["pairs"]]
    distinct, index = np.unique(np.concatenate(words), return_inverse=True)
    word = np.repeat(index, np.concatenate(per))
    context = np.concatenate([np.frombuffer(x, "<u2") for x in pdf["contexts"]]).astype(np.int64)
    pairs, pair = np.unique(word * CONTEXTS + context, return_inverse=True)
    n = np.bincount(pair, weights=np.concatenate([np.frombuffer(x, "<u4") for x in pdf["counts"]]), minlength=len(pairs)).astype(np.int64)
    w, c = pairs // CONTEXTS, pairs % CONTEXTS
    total = np.bincount(w, weights=n, minlength=len(distinct)).astype(np.int64)
    seen = n > 0
    # dishes of the levels above if every dish had one table per restaurant
    mid = np.unique((w * 256 + (c >> 8))[seen], return_counts=True)
    top = np.unique(mid[0] // 256, return_counts=True)[1]
    facts = [int(total.sum()), int((total > 0).sum())]
    for x in (n, mid[1], top):
        facts += [int((x == 1).sum()), int((x == 2).sum())]
    customers = np.bincount(c, weights=n, minlength=CONTEXTS).astype(np.int64)
    dishes = np.bincount(c[seen], minlength=CONTEXTS)
    # the parents' after the contexts'
    customers = np.r_[customers, np.zeros(256, np.int64)]
    dishes = np.r_[dishes, np.bincount(mid[0] % 256, minlength=256)]
    used = np.flatnonzero(dishes)
    wi = np.split(index.astype("<u4"), np.cumsum([len(x) for x in words])[:-1])
    pi = np.split(pair.astype("<u4"), np.cumsum([int(x.sum()) for x in per])[:-1])
    shard = int(pdf["shard"].iloc[0])
    out = pd.DataFrame([{
        "shard": shard, "words": w.astype("<u4").tobytes(), "contexts": c.astype("<u2").tobytes(),
        "customers": n.astype("<u4").tobytes(), "word_counts": total.astype("<u4").tobytes(),
        "blocks": pdf["block"].tolist(), "block_words": [x.tobytes() for x in wi],
        "block_per": [x.astype("<u4").tobytes() for x in per], "block_pairs": [x.tobytes() for x in pi],
        "s_context": used.tolist(), "s_customers": customers[used].tolist(), "s_dishes": dishes[used].tolist(), "facts": facts}])
    del words, per, distinct, index, word, context, pairs, pair, n, w, c, total, seen, mid, top, wi, pi
    _release()
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0 (Stirling's series after a shift by 8)."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y ** 3) - shift


def seat(rng: np.random.Generator, n: np.ndarray, a: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Tables of dishes with ``n`` customers each, seated one by one, and the log
    of the product of their normalisers."""
    tables, weight = np.minimum(n, 1), np.zeros(len(n))
    at = np.flatnonzero(n > 1)
    j, t = np.ones(len(at), np.int64), np.ones(len(at), np.int64)
    step = 0
    while len(at) and step < SINGLE_TABLES:
        step += 1
        mass, own = j - d * t, a[at]
        rate = np.clip(rng.beta(own, mass), 1e-15, 1.0)
        to = j + np.minimum(rng.geometric(rate), n[at])  # this customer opens a table
        end = np.minimum(to, n[at])
        weight[at] += _log_gamma(end - d * t + own) - _log_gamma(mass + own)
        opened = to <= n[at]
        tables[at] = t + opened
        go = opened & (to < n[at])
        at, j, t = at[go], to[go], t[go] + 1
    while len(at):  # in leaps of 2 % of the customers
        more = np.minimum(np.maximum(j // 50, 1), n[at] - j)
        t = t + rng.binomial(more, a[at] / (j - d * t + a[at]))
        j = j + more
        tables[at] = t
        go = j < n[at]
        at, j, t = at[go], j[go], t[go]
    return tables, weight


class Restaurants:
    """The seatings of one shard's dishes on all three levels: those of
    ``seats`` (tables per level), else one table per dish.  Either way they are
    this shard's part of ``totals``."""

    def __init__(self, word, context, customers, n_words, totals: dict, rng: np.random.Generator, seats=None, weights=None):
        self.word, self.context, self.n, self.rng = word, context, customers, rng
        self.mid_key, self.mid = np.unique(word * 256 + (context >> 8), return_inverse=True)
        self.mid_word, self.mid_context = self.mid_key // 256, self.mid_key % 256
        self.n_words, self.totals = n_words, totals
        self.d0, self.d1, self.d2 = totals["discounts"]
        if seats:
            self.t, self.t1, self.t0 = seats
        else:
            self.t = np.minimum(self.n, 1)
            self.t1, self.t0 = np.minimum(self._n1(), 1), None
            self.t0 = np.minimum(self._n0(), 1)
        self.weights: list = weights or [None, None, None]
        self.begin = self._sums()

    def _n1(self):
        return np.bincount(self.mid, weights=self.t, minlength=len(self.mid_key)).astype(np.int64)

    def _n0(self):
        return np.bincount(self.mid_word, weights=self.t1, minlength=self.n_words).astype(np.int64)

    def _sums(self):
        return (np.bincount(self.context, weights=self.t, minlength=CONTEXTS), np.bincount(self.mid_context, weights=self.t1, minlength=256),
                float(self.t0.sum()))

    def _tables(self):
        """Tables of all restaurants: other shards' as of the last round, this
        shard's as they are now (``begin`` is its part of the last round's)."""
        now = self._sums()
        return tuple(np.maximum(g + x - y, 0) for g, x, y in zip(
            (self.totals["tables"], self.totals["tables1"], self.totals["tables0"]), now, self.begin, strict=True))

    def _root(self, n0, t0, tables1, tables0):
        rest = tables1.sum() + STRENGTH
        return (np.maximum(n0 - self.d0 * t0, 0) + (STRENGTH + self.d0 * tables0) * self.totals["base"]) / rest

    def _parent(self, n1, t1, root, tables, tables1, context):
        customers = tables.reshape(256, 256).sum(axis=1)[context]
        return (np.maximum(n1 - self.d1 * t1, 0) + (STRENGTH + self.d1 * tables1[context]) * root) / (customers + STRENGTH)

    def _accept(self, level: int, new, weight, old, same):
        """Metropolis step where the customers are the same as at the last draw."""
        last = self.weights[level]
        if last is None:
            self.weights[level] = weight
            return new
        take = ~same | (np.log(self.rng.random(len(new)) + 1e-300) < weight - last)
        self.weights[level] = np.where(take, weight, last)
        return np.where(take, new, old)

    def sweep(self) -> None:
        """Seats every dish of every restaurant again, contexts first."""
        tables, tables1, tables0 = self._tables()
        n1, n0 = self._n1(), self._n0()
        # the parents' predictions without the dish's own tables
        n1_rest = n1[self.mid] - self.t
        t1_rest = np.minimum(self.t1[self.mid], n1_rest)
        n0_rest = n0[self.word] - (self.t1[self.mid] - t1_rest)
        root = self._root(n0_rest, np.minimum(self.t0[self.word], n0_rest), tables1, tables0)
        p = self._parent(n1_rest, t1_rest, root, tables, tables1, self.context >> 8)
        a = (STRENGTH + self.d2 * np.maximum(tables[self.context] - self.t, 0)) * p
        new, weight = seat(self.rng, self.n, a, self.d2)
        self.t = self._accept(0, new, weight, self.t, np.ones(len(new), bool))

        before, n1 = n1, self._n1()
        n0_rest = n0[self.mid_word] - self.t1
        root = self._root(n0_rest, np.minimum(self.t0[self.mid_word], n0_rest), tables1, tables0)
        a = (STRENGTH + self.d1 * np.maximum(tables1[self.mid_context] - self.t1, 0)) * root
        new, weight = seat(self.rng, n1, a, self.d1)
        self.t1 = self._accept(1, new, weight, self.t1, before == n1)

        before, n0 = n0, self._n0()
        a = np.full(len(n0), (STRENGTH + self.d0 * tables0) * self.totals["base"])
        new, weight = seat(self.rng, n0, a, self.d0)
        self.t0 = self._accept(2, new, weight, self.t0, before == n0)

    def predict(self) -> np.ndarray:
        """Probability of every pair's word in its context."""
        tables, tables1, tables0 = self._tables()
        root = self._root(self._n0(), self.t0, tables1, tables0)
        p1 = self._parent(self._n1(), self.t1, root[self.mid_word], tables, tables1, self.mid_context)
        customers = self.totals["customers"][self.context]
        return (self.n - self.d2 * self.t + (STRENGTH + self.d2 * tables[self.context]) * p1[self.mid]) / (customers + STRENGTH)


def _restaurants(row: dict, totals: dict, number: int, seats=None, weights=None) -> Restaurants:
    rng = np.random.Generator(np.random.Philox(key=[row["shard"], number]))
    word = np.frombuffer(row["words"], "<u4").astype(np.int64)
    return Restaurants(word, np.frombuffer(row["contexts"], "<u2").astype(np.int64),
                       np.frombuffer(row["customers"], "<u4").astype(np.int64), len(row["word_counts"]) // 4, totals, rng,
                       seats and [_unplaned(x).astype(np.int64) for x in seats],
                       weights and [np.frombuffer(x, "<f4").astype(np.float64) for x in weights])


STATE = ("shard", "words", "contexts", "customers", "word_counts", "seats", "weights", "samples")


def _round(totals: dict, number: int, sweeps: int, sample: bool, last: bool):
    """Shards to shards with new seatings, also kept as a sample, and the tables
    of their restaurants; what leads back to the blocks passes unread."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                row = {c: one.column(c)[0].as_py() for c in STATE}
                seats = _restaurants(row, totals, number, row["seats"], row["weights"])
                for _ in range(sweeps):
                    seats.sweep()
                tables, tables1, tables0 = seats._sums()
                sums = np.concatenate([tables, tables1, [tables0]]).astype(np.int64)
                used = np.flatnonzero(sums)
                now = [_planes(x) for x in (seats.t, seats.t1, seats.t0)]
                new = {"seats": now, "weights": [] if last else [x.astype("<f4").tobytes() for x in seats.weights],
                       "samples": row["samples"] + (now if sample else []), "s_index": used.tolist(), "s_tables": sums[used].tolist()}
                del seats, row  # before the next shard's is made
                yield pa.RecordBatch.from_arrays(
                    [pa.array([new[f.name]], f.type) if f.name in new else one.column(f.name) for f in batch.schema], schema=batch.schema)
                del one, now, new
                _release()

    return run


@contextmanager
def _shard_by_shard(spark: SparkSession):
    """One shard per Arrow batch, for what runs inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "1")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def rounds_of(shards: DataFrame, totals: dict, rounds: int, sweeps: int, samples: int) -> tuple[DataFrame, list[dict]]:
    """The shards with ``samples`` seatings, and the totals of each sample."""
    empty = F.array().cast("array<binary>")
    state = shards.select(*[c.split()[0] for c in SEATED.split(", ")[:9]], F.lit(None).cast("array<binary>").alias("seats"),
                          F.lit(None).cast("array<binary>").alias("weights"), empty.alias("samples"),
                          F.array().cast("array<int>").alias("s_index"), F.array().cast("array<long>").alias("s_tables"))
    last, kept = shards, []
    for number in range(rounds + samples):
        with _shard_by_shard(shards.sparkSession):
            state = materialize(state.mapInArrow(_round(totals, number, sweeps, number >= rounds, number + 1 == rounds + samples), SEATED), "lm-seats")
        discard(last)
        last = state
        sums = state.select(F.explode(F.arrays_zip("s_index", "s_tables")).alias("s")).groupBy(F.col("s.s_index").alias("i")).agg(
            F.sum("s.s_tables").alias("tables")).collect()
        flat = np.zeros(CONTEXTS + 257)
        for r in sums:
            flat[r["i"]] = r["tables"]
        totals = totals | {"tables": flat[:CONTEXTS], "tables1": flat[CONTEXTS:-1], "tables0": float(flat[-1])}
        if number >= rounds:
            kept.append(totals)
    return state, kept


PREDICTED = "block long, shard long, logs binary, per binary, counts binary"


def _predictions(kept: list[dict]):
    """Every block's pairs with their predictions, averaged over the samples."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                p = np.zeros(len(row["customers"]) // 4)
                for k, totals in enumerate(kept):
                    p += _restaurants(row, totals, 0, list(row["samples"][3 * k:3 * k + 3])).predict()
                logs = np.log10(p / len(kept)).astype("<f4")
                counts = np.frombuffer(row["word_counts"], "<u4")
                out = [{"block": int(b), "shard": row["shard"], "logs": logs[np.frombuffer(pi, "<u4")].tobytes(), "per": per,
                        "counts": counts[np.frombuffer(wi, "<u4")].tobytes()}
                       for b, wi, per, pi in zip(row["blocks"], row["block_words"], row["block_per"], row["block_pairs"], strict=True)]
                del p, logs, counts, row  # before the next shard's are made
                yield pd.DataFrame(out)
                del out
                _release()

    return run


def predicted(seated: DataFrame, kept: list[dict]) -> DataFrame:
    """The predictions of all shards, made one shard at a time and written: the
    seatings, several times as large, go before the blocks gather theirs."""
    with _shard_by_shard(seated.sparkSession):
        logs = materialize(seated.select(
            "shard", "words", "contexts", "customers", "word_counts", "blocks", "block_words", "block_per", "block_pairs", "samples").mapInPandas(
            _predictions(kept), PREDICTED), "lm-predicted")
    discard(seated)
    return logs


def _scores(n: int, v: int):
    def run(docs: pd.DataFrame, logs: pd.DataFrame) -> pd.DataFrame:
        logs = logs.sort_values("shard")  # the order of the block's words
        score = np.concatenate([np.frombuffer(x, "<f4") for x in logs["logs"]]).astype(np.float64)
        counts = np.concatenate([np.frombuffer(x, "<u4") for x in logs["counts"]]).astype(np.float64)
        per = np.concatenate([np.frombuffer(x, "<u4") for x in logs["per"]])
        base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
        out = []
        for _, row in docs.iterrows():
            order = _unplaned(row["pairs"])
            pair = order[_unplaned(row["tokens"])]
            word = np.repeat(np.arange(len(counts)), per)[pair]
            sizes = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
            first = np.cumsum(sizes) - sizes
            out.append(pd.DataFrame({
                "doc_id": pd.array(list(row["doc_ids"]), dtype="Int64"), "held_out": list(row["held"]), "n_tokens": sizes,
                "n_known": np.add.reduceat((counts > 0)[word].astype(np.int64), first), "train_tokens": n,
                "base_score": np.add.reduceat(base[word], first), "score": np.add.reduceat(score[pair], first)}))
            del order, pair, word
        del score, counts, per, base, docs, logs
        _release()
        return pd.concat(out)

    return run


def _discount(ones: int, twos: int) -> float:
    """Discount from the dishes with one and two customers."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


def score(docs: DataFrame, held_out: Column, rounds: int = ROUNDS, sweeps: int = SWEEPS, samples: int = SAMPLES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (add-0.5 unigrams) and score.  The model is learned
    from the rows with ``held_out`` false."""
    chars = docs.agg(F.sum(F.length("text"))).head()[0] or 0
    shift = max(0, int(np.ceil(np.log2(max(1.0, chars / SHARD_CHARS)))))
    parts = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text").mapInPandas(
        _blocks(shift), PART), "lm-blocks", partition_by="kind")
    pairs = parts.where("kind = 'pairs'").select("shard", "block", "words", "pairs", "contexts", "counts")
    shards = materialize(pairs.groupBy("shard").applyInPandas(_merge, SHARD), "lm-shards")
    discard(parts.where("kind = 'pairs'"), "kind=pairs")
    facts = [r[0] for r in shards.select(F.posexplode("facts").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").select("x").collect()]
    n, v, *steps = facts or [0] * 8
    per = shards.select(F.explode(F.arrays_zip("s_context", "s_customers", "s_dishes")).alias("s")).groupBy(
        F.col("s.s_context").alias("i")).agg(F.sum("s.s_customers").alias("n"), F.sum("s.s_dishes").alias("t")).collect()
    customers, tables = np.zeros(CONTEXTS + 256), np.zeros(CONTEXTS + 256)
    for r in per:
        customers[r["i"]], tables[r["i"]] = r["n"], r["t"]
    totals = {"customers": customers[:CONTEXTS], "tables": tables[:CONTEXTS], "base": 1.0 / (v + 1),
              "tables1": tables[CONTEXTS:], "tables0": float(v),
              "discounts": tuple(_discount(*steps[k:k + 2]) for k in (4, 2, 0))}
    seated, kept = rounds_of(shards, totals, rounds, sweeps, samples)
    logs = predicted(seated, kept)
    docs_of = parts.where("kind = 'tokens'").select("block", "doc_ids", "held", "sizes", "tokens", "pairs")
    return docs_of.groupBy("block").cogroup(logs.groupBy("block")).applyInPandas(
        _scores(n, v), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
