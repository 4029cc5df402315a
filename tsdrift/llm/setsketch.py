"""MinHash near-duplicates by SetSketch registers.

Sketch.  Every shingle is the seed of a Poisson process on the registers: points in
ascending time, each on a random register.  A register keeps its earliest time over
all shingles of a document, t, as the truncated exponent floor(1 - log_b(t / A)), so
registers are exponentially spaced minima.  The sketch of a union is the elementwise
maximum of the sketches, and two registers agree with a probability that grows with
the similarity.  Points are drawn in time order up to a horizon, which is moved for a
document as long as one of its registers is empty; the horizon does not change the
sketch.

Bands.  ``ROWS`` registers make a band value; documents that share a value of some
band are candidates.  At the least similarity, 0.8, a pair is missed by all 42 bands
with a probability of 3e-6, and with less above it.

Estimate.  The numbers of registers in which one sketch is larger, smaller or equal
are trinomial given the similarity and both set sizes.  A candidate goes on unless its
joint likelihood at 0.8 or more is below the largest by more than exp(-18) (so a true
link is dropped here with a probability of about 1e-9), or its sizes rule 0.8 out.

Verify.  Candidates that pass are joined to clusters; the shingle sets of a cluster's
documents are fetched once, and links are confirmed by exact intersection counts
(through an inverted index of the cluster).  Only links between documents not yet
connected are looked for and reported, so a large group of near copies costs about its
size.

Skew.  Copies have one set and enter once.  A band value is first compared with its
smallest member only (a star); the members that fail this are compared with the rest
of the value.  A value of more than ``BUCKET`` members is taken as one cluster without
an estimate, which adds work, not links.  A cluster with more than ``UNIT`` shingles
is first compared with one of its members, by a join; what is not linked to that one is
compared with the rest in blocks of ``UNIT`` shingles, a task per pair of blocks.

Shingles are compared by their 64-bit hashes.

Defined cases: null, empty and blank texts have the empty set, are linked to nothing and
name their own component; a text of one word is one shingle; repeated rows and equal
sets are one group; a null id names no component unless all ids of it are null, and is
kept only if that is so; empty tables give no rows; a very long text is a chunk of its
own.  Other columns than doc_id and text are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsdrift.llm.bittable import BitTable, bit_table
from tsdrift.llm.bytewords import byte_table, gathered, split
from tsdrift.llm.common import SPACE, content_key
from tsdrift.llm.components import components
from tsdrift.session import materialize

SHINGLE_WORDS = 2
PERCENT = 80  # least similarity
BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
BASE = 1.02
RATE = 20.0
DELTA = 18.0
CHUNK = 4 << 20  # bytes of text
BUCKET = 4096  # members of a band value that are compared in one task
UNIT = 1 << 21  # shingles of a block of a cluster

TABLE = byte_table(SPACE.encode())
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of the distinct shingles of every text, ascending."""
    words, doc, _ = split(texts, TABLE)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    coded = words.dictionary_encode()
    digest = xxhash.xxh64_intdigest
    own = np.fromiter((digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    h = own[coded.indices.to_numpy()]
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    # a shingle per word that has size - 1 words after it, or the first word of a shorter text
    at = np.arange(len(h)) - first[doc]
    begin = np.flatnonzero((at + size <= n[doc]) | ((at == 0) & (n[doc] < size)))
    out = np.zeros(len(begin), np.uint64)
    for k in range(size):
        here = at[begin] + k < n[doc[begin]]
        out[here] = mixed((out[here] + GOLDEN) ^ h[np.minimum(begin[here] + k, len(h) - 1)])
    owner = doc[begin]
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    keep = np.r_[True, (owner[1:] != owner[:-1]) | (out[1:] != out[:-1])]
    return owner[keep], out[keep]


def sketches(owner: np.ndarray, shingles: np.ndarray, documents: int, registers: int = REGISTERS) -> np.ndarray:
    """Registers (documents x registers, uint16) of the sets (owner, shingle)."""
    n = np.bincount(owner, minlength=documents)
    horizon = np.zeros(documents)
    has = n > 0
    horizon[has] = (np.log(registers) + 2) / n[has]
    least = np.full(documents * registers, np.inf)
    step = np.zeros(len(shingles), np.uint64)
    time = np.zeros(len(shingles))
    place = np.zeros(len(shingles), np.int64)

    def draw(at: np.ndarray) -> None:
        step[at] += np.uint64(1)
        z = mixed(shingles[at] + step[at] * GOLDEN)
        time[at] -= np.log((z >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / registers
        place[at] = (((z * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) * registers) >> 24

    every = np.arange(len(shingles))
    draw(every)
    live = every
    while len(live):
        live = live[time[live] < horizon[owner[live]]]
        while len(live):
            np.minimum.at(least, owner[live] * registers + place[live], time[live])
            draw(live)
            live = live[time[live] < horizon[owner[live]]]
        open_ = has & np.isinf(least.reshape(documents, registers)).any(axis=1)
        horizon[open_] *= 1.5
        live = every[open_[owner]]
    with np.errstate(divide="ignore"):
        out = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    return np.clip(out, 0, 65535).astype("<u2").reshape(documents, registers)


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Pairs of registers (rows of ``a`` and ``b``) whose sets may be as similar as
    asked, by the joint likelihood of their larger, smaller and equal registers."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    u = n_a / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    out = 100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)

    def p(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - (1 - u) * j), p((1 - u) - u * j)
        return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-9))

    low = np.max([likelihood(np.minimum(j, most)) for j in np.linspace(0, PERCENT / 100, 33)], axis=0)
    high = np.max([likelihood(PERCENT / 100 + x * np.maximum(most - PERCENT / 100, 0)) for x in np.linspace(0, 1, 9)], axis=0)
    return out & (low - high <= DELTA)


def _registers(column: pa.Array, registers: int = REGISTERS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), registers)


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in gathered(batches, 1, CHUNK):
        table = table.combine_chunks()
        owner, shingles = shingle_sets(pa.concat_arrays(table["text"].chunks))
        n = np.bincount(owner, minlength=len(table))
        ends = np.cumsum(n)
        data = shingles.view(np.uint8)
        keys = [xxhash.xxh3_128_digest(data[8 * (e - k):8 * e]) for e, k in zip(ends.tolist(), n.tolist())]
        got = sketches(owner, shingles, len(table))
        key = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([
            *(pa.concat_arrays(table[c].chunks) for c in ("doc_id", "key_a", "key_b")), pa.array(n.astype(np.int64)),
            pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.array([r.tobytes() for r in got], pa.binary())],
            ["doc_id", "key_a", "key_b", "n", "set_a", "set_b", "registers"])


def _bands(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Band values (id, bucket)."""
    for batch in batches:
        rows = _registers(batch.column(1)).reshape(len(batch), BANDS, ROWS).astype(np.uint64)
        value = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN, rows.shape[:2]).copy()
        for k in range(ROWS):
            value = mixed(value + rows[:, :, k] + GOLDEN)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(value.ravel().view(np.int64))], ["id", "bucket"])


def _tested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether a pair (a, b, n_a, registers_a, n_b, registers_b) is plausible."""
    for batch in batches:
        for at in range(0, len(batch), 2048):
            some = batch.slice(at, 2048)
            ok = plausible(_registers(some.column(3)), _registers(some.column(5)), some.column(2).to_numpy(), some.column(4).to_numpy())
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(ok)], ["a", "b", "ok"])


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal first ``keys`` columns, which arrive next to each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        edge = np.zeros(len(batch), bool)
        for c in batch.columns[:keys]:
            v = c.to_numpy()
            edge[1:] |= v[1:] != v[:-1]
            edge[0] |= bool(held) and held[-1].column(batch.columns.index(c))[-1].as_py() != v[0]
        at = np.flatnonzero(edge).tolist()
        for a, b in zip([0, *at], [*at, len(batch)]):
            if a in at and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _spanning(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per band value (bucket, id, main, n, registers): plausible pairs that connect the
    members outside the main part with each other and with it."""
    for table in _groups(batches, 1):
        ids, main, n = (table[c].to_numpy() for c in ("id", "main", "n"))
        rows = _registers(table["registers"].combine_chunks())
        label = np.where(main, -1, np.arange(len(ids)))
        a, b = [], []
        for s in np.flatnonzero(~main).tolist():
            other = np.flatnonzero(label != label[s])
            for c in range(0, len(other), 4096):
                part = other[c:c + 4096]
                near = part[plausible(np.broadcast_to(rows[s], (len(part), rows.shape[1])), rows[part], np.full(len(part), n[s]), n[part])]
                found, first = np.unique(label[near], return_index=True)
                for x, k in zip(found.tolist(), near[first].tolist()):
                    if x != label[s]:
                        a.append(ids[s])
                        b.append(ids[k])
                        label[label == x] = label[s]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the shingles of their text (second column) instead of it."""
    for table in gathered(batches, 1, CHUNK):
        table = table.combine_chunks()
        owner, shingles = shingle_sets(pa.concat_arrays(table["text"].chunks))
        ends = pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=len(table)))].astype(np.int32))
        names = [c for c in table.column_names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(pa.concat_arrays(table[c].chunks) for c in names), pa.ListArray.from_arrays(ends, pa.array(shingles.view(np.int64)))],
            [*names, "shingles"])


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per unit (cluster, i, j, id, seed, main, shingles): exact links that connect the
    seeds with all others they are similar to."""
    for table in _groups(batches, 3):
        ids, seed, main = (table[c].to_numpy() for c in ("id", "seed", "main"))
        sets = table["shingles"].combine_chunks()
        n = pc.list_value_length(sets).to_numpy().astype(np.int64)
        first = np.cumsum(n) - n
        _, token = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        holder = np.repeat(np.arange(len(ids)), n)[np.argsort(token, kind="stable")]
        held = np.bincount(token)
        start = np.cumsum(held) - held
        label = np.where(main, -1, np.unique(ids, return_inverse=True)[1])
        a, b = [], []
        for s in np.flatnonzero(seed).tolist():
            if (label == label[s]).all():
                continue
            own = token[first[s]:first[s] + n[s]]
            sizes = held[own]
            shift = np.repeat(start[own] - (np.cumsum(sizes) - sizes), sizes)
            common = np.bincount(holder[shift + np.arange(len(shift))], minlength=len(ids))
            near = np.flatnonzero((100 * common >= PERCENT * (n[s] + n - common)) & (label != label[s]))
            found, at = np.unique(label[near], return_index=True)
            for x, k in zip(found.tolist(), near[at].tolist()):
                a.append(ids[s])
                b.append(ids[k])
                label[label == x] = label[s]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _shared(limit: int):
    """Sorted band values (bucket, id) to the members of those that more than one has:
    bucket, id, centre (the smallest id), and whether there are more than ``limit``."""

    def rows(bucket: int, ids: list[np.ndarray], large: bool, centre: int) -> pa.RecordBatch:
        every = np.concatenate(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(every), bucket)), pa.array(every), pa.array(np.full(len(every), centre)),
             pa.array(np.full(len(every), large))], ["bucket", "id", "centre", "large"])

    def inside(bucket, ids, first, n) -> Iterator[pa.RecordBatch]:
        """Values that begin and end in a batch, all at once."""
        for many, large in (((n > 1) & (n <= limit), False), (n > limit, True)):
            if many.any():
                sizes = n[many]
                at = np.repeat(first[many] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[at]), pa.array(ids[at]), pa.array(np.repeat(ids[first[many]], sizes)),
                     pa.array(np.full(len(at), large))], ["bucket", "id", "centre", "large"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, centre, large = None, [], 0, 0, False  # the value that may go on
        for batch in batches:
            if not len(batch):
                continue
            bucket, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            first, n = edges[:-1], np.diff(edges)
            goes_on = now is not None and bucket[0] == now
            if goes_on:
                held.append(ids[:n[0]])
                size += int(n[0])
            if now is not None and (len(first) > 1 or not goes_on):
                if size and (size > 1 or large):
                    yield rows(now, held, large or size > limit, centre)
                now = None
            if now is None:
                yield from inside(bucket, ids, first[int(goes_on):-1], n[int(goes_on):-1])
                part = ids[first[-1]:]
                now, held, size, centre, large = int(bucket[-1]), [part], len(part), int(part[0]), False
            if size > limit or (large and size):  # no need to hold them any longer
                yield rows(now, held, True, centre)
                held, size, large = [], 0, True
        if now is not None and size and (size > 1 or large):
            yield rows(now, held, large, centre)

    return run


def _only(known: BitTable, columns: list[str]):
    """Rows whose first column, a hash, may be known; the other columns of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(known.has(batch.column(0).to_numpy())))
            yield pa.RecordBatch.from_arrays(some.columns[1:], columns)

    return run


def _registers_of(reps: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n and registers of the sets that ``ids`` (id, a written table) names, and of
    few others, found without shuffling those of all sets."""
    known = bit_table(ids, F.xxhash64("id"))
    return reps.select(F.xxhash64("id").alias("h"), "id", "n", "registers").mapInArrow(
        _only(known, ["id", "n", "registers"]), "id long, n long, registers binary")


def candidates(reps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) that connect all plausible pairs of ``reps`` (id, n, registers; a
    written table) sharing a band value."""
    values = reps.select("id", "registers").mapInArrow(_bands, "id long, bucket long")
    members = materialize(values.select("bucket", "id").repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(
        _shared(bucket), "bucket long, id long, centre long, large boolean"), "band-members")
    star = members.where("id <> centre").groupBy("id", "centre").agg(F.max("large").alias("large"))
    sizes = reps.select("id", "n")
    near = 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")
    sized = materialize(star.where("not large").join(sizes.toDF("id", "n_a"), "id").join(sizes.toDF("centre", "n_b"), "centre").select(
        "id", "centre", near.alias("near")), "star-sizes")
    pairs = sized.where("near")
    needed = materialize(pairs.select(F.explode(F.array("id", "centre")).alias("id")).distinct(), "star-sets")
    own = materialize(_registers_of(reps, needed), "star-registers")
    both = pairs.join(own.toDF("id", "n_a", "registers_a"), "id").join(own.toDF("centre", "n_b", "registers_b"), "centre")
    tested = materialize(both.select(F.col("id").alias("a"), F.col("centre").alias("b"), "n_a", "registers_a", "n_b", "registers_b")
                         .mapInArrow(_tested, "a long, b long, ok boolean"), "stars")
    # band values with a member that its star does not connect, and two others
    linked = tested.where("ok").select(F.col("a").alias("id"), F.col("b").alias("centre"), F.lit(True).alias("ok"))
    marked = members.where("not large").join(linked, ["id", "centre"], "left").withColumn(
        "main", F.coalesce("ok", F.col("id") == F.col("centre")))
    open_ = marked.groupBy("bucket").agg(F.count_if(~F.col("main")).alias("out"), F.count("*").alias("members")).where(
        "out > 0 and members > 2").select("bucket")
    rest = materialize(marked.join(open_, "bucket").select("bucket", "id", "main"), "open-values")
    inner = _registers_of(reps, materialize(rest.select("id").distinct(), "open-sets"))
    spanning = rest.join(inner, "id").select("bucket", "id", "main", "n", "registers").repartition("bucket").sortWithinPartitions(
        "bucket", "id").mapInArrow(_spanning, "a long, b long")
    large = star.where("large").select(F.col("id").alias("a"), F.col("centre").alias("b"))
    return tested.where("ok").select("a", "b").unionByName(spanning).unionByName(large)


def links(docs: DataFrame, reps: DataFrame, pairs: DataFrame, unit: int = UNIT) -> DataFrame:
    """Exact links (a, b) that connect all similar sets inside the clusters that
    ``pairs`` make of ``reps`` (id, n, at: id and key of one text)."""
    clusters = components(materialize(pairs, "plausible"))
    members = materialize(reps.select("id", "n", "at").join(clusters, F.col("id") == F.col("node")).select(
        "id", "n", F.col("component").alias("cluster"), F.col("at.doc_id").alias("of"), F.col("at.key_a").alias("a"), F.col("at.key_b").alias("b")),
        "cluster-members")
    before = F.expr("sum(n) over (partition by cluster order by n, id rows between unbounded preceding and 1 preceding)")
    blocks = members.withColumn("block", F.floor(F.coalesce(before, F.lit(0)) / F.lit(unit)))
    counts = blocks.groupBy("cluster").agg((F.max("block") + 1).alias("blocks"), F.min("id").alias("hub"))
    placed = materialize(blocks.join(counts, "cluster").drop("n"), "cluster-blocks")
    kind = dict(docs.dtypes)["doc_id"]
    # the members' texts, found without shuffling the others
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *content_key("text"))
    some = texts.select("key_a", "doc_id", "text", "key_a", "key_b").mapInArrow(
        _only(bit_table(placed, "a"), ["doc_id", "text", "key_a", "key_b"]), f"doc_id {kind}, text string, key_a long, key_b long")
    found = some.join(placed, (F.col("key_a") == F.col("a")) & (F.col("key_b") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("of")))
    # equal rows of one id fetch the set again: any of them will do
    sets = materialize(found.select("id", "text", "cluster", "block", "blocks", "hub").dropDuplicates(["id"]).mapInArrow(
        _sets, "id long, cluster long, block long, blocks long, hub long, shingles array<long>"), "cluster-sets")
    zero = F.lit(0).cast("long")
    single = sets.where("blocks = 1").select(
        "cluster", zero.alias("i"), zero.alias("j"), "id", F.lit(True).alias("seed"), F.lit(False).alias("main"), "shingles")
    hubs = sets.where("blocks > 1 and id = hub").select(F.col("cluster").alias("c"), F.col("shingles").alias("hub_set"))
    common = F.size(F.array_intersect("shingles", "hub_set"))
    near = 100 * common >= PERCENT * (F.size("shingles") + F.size("hub_set") - common)
    wide = materialize(sets.where("blocks > 1").join(hubs, F.col("cluster") == F.col("c")).select(
        "cluster", "block", "blocks", "hub", "id", near.alias("main"), "shingles"), "wide-clusters")
    by_hub = wide.where("main and id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    others = F.explode(F.sequence(zero, F.col("blocks") - 1))
    seeds = wide.where("not main").withColumn("j", others).select(
        "cluster", F.col("block").alias("i"), "j", "id", F.lit(True).alias("seed"), "main", "shingles")
    rows = wide.withColumn("i", others).select("cluster", "i", F.col("block").alias("j"), "id", F.lit(False).alias("seed"), "main", "shingles")
    units = single.unionByName(seeds).unionByName(rows)
    exact = units.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id").mapInArrow(_verified, "a long, b long")
    return by_hub.unionByName(exact)


def near_duplicates(docs: DataFrame, bucket: int = BUCKET, unit: int = UNIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id (smallest
    doc_id reachable over links) and kept."""
    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", "text", *content_key("text"))
    sketched = materialize(keyed.select("doc_id", "text", "key_a", "key_b").mapInArrow(
        _sketched, f"doc_id {kind}, key_a long, key_b long, n long, set_a long, set_b long, registers binary"), "sketches")
    at = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key_a", "key_b")
    reps = materialize(sketched.where("n > 0").groupBy("set_a", "set_b").agg(
        F.min(at).alias("at"), F.first("n").alias("n"), F.first("registers").alias("registers")).withColumn(
        "id", F.monotonically_increasing_id()), "sets")
    groups = components(materialize(links(docs, reps, candidates(reps, bucket), unit), "links"))
    named = reps.select("id", "set_a", "set_b", "at").join(groups, F.col("id") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "id"))
    names = named.groupBy("component").agg(F.min("at").alias("least")).select(
        F.col("component").alias("c"), F.col("least.doc_id").alias("component_id"))
    ids = named.join(names, F.col("component") == F.col("c")).select(
        F.col("set_a").alias("s_a"), F.col("set_b").alias("s_b"), "component_id")
    out = sketched.drop("registers").join(ids, (F.col("n") > 0) & (F.col("set_a") == F.col("s_a")) & (F.col("set_b") == F.col("s_b")), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
