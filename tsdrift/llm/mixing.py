"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Targets: the sources in code-point order (null last) weigh 5, 2, 1,
   repeating, and share 150 % of all words; a target stops at twice its
   source's size and the excess goes to the others by weight.  That fixed point
   is ``min(2 * size, level * weight)`` with one level for all, found from the
   sources sorted by the level at which they fill up.
2. Blocks: the documents of a source are dealt by a hash into blocks of about
   ``block_words`` words.  A source takes whole passes over its blocks, then
   blocks in a permuted order until the target is reached; the last block is
   used in part, so one document per source may be cut.
3. Splitting tree: each source's quota is its number of blocks.  The root holds
   all quotas; a node gives half of its blocks to its left child, drawn without
   replacement over all sources (a multivariate hypergeometric draw), the rest
   to the right child, down to the output shards.  The draw of a node is its
   blocks in the order of a hash: the lower half goes left.  Every shard then
   owns a disjoint range of each source's permuted blocks and orders its
   documents by a hash of its own.

All draws come from hashes of the seed and the position, so reruns agree.
Windows run over one block of documents, over the blocks of a source, or over
``BUCKETS`` counts; never over the documents of a source.  There are ``MAX_BLOCKS``
blocks at most (one more per source), which grow with the corpus beyond that, and
a shard for about every ``SHARD_WORDS`` words.

Texts are shuffled once, to their shard: a block follows from the document alone,
and whether and where a block is taken from the table of blocks.  That table, and the
one of sources, is sent to all tasks while it has at most ``SENT_BLOCKS`` rows
(counted); beyond that it is joined.  Only documents of blocks taken in part are looked up one by one.

Defined cases: a null source is a source of its own, last in order; null and
blank texts have size 0 and are never taken; repeated rows count each; equal
rows of one id share that id's takings in order; empty tables give no rows; a
document longer than a block is in a block with others, which is then longer.
``summary`` and ``takings`` return columns of their own only, besides those named
there; ``mixed_documents`` returns all columns of its input, whatever their names.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsdrift.llm.common import SPACE_CLASS, keyed_rows, words
from tsdrift.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 16384
MAX_BLOCKS = 1 << 20  # beyond this many blocks they grow with the corpus
SEED = 42
SHARD_WORDS = 1 << 24  # of an output shard, about
TASK_WORDS = 1 << 20  # written by a task, about
BUCKETS = 4096
SENT_BLOCKS = 1 << 21  # rows of a table of sources or blocks sent to all tasks, some 100 MB


def unit(*parts: Column) -> Column:
    """A hash of the parts in [0, 2^60), the same in any SQL engine with md5."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and ``size`` (number of words) of every row."""
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: source_size, weight and target words.  One row per source
    enters the ordered windows, after the grouped count."""
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    # sources fill up in this order; while the level is below a source's own,
    # the words left are shared by the weights of those not yet full
    w = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_first())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    # the first open source's level: later ones' are lower, also among ties
    common = F.max(F.when(F.col("open"), F.col("level"))).over(every)
    return filled.withColumn("common", common).select(
        "source", "source_size", "weight",
        F.when(F.col("common").isNull(), F.col("cap")).otherwise(
            F.least(F.col("cap"), F.col("common") * F.col("weight"))).alias("target"))


def block_width(sizes: DataFrame, block_words: int) -> int:
    """Words of a block: ``block_words``, or what makes ``MAX_BLOCKS`` of all words."""
    return max(block_words, ceil((sizes.agg(F.sum("size")).head()[0] or 0) / MAX_BLOCKS))


def n_blocks(source_size: Column, width: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(source_size / F.lit(width))).cast("long")


def document_hash(doc_id: Column, size: Column, seed: int) -> Column:
    return unit(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), size)


def dealt(sizes: DataFrame, aims: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """``sizes`` with ``block``, ``at`` (place in the block) and ``before``
    (words of the block ahead of the document); a document without words gets
    no block."""
    width = block_width(sizes, block_words)
    blocks = aims.select(F.col("source").alias("s"), "source_size", "target", n_blocks(F.col("source_size"), width).alias("n_blocks"))
    at = document_hash(F.col("doc_id"), F.col("size"), seed)
    placed = sizes.join(blocks, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("at", at).withColumn(
        "block", F.when(F.col("size") > 0, F.pmod(F.col("at"), F.col("n_blocks")))).drop("n_blocks")
    # without words: a window of their own for every few, as their order is idle
    idle = F.when(F.col("size") == 0, F.pmod(F.col("at"), F.lit(4096)))
    more = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    w = Window.partitionBy("source", "block", idle).orderBy("at", "doc_id", *more).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long"))


def drawn_blocks(placed: DataFrame, aims: DataFrame, seed: int = SEED) -> DataFrame:
    """Blocks the mix takes: source, epoch, block, ``slot`` (place in the
    source's permuted sequence) and ``use`` (words of the block taken)."""
    sizes = placed.groupBy("source", "block").agg(F.sum("size").cast("long").alias("block_words"))
    goal = aims.select(F.col("source").alias("s"), "source_size", F.round("target").cast("long").alias("goal"))
    passes = sizes.join(goal, F.col("source").eqNullSafe(F.col("s"))).where("source_size > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("goal") / F.col("source_size")))))
    order = Window.partitionBy("source", "epoch").orderBy(
        unit(F.lit(seed + 1), F.coalesce(F.col("source"), F.lit("")), F.col("epoch"), F.col("block")), "block")
    before = F.coalesce(F.sum("block_words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    due = F.least(F.col("source_size"), F.col("goal") - F.col("epoch") * F.col("source_size"))
    cut = passes.withColumn("use", F.least(F.col("block_words"), due - before)).where("use > 0")
    slot = F.row_number().over(Window.partitionBy("source").orderBy(
        "epoch", unit(F.lit(seed + 1), F.coalesce(F.col("source"), F.lit("")), F.col("epoch"), F.col("block")), "block"))
    return cut.select("source", "epoch", "block", "block_words", F.col("use").cast("long"), (slot - 1).cast("long").alias("slot"))


def depth_for(words: int, shard_words: int = SHARD_WORDS) -> int:
    """Levels of a tree with a shard for about every ``shard_words`` words."""
    return max(0, ceil(log2(max(1, words / shard_words))))


def split_tree(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """Quota of every output shard: rows (source, shard, quota, first), where
    ``first`` is the shard's first slot in the source's permuted blocks.

    ``quotas`` has one row per source.  A node orders its blocks by a hash and
    gives the lower half to its left child; as the children keep that order, the
    shard of a block follows from its place among all blocks.  Places are counted
    in ``BUCKETS`` ranges of the hash.  Without replacement: every block has one
    place."""
    draw = unit(F.lit(seed + 2), F.coalesce("source", F.lit("")), F.col("source").isNull(), F.col("i"))
    blocks = quotas.where("quota > 0").select("source", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("i"))
    drawn = blocks.withColumn("draw", draw).withColumn("bucket", F.shiftright("draw", 60 - BUCKETS.bit_length() + 1))
    counts = drawn.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("bucket", before.alias("ahead"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("draw", "source", "i")) - 1
    placed = drawn.withColumn("inside", inside).join(counts, "bucket").withColumn("place", F.col("ahead") + F.col("inside"))
    # node, its first place and its number of blocks, level by level
    start = F.struct(F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("lo"), F.col("total").cast("long").alias("n"))

    def level(at: Column, _i: Column) -> Column:
        half = F.floor(at["n"] / 2).cast("long")
        left = F.col("place") < at["lo"] + half
        return F.struct((at["node"] * 2 + F.when(left, 0).otherwise(1)).alias("node"),
                        F.when(left, at["lo"]).otherwise(at["lo"] + half).alias("lo"),
                        F.when(left, half).otherwise(at["n"] - half).alias("n"))

    steps = F.sequence(F.lit(1), F.lit(depth)) if depth else F.array().cast("array<int>")
    leaves = placed.withColumn("shard", F.aggregate(steps, start, level)["node"]).groupBy("source", "shard").agg(
        F.count("*").cast("long").alias("quota"))
    w = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return leaves.withColumn("first", F.coalesce(F.sum("quota").over(w), F.lit(0)).cast("long"))


def _plan(sizes: DataFrame, shard_words: int, block_words: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(aims, placed, owned): targets per source; documents in blocks; per taken
    block its ``uses`` (epoch, words used, shard) and whether it is ``whole``."""
    aims = targets(sizes)
    placed = dealt(sizes, aims, block_words, seed)
    blocks = drawn_blocks(placed.select("source", "block", "size").where("size > 0"), aims, seed)
    total = sizes.agg(F.sum("size")).head()[0] or 0
    shares = split_tree(blocks.groupBy("source").agg(F.count("*").cast("long").alias("quota")),
                        depth_for(total * SHARE, shard_words), seed)
    slots = shares.select(F.col("source").alias("s"), "shard", F.explode(
        F.sequence("first", F.col("first") + F.col("quota") - 1)).alias("at_slot"))
    owned = blocks.join(slots, F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("at_slot"))).groupBy(
        F.col("source").alias("s"), F.col("block").alias("b")).agg(
        F.sort_array(F.collect_list(F.struct("epoch", "use", "shard"))).alias("uses"),
        F.min(F.col("use") == F.col("block_words")).alias("whole"))
    return aims, placed, owned


def _draws(uses: Column, seed: int, before: Column) -> Column:
    """What the uses of a block take of one document (size, at, before)."""
    each = F.transform(F.coalesce(uses, F.array().cast("array<struct<epoch:bigint,use:bigint,shard:bigint>>")), lambda u: F.struct(
        u["epoch"].alias("epoch"), u["shard"].alias("shard"),
        F.xxhash64(F.lit(seed + 3), u["shard"], u["epoch"], F.col("at"), before).alias("place"),
        F.least(F.col("size"), u["use"] - before).alias("words")))
    return F.filter(each, lambda d: d["words"] > 0)


def takings(sizes: DataFrame, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """``sizes`` (doc_id, source, size and any other columns) with source_size,
    target and ``draws``: an array of (epoch, shard, place, words), one for
    every time the mix takes words of the document, from its start.

    ``sizes`` is read several times: pass a written table."""
    _, placed, owned = _plan(sizes, shard_words, block_words, seed)
    joined = placed.join(owned, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    return joined.withColumn("draws", _draws(F.col("uses"), seed, F.col("before"))).drop("s", "b", "uses", "whole", "at", "before", "block")


def summary(docs: DataFrame, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken, and the
    output shard of its first draw."""
    got = takings(materialize(sized(docs), "mix-sizes"), shard_words, block_words, seed)
    return got.select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"),
        F.get("draws", F.lit(0))["shard"].alias("first_shard"))


def _mixed(docs: DataFrame, shard_words: int, block_words: int, seed: int) -> DataFrame:
    """A row of ``docs`` (as ``row``) for every draw, with ``text`` cut after the
    words taken, ``shard`` and ``place`` (sort by it inside the shard)."""
    keyed = keyed_rows(docs).withColumn("size", F.size(words(F.col("row.text"))).cast("long"))
    keys = ["key_a", "key_b"]
    light = materialize(keyed.select(
        *keys, F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "size"), "mix-sizes")
    aims, placed, owned = _plan(light, shard_words, block_words, seed)
    owned = materialize(owned, "mix-blocks")
    # documents of blocks taken in part: their places in the block decide
    part = owned.where("not whole")
    inner = materialize(placed.join(part, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select(
        *keys, F.explode(_draws(F.col("uses"), seed, F.col("before"))).alias("d")), "mix-parts")
    cuts = materialize(aims.select(F.col("source").alias("s_"), n_blocks(F.col("source_size"), block_width(light, block_words)).alias("n_blocks")),
                       "mix-cuts")

    def sent(small: DataFrame) -> DataFrame:
        return F.broadcast(small) if small.count() <= SENT_BLOCKS else small

    at = document_hash(F.col("row.doc_id"), F.col("size"), seed)
    rows = keyed.where("size > 0").withColumn("at", at).join(sent(cuts), F.col("row.source").eqNullSafe(F.col("s_"))).withColumn(
        "block_", F.pmod("at", "n_blocks"))
    taken = rows.join(sent(owned.where("whole")), F.col("row.source").eqNullSafe(F.col("s")) & (F.col("block_") == F.col("b")))
    whole = taken.select("row", "size", F.explode(_draws(F.col("uses"), seed, F.lit(0))).alias("d"))
    # fully equal rows share their draws: one of them stands for all
    once = keyed_rows(docs).join(inner.select(*keys).distinct(), keys, "left_semi").dropDuplicates(keys)
    once = once.withColumn("size", F.size(words(F.col("row.text"))).cast("long"))
    pieces = whole.unionByName(once.join(inner, keys).select("row", "size", "d"))
    chunks = F.split(F.col("row.text"), f"(?<=[{SPACE_CLASS}])(?=[^{SPACE_CLASS}])")
    lead = F.when(F.col("row.text").rlike(f"^[{SPACE_CLASS}]"), 1).otherwise(0)
    cut = F.array_join(F.slice(chunks, F.lit(1), (F.col("d.words") + lead).cast("int")), "")
    text = F.when(F.col("d.words") < F.col("size"), cut).otherwise(F.col("row.text"))
    return pieces.select("row", text.alias("text"), "size", F.col("d.shard").alias("shard"), F.col("d.place").alias("place"))


def mixed_documents(docs: DataFrame, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mix as rows of ``docs``, shuffled inside each shard; n_chars (long)
    follows the text.  Only the last block of a source is cut.  A task writes a
    range of a shard of about ``TASK_WORDS`` words."""
    rows = _mixed(docs, shard_words, block_words, seed)
    spread = max(1, shard_words // TASK_WORDS)
    order = rows.repartition(F.col("shard"), F.pmod(F.col("place"), F.lit(spread))).sortWithinPartitions("shard", "place")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return order.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
