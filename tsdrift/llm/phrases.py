"""Phrase collocations by the stripes pattern.

A stripe belongs to a prefix (no word up to four) and counts the words that follow
it inside a piece of text.  Stripes of one prefix are merged elementwise.  One merged
structure gives

* extensions: the count of prefix + word for every word of the stripe;
* prefix totals: the sum of the stripe of the empty prefix is the number of words, and
  the count of any prefix is its last word's entry in the stripe one word shorter;
* subsumption maxima: the largest extension of a phrase to the right in its own
  stripe, to the left over the stripes whose entry ends with it.

A longer phrase is never more frequent than a part of it, so a candidate that some
longer candidate subsumes is subsumed by one that is a single word longer.

Passes.  First the stripes of the empty prefix; then those of one word, of frequent
words only; those of two words, along frequent word pairs; and those of three and four
words, along frequent triples.  What is frequent is tested by a bit table of phrase
hashes.  A false hit only costs work, as counts are of the words themselves; the table
has 16 bits per frequent phrase, at most ``FILTER_BITS`` (32 MB); beyond it the test
passes more, the results stay exact.

Work and skew.  Tasks combine ``CHUNK`` bytes of text; what they send is a bundle of
stripes per bucket of prefixes, a bucket for about every ``BUCKET_WORDS`` words of the
corpus.  A stripe is cut into slices by the hash of the next word: of a word that
occurs f times about f / ``SLICE``, so that a frequent prefix is merged in many
buckets; the at most 65,536 words this concerns are sent to the tasks.  A task merges
one bucket at a time and holds its distinct entries.

Defined cases: a null text is empty, a null language is ``und``; a text without words
has no stripe; repeated rows count each; empty tables give no phrases; very long texts
are one chunk; columns other than lang and text are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsdrift.llm.bittable import MAX_BITS, BitTable, bit_table
from tsdrift.llm.bytewords import byte_ranges, byte_table, gathered, split
from tsdrift.session import materialize

MOST_WORDS = 5
LEAST_COUNT = 100
TOP = 2000
CHUNK = 12 << 20  # bytes of text combined in a task before the shuffle
SLICE = 1 << 20  # occurrences of a prefix per slice of its stripe
HOT_WORDS = 1 << 16  # a word below one in so many occurrences is not sliced
FILTER_BITS = MAX_BITS
BUCKET_WORDS = 1 << 21
MERGE = 3_000_000  # stripe entries gathered before they are merged

TABLE = byte_table(b" \t", b".,;:!?" + byte_ranges((0x0A, 0x0D)))
# stripes on their way: prefixes joined by a line end and words by a space, which no
# word has, with 32-bit numbers of words per prefix and counts per word
BUNDLE = "lang string, bucket long, prefixes string, sizes binary, words string, counts binary"


def word_hashes(words: pa.Array, lang: str) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode(), 42)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def phrase_hash(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of the hashes of a phrase's words."""
    out = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        out = (out ^ h) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def frequent(entries: DataFrame, words: int) -> BitTable:
    """Bit table of the phrases (lang, prefix, word) of ``words`` words."""

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), lang))
                parts = [word_hashes(own.column(2), lang)]
                if words > 1:
                    before = pc.split_pattern(own.column(1), " ")
                    parts = [word_hashes(pc.list_element(before, k), lang) for k in range(words - 1)] + parts
                yield pa.RecordBatch.from_arrays([pa.array(phrase_hash(parts).view(np.int64))], ["hash"])

    return bit_table(entries.select("lang", "prefix", "word").mapInArrow(hashes, "hash long"), "hash", FILTER_BITS)


def _joined(values: pa.Array, ends: np.ndarray, separator: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values), separator)


def _numbers(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    data = pa.py_buffer(values.astype("<u4").tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), data])


def _bundles(lang: str, names: pa.Array, prefix: np.ndarray, slices: np.ndarray, words: pa.Array, word: np.ndarray,
             counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket from entries (one at least) ordered by (prefix, slice):
    number of its prefix in ``names``, of its word in ``words``, and its count."""
    first = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (slices[1:] != slices[:-1])])
    sizes = np.diff(np.append(first, len(prefix)))
    own, back = np.unique(prefix[first], return_inverse=True)
    place = phrase_hash([word_hashes(names.take(pa.array(own)), lang)[back], slices[first].astype(np.uint64)])
    bucket = (place % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, sizes, first = bucket[order], sizes[order], first[order]
    ends = np.r_[0, np.cumsum(sizes)]
    entry = np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    stripes = np.append(at, len(bucket))
    return pa.RecordBatch.from_arrays([
        pa.array([lang] * len(at), pa.string()), pa.array(bucket[at]),
        _joined(names.take(pa.array(prefix[first])), stripes, "\n"), _numbers(sizes, stripes),
        _joined(words.take(pa.array(word[entry])), ends[stripes], " "), _numbers(counts[entry], ends[stripes])],
        ["lang", "bucket", "prefixes", "sizes", "words", "counts"])


def _chunks(batches: Iterable[pa.RecordBatch]):
    """Per chunk and language: (lang, distinct words, word of every token, piece of every token)."""
    for table in gathered(batches, 1, CHUNK):
        table = table.combine_chunks()
        for lang in pc.unique(table["lang"]).to_pylist():
            texts = pa.concat_arrays(table.filter(pc.equal(table["lang"], lang))["text"].chunks)
            words, _, piece = split(texts, TABLE)
            if len(words):
                coded = words.dictionary_encode()
                yield lang, coded.dictionary, coded.indices.to_numpy().astype(np.int64), piece


def _root(buckets: int):
    """Stripes of the empty prefix."""

    def run(batches):
        for lang, words, token, _ in _chunks(batches):
            part = (word_hashes(words, lang) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            yield _bundles(lang, pa.array([""]), np.zeros(len(order), np.int64), part[order], words, order,
                           np.bincount(token, minlength=len(words))[order], buckets)

    return run


def _growth(known: BitTable, size: int, lengths: tuple[int, ...], hot: dict[str, dict[str, int]], buckets: int):
    """Stripes of the prefixes of ``lengths`` words all of whose runs of ``size``
    words are frequent; a next word counts by name if the run it ends is, too."""

    def run(batches):
        for lang, words, token, piece in _chunks(batches):
            hashes = word_hashes(words, lang)
            n = len(token)
            runs = n - size + 1
            if runs < 1:
                continue
            good = known.has(phrase_hash([hashes[token[k:k + runs]] for k in range(size)]))
            good &= piece[:runs] == piece[size - 1:]
            good = np.append(good, np.zeros(MOST_WORDS, bool))
            wide = np.ones(len(words), np.int64)
            if hot.get(lang):
                at = pc.index_in(pa.array(list(hot[lang])), value_set=words)
                here = at.is_valid().to_numpy(zero_copy_only=False)
                wide[at.drop_null().to_numpy()] = np.array(list(hot[lang].values()))[here]
            part = (hashes >> np.uint64(8)).astype(np.int64) & 0x7FFFFFFF
            more = len(words)
            for m in lengths:
                ok = reduce(np.logical_and, (good[k:k + n] for k in range(m - size + 1)))
                at = np.flatnonzero(ok)
                if not len(at):
                    break
                # number the prefixes: pairs of (number so far, next word)
                number, names = token[at], words
                for k in range(1, m):
                    pairs, number = np.unique(number * more + token[at + k], return_inverse=True)
                    names = pc.binary_join_element_wise(names.take(pa.array(pairs // more)), words.take(pa.array(pairs % more)), " ")
                follows = good[at + m - size + 1] & (piece[np.minimum(at + m, n - 1)] == piece[at])
                keys, counts = np.unique(number[follows] * more + token[at[follows] + m], return_counts=True)
                prefix, word = keys // more, keys % more
                slices = np.zeros(len(keys), np.int64)
                if m == 1:
                    slices = part[word] % wide[prefix]
                    order = np.lexsort((slices, prefix))
                    prefix, word, counts, slices = prefix[order], word[order], counts[order], slices[order]
                if len(keys):
                    yield _bundles(lang, names, prefix, slices, words, word, counts, buckets)

    return run


class Merged:
    """Distinct (key, word) entries of stripes with their counts; a key is a language
    and a prefix, joined by a line end."""

    def __init__(self):
        self.keys, self.words = pa.array([], pa.string()), pa.array([], pa.string())
        self.key, self.word, self.count = (np.empty(0, np.int64) for _ in range(3))

    def add(self, rows: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(rows).combine_chunks()
        prefixes = pc.split_pattern(table["prefixes"].combine_chunks(), "\n")
        langs = table["lang"].combine_chunks().take(pa.array(np.repeat(np.arange(len(table)), pc.list_value_length(prefixes).to_numpy())))
        sizes = np.frombuffer(b"".join(table["sizes"].to_pylist()), "<u4")
        words = pc.split_pattern(table["words"].combine_chunks(), " ").flatten()
        keys = pa.concat_arrays([self.keys, pc.binary_join_element_wise(langs, prefixes.flatten(), "\n")]).dictionary_encode()
        names = pa.concat_arrays([self.words, words]).dictionary_encode()
        key, word = keys.indices.to_numpy().astype(np.int64), names.indices.to_numpy().astype(np.int64)
        known, width = len(self.keys), max(1, len(names.dictionary))
        key = np.r_[key[:known][self.key], np.repeat(key[known:], sizes)]
        word = np.r_[word[:len(self.words)][self.word], word[len(self.words):]]
        count = np.r_[self.count, np.frombuffer(b"".join(table["counts"].to_pylist()), "<u4").astype(np.int64)]
        entry, place = np.unique(key * width + word, return_inverse=True)
        self.count = np.zeros(len(entry), np.int64)
        np.add.at(self.count, place, count)
        self.keys, self.words, self.key, self.word = keys.dictionary, names.dictionary, entry // width, entry % width

    def result(self, least: int) -> pa.RecordBatch:
        """Stripes that have entries of ``least`` and more, and all of the empty prefix."""
        n = len(self.keys)
        sums = np.zeros(n, np.int64)
        np.add.at(sums, self.key, self.count)
        parts = pc.split_pattern(self.keys, "\n", max_splits=1, reverse=True)
        prefix = pc.list_element(parts, 1)
        keep = self.count >= least
        found = np.bincount(self.key[keep], minlength=n)
        stays = (found > 0) | pc.equal(prefix, "").to_numpy(zero_copy_only=False)
        ends = pa.array(np.r_[0, np.cumsum(found[stays])].astype(np.int32))
        some = pa.array(np.flatnonzero(stays))
        return pa.RecordBatch.from_arrays([
            pc.list_element(parts, 0).take(some), prefix.take(some), pa.array(sums[stays]),
            pa.ListArray.from_arrays(ends, self.words.take(pa.array(self.word[keep]))),
            pa.ListArray.from_arrays(ends, pa.array(self.count[keep]))], ["lang", "prefix", "total", "words", "counts"])


def _merge(least: int):
    """Bundles sorted by bucket to merged stripes, a bucket at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, merged, held, size = None, Merged(), [], 0
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                bucket = row.column(1)[0].as_py()
                if bucket != now and now is not None:
                    if held:
                        merged.add(held)
                    yield merged.result(least)
                    merged, held, size = Merged(), [], 0
                now = bucket
                held.append(row)
                size += len(row.column(5)[0].as_py()) // 4
                if size >= MERGE:
                    merged.add(held)
                    held, size = [], 0
        if now is not None:
            if held:
                merged.add(held)
            yield merged.result(least)

    return run


def merged_stripes(bundles: DataFrame, least: int, name: str) -> DataFrame:
    """lang, prefix, total, words, counts: a row per prefix and slice."""
    return materialize(bundles.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _merge(least), "lang string, prefix string, total long, words array<string>, counts array<long>"), name)


def entries(stripes: DataFrame) -> DataFrame:
    return stripes.where(F.size("words") > 0).select(
        "lang", "prefix", F.explode(F.arrays_zip("words", "counts")).alias("e")).select(
        "lang", "prefix", F.col("e.words").alias("word"), F.col("e.counts").alias("count"))


def stripes(docs: DataFrame, least: int = LEAST_COUNT) -> dict[int, DataFrame]:
    """Merged stripes of ``docs`` (lang, text) by length of the prefix, entries of
    ``least`` occurrences and more."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = merged_stripes(texts.mapInArrow(_root(parts), BUNDLE), least, "stripes-0")
    words = entries(root)
    total = root.agg(F.sum("total")).head()[0] or 0
    each = max(SLICE, total // HOT_WORDS)
    buckets = 1 + total // BUCKET_WORDS
    hot: dict[str, dict[str, int]] = {}
    for r in words.where(F.col("count") > each).collect():  # HOT_WORDS rows at most
        hot.setdefault(r["lang"], {})[r["word"]] = -(-r["count"] // each)
    one = merged_stripes(texts.mapInArrow(_growth(frequent(words, 1), 1, (1,), hot, buckets), BUNDLE), least, "stripes-1")
    two = merged_stripes(texts.mapInArrow(_growth(frequent(entries(one), 2), 2, (2,), {}, buckets), BUNDLE), least, "stripes-2")
    longer = tuple(range(3, MOST_WORDS))
    more = merged_stripes(texts.mapInArrow(_growth(frequent(entries(two), 3), 3, longer, {}, buckets), BUNDLE), least, "stripes-3")
    return {0: root, 1: one, 2: two} | {k: more.where(F.size(F.split("prefix", " ")) == k) for k in longer}


def _part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found = stripes(docs, least)
    totals = found[0].groupBy("lang").agg(F.sum("total").alias("n"))
    singles = entries(found[0]).select("lang", F.col("word").alias("phrase"), F.col("count").alias("a"))
    longer = materialize(reduce(DataFrame.unionByName, [entries(found[k]) for k in range(1, MOST_WORDS)]).select(
        "lang", "prefix", F.concat_ws(" ", "prefix", "word").alias("phrase"), F.col("count").alias("a")), "phrases")
    # the largest extension of a phrase, on either side
    tail = F.substring_index("phrase", " ", -1)
    behind = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    over = longer.where(F.instr("prefix", " ") > 0).select(
        "lang", "a", F.explode(F.array(F.col("prefix"), behind)).alias("inner")).groupBy("lang", "inner").agg(F.max("a").alias("most"))
    own = longer.join(over.select(F.col("lang").alias("lang_"), F.col("inner"), "most"),
                      (F.col("lang") == F.col("lang_")) & (F.col("phrase") == F.col("inner")), "left").where(
        "most is null or 100 * most < 100 * a").select("lang", "phrase", "a")
    words = F.split("phrase", " ")
    size = F.size(words)
    cuts = own.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "*", _part(words, F.lit(1), F.col("k")).alias("left"), _part(words, F.col("k") + 1, size - F.col("k")).alias("right"))
    known = singles.unionByName(longer.select("lang", "phrase", "a"))
    both = cuts
    for side, name in (("left", "l"), ("right", "r")):
        own = known.select(F.col("lang").alias("lang_"), F.col("phrase").alias("phrase_"), F.col("a").alias(name))
        both = both.join(own, (F.col("lang") == F.col("lang_")) & (F.col(side) == F.col("phrase_"))).drop("lang_", "phrase_")
    both = both.join(totals.select(F.col("lang").alias("lang_n"), "n"), F.col("lang") == F.col("lang_n"))
    wide = "decimal(19,0)"
    score = F.expr(f"(cast(1000 * a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    best = both.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = best.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return first.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
