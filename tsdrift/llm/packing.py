"""Bounded-space online packing of tokenized documents into fixed sequences.

Every partition packs its documents as they come.  A document's ids are cut
into full sequences; the rest, shorter than a sequence, goes whole into the
open window it fits best.  At most ``open_windows`` windows are open: when none
fits, the fullest is emitted.  What is still open at the end of the partitions
is merged in rounds, a few partitions' windows at a time, until one group is
left; those rounds move window descriptors only, never ids.

Texts are tokenized word by word, as the tokenizer's own splitting never joins
across white space.  A batch is split, and its words numbered, as Arrow arrays;
the ids of the distinct letter runs and signs are looked up in the worker's cache
(bounded, it only saves time), the unknown ones encoded many to a call, and the
ids of all texts of the batch gathered at once.

Defined cases: a null or empty text is a document of its end id alone; repeated
rows and null ids are packed like any other row; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsdrift.session import materialize

LENGTH = 4096
END_ID = 2
OPEN_WINDOWS = 128
FAN_IN = 8  # partitions merged per group and round
FULL = 31 / 32  # a merged window this full is closed
BATCH_BYTES = 2 << 20
CACHE_PARTS = 200_000  # beyond it nothing more is kept

PIECE = ("doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, "
         "open boolean, members array<struct<window:long,base:long>>")
# A word of plain Latin letters and a tail of ASCII signs without an apostrophe
# splits into exactly these two parts; other words are encoded whole.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
SIMPLE = r"^[A-Za-zÀ-ÖØ-öø-ÿ]*[!-&(-/:-@\[-`{-~]*$"
MEMBERS = pa.list_(pa.struct([("window", pa.int64()), ("base", pa.int64())]))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary file ``name`` lies, on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    """Ids of whole texts by ``tokenizers``, through their distinct words."""

    _loaded: dict[str, "WordTokenizer"] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = pa.array([""], pa.string())  # known parts: part k has
        self.sizes = np.zeros(1, np.int64)  # sizes[k] ids
        self.ids = np.empty(0, "<u4")  # that follow those of the parts before

    @classmethod
    def load(cls, path: str) -> "WordTokenizer":
        if path not in cls._loaded:  # once per worker process
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of distinct parts without white space, many to a call."""
        sizes, ids = [np.empty(0, np.int64)], [np.empty(0, "<u4")]
        for k in range(0, len(parts), 4000):
            some = parts[k:k + 4000]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            starts = np.array(got.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            widths = np.fromiter(map(len, some), np.int64, len(some)) + 1
            sizes.append(np.diff(np.searchsorted(starts, np.r_[0, np.cumsum(widths)])))
            ids.append(np.array(got.ids, dtype="<u4"))
        return np.concatenate(sizes), np.concatenate(ids)

    def _lookup(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, sizes, ids): ids of every part, ``sizes`` and ``ids`` running
        over known and new parts, ``place`` where a part is in them."""
        at = pc.index_in(parts, value_set=self.parts)
        new = parts.filter(pc.is_null(at)).unique()
        if not len(new):
            return at.to_numpy(zero_copy_only=False), self.sizes, self.ids
        sizes, ids = self._encode(new.to_pylist())
        known = pa.concat_arrays([self.parts, new])
        sizes, ids = np.concatenate([self.sizes, sizes]), np.concatenate([self.ids, ids])
        if len(self.parts) < CACHE_PARTS:
            self.parts, self.sizes, self.ids = known, sizes, ids
        return pc.index_in(parts, value_set=known).to_numpy(), sizes, ids

    def texts(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of every text, end id included."""
        ids, begin = self.batch(pa.array([t.decode("utf-8") for t in texts], pa.string()))
        yield from np.split(ids, begin[1:-1])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (strings, none null), end ids included, in one
        array, and where each text begins in it (one more for the end)."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        # a word is two parts: its letters and its signs, or itself and nothing
        simple = pc.match_substring_regex(words, SIMPLE)
        letters = pc.if_else(simple, pc.utf8_lower(pc.ascii_rtrim(words, characters=SIGNS)), words)
        tail = pc.if_else(simple, pc.subtract(pc.binary_length(words), pc.binary_length(pc.ascii_rtrim(words, characters=SIGNS))), 0)
        some = pc.greater(tail, 0)
        signs = pa.array([w[-n:] for w, n in zip(words.filter(some).to_pylist(), tail.filter(some).to_pylist())], pa.string())
        place, sizes, ids = self._lookup(pa.concat_arrays([letters, signs]))
        first = np.cumsum(sizes) - sizes
        # ids of the distinct words, the end id as one more
        n = len(words)
        parts = np.zeros((n + 1, 2), np.int64)
        parts[:n, 0] = place[:n]
        parts[np.flatnonzero(some.to_numpy(zero_copy_only=False)), 1] = place[n:]  # part 0 is empty
        parts[n, 0] = len(sizes)
        sizes, first, ids = np.append(sizes, 1), np.append(first, len(ids)), np.append(ids, np.uint32(END_ID)).astype("<u4")
        flat = _gather(ids, first, sizes, parts.ravel())
        widths = sizes[parts].sum(axis=1)
        begin = np.cumsum(widths) - widths
        ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
        order = np.insert(coded.indices.to_numpy().astype(np.int64), ends, n)
        lengths = np.r_[0, np.cumsum(widths[order])]
        return _gather(flat, begin, widths, order), np.r_[0, lengths[ends + np.arange(1, len(ends) + 1)]]


def _gather(data: np.ndarray, first: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The runs ``data[first[k]:first[k] + sizes[k]]`` for every k of ``order``."""
    own = sizes[order]
    shift = np.repeat(first[order] - (np.cumsum(own) - own), own)
    return data[shift + np.arange(len(shift))]


class OpenWindows:
    """A bounded set of open windows with best-fit placement."""

    def __init__(self, first: int, length: int, limit: int):
        self.next, self.length, self.limit = first, length, limit
        self.room: list[tuple[int, int]] = []  # (free tokens, window), ascending

    def place(self, n: int) -> tuple[int, int]:
        """Window and offset for ``n`` tokens, n < length."""
        k = bisect_left(self.room, (n, -1))
        if k < len(self.room):
            free, window = self.room.pop(k)
        else:
            if len(self.room) >= self.limit:
                self.room.pop(0)  # the fullest is emitted
            free, window = self.length, self.open()
        if free > n:
            insort(self.room, (free - n, window))
        return window, self.length - free

    def open(self) -> int:
        self.next += 1
        return self.next - 1


def _small(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """ids and texts of a few rows at a time: ``BATCH_BYTES``, or one longer text."""
    for batch in batches:
        ids, texts = batch.column(0), pc.fill_null(batch.column(1).cast(pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + BATCH_BYTES, side="right")))
            yield ids.slice(at, to - at), texts.slice(at, to - at)
            at = to


def _packer(path: str, length: int, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.load(path)
        windows = OpenWindows(TaskContext.get().partitionId() << 32, length, limit)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "open", "members"]
        kind = pa.null()
        for doc_ids, texts in _small(batches):
            kind = doc_ids.type
            got, begin = tokenizer.batch(texts)
            data = memoryview(np.ascontiguousarray(got)).cast("B")
            out = []
            for k, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
                for start in range(a, b, length):
                    n = min(length, b - start)
                    window, offset = (windows.open(), 0) if n == length else windows.place(n)
                    out.append((k, start - a, n, zlib.crc32(data[4 * start:4 * (start + n)]), b - a, window, offset))
            rows = np.array(out, dtype=np.int64).T
            yield pa.RecordBatch.from_arrays(
                [doc_ids.take(pa.array(rows[0])), *map(pa.array, rows[1:]), pa.array(np.zeros(len(out), bool)),
                 pa.nulls(len(out), MEMBERS)], names)
        if windows.room:
            n, none = len(windows.room), pa.nulls(len(windows.room), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, kind), none, pa.array([length - free for free, _ in windows.room], pa.int64()), none, none,
                 pa.array([w for _, w in windows.room], pa.int64()), none, pa.array(np.ones(n, bool)),
                 pa.array([[{"window": w, "base": 0}] for _, w in windows.room], MEMBERS)], names)

    return run


def _merger(length: int, limit: int, last: bool):
    """Packs the open windows of a group of partitions into each other, largest
    first.  Windows nearly full, and all in the last round, are closed."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["total"].tolist(), pdf["window"].tolist(), pdf["members"], strict=True), key=lambda r: (-r[0], r[1]))
        room: list[tuple[int, int]] = []
        bins: list[list] = []  # window id, members
        for n, window, members in rows:
            k = bisect_left(room, (n, -1))
            if k < len(room):
                free, b = room.pop(k)
            else:
                free, b = length, len(bins)
                bins.append([window, []])
            bins[b][1].extend({"window": int(m["window"]), "base": int(m["base"]) + length - free} for m in members)
            insort(room, (free - n, b))
        keep = [b for free, b in room if free > length * (1 - FULL)][-limit:] if not last else []
        free = {b: f for f, b in room}
        return pd.DataFrame({
            "window": [w for w, _ in bins], "total": [length - free[b] for b in range(len(bins))],
            "members": [m for _, m in bins], "closed": [b not in set(keep) for b in range(len(bins))]},
        ).astype({"window": "int64", "total": "int64", "closed": "bool"})

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text): doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset."""
    kind = dict(docs.dtypes)["doc_id"]
    done = materialize(docs.select("doc_id", "text").mapInArrow(
        _packer(tokenizer, length, open_windows), PIECE.format(id=kind)), "packed")
    left = done.where("open").select("window", F.col("length").alias("total"), "members")
    parts = left.agg(F.max(F.shiftright("window", 32))).head()[0]
    schema = "window long, total long, members array<struct<window:long,base:long>>, closed boolean"
    closed = None
    span = 1
    groups = (parts or 0) + 1
    while True:
        span *= FAN_IN
        groups = -(-groups // FAN_IN)
        merged = materialize(left.groupBy(F.floor(F.shiftright("window", 32) / span)).applyInPandas(
            _merger(length, open_windows, groups == 1), schema), "merged-windows")
        shut = merged.where("closed").select("window", "members")
        closed = shut if closed is None else closed.unionByName(shut)
        if groups == 1:
            break
        left = merged.where("not closed").select("window", "total", "members")
    homes = closed.select(F.col("window").alias("sequence"), F.explode("members").alias("m")).select(
        F.col("m.window").alias("w"), F.col("m.base").alias("base"), "sequence")
    return done.where("not open").join(homes, F.col("window") == F.col("w"), "left").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("sequence", "window").alias("sequence_id"),
        (F.col("offset") + F.coalesce("base", F.lit(0))).cast("long").alias("offset"))
