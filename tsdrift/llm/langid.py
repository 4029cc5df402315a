"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 (a function of its code point).
An n-gram binds its letters: the vectors are permuted by their place (a cyclic
shift) and multiplied.  A text bundles (adds) the vectors of its n-grams, a
language those of all its training texts, and a text gets the language whose
prototype has the highest cosine with it.

Bundling is linear, so the dot product of a text with a prototype is the sum of
its n-grams' dot products; those are computed once per distinct n-gram of a
batch instead of once per text, and the norm of the text, common to all
cosines, cancels in the score: the best cosine over the sum of the positive
ones.  Training counts n-grams per language first, then bundles each distinct
one once; partial prototypes are integers, summed exactly in any order.

Letters are lower-cased; a run of anything else is one boundary symbol.  Only
the prototypes (one vector per language, the label set) reach the driver.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
rows with a null language or without letters are not learned from; without any
prototype everything is ``und``.  Of languages with equal cosines the first by
name is taken; repeated rows get equal predictions; an empty table gives no rows;
a very long text is read whole, as a batch of its own.  All columns of the input
but text stay, one named ``lang_pred`` or ``score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
BATCH_CHARS = 2 << 20
DENSE = 1 << 24  # n-gram codes counted in a dense array up to here

_letters: np.ndarray | None = None
_vectors: dict[tuple[int, int], np.ndarray] = {}


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:  # once per worker process
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def letter_vector(point: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The fixed random vector of a code point (0: the boundary symbol)."""
    key = (point, dimensions)
    if key not in _vectors:
        bits = np.random.Generator(np.random.Philox(key=[point, 20])).integers(0, 2, dimensions, dtype=np.int8)
        _vectors[key] = 2 * bits - 1
    return _vectors[key]


def bind(grams: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Vectors of trigrams given as rows of three code points."""
    points, index = np.unique(grams, return_inverse=True)
    base = np.stack([letter_vector(int(p), dimensions) for p in points])
    a, b, c = index.reshape(grams.shape).T
    return np.roll(base, 2, axis=1)[a] * np.roll(base, 1, axis=1)[b] * base[c]


def encode(text: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bundled vector of one text, straight from the definition."""
    _, grams, index = _grams([text])
    return bind(grams, dimensions)[index].sum(axis=0, dtype=np.int64) if len(index) else np.zeros(dimensions, np.int64)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of texts of every trigram, the distinct trigrams, and the index of
    each trigram among them.  A trigram has a letter in its middle."""
    points = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = [len(p) + 2 for p in points]
    edge = np.zeros(1, np.uint32)
    c = np.concatenate([x for p in points for x in (edge, p, edge)]) if points else np.empty(0, np.uint32)
    c = np.where(_is_letter()[c], c, 0).astype(np.uint32)
    rows = np.repeat(np.arange(len(texts)), sizes)
    if not len(c):
        return rows, np.empty((0, 3), np.uint32), np.empty(0, np.int64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c, rows = c[keep], rows[keep]
    seen = np.zeros(0x110000, bool)
    seen[c] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    x, size = number[c], len(alphabet)
    middle = c[1:-1] != 0
    code = ((x[:-2] * size + x[1:-1]) * size + x[2:])[middle]
    rows = rows[1:-1][middle]
    if size ** 3 <= DENSE:
        present = np.zeros(size ** 3, bool)
        present[code] = True
        distinct = np.flatnonzero(present)
        place = np.zeros(size ** 3, np.int64)
        place[distinct] = np.arange(len(distinct))
        index = place[code]
    else:
        distinct, index = np.unique(code, return_inverse=True)
    grams = np.stack([alphabet[distinct // (size * size)], alphabet[distinct // size % size], alphabet[distinct % size]], axis=1)
    return rows, grams, index


def _chunks(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        sizes = pdf["text"].str.len().fillna(0).cumsum() // BATCH_CHARS
        for _, part in pdf.groupby(sizes, sort=False):
            yield part


def _bundler(dimensions: int):
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in _chunks(batches):
            langs, names = pd.factorize(pdf["lang"])
            rows, grams, index = _grams(pdf["text"].tolist())
            if not len(index):
                continue
            counts = np.bincount(langs[rows] * len(grams) + index, minlength=len(names) * len(grams))
            counts = counts.reshape(len(names), len(grams)).astype(np.float64)
            for k in range(0, len(grams), 2048):
                part = counts[:, k:k + 2048] @ bind(grams[k:k + 2048], dimensions).astype(np.float64)
                for name, v in zip(names, part, strict=True):
                    total[name] = total.get(name, 0) + v
        if total:
            yield pd.DataFrame({"lang": list(total), "vector": list(total.values())})

    return run


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Bundled vector of every language of ``docs`` (text, lang)."""
    partial = docs.where("text is not null and lang is not null").select("text", "lang").mapInPandas(
        _bundler(dimensions), "lang string, vector array<double>")
    sums = partial.select("lang", F.posexplode("vector").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("vs")).collect():
        vector = np.array([x["v"] for x in r["vs"]])
        if vector.any():
            out[r["lang"]] = vector
    return out


def _predictor(names: list[str], matrix: np.ndarray, columns: list[str]):
    dimensions = matrix.shape[1] if len(names) else 0

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _chunks(batches):
            n = len(pdf)
            lang, score = np.full(n, "und", dtype=object), np.zeros(n)
            rows, grams, index = _grams(pdf["text"].fillna("").tolist())
            if names and len(index):
                dots = np.concatenate([bind(grams[k:k + 2048], dimensions).astype(np.float32) @ matrix.T
                                       for k in range(0, len(grams), 2048)])
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                sums = np.add.reduceat(dots[index].astype(np.float64), first, axis=0)
                best = sums.argmax(axis=1)
                top = sums[np.arange(len(sums)), best]
                positive = np.maximum(sums, 0).sum(axis=1)
                lang[rows[first]] = np.array(names, dtype=object)[best]
                score[rows[first]] = np.where(top > 0, top / np.where(positive > 0, positive, 1), 0)
            yield pdf[columns].assign(lang_pred=lang, score=score)

    return run


def predict(docs: DataFrame, protos: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` (its columns but text) with lang_pred and score."""
    names = sorted(protos)
    matrix = np.array([protos[k] / np.linalg.norm(protos[k]) for k in names], dtype=np.float32)
    columns = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in columns] + ["lang_pred string", "score double"])
    return docs.select(*columns, "text").mapInPandas(_predictor(names, matrix, columns), schema)
