import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm import brute, data

from tsdrift.llm import setsketch as S


def shingles(text):
    w = brute.words(brute.ascii_lower(text))
    return {tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def expected(rows):
    """Rows (doc_id, n_shingles, component_id, kept), by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = "".join(rng.choice("abcdefghij") for _ in range(6))
    return " ".join(w)


def family_rows(seed=3):
    """Families of near copies around the threshold, with exact copies and chains."""
    rng = random.Random(seed)
    rows = [(r[0], r[1]) for r in data.rows(seed, 40)]
    k = 5000
    for n in (12, 40, 150):
        for family in range(3):
            base = data.prose(rng, "en", n)
            for _ in range(14):
                rows.append((k, edited(rng, base, rng.randrange(0, max(2, n // 8)))))
                k += 1
            chain = base
            for _ in range(6):
                chain = edited(rng, chain, max(1, n // 25))
                rows.append((k, chain))
                k += 1
    rng.shuffle(rows)
    return rows


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("bucket,unit", [(4096, 1 << 21), (3, 1 << 21), (4096, 400)])
def test_equals_brute_force(spark, bucket, unit):
    rows = family_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns(
        {"n": F.lit(1), "set_a": F.lit("x"), "id": F.lit(2), "registers": F.lit(3), "component_id": F.lit(4)})
    assert got(S.near_duplicates(df, bucket, unit)) == expected(rows)


def test_empty_table_and_textless_rows(spark):
    assert got(S.near_duplicates(data.empty(spark))) == []
    rows = [(1, None), (2, ""), (3, " \n"), (None, None), (4, "word"), (5, "WORD "), (None, "word"), (None, "all alone here"), (6, "a b"), (6, "a b")]
    found = got(S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert found == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, True), (4, 1, 4, True), (5, 1, 4, False),
                            (None, 1, 4, False), (None, 2, None, True), (6, 1, 6, True), (6, 1, 6, True)], key=str)


def sketch(values):
    x = np.unique(np.array(values, np.uint64))
    return S.sketches(np.zeros(len(x), np.int64), S.mixed(x), 1)[0]


@pytest.mark.parametrize("n", [1, 7, 300, 5000])
def test_sketch_of_a_union_is_the_maximum(n):
    a, b = sketch(range(n)), sketch(range(n // 2, 3 * n))
    assert (np.maximum(a, b) == sketch(range(3 * n))).all() and (a > 0).all()


def test_sketch_does_not_depend_on_the_documents_beside_it():
    owner = np.repeat([0, 1, 2], [5, 400, 30])
    x = S.mixed(np.arange(435, dtype=np.uint64))
    every = S.sketches(owner, x, 3)
    for k in range(3):
        assert (every[k] == S.sketches(np.zeros((owner == k).sum(), np.int64), x[owner == k], 1)[0]).all()


def test_registers_agree_as_the_similarity_says():
    n = 2000
    for similarity in (0.3, 0.8, 0.95):
        shared = round(2 * n * similarity / (1 + similarity))
        same = np.mean([(sketch(range(k * 10**6, k * 10**6 + n)) == sketch(range(k * 10**6 + n - shared, k * 10**6 + 2 * n - shared))).mean() for k in range(8)])
        assert similarity - 0.06 < same < similarity + 0.09


def test_likelihood_keeps_true_pairs_and_drops_far_ones():
    rng = np.random.default_rng(5)

    def rate(similarity, n=600, tries=60):
        shared = round(2 * n * similarity / (1 + similarity))
        a, b = [], []
        for _ in range(tries):
            at = int(rng.integers(0, 1 << 40))
            a.append(sketch(range(at, at + n)))
            b.append(sketch(range(at + n - shared, at + 2 * n - shared)))
        size = np.full(tries, n)
        return S.plausible(np.array(a), np.array(b), size, size).mean()

    assert rate(0.8) == 1 and rate(0.9) == 1 and rate(0.5) < 0.2 and rate(0.3) == 0
    a = sketch(range(100))
    assert not S.plausible(a[None], a[None], np.array([100]), np.array([79]))[0]  # sizes rule it out


def test_shingle_sets():
    texts = ["A b  a B c", "one", "", "x\ty\nx y"]
    owner, h = S.shingle_sets(pa.array(texts))
    assert np.bincount(owner, minlength=4).tolist() == [len(shingles(t)) for t in texts]
    again = S.shingle_sets(pa.array(["a b a b c", "X Y X y"]))
    assert set(h[owner == 0]) == set(again[1][again[0] == 0]) and set(h[owner == 3]) == set(again[1][again[0] == 1])


def test_very_long_text(spark):
    rng = random.Random(1)
    long = data.prose(rng, "en", 60_000)
    rows = [(1, long), (2, edited(rng, long, 500)), (3, data.prose(rng, "de", 60_000))]
    assert got(S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), unit=50_000)) == expected(rows)
