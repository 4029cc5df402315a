import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.llm import brute, data

from tsdrift.llm import phrases as P

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def expected(rows, least, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", brute.ascii_lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in candidates.items():
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(inside[lang, w[i:j]], a)
    out = []
    for lang in n:
        found = []
        for (x, w), a in candidates.items():
            if x == lang and inside[lang, w] < a:
                score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
                found.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least", [3, 12])
def test_equals_brute_force(spark, least):
    rows = data.rows()
    want = expected([(r[2], r[1]) for r in rows], least)
    docs = data.documents(spark).repartition(5).withColumns({"prefix": F.lit("x"), "phrase": F.lit(1), "count": F.lit(2), "word": F.lit(3)})
    assert want and got(P.collocations(docs.select("lang", "text", "prefix", "phrase", "count", "word"), least)) == want


def test_slices_chunks_and_a_small_bit_table_change_nothing(spark, monkeypatch):
    rows = data.rows(2)
    want = expected([(r[2], r[1]) for r in rows], 4)
    for name, value in (("SLICE", 5), ("HOT_WORDS", 100000), ("BUCKET_WORDS", 100), ("CHUNK", 4000), ("MERGE", 50), ("FILTER_BITS", 128)):
        monkeypatch.setattr(P, name, value)
    found = P.stripes(data.documents(spark, 2).select("lang", "text").repartition(3), 4)
    assert found[1].groupBy("lang", "prefix").count().where("count > 1").count() > 0  # sliced
    assert got(P.collocations(data.documents(spark, 2).repartition(3), 4)) == want


def test_one_structure_gives_totals_and_maxima(spark):
    docs = spark.createDataFrame([("a", "of the sea of the land, of it. THE sea")], "lang string, text string")
    found = P.stripes(docs, 1)
    assert found[0].agg(F.sum("total")).head()[0] == 10
    count = {(r["prefix"], r["word"]): r["count"] for k in range(5) for r in P.entries(found[k]).collect()}
    assert count["", "of"] == 3 and count["of", "the"] == 2 and count["the", "sea"] == 2 and count["of the", "sea"] == 1
    assert count["of the sea of", "the"] == 1 and ("of the sea of the", "land") not in count


def test_top_and_ties(spark):
    text = ". ".join(["b c", "a b", "x y"] * 4)
    docs = spark.createDataFrame([(None, text), ("z", None), ("q", " \n. ")], "lang string, text string")
    want = expected([(None, text)], 4, 2)
    assert got(P.collocations(docs, 4, 2)) == want and [r[2] for r in want] == ["x y", "a b"]


def test_very_long_text_and_exact_large_products(spark):
    docs = spark.createDataFrame([("en", "ab cd " * 200_000)], "lang string, text string")
    assert got(P.collocations(docs, 100)) == expected([("en", "ab cd " * 200_000)], 100)
    big = 3_000_000_000_000
    row = spark.range(1).select(F.expr(
        f"(cast(1000L * {big}L as decimal(19,0)) * cast({big * 7}L as decimal(19,0))) div (cast({big}L as decimal(19,0)) * cast({big + 1}L as decimal(19,0)))"))
    assert row.head()[0] == 1000 * big * big * 7 // (big * (big + 1))


def test_empty_table(spark):
    assert got(P.collocations(data.empty(spark))) == []
