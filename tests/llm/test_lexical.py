import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tests.llm import brute, data

from tsdrift.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(brute.ascii_lower(text))


def expected(docs, items, best=50):
    """(item_id, [(doc_id, score)]) of every item."""
    rows = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, length = len(rows), sum(sum(c.values()) for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in rows:
            m = 50 + 50 * sum(c.values()) * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out.append((item, [(None if none else d, -s) for s, none, d in sorted(scored)[:best]]))
    return out


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"] and dict(df.dtypes)["rank"] == "int"
    out = {}
    for r in sorted(df.collect(), key=lambda r: (str(r["item_id"]), r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
    return out


ITEMS = [(1, "the thing of her and Über NICHT"), (2, "thing of her"), (3, "the of and her thing nicht ein"), (4, None), (5, ""),
         (6, "unknownword"), (7, "français où 漢字"), (8, "the thing of her and Über NICHT"), (9, "x" * 5000), (10, "a_b#c")]


@pytest.mark.parametrize("best,block", [(50, 1024), (3, 2)])
def test_equals_brute_force(spark, best, block):
    rows = data.rows()
    docs = data.documents(spark).repartition(6).withColumns({"n": F.lit(0), "terms": F.lit("x"), "score": F.lit(1), "item": F.lit(2)})
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("rank", F.lit("r"))
    want = {i: x for i, x in expected([(r[0], r[1]) for r in rows], ITEMS, best) if x}
    assert got(L.search(docs, items, best, block)) == want


def test_many_documents_per_task_and_ties(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 7)
    rows = [(k, f"alpha {'beta ' * (k % 3)}gamma{k % 5}") for k in range(400, 0, -1)]
    items = [("p", "alpha beta"), ("q", "gamma1 beta"), ("r", "gamma2")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = dict(expected(rows, items, 4))
    assert got(L.search(df, spark.createDataFrame(items, "item_id string, text string"), 4)) == want


def test_string_and_missing_ids(spark):
    rows = [("a", "one two"), (None, "one two"), ("b", "one"), ("a", "one two"), ("c", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    found = got(L.search(df, spark.createDataFrame([(1, "two one")], "item_id long, text string")))[1]
    assert [d for d, _ in found] == ["a", "a", None, "b"] and found[0][1] == found[2][1] > found[3][1]


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(L.search(data.empty(spark), items)) == {}
    assert got(L.search(data.documents(spark), items.where("false"))) == {}


@given(st.lists(st.sets(st.integers(0, 11), max_size=9), max_size=12), st.integers(0, 99))
@settings(max_examples=60, deadline=None)
def test_dag_sums_equal_plain_sums(items, seed):
    rows = np.random.default_rng(seed).integers(0, 10**12, (12, 5))
    dag = L.Dag([sorted(x) for x in items], 12)
    want = np.array([rows[sorted(x)].sum(axis=0) for x in items]).reshape(len(items), 5)
    assert (dag.evaluate(rows) == want).all()
    assert dag.additions() <= sum(max(0, len(x) - 1) for x in items)


def test_dag_shares_what_items_have_in_common():
    dag = L.Dag([[0, 1, 2, 3], [0, 1, 2, 4], [0, 1, 2], [5]], 6)
    assert dag.additions() == 4 and len(dag.nodes) == 2  # 0+1+2 once, then one more each for two items


def test_items_wider_than_the_pair_limit(spark, monkeypatch):
    monkeypatch.setattr(L, "PAIRS", 10)
    rows = [(r[0], r[1]) for r in data.rows()[:60]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert got(L.search(df, items)) == {i: x for i, x in expected(rows, ITEMS) if x}
