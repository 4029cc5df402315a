from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm import brute, data

from tsdrift.llm import mixing as M


def sizes_of(rows):
    out = defaultdict(int)
    for r in rows:
        out[r[3]] += len(brute.words(r[1]))
    return dict(out)


def test_targets_equal_resharing(spark):
    for seed in (1, 2, 3):
        rows = data.rows(seed)
        want = brute.targets(sizes_of(rows))
        got = {r["source"]: r["target"] for r in M.targets(M.sized(data.documents(spark, seed))).collect()}
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s], rel=1e-9)


def test_takings_meet_targets_and_stay_below_twice_the_size(spark):
    got = M.summary(data.documents(spark), block_words=300).collect()
    assert len(got) == len(data.rows())
    per = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        per[r["source_size"], r["target"]] += r["taken"]
    for (_, target), taken in per.items():
        assert abs(taken - target) <= 1


def test_reruns_and_partitionings_agree(spark):
    docs = data.documents(spark)
    key = ("doc_id", "size", "taken", "first_shard")
    first = sorted(str([r[k] for k in key]) for r in M.summary(docs, block_words=200).collect())
    again = sorted(str([r[k] for k in key]) for r in M.summary(docs.repartition(7, "lang"), block_words=200).collect())
    assert first == again


def test_tree_splits_exact_quotas_evenly_and_disjointly(spark):
    quotas = {"a": 700, "b": 250, None: 31, "c": 0, "d": 1}
    df = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    rows = M.split_tree(df, 3).collect()
    by_shard, by_source = defaultdict(int), defaultdict(list)
    for r in rows:
        assert r["quota"] >= 0
        by_shard[r["shard"]] += r["quota"]
        by_source[r["source"]].append((r["first"], r["quota"]))
    assert max(by_shard.values()) - min(by_shard.values()) <= 1 and len(by_shard) == 8
    for s, q in quotas.items():
        at = 0
        for first, n in sorted(by_source[s]):
            assert first == at
            at += n
        assert at == q
    share = [n for f, n in by_source["a"]]
    assert 60 < min(share) and max(share) < 115 and len(set(share)) > 1  # hypergeometric around 87.5


def test_split_is_unbiased(spark):
    df = spark.createDataFrame([("a", 40), ("b", 60)], "source string, quota long")
    lefts = [M.split_tree(df, 1, seed).where("source = 'a' and shard = 0").head()["quota"] for seed in range(0, 120, 6)]
    assert 17 < sum(lefts) / len(lefts) < 23  # mean 20


def test_mixed_documents(spark):
    docs = data.documents(spark)
    got = M.mixed_documents(docs, block_words=300)
    assert got.columns == docs.columns
    want = {(r["doc_id"], r["size"], r["taken"]) for r in M.summary(docs, block_words=300).collect() if r["doc_id"] != 1003}
    words, texts = defaultdict(int), {r[0]: r[1] for r in data.rows()}
    for r in got.collect():
        words[r["doc_id"]] += len(brute.words(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    for d, _, taken in want:
        assert words.get(d, 0) == taken


def test_empty_and_textless_tables(spark):
    assert M.summary(data.empty(spark)).count() == 0
    assert M.mixed_documents(data.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None, "a", 0), (2, "", None, None, 0)], data.SCHEMA)
    assert [(r["size"], r["taken"], r["target"]) for r in M.summary(blank).collect()] == [(0, 0, 0.0)] * 2
    clash = data.documents(spark).withColumns({"size": F.lit("x"), "block": F.lit(1), "shard": F.lit(2), "uid": F.lit(3)})
    assert "uid" in M.mixed_documents(clash).columns


def test_a_tree_of_depth_ten(spark):
    quotas = {"a": 3000, "b": 1500, None: 37}
    rows = M.split_tree(spark.createDataFrame(list(quotas.items()), "source string, quota long"), 10).collect()
    by_shard, by_source = defaultdict(int), defaultdict(list)
    for r in rows:
        by_shard[r["shard"]] += r["quota"]
        by_source[r["source"]].append((r["shard"], r["first"], r["quota"]))
    assert len(by_shard) == 1024 and set(by_shard.values()) == {4, 5}
    # all nodes of a level hold equal shares, too
    for level in range(11):
        node = defaultdict(int)
        for shard, n in by_shard.items():
            node[shard >> (10 - level)] += n
        assert max(node.values()) - min(node.values()) <= 1
    for s, q in quotas.items():
        at = 0
        for _, first, n in sorted(by_source[s]):
            assert first == at and n > 0
            at += n
        assert at == q


def test_five_thousand_sources(spark):
    import random
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 9), None, f"s{min(i, rng.randrange(5000)):04d}", 0) for i in range(9000)]
    rows += [(9000 + k, "w", None, f"s{k:04d}", 0) for k in range(5000)]
    sizes = sizes_of(rows)
    order = sorted(sizes)
    weight = {s: M.WEIGHTS[k % 3] for k, s in enumerate(order)}
    # the level at which all are served, by bisection
    total, low, high = 1.5 * sum(sizes.values()), 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * n, mid * weight[s]) for s, n in sizes.items()) < total else (low, mid)
    docs = spark.createDataFrame(rows, data.SCHEMA)
    taken, aim = defaultdict(int), {}
    for r in M.takings(M.sized(docs), shard_words=1 << 10, block_words=16).collect():
        taken[r["source"]] += sum(d["words"] for d in r["draws"])
        aim[r["source"]] = r["target"]
    assert len(aim) == 5000
    for s, n in sizes.items():
        assert aim[s] == pytest.approx(min(2 * n, high * weight[s]), rel=1e-6) and abs(taken[s] - aim[s]) <= 1
    assert M.mixed_documents(docs, shard_words=1 << 10, block_words=16).count() > 0


def test_large_tables_are_joined_instead_of_sent(spark, monkeypatch):
    docs = data.documents(spark)
    sent = sorted(map(str, M.mixed_documents(docs, block_words=300).collect()))
    monkeypatch.setattr(M, "SENT_BLOCKS", 0)
    assert sorted(map(str, M.mixed_documents(docs, block_words=300).collect())) == sent
