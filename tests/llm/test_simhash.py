import random

import numpy as np
from pyspark.sql import functions as F
from tests.llm import brute, data

from tsdrift.llm import simhash as S
from tsdrift.llm.components import components
from tsdrift.session import materialize


def flips(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def clustered(seed, n=1500, centres=60):
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(n)]
    near = [flips(rng, base[i % centres], rng.randint(0, 6)) for i in range(n)]
    dense = [flips(rng, 0xABCDEF, rng.randint(0, 3)) for _ in range(600)]  # one large group
    return list(dict.fromkeys(base + near + dense))


def as_long(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_equal_definition(spark):
    got = {(r["doc_id"], r["text"]): r["h"] for r in data.documents(spark).select(
        "doc_id", "text", S.hex_digits(S.fingerprints(F.col("text"))).alias("h")).collect()}
    for d, t, *_ in data.rows():
        assert got[d, t] == format(brute.simhash(t), "016x")
    assert got[1000, None] == "0" * 16


def test_parts_cover_every_pair_within_the_radius():
    for radius in range(0, 8):
        cut = S.parts(radius)
        assert sum(m for m, _ in cut) == S.ALL_BITS and sum(r + 1 for _, r in cut) == radius + 1


def test_links_connect_what_brute_force_connects(spark):
    for seed, shard in ((1, 100_000), (2, 150)):
        prints = clustered(seed)
        points = materialize(spark.createDataFrame([(as_long(x),) for x in prints], "fp long"), "points")
        found = {(r["a"], r["b"]) for r in S.links(points, 4, shard).collect()}
        at = {as_long(x): i for i, x in enumerate(prints)}
        parent = list(range(len(prints)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in found:
            parent[max(root(at[a]), root(at[b]))] = min(root(at[a]), root(at[b]))
        assert [root(i) for i in range(len(prints))] == brute.components(prints)


def test_dense_group_reports_stars_not_pairs():
    rng = random.Random(5)
    dense = np.array(list({flips(rng, 99, rng.randint(0, 2)) for _ in range(800)}), dtype=np.uint64)
    stars = S.leaf_stars(dense, np.arange(len(dense)), 4)
    assert len(stars) == 1 and len(stars[0][1]) == len(dense) - 1


def test_near_duplicates_equal_brute_force(spark):
    prints = materialize(data.documents(spark).select("doc_id", S.fingerprints(F.col("text")).alias("fp")), "prints")
    got = {r["doc_id"]: r["component_id"] for r in S.near_duplicates(prints).collect()}
    rows = data.rows()
    label = brute.components([brute.simhash(r[1]) for r in rows])
    for i, r in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None]
        assert got[r[0]] == min(ids, default=None)
    assert got[1000] == got[1001] == got[1002] == 1000  # no words: fingerprint zero


def test_keep_one_of_each_group(spark):
    docs = data.documents(spark).withColumns({"uid": F.lit(1), "fp": F.lit(2), "row": F.lit(3)})
    got = S.keep_one(docs)
    assert got.columns == docs.columns
    rows = data.rows()
    label = brute.components([brute.simhash(r[1]) for r in rows])
    best = {}
    for lab, r in zip(label, rows):
        best[lab] = min(best.get(lab, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == sorted(best.values())


def test_empty_table(spark):
    assert S.keep_one(data.empty(spark)).count() == 0


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1, i) for i in range(500, 700)] + [(699, 800), (800, 2)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain + hub + [(7, 7)], "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and got[800] == got[2] == got[650] == 1 and 7 not in got
