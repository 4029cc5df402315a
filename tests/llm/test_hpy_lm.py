import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute, data

from tsdrift.llm import hpy_lm as H
from tsdrift.llm.common import fold
from tsdrift.session import tables_written


def scored(spark, docs):
    return H.score(docs, fold(F.col("doc_id"), 5) == 1)


def test_counts_and_base_scores_equal_brute_force(spark):
    rows = data.rows()
    docs = data.documents(spark).repartition(3).withColumns({"shard": F.lit(1), "block": F.lit("x"), "held_out": F.lit(2)})
    got = {}
    for r in scored(spark, docs).collect():
        got.setdefault(r["doc_id"], r)
    toks = [(r[0], brute.words(brute.ascii_lower(r[1])) + ["\0end"]) for r in rows]
    train = Counter(w for d, ws in toks if brute.fold(d, 5) != 1 for w in ws)
    n, v = sum(train.values()), len(train)
    for d, ws in toks:
        r = got[d]
        assert r["held_out"] == (brute.fold(d, 5) == 1) and r["n_tokens"] == len(ws) and r["train_tokens"] == n
        assert r["n_known"] == sum(train[w] > 0 for w in ws)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), abs=1e-6)
        assert r["score"] < 0
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_reruns_agree_and_blocks_do_not_matter(spark, monkeypatch):
    docs = data.documents(spark).coalesce(1)
    first = sorted(map(str, scored(spark, docs).collect()))
    assert sorted(map(str, scored(spark, docs).collect())) == first


def test_predictions_sum_to_one():
    rng = np.random.default_rng(0)
    types, contexts = 40, (0x6101, 0x6102, 0x6203)
    word = np.repeat(np.arange(types), 3)
    context = np.tile(contexts, types)
    n = rng.integers(0, 30, len(word))
    seen = n > 0
    mid = np.unique((word * 256 + (context >> 8))[seen])
    totals = {"customers": np.bincount(context, weights=n, minlength=H.CONTEXTS), "base": 1 / (types + 1), "discounts": (0.5, 0.6, 0.7),
              "tables": np.bincount(context[seen], minlength=H.CONTEXTS).astype(float),
              "tables1": np.bincount(mid % 256, minlength=256).astype(float), "tables0": float(len(np.unique(mid // 256)))}
    seats = H.Restaurants(word, context, n, types, totals, np.random.default_rng(1))
    for _ in range(4):
        seats.sweep()
        assert (seats.t <= n).all() and (seats.t[seen] >= 1).all()
        p = seats.predict()
        tables, tables1, tables0 = seats._tables()
        root = (H.STRENGTH + 0.5 * tables0) / (tables1.sum() + H.STRENGTH) / (types + 1)
        for c in contexts:
            up = tables.reshape(256, 256).sum(axis=1)[c >> 8]
            unknown = (H.STRENGTH + 0.6 * tables1[c >> 8]) / (up + H.STRENGTH) * root
            unknown *= (H.STRENGTH + 0.7 * tables[c]) / (totals["customers"][c] + H.STRENGTH)
            assert p[context == c].sum() + unknown == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("shards", [1, 8])
def test_scores_after_rounds_sum_to_one(spark, monkeypatch, shards):
    """All words end alike, so there are two contexts, the first token's and one
    more; the end token's share in the latter follows from the former's sum."""
    rng = np.random.default_rng(2)
    types = [f"w{i}xyz" for i in range(30)]
    training = [" ".join(rng.choice(types, 12, p=np.arange(1, 31) / 465)) for _ in range(60)]
    held = ["", *types, "newxyz", *[f"{types[0]} {w}" for w in [*types, "newxyz"]]]
    monkeypatch.setattr(H, "SHARD_CHARS", sum(map(len, training + held)) / shards)
    rows = [(i, t) for i, t in enumerate(held + training)]
    got = {r["doc_id"]: 10 ** r["score"] for r in H.score(
        spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < len(held)).collect()}
    p = {t: got[i] for i, t in enumerate(held)}
    end = sum(p[w] for w in [*types, "newxyz"]) / (1 - p[""])
    assert sum(p[f"{types[0]} {w}"] for w in [*types, "newxyz"]) / p[types[0]] + end == pytest.approx(1, abs=1e-4)


def test_seating_has_the_law_of_one_by_one_seating():
    rng = np.random.default_rng(3)

    def slow(n, a, d):
        t, w = 1, 0.0
        for j in range(1, n):
            w += math.log(j - d * t + a)
            t += rng.random() < a / (j - d * t + a)
        return t, w

    for n, a, d in ((10, 0.5, 0.6), (200, 3.0, 0.7)):
        one = np.array([slow(n, a, d) for _ in range(4000)])
        tables, weight = H.seat(rng, np.full(20000, n), np.full(20000, a), d)
        for x, y in ((one[:, 0], tables), (one[:, 1], weight)):
            assert abs(x.mean() - y.mean()) < 5 * x.std() / math.sqrt(len(x))
    many, _ = H.seat(rng, np.full(50, 200_000), np.full(50, 900.0), 0.5)
    assert abs(many.mean() / 900 / math.log(1 + 200_000 / 900) - 1.05) < 0.25  # leaps beyond 256 tables
    assert np.allclose(H._log_gamma(np.array([0.3, 1.0, 4.5, 120.0])), [math.lgamma(x) for x in (0.3, 1.0, 4.5, 120.0)], atol=1e-6)


def test_tokens_of_awkward_texts():
    words, contexts, sizes = H.tokens([b"", b"A b", b" \t", "éÉ a".encode(), b"a" * 3000])
    assert sizes.tolist() == [1, 3, 1, 3, 2] and (contexts[np.cumsum(sizes) - sizes] == H.START).all()
    assert words[0] == words[3] and words[1] != words[2] and len(set(contexts[[2, 3]].tolist())) == 2
    assert H.tokens([b"a"])[0][0] == words[1]  # A-Z lower-cased


def test_empty_table_and_no_training_text(spark):
    assert scored(spark, data.empty(spark)).count() == 0
    rows = H.score(data.documents(spark).limit(3), F.lit(True)).collect()
    assert len(rows) == 3 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in rows)


def test_predictions_take_one_shard_at_a_time_and_leave_no_seatings(spark, monkeypatch):
    make, known = H._predictions, len(tables_written())

    def checked(kept):
        predict = make(kept)

        def run(batches):
            def single():
                for pdf in batches:
                    assert len(pdf) == 1, f"{len(pdf)} shards at once"
                    yield pdf

            yield from predict(single())

        return run

    docs = data.documents(spark).coalesce(1)
    whole = sorted(str(r["doc_id"]) for r in docs.select("doc_id").collect())
    monkeypatch.setattr(H, "_predictions", checked)
    monkeypatch.setattr(H, "SHARD_CHARS", sum(len(r[1] or "") for r in data.rows()) / 16)
    scores = scored(spark, docs)
    seats = [p.removeprefix("file:") for p in tables_written()[known:] if "/lm-seats-" in p]
    assert seats and not any(os.path.exists(p) for p in seats)
    assert sorted(str(r["doc_id"]) for r in scores.collect()) == whole
