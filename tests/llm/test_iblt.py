import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from tests.llm import data

from tsdrift.llm import iblt as I


def true_likeness(a, b):
    x, y = Counter(a.tolist()), Counter(b.tolist())
    total = sum(x.values()) + sum(y.values())
    return 1 - sum(((x - y) + (y - x)).values()) / total if total else 1.0


def test_differences_are_recovered_whatever_their_number():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 2**63, 3000).astype(np.uint64)
    cases = [(0, 0), (1, 0), (3, 5), (40, 10), (400, 700), (0, 3000)]
    a = [np.concatenate([shared, rng.integers(0, 2**63, n).astype(np.uint64)]) for n, _ in cases] + [np.empty(0, np.uint64)]
    b = [np.concatenate([shared, rng.integers(0, 2**63, n).astype(np.uint64)]) for _, n in cases] + [np.empty(0, np.uint64)]
    got = I.differences(a, b)
    for x, y, d in zip(a, b, got):
        assert set(d.tolist()) == set(x.tolist()) ^ set(y.tolist()) and len(d) == len(set(d.tolist()))


def test_repeated_paragraphs_count():
    keys = I.digests("\n".join(["same paragraph here now"] * 5))
    assert len(keys) == len(set(keys.tolist()))
    one, five = I.digests("x " * 12 + "\nsame"), I.digests("x " * 12 + "\nsame" * 5)
    assert set(one.tolist()) < set(five.tolist()) and len(I.digests(" \n\t")) == 0


def expected(rows):
    out = []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for r, nxt in zip(rows, rows[1:] + rows[:1]):
        t, u = r[1] or "", nxt[1] or ""
        k = len(t) // 4
        edited = t[:len(t) - k] + u[:k]
        own = I.digests(t)
        out.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), round(true_likeness(own, I.digests(edited)), 9),
                    round(true_likeness(own, I.digests(u)), 9)))
    return sorted(map(str, out))


def test_versions_equal_brute_force(spark):
    rows = data.rows()
    for chars, parts in ((1 << 20, 3), (2000, 5)):
        docs = data.documents(spark).repartition(parts).withColumns({"bucket": F.lit(1), "key": F.lit("x"), "halo": F.lit(2)})
        got = I.versions(docs, chars).collect()
        assert sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)))
                      for r in got) == expected(rows)
    by_text = {}
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        assert by_text.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def test_one_row_and_empty_table(spark):
    one = I.versions(spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()
    assert I.versions(data.empty(spark)).count() == 0
