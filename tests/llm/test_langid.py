import numpy as np
from pyspark.sql import functions as F
from tests.llm import brute, data

from tsdrift.llm import langid as G


def test_scores_equal_cosines_of_bundled_vectors(spark):
    docs = data.documents(spark).select("doc_id", "text", "lang")
    protos = G.prototypes(docs)
    rows = data.rows()
    for lang in ("en", "de", "fr"):
        want = sum(G.encode(r[1]) for r in rows if r[2] == lang and r[1])
        assert np.array_equal(protos[lang], want)
    got = {(r["doc_id"], r["lang"]): r for r in G.predict(docs, protos).collect()}
    names = sorted(protos)
    for r in rows[:30]:
        v = G.encode(r[1])
        cos = np.array([v @ protos[k] / np.linalg.norm(v) / np.linalg.norm(protos[k]) for k in names])
        row = got[r[0], r[2]]
        assert row["lang_pred"] == names[cos.argmax()]
        assert abs(row["score"] - cos.max() / cos[cos > 0].sum()) < 1e-4


def test_held_out_accuracy_and_defined_cases(spark):
    docs = data.documents(spark, 4, 400).withColumns({"held": F.lit(1), "score": F.lit("x"), "lang_pred": F.lit("y")})
    split = [(r[0], brute.fold(r[0], 3) == 1) for r in data.rows(4, 400)]
    held = {d for d, h in split if h}
    protos = G.prototypes(docs.where(~F.col("doc_id").isin(*held)))
    got = G.predict(docs.select("doc_id", "text", "source", "held", "score", "lang_pred"), protos)
    assert got.columns == ["doc_id", "source", "held", "lang_pred", "score"]
    out = {r["doc_id"]: r for r in got.collect()}
    rows = [r for r in data.rows(4, 400) if r[0] in held and r[0] is not None and r[0] < 400]
    assert sum(out[r[0]]["lang_pred"] == r[2] for r in rows) / len(rows) > 0.97
    assert out[1000]["lang_pred"] == out[1001]["lang_pred"] == out[1005]["lang_pred"] == "und" and out[1000]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = data.documents(spark).select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert G.prototypes(docs) == {}
    assert {r["lang_pred"] for r in G.predict(docs.drop("lang"), {}).collect()} == {"und"}
    assert G.predict(data.empty(spark).select("doc_id", "text"), {"en": np.ones(8)}).count() == 0


def test_permutation_orders_letters():
    a, b = G.encode("abc"), G.encode("cba")
    assert abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b) < 0.9
    big = "".join(chr(0x4E00 + i) for i in range(400))  # an alphabet too wide for a dense table
    assert len(G._grams([big])[1]) == 400
