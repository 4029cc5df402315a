from pyspark.sql import functions as F
from tests.llm import brute, data

from tsdrift.llm import line_dedup as L


def test_equals_brute_force(spark):
    docs = data.documents(spark)
    rows = data.rows()
    bad = brute.boilerplate([(r[3], r[1]) for r in rows], 0.01, 5)
    assert any("Subscribe" in line for _, line in bad)
    got = L.drop_boilerplate(docs).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[0]), brute.drop_lines(r[3], r[1], bad) or "") for r in rows)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in got) == want
    assert {r["text"] for r in got if r["doc_id"] == 1000} == {None}
    assert all(r["dropped_lines"] == (r["doc_id"] is not None and r["doc_id"] < 40 and ("s" + r["source"][1:], "Subscribe to our letter of the week") in bad)
               for r in got if r["doc_id"] is not None and r["doc_id"] < 40)


def test_ratio_counts_pages_of_the_host_once(spark):
    rows = [(i, "buy now\nbuy now\nown line %d" % i, None, "a", 1) for i in range(6)] + [(9, "buy now", None, "b", 1)]
    rows += [(100 + i, "other %d" % i, None, "a", 1) for i in range(94)]
    df = spark.createDataFrame(rows, data.SCHEMA)
    got = {r["doc_id"]: r for r in L.drop_boilerplate(df, ratio=0.05, min_pages=5).collect()}
    assert got[0]["text"] == "own line 0" and got[0]["dropped_lines"] == 2  # 6 of 100 pages
    assert got[9]["text"] == "buy now"  # one page of its host
    kept = L.drop_boilerplate(df, ratio=0.06, min_pages=5).where("doc_id = 0").head()
    assert kept["dropped_lines"] == 0  # not more than the ratio


def test_empty_table_and_clashing_columns(spark):
    assert L.drop_boilerplate(data.empty(spark)).count() == 0
    docs = data.documents(spark).withColumns({"dropped_lines": F.lit("x"), "host": F.lit("h"), "line": F.lit(1), "pages": F.lit(2)})
    got = L.drop_boilerplate(docs)
    assert got.columns == [c for c in docs.columns if c != "dropped_lines"] + ["dropped_lines"]
    assert got.count() == docs.count()


def test_a_source_of_hundreds_of_pages(spark):
    own = [f"own words of page {i}" for i in range(600)]
    rows = [(i, own[i] + ("\nSeen on seven pages" if i < 7 else "") + ("\nSeen on six" if 10 <= i < 16 else "")
             + ("\nSeen on four" if 20 <= i < 24 else "") + "\nImprint", None, "a", 1) for i in range(600)]
    rows += [(1000 + i, "A page of many copies\nwith lines of its own\nImprint", None, "a", 1) for i in range(300)]  # one page
    rows += [(2000, None, None, "a", 0), (2001, "", None, "a", 0), (2002, "", None, "a", 0)]
    got = {r["doc_id"]: r for r in L.drop_boilerplate(spark.createDataFrame(rows, data.SCHEMA).repartition(9)).collect()}
    assert len(got) == len(rows)
    assert got[3]["text"] == own[3] and got[3]["dropped_lines"] == 2  # 7 of 603 pages are more than 1 %
    assert got[12]["text"] == own[12] + "\nSeen on six"  # 6 of 603 are not
    assert got[21]["text"] == own[21] + "\nSeen on four"
    assert got[1299]["text"] == "A page of many copies\nwith lines of its own" and got[2000]["text"] is None
    bad = brute.boilerplate([(r[3], r[1]) for r in rows], L.RATIO, L.MIN_PAGES)
    assert all(r["text"] == brute.drop_lines("a", next(x[1] for x in rows if x[0] == d), bad) for d, r in got.items())
