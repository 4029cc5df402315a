"""Every document operator and stage on tables with columns of its own inner names,
maps, string ids, repeated rows and no rows at all."""

import pytest
from pyspark.sql import functions as F
from tests.llm import brute, data

import corpus_pipeline
from tsdrift.llm import html_main, langid, line_dedup, mixing, packing, quality_rules, setsketch, simhash
from tsdrift.llm.common import keyed_rows, unused

CLASHING = ("__host", "__lines", "__bad", "__kept", "__words", "__hash", "__sorted", "__at", "f", "fp", "row", "component", "key_a", "key_b",
            "place", "shard", "block", "at", "s", "s_", "b", "d", "size", "uses", "whole", "draw", "bucket", "node", "i", "best", "least")


def clashing(spark):
    docs = data.documents(spark)
    return docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHING})


def near(docs):
    prints = docs.drop("fp").withColumn("fp", simhash.fingerprints(F.col("text")))
    return simhash.near_duplicates(corpus_pipeline.materialize(prints, "test-prints"))


ROWWISE = {
    "measure": (quality_rules.measure, CLASHING),
    "ledger": (quality_rules.ledger, CLASHING),
    "keep_passing": (quality_rules.keep_passing, CLASHING),
    "drop_boilerplate": (line_dedup.drop_boilerplate, CLASHING),
    "near_duplicates": (near, tuple(c for c in CLASHING if c != "fp")),
    "keep_one": (simhash.keep_one, CLASHING),
    "mixed_documents": (lambda d: mixing.mixed_documents(d, block_words=300), CLASHING),
    "predict": (lambda d: langid.predict(d, langid.prototypes(d)), CLASHING),
}


@pytest.mark.parametrize("name", ROWWISE)
def test_columns_with_inner_names_keep_their_values(spark, name):
    run, kept = ROWWISE[name]
    got = run(clashing(spark))
    assert len({c.lower() for c in got.columns}) == len(got.columns) and set(kept) <= set(got.columns)
    for r in got.select("doc_id", *kept).collect():
        own = "none" if r["doc_id"] is None else str(r["doc_id"])
        assert all(r[c] == f"{c}-{own}" for c in kept)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_keep_extra_columns_and_maps(spark, name, stage):
    docs = clashing(spark).withColumn("facts", F.create_map(F.lit("id"), F.col("doc_id"))).withColumn(
        "deep", F.array(F.struct(F.create_map(F.lit(1), F.col("lang")).alias("m"))))
    got = corpus_pipeline.materialize(stage(spark, docs, ""), f"edge-{name}")
    if name == "packing":
        assert got.count() >= docs.count()
        return
    assert got.columns == docs.columns
    rows = got.select("doc_id", "facts", "deep", "lang", *CLASHING).collect()
    assert rows and all(r["facts"] == {"id": r["doc_id"]} and r["deep"][0]["m"] == {1: r["lang"]} for r in rows)


def test_string_ids(spark):
    docs = data.documents(spark).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    ids = {r["doc_id"] for r in docs.collect()}
    for got in (line_dedup.drop_boilerplate(docs), near(docs), mixing.mixed_documents(docs), setsketch.near_duplicates(docs),
                packing.pack(docs, packing.tokenizer_path())):
        assert dict(got.dtypes)["doc_id"] == "string" and {r["doc_id"] for r in got.select("doc_id").collect()} <= ids


def test_keys_tell_rows_and_maps_apart(spark):
    df = spark.createDataFrame([(1, {"a": 1}), (1, {"a": 2}), (1, {"a": 1}), (1, None)], "doc_id long, m map<string,int>")
    assert keyed_rows(df).select("key_a", "key_b").distinct().count() == 3


def test_unused_names():
    assert unused(["A", "_b"], "a", "_B", "c") == ["_a", "__B", "c"]


def test_very_long_texts(spark):
    long = " ".join(f"wörd{k % 977}" for k in range(150_000))
    docs = spark.createDataFrame([(1, long, "de", "s", len(long)), (2, "<p>kurz</p>", "de", "s", 4)], data.SCHEMA)
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/x").alias("url"), F.concat(F.lit("<p>"), "text").alias("html"))
    assert {r["page_id"]: r["n_chars"] for r in html_main.main_text(pages).collect()}[1] == len(long)
    pred = {r["doc_id"]: r for r in langid.predict(docs, langid.prototypes(docs)).collect()}
    assert pred[1]["lang_pred"] == "de"
    assert sum(len(brute.words(r["text"])) for r in mixing.mixed_documents(docs).collect()) == round(1.5 * 150_001)


def template_texts(pages, min_pages, ratio):
    """Main texts by counting recurring subtrees on parsed pages, all in one place."""
    parsed = [(p, html_main.host_of(u), [(t, [n.digest.digest() for n in around]) for t, around in html_main.parse(h)]) for p, u, h in pages]
    different = {(host, tuple(t for t, _ in blocks)): {s for _, around in blocks for s in around} for _, host, blocks in parsed if host}
    out = {}
    for page, host, blocks in parsed:
        own = [s for (h, _), s in different.items() if h == host] if host else []
        bad = {x for s in own for x in s if sum(x in y for y in own) >= max(min_pages, ratio * len(own))}
        out[page] = "\n".join(t for t, around in blocks if not bad & set(around))
    return out


def test_templates_equal_counting_all_pages_of_a_host(spark):
    import random
    rng = random.Random(8)
    pages = []
    for host, n in (("a.org", 40), ("b.org", 15), ("c.org", 5)):
        menus = [f"<div><p>Go to part {k} of {host}</p><ul><li>home<li>part {k}</ul></div>" for k in range(3)]
        for i in range(n):
            body = "".join(f"<p>{data.prose(rng, 'en', 12)}</p>" for _ in range(rng.randrange(1, 4)))
            half = "<div><p>Seen on half the pages</p></div>" if i % 2 else ""
            rare = "<section><p>Seen now and then</p></section>" if i % 7 == 0 else ""
            pages.append((len(pages), f"http://{host}/{i}", f"{menus[0]}{menus[i % 2 + 1]}{body}{half}{rare}<div><p>Imprint of {host}</p></div>"))
            if i % 5 == 0:
                pages.append((len(pages), f"http://{host}/copy{i}", pages[-1][2]))
    pages += [(900, None, pages[0][2]), (901, "http://a.org/none", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    for min_pages, ratio in ((8, 0.5), (3, 0.1), (2, 0.9)):
        got = {r["page_id"]: r["text"] for r in html_main.main_text(df, min_pages, ratio).collect()}
        want = template_texts(pages, min_pages, ratio)
        assert got == want
    assert "Imprint of a.org" not in got[0] and "Imprint of a.org" in got[900]
