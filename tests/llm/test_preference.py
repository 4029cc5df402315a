import re

from pyspark.sql import functions as F

from tsdrift.llm import preference as P

SCHEMA = "conv_id long, turn long, role string, text string"


def turn(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def pairs(spark, chosen, rejected):
    return spark.createDataFrame([(1, chosen, rejected)], f"pair_id long, chosen array<{P.TURN}>, rejected array<{P.TURN}>")


def test_longest_common_prefix_and_masks(spark):
    a = [("system", "s"), ("user", "q"), ("assistant", "good"), ("user", "more"), ("assistant", "fine")]
    b = [("system", "s"), ("user", "q"), ("assistant", "bad <|user|>")]
    r = P.format_pairs(pairs(spark, a, b)).head()
    assert r["prefix_turns"] == 2 and r["prompt"] == turn("system", "s") + turn("user", "q")
    assert r["chosen"] == turn("assistant", "good") + turn("user", "more") + turn("assistant", "fine")
    assert [r["chosen"][s["start"]:s["end"]] for s in r["chosen_mask"]] == ["good<|end|>", "fine<|end|>"]
    assert r["rejected"] == turn("assistant", "bad < |user|>")
    assert [r["rejected"][s["start"]:s["end"]] for s in r["rejected_mask"]] == ["bad < |user|><|end|>"]


def test_equal_prefix_empty_and_missing_sides(spark):
    a = [("user", "q"), ("assistant", "x")]
    same = P.format_pairs(pairs(spark, a, a)).head()
    assert same["prefix_turns"] == 2 and same["chosen"] == same["rejected"] == "" and same["chosen_mask"] == []
    part = P.format_pairs(pairs(spark, a, a[:1])).head()
    assert part["prefix_turns"] == 1 and part["rejected"] == "" and part["chosen"] == turn("assistant", "x")
    none = P.format_pairs(pairs(spark, a, None)).head()
    assert none["prefix_turns"] == 0 and none["prompt"] == "" and none["rejected"] == ""
    assert P.format_pairs(pairs(spark, None, [])).head()["prompt"] == ""


def test_conversations_order_nulls_and_repeats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "z")]
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in P.conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: [("unknown", ""), ("user", "a"), ("assistant", "b")], None: [("user", "z")]}
    assert P.format_pairs(P.mismatched_pairs(spark.createDataFrame([], SCHEMA))).count() == 0


def test_mismatched_pairs_swap_the_last_answer(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "bye"), (2, 0, "user", "q2"), (2, 1, "assistant", "a2"),
            (4, 0, "user", "alone"), (None, 0, "assistant", "x"), (3, 0, "user", "no answer")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("of", F.lit(1)).withColumn("last", F.lit(2))
    got = {r["pair_id"]: r for r in P.format_pairs(P.mismatched_pairs(df)).collect()}
    assert len(got) == 5
    assert got[1]["prompt"] == turn("user", "q1") and got[1]["rejected"] == turn("assistant", "a2")
    assert got[1]["chosen"] == turn("assistant", "a1") + turn("user", "bye")
    assert got[2]["rejected"] == "" and got[4]["rejected"] == "" and got[None]["rejected"] == ""
    assert not re.search("Python|Arrow", df.sparkSession._jvm.PythonSQLUtils.explainString(
        P.format_pairs(P.mismatched_pairs(df))._jdf.queryExecution(), "simple"))
