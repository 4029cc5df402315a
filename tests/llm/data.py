"""Small made documents with the awkward cases."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])

STEMS = {"en": ["the", "and", "of", "thing", "with", "that", "ing", "her"], "de": ["der", "und", "schön", "über", "nicht", "ein"],
         "fr": ["être", "où", "le", "que", "ça", "français"]}


def prose(rng, lang="en", n=60):
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(STEMS[lang]) for _ in range(rng.choice([1, 1, 2, 3]))))
        if rng.random() < 0.08:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


def rows(seed=1, n=120):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        out.append([i, prose(rng, lang, rng.choice([15, 60, 200])), lang, f"s{rng.choice([0, 0, 0, 1, 2, 3, 4])}"])
    body = prose(rng, "en", 150)
    for k in range(12):  # near copies and exact ones
        out.append([n + k, body if k < 6 else body.replace("thing", "king", k - 5), "en", f"s{k % 3}"])
    line = "Subscribe to our letter of the week"
    for r in out[:40]:
        r[1] = f"{r[1]}\n  {line} "
    out += [[1000, None, "en", "s1"], [1001, "", "en", "s1"], [1002, " \n\t ", None, None], [None, "no id at all here", "en", None],
            [1003, "word", "en", "s2"], [1003, "word", "en", "s2"], [1004, "a b c a b c a b c a b c a b c a b c", "en", "s0"],
            [1005, "### | $$ % " * 20, "en", "s0"], [1006, "x" * 5000, "en", "s0"], [1007, "ТЕКСТ İstanbul ñ 漢字 \U0001f600 é", "ru", "s4"],
            [1008, prose(rng, "en", 6000), "en", "s0"], [1009, "same line\n" * 30, "de", "s3"]]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in out]


def documents(spark, seed=1, n=120):
    return spark.createDataFrame(rows(seed, n), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
