import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F
from tests.llm import data
from tokenizers import Tokenizer

from tsdrift.llm import packing as K


def whole_ids(rows):
    t = Tokenizer.from_file(K.tokenizer_path())
    return [np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], dtype="<u4") for r in rows]


def check(pieces, ids_of, length):
    covered, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        options = ids_of[p["doc_id"]]
        assert any(p["doc_tokens"] == len(x) and p["ids_crc32"] == zlib.crc32(x[p["start"]:p["start"] + p["length"]].tobytes()) for x in options)
        covered[p["doc_id"]].append((p["start"], p["length"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for d, options in ids_of.items():
        assert sum(n for _, n in covered[d]) == sum(map(len, options))
        if len(options) == 1:
            at = 0
            for start, n in sorted(covered[d]):
                assert start == at
                at += n
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return [sum(n for _, n in s) for s in sequences.values()]


def test_pieces_tile_documents_and_sequences(spark):
    rows = data.rows()
    ids_of = defaultdict(list)
    for r, x in zip(rows, whole_ids(rows)):
        ids_of[r[0]].append(x)
    for parts, length, limit in ((1, 4096, 64), (9, 512, 4), (40, 4096, 8)):
        docs = data.documents(spark).repartition(parts).withColumns({"window": F.lit(1), "start": F.lit("x")})
        fill = check(K.pack(docs, K.tokenizer_path(), length, limit).collect(), ids_of, length)
        assert sum(fill) / (len(fill) * length) > 0.85
        assert sum(1 for n in fill if n < length * K.FULL) <= max(3, len(fill) // 2)


def test_word_ids_equal_whole_text_ids():
    t = Tokenizer.from_file(K.tokenizer_path())
    texts = ["It's  don't I'D we'll", "x́y é", "foo_bar 12,345.6 A.B.C", "<|endoftext|> a<|startoftext|>b", "ΣΑΣ İi ß ÉCOLE",
             "a b c　d", "tab\tnew\nline\x0bx\x0cy\rz", "漢字かな 한국어 \U0001f600\U0001f601", "", "   ", "word,.!?;: (x) [y] --z--", "a\x1cb\x85c"]
    got = list(K.WordTokenizer(K.tokenizer_path()).texts([x.encode() for x in texts]))
    for x, g in zip(texts, got):
        assert g.tolist() == t.encode(x, add_special_tokens=False).ids + [2], x


def test_open_windows_are_bounded_and_best_fit():
    w = K.OpenWindows(0, 100, 2)
    assert w.place(60) == (0, 0) and w.place(70) == (1, 0)
    assert w.place(30) == (1, 70)  # the window it fits best, now full
    assert w.place(50) == (2, 0) and len(w.room) == 2
    assert w.place(55) == (3, 0)  # none fits: window 0, the fullest, is emitted
    assert sorted(x for _, x in w.room) == [2, 3]


def test_empty_table_and_textless_rows(spark):
    assert K.pack(data.empty(spark), K.tokenizer_path()).count() == 0
    got = K.pack(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), K.tokenizer_path()).collect()
    assert len(got) == 2 and {(r["length"], r["doc_tokens"]) for r in got} == {(1, 1)} and len({r["sequence_id"] for r in got}) == 1
