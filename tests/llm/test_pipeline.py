"""The pipeline against plain-Python versions of its stages, each judged on the
input it really had."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.llm import brute, data
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tsdrift.llm import packing, quality_rules
from tsdrift.llm.queries import QUERIES
from tsdrift.session import materialize


@pytest.fixture(scope="module")
def stages(spark):
    docs = materialize(data.documents(spark, 7, 200), "pipeline-input")
    out = [("documents", docs.columns, [tuple(r) for r in docs.collect()])]
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), f"test-{name}")
        out.append((name, docs.columns, [tuple(r) for r in docs.collect()]))
    return out


def key(rows):
    return sorted(map(str, rows))


def test_stage_names_and_columns(stages):
    assert [s[0] for s in stages[1:]] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "packing"]
    assert all(s[1] == ["doc_id", "text", "lang", "source", "n_chars"] for s in stages[:-1])


def test_quality_rules(stages):
    def rejected(t):
        m, letters = brute.measures(t), [c for c in t or "" if c.isalpha()]
        return (m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"]
                or 2 * m["n_dup_lines"] > m["n_lines"] or not 2.5 * m["n_words"] <= m["word_chars"] <= 14 * m["n_words"]
                or 2 * sum(c.isupper() for c in letters) > len(letters) or 10 * (t or "").count("!") > 3 * m["n_words"]
                or 2 * len(letters) < m["word_chars"])

    assert key(stages[1][2]) == key(r for r in stages[0][2] if not rejected(r[1]))
    assert quality_rules.PRODUCTION.version == "production"


def test_line_dedup(stages):
    bad = brute.boilerplate([(r[3], r[1]) for r in stages[1][2]], 0.01, 5)
    want = []
    for d, t, lang, s, _ in stages[1][2]:
        t = brute.drop_lines(s, t, bad)
        want.append((d, t, lang, s, len(t)))
    assert bad and key(stages[2][2]) == key(want)


def test_near_dedup(stages):
    rows = sorted(stages[2][2], key=lambda r: (r[0] is None, r[0] or 0))
    label = brute.components([brute.simhash(r[1]) for r in rows])
    assert key(stages[3][2]) == key(r for i, r in enumerate(rows) if label[i] == i)
    assert len(stages[3][2]) < len(rows)


def test_mixing(stages):
    sizes, got = defaultdict(int), defaultdict(int)
    source = {}
    for d, t, _, s, _ in stages[3][2]:
        sizes[s] += len(brute.words(t))
        source[d] = (s, t)
    per = defaultdict(int)
    for d, t, _, s, n in stages[4][2]:
        assert s == source[d][0] and source[d][1].startswith(t) and n == len(t)
        got[s] += len(brute.words(t))
        per[d] += len(brute.words(t))
    want = brute.targets(sizes)
    assert all(abs(got[s] - want[s]) <= 1 for s in want)
    assert all(n <= 2 * len(brute.words(source[d][1])) for d, n in per.items())


def test_packing(stages):
    t = Tokenizer.from_file(packing.tokenizer_path())
    ids_of, sequences, total = defaultdict(list), defaultdict(list), 0
    for r in stages[4][2]:
        ids_of[r[0]].append(np.array(t.encode(r[1], add_special_tokens=False).ids + [2], dtype="<u4"))
        total += len(ids_of[r[0]][-1])
    for d, start, n, crc, tokens, sequence, offset in stages[5][2]:
        assert any(len(x) == tokens and zlib.crc32(x[start:start + n].tobytes()) == crc for x in ids_of[d])
        sequences[sequence].append((offset, n))
        total -= n
    assert total == 0
    for parts in sequences.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and min(parts)[0] == 0


def test_empty_input_passes_all_stages(spark):
    docs = data.empty(spark)
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), f"empty-{name}")
        assert docs.count() == 0


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
    assert QUERIES["pipeline"] is pipeline.run and QUERIES.items() <= entry.queries().items()
