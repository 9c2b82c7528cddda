"""The corpus pipeline against plain versions of its stages, each on its own input."""

import re
from collections import Counter

import pytest
from test_operators import check_places, plain_alignment, plain_components, plain_pieces, plain_spans

import corpus_pipeline
from lodestone.llm._common import stash


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stash(stage(spark, out[-1], sf)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(s.schema.simpleString() == stages[0].schema.simpleString() for s in stages[:-1])


def test_quality(spark, sf, stages):
    kept, labels = texts(stages[1]), {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all((d in kept) == bool(q) for d, q in labels.items())


def test_near_duplicates(stages):
    before = texts(stages[1])
    assert set(texts(stages[2])) == {c for _, c in plain_components(before.items(), 80).values()}


def test_rows_that_share_an_id(spark, sf):
    names = "doc_id long, text string, lang string, source string, n_chars long, cluster map<string,int>"
    one, other = "some plain words of one text", "quite another text than that, in other words"
    rows = [(1, one, "en", "b", 0, {"a": 1}), (1, one, "en", "a", 0, {"a": 1}), (1, other, "en", "b", 0, None), (2, "a third text that shares no words in a row", None, None, None, None), (None, one, None, None, None, None), (None, one, None, None, None, None)]
    got = corpus_pipeline.minhash_near_dedup(spark, spark.createDataFrame(rows, names), sf).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter([(1, one, "a"), (1, other, "b"), (2, "a third text that shares no words in a row", None), (None, one, None), (None, one, None)])


def test_decontamination(spark, sf, stages):
    before, after = texts(stages[2]), texts(stages[3])
    items = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    held = [grams(w) for w in items]
    for d, t in before.items():
        w = t.lower().split()
        own = grams(w)
        leaks = any(own & g and plain_alignment(i, w) >= len(i) for i, g in zip(items, held, strict=True))
        assert (d in after) == (not leaks)


def test_secrets(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    for d, t in before.items():
        spans, out, at = plain_spans(t), [], 0
        for _, a, b in spans:
            if a >= at:
                out.append(t[at:a] + "[REDACTED]")
            at = max(at, b)
        assert after[d] == "".join(out) + t[at:] or re.search(r"AKIA|(?i:user|login)", t)
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_packing(stages):
    rows = stages[5].collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == plain_pieces(texts(stages[4]), 4096)
    assert check_places(rows, 4096) == -(-sum(r.length for r in rows) // 4096)


def test_run_and_awkward_rows(spark, sf, stages):
    assert Counter((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, sf).collect()) == Counter((r.doc_id, r.piece) for r in stages[5].collect())
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "some plain words", "en", "s", 16), (None, "some plain words", "en", "s", 16), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], stages[0].schema)
    for rows, left in ((odd, Counter({1: 1, None: 2, 2: 1})), (odd.limit(0), Counter())):
        for _, stage in corpus_pipeline.STAGES:
            rows = stash(stage(spark, rows, sf))
        assert Counter(r.doc_id for r in rows.collect()) == left
