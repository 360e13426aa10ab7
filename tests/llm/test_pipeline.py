"""The corpus pipeline against a plain version of each stage."""

import re

import corpus_pipeline
import public_tokenizers as P
from test_pairs import brute_jaccard

from lexarc.llm import op2_secrets, op3_bpe, op8_quality
from lexarc.llm.common import Scratch, read


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    scratch = Scratch(spark, "t")
    held = {"": {r.doc_id: r.text for r in docs.collect()}}
    before = ""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        held[name] = {r.doc_id: r.text for r in docs.collect()}
        assert set(held[name]) <= set(held[before])
        before = name
    scored = {r.doc_id: r.score for r in op8_quality.score_documents(read(spark, sf, "documents"), read(spark, sf, "labels"), Scratch(spark, "t")).collect()}
    assert set(held["quality"]) == {i for i, x in scored.items() if x >= op8_quality.THRESHOLD}
    groups = brute_jaccard(list(held["quality"].items()), 5, 80)
    assert set(held["jaccard"]) == {i for i, (_, c) in groups.items() if i == c}
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = [tokens(r.text) for r in read(spark, sf, "benchmark").collect()]
    clean = set()
    for i, t in held["jaccard"].items():
        w = tokens(t)
        seen = {tuple(w[j:j + 8]) for j in range(len(w) - 7)}
        if not any(sum(tuple(b[j:j + 8]) in seen for j in range(len(b) - 7)) >= (len(b) - 7) / 2 for b in items):
            clean.add(i)
    assert set(held["decontaminate"]) == set(held["secrets"]) == clean
    forest = op2_secrets.standard_forest()
    for i, t in held["secrets"].items():
        changed = bool([x for x in op2_secrets._findings([held["decontaminate"][i] or ""], forest)[0] if x["score"] >= op2_secrets.ACCEPT])
        assert (t != held["decontaminate"][i]) == changed
    codec = op3_bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    assert got == {i: codec.encode(t or "") for i, t in held["secrets"].items()}


def test_run(spark, sf):
    df = corpus_pipeline.run(spark, sf)
    assert df.count() > 0 and df.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_odd_rows(spark, sf):
    """Rows without id or text, repeated rows, and an empty table go through every stage; a row without an id goes by its text."""
    good = read(spark, sf, "documents").filter("n_chars between 800 and 1200").limit(1).collect()[0]
    other = read(spark, sf, "documents").filter("n_chars between 1300 and 1600").limit(1).collect()[0].text
    rows = [(1, good.text), (1, good.text), (2, good.text), (None, good.text), (3, None), (4, ""), (None, other), (None, other)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, df, sf).collect()
    assert sorted((str(r.doc_id) for r in kept)) == ["1", "3", "4", "None"]
    for table in (df, df.filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, sf).count() <= len(rows)
