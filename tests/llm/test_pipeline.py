"""The pipeline's stages on the smallest tables, each against what it must keep."""

from __future__ import annotations

import re

import corpus_pipeline
from loomdex.llm import mixing
from loomdex.llm._store import materialize


def test_stages(spark, sf_dir, model_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "mix", "bpe"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(materialize(stage(spark, seen[-1], sf_dir)))
        assert seen[-1].columns == columns
    raw, good, lines, single, mixed = seen
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(good) < ids(raw) and ids(lines) <= ids(good) and ids(single) <= ids(lines) and ids(mixed) <= ids(single)
    assert good.join(raw, columns, "left_anti").count() == 0
    # No longer normal form occurs twice after line dedup.
    texts = [r.text for r in lines.collect()]
    norm = lambda s: re.sub(r"[!-/:-@\[-`{-~]", "", s.replace("\t", " ").replace("\r", " ").lower()).strip(" ")
    forms = [f for t in texts for f in map(norm, t.split("\n")) if len(f) >= 12]
    assert len(forms) == len(set(forms))
    want = {r.doc_id: r.copies for r in mixing.copies(single).where("copies > 0").collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == want
    coded = corpus_pipeline.STAGES[-1][1](spark, mixed, sf_dir).collect()
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert len(coded) == mixed.count() and all(r.text == text[r.doc_id] and len(r.ids) == r.n_tokens for r in coded)


def test_one_of_each_by_row(spark):
    near = [" ".join(f"w{i}" for i in range(n)) for n in (60, 61)]
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, near[0]), (1, near[0]), (None, near[1]), (5, near[1]), (5, other), (None, "a b c d e f"), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.one_of_each(spark, docs, "").collect())
    assert got == [(0, "a b c d e f"), (1, near[0]), (5, other)]
