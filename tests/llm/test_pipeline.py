"""The pipeline against brute force over what each stage decides."""

import re

import numpy as np
import public_tokenizers as P
import sentencepiece

import corpus_pipeline
from siltstone.llm import toxicity
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import brute as components
from tests.llm.test_native import base


def test_run_equals_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = toxicity.fitted(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    docs = {i: t for i, t in docs.items() if model.probabilities(np.array([model.latent(toxicity.WORD.findall(t.lower()))]))[0][0] < 0.5}
    docs = {i: docs[i] for i, _, c in components(docs.items(), 5, 80, 100) if i == c}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r[0] for r in contaminated(docs.items(), items) if r[-1]}
    docs = {i: t for i, t in docs.items() if i not in hit}
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert got.keys() == docs.keys() and len(got) > 100
    for i, r in got.items():
        assert r["n_tokens"] == len(r["ids"])
        text = sp.decode(r["ids"])
        assert not base(text.replace("<secret>", "\n"))
        if "<secret>" not in text:
            assert text == docs[i]


def test_stages_keep_columns_and_odd_rows(spark, sf):
    rows = [(1, "a b c d e f g", "en", "s", 13), (2, None, None, "s", None), (3, "", "en", None, 0), (3, "", "en", None, 0), (4, "password: hunter2hunter2", "en", "s", 1), (None, "x " * 20000, "en", "s", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    out = docs.collect()
    assert {r["doc_id"] for r in out} == {None, 1, 2, 3, 4}
    assert next(r for r in out if r["doc_id"] == 4)["text"] == "<secret>" and next(r for r in out if r["doc_id"] == 4)["n_chars"] == 8
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(out)
    assert re.match("toxicity", corpus_pipeline.STAGES[0][0])
