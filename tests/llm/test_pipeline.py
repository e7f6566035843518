"""The pipeline against its stages in plain Python, one text at a time."""

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from scrutari.llm import bpe, pii, runtime, tokens, toxicity

from test_decontaminate import plain as spans
from test_minhash import plain as groups


def test_stages_do_what_they_say(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    m = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rows = [r.asDict() for r in docs.collect()]

    def toxic(s):
        w = tokens.words([s])
        return bool((m.best(toxicity.terms(w), w.doc)[0] > m.threshold)[0])

    rows = [r for r in rows if not toxic(r["text"])]
    rows.sort(key=lambda r: r["doc_id"])
    kept, seen = [], set()
    for r, g in zip(rows, groups([r["text"] for r in rows])):
        if g not in seen:
            kept.append(r)
            seen.add(g)
    kept = [r for r in kept if not any(_may(r["text"], t) and spans(r["text"], t) for t in items)]
    tagger = pii.Tagger(pii.weights())
    t = Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    want = {}
    for r in kept:
        s = r["text"]
        if s is not None:
            for a, b, k in reversed(tagger.spans([s])[0]):
                s = f"{s[:a]}[{pii.KINDS[k - 1]}]{s[b:]}"
        want[r["doc_id"]] = (s, None if s is None else t.encode(s, add_special_tokens=False).ids)
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*docs.columns, "tokens"]
    got = {r["doc_id"]: (r["text"], r["tokens"]) for r in out.collect()}
    assert got == want


def _may(s, t):
    """A cheap look before every pair of words is compared."""
    import re

    w = lambda x: re.findall(r"[^\W_]+", (x or "").lower())
    a, b = w(s), w(t)
    return bool({tuple(a[i : i + 10]) for i in range(len(a) - 9)} & {tuple(b[i : i + 10]) for i in range(len(b) - 9)})


def test_every_stage_on_awkward_rows(spark, awkward, nothing, folder):
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            before = docs
            docs, _ = runtime.written(stage(spark, docs, folder), "stage")
        assert [c for c in docs.columns if c != "tokens"] == [c for c in before.columns if c != "tokens"]
    assert docs.count() == 0
