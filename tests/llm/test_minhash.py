import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrutari.llm import minhash

from awkward_rows import TEXTS, table


def plain(texts):
    """Groups of all pairs that share a band and enough minima, joined; texts without words are alone."""
    sig = minhash.signatures(texts)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    full = np.flatnonzero((sig != 0xFFFFFFFF).any(axis=1))
    rows = minhash.ROWS
    for a, i in enumerate(full):
        for j in full[a + 1 :]:
            same = sig[i] == sig[j]
            if same.reshape(-1, rows).all(axis=1).any() and same.mean() >= minhash.THRESHOLD:
                root[find(j)] = find(i)
    return [find(i) for i in range(len(texts))]


def linked(texts):
    """Of each text the number of others that share a band and enough minima with it."""
    sig = minhash.signatures(texts)
    full = np.flatnonzero((sig != 0xFFFFFFFF).any(axis=1))
    out = [0] * len(texts)
    for i in full:
        same = sig[full] == sig[i]
        hit = same.reshape(len(full), minhash.BANDS, minhash.ROWS).all(axis=2).any(axis=1) & (same.mean(axis=1) >= minhash.THRESHOLD)
        out[i] = int(hit.sum()) - 1
    return out


def variants(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    out = []
    while len(out) < n:
        base = r.choices(words, k=r.randrange(3, 120))
        for _ in range(r.choice([1, 1, 2, 5, 9])):
            s = list(base)
            for _ in range(int(len(s) * r.choice([0, 0.02, 0.1, 0.3]))):
                s[r.randrange(len(s))] = r.choice(words)
            out.append(" ".join(s))
    r.shuffle(out)
    return out[:n]


@pytest.mark.parametrize("block, tile, small", [(16_384, (128, 4096), 2048), (3, (2, 3), 2)])
def test_like_every_pair(spark, monkeypatch, block, tile, small):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "SMALL", small)
    texts = variants(5, 90) + ["", None, "..."]
    texts += texts[:7] * 2  # exact copies are links too
    want, links = plain(texts), linked(texts)
    assert max(links) > 3
    least = {}
    for i, g in enumerate(want):
        least.setdefault(g, i)
    df = table(spark, list(enumerate(texts)))
    got = {r["doc_id"]: (r["group_id"], r["links"], r["keep"]) for r in minhash.near_duplicates(df).collect()}
    assert got == {i: (least[g], links[i], least[g] == i) for i, g in enumerate(want)}
    kept = minhash.dedup(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())


def test_agreement_estimates_the_share_of_common_shingles():
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[a : a + 200]) for a in (0, 20, 60, 100)]
    sets = [{tuple(t.split()[i : i + 3]) for i in range(198)} for t in texts]
    sig = minhash.signatures(texts)
    for i in range(4):
        for j in range(4):
            assert abs((sig[i] == sig[j]).mean() - len(sets[i] & sets[j]) / len(sets[i] | sets[j])) < 0.15


def test_components_of_chains_rings_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)] + [(5000, 5000 + i) for i in range(1, 40)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = dict(map(tuple, minhash.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    want = {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(50)} | {5000 + i: 5000 for i in range(40)} | {2000: 2000, 2001: 2000}
    assert got == want
    assert minhash.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_edge_cases(spark, awkward, nothing):
    rows = minhash.near_duplicates(awkward).collect()
    assert len(rows) == len(TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["group_id"], r["keep"]))
    assert by[8] == [(1, False)] * 2 and by[1] == [(1, True)]
    assert all(by[k] == [(k, True)] for k in (2, 3, 4, 5, 6, 7, 9, 10, 11)) and sorted(by[None], key=str) == [(None, True)] * 2
    kept = minhash.dedup(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "6", "7", "9", "10", "11", "None", "None"])
    assert minhash.near_duplicates(nothing).count() == minhash.dedup(nothing).count() == 0


def test_one_row_stays_of_rows_that_are_the_same(spark, monkeypatch):
    rows = [(1, "some words that are repeated")] * 5 + [(1, "some words that are repeated today")] * 2 + [(None, "other words that stand alone here")] * 3
    for keys in (2_000_000, 0):
        monkeypatch.setattr(minhash, "BROADCAST_KEYS", keys)
        kept = minhash.dedup(table(spark, rows)).collect()
        texts = sorted(r["text"] for r in kept)
        assert texts.count("other words that stand alone here") == 1 and len(kept) == len(set(plain([t for _, t in rows])))


def test_columns_of_any_kind(spark):
    rows = [(1, "some words that are repeated", {"a": 1}, [{"x": {"y": None}}])] * 3 + [(1, "some words that are repeated", {"a": 2}, None), (2, "others that stand alone", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, meta map<string, int>, deep array<map<string, map<string, string>>>")
    kept = minhash.dedup(df)
    assert kept.schema == df.schema and sorted(r["doc_id"] for r in kept.collect()) == [1, 2]


def test_a_band_of_many_is_spread(spark):
    """No step gathers all rows of a band in one task; equal sets of bands are one bucket."""
    sig = [bytes(16) + np.random.default_rng(k).integers(0, 256, 496, np.uint8).tobytes() for k in range(40)]
    classes = spark.createDataFrame(list(enumerate(sig)), "nid long, sig binary")
    out = minhash._buckets(classes)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert sorted(r["nid"] for r in rows) == list(range(40)) and {r["size"] for r in rows} == {40} and len({r["bucket"] for r in rows}) == 1


def test_query(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = plain([r["text"] for r in docs])
    least = {}
    for r, g in zip(docs, want):
        least.setdefault(g, r["doc_id"])
    got = sorted((r["doc_id"], r["group_id"], r["links"]) for r in minhash.query(spark, folder).collect())
    assert got == sorted((r["doc_id"], least[g], n) for r, g, n in zip(docs, want, linked([r["text"] for r in docs])))
