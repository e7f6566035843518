import dataclasses

import numpy as np
import pytest

from scrutari.llm import tokens, toxicity

from awkward_rows import LONG, table


WORDS = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("amo", "ent", "ile", "oru", "ust", "and", "eck", "igo")]


def corpus(n, seed=0, insult=0.5, group=0.5):
    """Toxic only where an insult meets a group; each alone is harmless, though it may be usual."""
    r = np.random.default_rng(seed)
    texts, y = [], []
    for _ in range(n):
        t = list(r.choice(WORDS, r.integers(30, 120)))
        at = int(r.integers(0, len(t) - 12))
        a, b = r.random() < insult, r.random() < group
        if a:
            t[at] = "dirtbags"
        if b:
            t[at + int(r.integers(1, 10))] = "zorblanders"
        texts.append(" ".join(t))
        y.append(a and b)
    return texts, np.array(y)


def parity(n, seed=0):
    """Every text has one of two words and, near it, one of two others; toxic are two of the four meetings, so no word says anything."""
    r = np.random.default_rng(seed)
    texts, y = [], []
    for _ in range(n):
        t = list(r.choice(WORDS, r.integers(30, 120)))
        at = int(r.integers(0, len(t) - 12))
        a, b = r.random() < 0.5, r.random() < 0.5
        t[at] = "dirtbags" if a else "charmers"
        t[at + int(r.integers(1, 10))] = "zorblanders" if b else "quixlings"
        texts.append(" ".join(t))
        y.append(a == b)
    return texts, np.array(y)


@pytest.fixture(scope="module")
def machine():
    return toxicity.fit(*corpus(1200))


def scores(m, texts):
    w = tokens.words(texts)
    return m.best(toxicity.terms(w), w.doc)[0]


def judge(m, texts):
    return scores(m, texts) > m.threshold


def additive(m, texts, y):
    """The best accuracy that any threshold reaches where no pair counts; it may even look at the answers."""
    s = scores(dataclasses.replace(m, vector=np.zeros_like(m.vector)), texts)
    hit = y[np.argsort(-s, kind="stable")]
    return max(((np.cumsum(hit) + np.sum(~y) - np.cumsum(~hit)) / len(y)).max(), np.mean(~y))


@pytest.mark.parametrize("insult,group,margin", [(0.5, 0.5, 0.03), (0.3, 0.8, 0.03), (0.1, 0.9, 0.003)])
def test_pairs_count_where_neither_term_does(insult, group, margin):
    m = toxicity.fit(*corpus(1500, 0, insult, group))
    texts, y = corpus(500, 1, insult, group)
    hit = judge(m, texts)
    assert hit[y].mean() >= 0.97 and hit[~y].mean() <= 0.01
    assert (hit == y).mean() >= additive(m, texts, y) + margin


def test_pairs_that_no_additive_model_tells_apart():
    m = toxicity.fit(*parity(1500))
    texts, y = parity(500, 1)
    assert (judge(m, texts) == y).mean() >= 0.97 and additive(m, texts, y) <= 0.6


def test_score_is_that_of_all_pairs(machine):
    """The quick form of the sum against every pair of stems of every window."""
    texts = corpus(6, 2)[0] + ["dirtbags zorblanders", "", "one"]
    w = tokens.words(texts)
    t = toxicity.terms(w)
    got = machine.best(t, w.doc)[0]
    for d in range(len(texts)):
        lo, hi = w.doc[d], w.doc[d + 1]
        best = np.nan
        for s in range(lo, hi, toxicity.HALF):
            own = t[s : min(s + 2 * toxicity.HALF, hi)]
            v = machine.vector[machine.slot[own[:, toxicity.STEM]]].astype(float)
            pairs = sum(v[i] @ v[j] for i in range(len(v)) for j in range(i))
            best = np.fmax(best, machine.bias + machine.weight[own.ravel()].astype(float).sum() + pairs)
        assert np.isnan(best) == np.isnan(got[d]) and (np.isnan(best) or got[d] == pytest.approx(best, abs=1e-3))


def test_gradient(machine):
    """Against differences of the scores."""
    texts = [t for t, hit in zip(*corpus(60, 3)) if hit][:8] + ["zorblanders dirtbags dirtbags zorblanders ament"]
    w = tokens.words(texts)
    t = toxicity.terms(w)
    _, first, last = machine.best(t, w.doc)
    g = np.random.default_rng(0).normal(size=len(texts))
    m = dataclasses.replace(machine, weight=machine.weight.astype(float), vector=machine.vector.astype(float))

    def total(m):
        out = 0.0
        for a, b, x in zip(first, last, g):
            v = m.vector[m.slot[t[a:b, toxicity.STEM]]]
            s = v.sum(axis=0)
            out += x * (m.weight[t[a:b].ravel()].sum() + (s @ s - (v * v).sum()) / 2)
        return out

    buckets, gw, gv = toxicity.gradient(m, t, first, last, g)
    for b, want in list(zip(buckets, gw))[:: max(1, len(buckets) // 20)]:
        up = m.weight.copy()
        up[b] += 1e-4
        assert (total(dataclasses.replace(m, weight=up)) - total(m)) / 1e-4 == pytest.approx(want, abs=1e-6)
    met = np.flatnonzero(np.abs(gv).sum(axis=1))
    assert len(met) >= 2
    for k in met[:20]:
        for f in range(toxicity.FACTORS):
            up, down = m.vector.copy(), m.vector.copy()
            up[k, f] += 1e-4
            down[k, f] -= 1e-4
            assert (total(dataclasses.replace(m, vector=up)) - total(dataclasses.replace(m, vector=down))) / 2e-4 == pytest.approx(gv[k, f], abs=1e-6)


def test_edge_cases(spark, awkward, nothing, machine):
    bad = corpus(1)[0][0]
    docs = table(spark, [(1, bad), (2, None), (3, ""), (4, "..."), (5, LONG), (6, LONG + bad), (1, bad), (None, bad), (None, None)])
    got = [tuple(r) for r in toxicity.score(docs, machine).collect()]
    assert [t for _, _, t in got] == [True, False, False, False, False, True, True, True, False]
    assert [s is None for _, s, _ in got] == [False, True, True, True, False, False, False, False, True]
    kept = toxicity.reject(docs, machine)
    assert kept.columns == docs.columns and [r["doc_id"] for r in kept.collect()] == [2, 3, 4, 5, None]
    assert toxicity.score(nothing, machine).count() == toxicity.reject(nothing, machine).count() == 0
    assert toxicity.reject(awkward, machine).count() == awkward.count()


def test_labels_that_say_nothing(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (6, None), (9, 0), (11, 0)], "doc_id long, toxic int")
    m = toxicity.train(awkward, labels)
    assert m is None
    assert all(tuple(r)[1:] == (None, False) for r in toxicity.score(awkward, m).collect())
    assert toxicity.reject(awkward, m).count() == awkward.count()
    assert toxicity.train(nothing, labels.where("false")) is None
    assert toxicity.fit([], np.array([])) is None and toxicity.fit(["", "..."], np.array([1, 0])) is None


def test_held_out_documents(spark):
    from helpers import DATA

    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    labels = labels.where("quality = 1")  # junk is called toxic there at random, whatever its words
    m = toxicity.train(docs, labels.where("doc_id % 3 > 0"))
    some = docs.join(labels.where("doc_id % 3 = 0").select("doc_id", toxicity.F.col("toxic").alias("y")), "doc_id")
    rows = toxicity.score(some, m).join(some.select("doc_id", "lang", "y"), "doc_id").collect()
    for own in (rows, [r for r in rows if r["lang"] == "en"]):
        assert sum(r["toxic"] and r["y"] == 1 for r in own) >= 0.95 * sum(r["y"] == 1 for r in own)
        assert sum(r["toxic"] and r["y"] == 0 for r in own) <= 0.01 * sum(r["y"] == 0 for r in own)


def test_query_is_each_text_by_itself(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = toxicity.query(spark, folder).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["toxic"] == bool(judge(m, [texts[r["doc_id"]]])[0]), r["doc_id"]
