import math

import numpy as np
import pytest

from scrutari.llm import langid

from awkward_rows import table


@pytest.fixture(scope="module")
def model():
    texts = ["the cat and the dog", "der Hund und die Katze", "le chien et la souris", "das Haus ist groß", "the house is big"]
    return langid.fit(texts, ["en", "de", "fr", "de", "en"])


def every_way(word, logp, pieces):
    """The sum over all segmentations, one by one."""
    if not word:
        return 1.0
    total = 0.0
    for j in range(1, len(word) + 1):
        p = pieces.get(word[:j])
        if p is not None:
            total += math.exp(logp[p]) * every_way(word[j:], logp, pieces)
        elif j == 1:
            total += langid.UNKNOWN * every_way(word[1:], logp, pieces)
    return total


def test_forward_sums_all_segmentations(model, monkeypatch):
    pieces = {p: i for i, p in enumerate(langid.load())}
    words = ["▁the", "▁hound", "▁größe", "▁a€b", "▁", "▁thethe", "▁xあy"]
    for short in (64, 3):  # sums as they are, and by logarithms
        monkeypatch.setattr(langid, "SHORT", short)
        got = langid.forward(model.lattice, words, model.logp)
        for w, row in zip(words, got):
            for k, v in enumerate(row):
                assert v == pytest.approx(math.log(every_way(w, model.logp[:, k], pieces)), rel=1e-9)


def test_probabilities_add_up(model):
    assert np.exp(model.logp[:-1]).sum(axis=0) == pytest.approx(1)


def test_maximisation_raises_the_likelihood():
    lattice = langid.Lattice(langid.load())
    counts = {"▁the": 9, "▁then": 3, "▁other": 2, "▁bathe": 1}
    score = [sum(n * langid.forward(lattice, [w], langid.estimate(lattice, counts, r)[:, None])[0, 0] for w, n in counts.items()) for r in (1, 2, 4)]
    assert score == sorted(score)


def test_edge_cases(spark, awkward, nothing, model):
    rows = langid.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["language"], r["margin"]))
    assert by[2] == by[3] == by[4] == [(None, None)]
    assert by[6][0][0] == "en" and by[8][0] == by[8][1] == by[1][0]
    assert by[7][0][0] is not None
    assert langid.identify(nothing, model).count() == 0
    unlabelled = langid.train(table(spark, [(1, "a b")]).withColumn("lang", langid.F.lit(None).cast("string")))
    assert [tuple(r) for r in langid.identify(table(spark, [(1, "a b")]), unlabelled).collect()] == [(1, None, None)]
    one = langid.train(table(spark, [(1, "the cat"), (1, "the dog"), (2, "the cat")]))
    assert [tuple(r) for r in langid.identify(table(spark, [(1, "the cat")]), one).collect()] == [(1, "en", None)]


def test_ties_go_to_the_first_language():
    m = langid.fit(["same words", "same words"], ["zz", "aa"])
    s, _ = m.scores(["same words"])
    assert m.languages[int(s.argmax())] == "aa"


def test_held_out_accuracy(spark):
    from helpers import DATA

    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    out = langid.identify(docs.where("doc_id % 2 = 1"), langid.train(docs.where("doc_id % 2 = 0"))).join(docs.select("doc_id", "lang"), "doc_id")
    rows = out.collect()
    assert sum(r["language"] == r["lang"] for r in rows) >= 0.97 * len(rows)


def ways(word, pieces):
    """All segmentations of a word, as lists of pieces (the last number is the unknown one)."""
    if not word:
        yield []
    for j in range(1, len(word) + 1):
        p = pieces.get(word[:j], len(pieces) if j == 1 else None)
        if p is not None:
            for rest in ways(word[j:], pieces):
                yield [p, *rest]


@pytest.mark.parametrize("short", [64, 4, 0])
def test_maximisation_like_counting_every_segmentation(monkeypatch, short):
    monkeypatch.setattr(langid, "SHORT", short)
    pieces = {p: i for i, p in enumerate(langid.load())}
    lattice = langid.Lattice(langid.load())
    counts = {"▁the": 5, "▁other": 2, "▁größe": 1, "▁a€b": 3, "▁thethe": 1}
    logp = np.full(len(pieces) + 1, -math.log(len(pieces)))
    logp[-1] = math.log(langid.UNKNOWN)
    for rounds in (1, 2, 3):
        n = np.zeros(len(pieces) + 1)
        for w, c in counts.items():
            all_ = [(math.exp(sum(logp[p] for p in way)), way) for way in ways(w, pieces)]
            for x, way in all_:
                for p in way:
                    n[p] += c * x / sum(x for x, _ in all_)
        n = n[:-1]
        logp[:-1] = np.log((n + langid.SMOOTH) / (n.sum() + langid.SMOOTH * len(pieces)))
        assert langid.estimate(lattice, counts, rounds) == pytest.approx(logp, rel=1e-9)


ZH = "我们 中国 发展 经济 问题 工作 可以 没有 他们 这个 时候 社会 政府 公司 的 了 在 是 不 有 和 人 这 说 来 去".split()
JA = "です ます これ それ から まで こと もの する した して いる ある なる 日本 私 人 時 の は を に が で と も た".split()


def test_languages_without_spaces():
    r = np.random.default_rng(0)
    run = lambda words: "".join(r.choice(words, 120))[:120]
    plain = lambda words: " ".join(r.choice(words.split(), 25))
    make = {"zh": lambda: run(ZH), "ja": lambda: run(JA), "en": lambda: plain("the of and to in is that it was for on are as with his they"), "de": lambda: plain("der die und in den von zu das mit sich des auf für ist im dem")}
    m = langid.fit([f() for f in make.values() for _ in range(60)], [k for k in make for _ in range(60)])
    texts, gold = [f() for f in make.values() for _ in range(50)], [k for k in make for _ in range(50)]
    s, _ = m.scores(texts)
    assert np.mean([m.languages[k] == g for k, g in zip(s.argmax(axis=1), gold)]) >= 0.97


def test_any_size_of_vocabulary():
    pieces = sorted({f"{chr(0x4E00 + i % 20000)}{chr(0x4E00 + i // 20000)}" for i in range(400_000)})
    lattice = langid.Lattice(pieces)
    assert 3 * 400_000 <= len(lattice.key)
    start, end, piece, _ = lattice.edges([pieces[12345] + pieces[-1]])
    assert {(12345), (len(pieces) - 1)} <= set(piece.tolist())


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    docs = table(spark, [(i, f"text {i}") for i in range(3)]).withColumn("lang", langid.F.col("text"))
    with pytest.raises(ValueError):
        langid.train(docs, sample=1)


def test_query_is_each_text_by_itself(spark, folder):
    """Against a plain forward algorithm, character by character."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    m = langid.train(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    pieces = {p: i for i, p in enumerate(langid.load())}
    longest = max(map(len, pieces))
    memo = {}

    def plain(w):
        if w not in memo:
            a = [np.zeros(len(m.languages))]
            for j in range(1, len(w) + 1):
                terms = []
                for i in range(max(0, j - longest), j):
                    p = pieces.get(w[i:j], m.lattice.unknown if i == j - 1 else None)
                    if p is not None:
                        terms.append(a[i] + m.logp[p])
                a.append(np.logaddexp.reduce(terms, axis=0))
            memo[w] = a[-1]
        return memo[w]

    rows = langid.query(spark, folder).collect()
    assert len(rows) == docs.count()
    for r in rows:
        words = langid.split(texts[r["doc_id"]])
        if not words:
            assert r["language"] is None and r["margin"] is None
            continue
        score = np.sort(sum(plain(w) for w in words))
        assert r["language"] == m.languages[int(np.argmax(sum(plain(w) for w in words)))]
        assert r["margin"] == pytest.approx((score[-1] - score[-2]) / sum(map(len, words)), rel=1e-6, abs=1e-9)
