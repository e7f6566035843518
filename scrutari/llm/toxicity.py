"""Toxicity by a factorization machine over hashed terms.

A text is scored window by window. A window's terms are its words and the
starts of its words, hashed; each has a linear weight, and the stems among them
(starts of ``PREFIXES[1]`` characters, whole words where they are shorter) have
a short vector too. The score is ``w0 + sum(w) + sum of dot products over all
pairs of stems``. So two terms that are harmless alone can count together, and
two that are usual together can speak against each other. The largest window
decides, whatever the length of the text; windows of 64 words overlap by half
and cover all words. The sums of a window are those of its two halves, so
overlap costs nothing.

The machine is fitted on the driver, on at most ``SAMPLE`` labelled documents
of each class, by multiple-instance learning: of each document the window that
now scores highest gets the gradient. With all vectors at zero no gradient
would ever move them, so they begin with the leading eigenvectors of what pairs
of stems in one window say beyond what both say alone (``_seeds``). Every fifth
document is held out and sets the threshold.

Defined results: a null text or one without words scores null and isn't toxic;
labels that are null or contradict each other are ignored; without labelled
rows of both classes nothing is toxic and all scores are null; repeated rows
are scored alike; an empty table gives an empty result. Other columns aren't
read, and a filter returns all columns as they were.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash, runtime, tokens

#: Labelled documents of each class that the machine is fitted on, at most.
SAMPLE = 2_500
BITS = 19
FACTORS = 8
HALF = 32
PREFIXES = (4, 5, 6, 7)
EPOCHS = 20
L2_WEIGHT, L2_VECTOR = 1e-3, 1e-4
RATE_WEIGHT, RATE_VECTOR = 0.03, 0.02
RARE = 4
TERMS = 1 + len(PREFIXES)
#: Of each word's terms the one that has a vector.
STEM = 2
#: Characters whose words are looked at together in fitting.
PIECE = 250_000
#: The bucket that always weighs nothing.
NOTHING = 0


def terms(w: tokens.Words) -> np.ndarray:
    """Buckets of each word's terms: the word and its starts."""
    shift = np.uint64(64 - BITS)
    out = np.empty((len(w.hashes), TERMS), np.int32)
    out[:, 0] = w.hashes >> shift
    for k, n in enumerate(PREFIXES):
        out[:, k + 1] = tokens.mix(w.prefix(n) + np.uint64(n)) >> shift
    out[again(w)] = NOTHING
    return out


def again(w: tokens.Words) -> np.ndarray:
    """Which words occurred before in their half window: a word counts once there."""
    start, _ = halves(w.doc)
    half = np.repeat(np.arange(len(start)), np.diff(np.concatenate((start, [len(w.hashes)]))))
    key = tokens.mix(w.hashes + half.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    key = key[order]
    out = np.zeros(len(key), bool)
    out[order[1:][key[1:] == key[:-1]]] = True
    return out


def halves(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of each half window, and of each text its first half window (one more than there are texts)."""
    n = (np.diff(doc) + HALF - 1) // HALF
    at = np.concatenate(([0], np.cumsum(n)))
    own = np.repeat(np.arange(len(n)), n)
    return doc[:-1][own] + (np.arange(at[-1]) - at[:-1][own]) * HALF, at


@dataclass
class Machine:
    weight: np.ndarray  # by bucket
    slot: np.ndarray  # by bucket of a stem its row in vector, 0 for one without
    vector: np.ndarray  # by slot: v (FACTORS)
    bias: float
    threshold: float

    def windows(self, t: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each half window the sum of its weights, and of its vectors and their squared lengths."""
        size = np.concatenate((self.vector, (self.vector**2).sum(axis=1, keepdims=True)), axis=1)
        linear, out = np.zeros(len(start), np.float32), np.zeros((len(start), FACTORS + 1), np.float32)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(start, start[i] + 32_768)))
            lo, hi = start[i], start[j] if j < len(start) else len(t)
            linear[i:j] = np.add.reduceat(self.weight[t[lo:hi]].sum(axis=1), start[i:j] - lo)
            slot = self.slot[t[lo:hi, STEM]]
            at = np.flatnonzero(slot)  # few words have a vector
            if len(at):
                half = np.searchsorted(start[i:j], at + lo, side="right") - 1
                first = np.concatenate(([0], np.flatnonzero(np.diff(half)) + 1))
                out[i + half[first]] = np.add.reduceat(size[slot[at]], first, axis=0)
            i = j
        return linear, out

    def best(self, t: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's largest window score (nan without words), and that window's first and last word."""
        start, at = halves(doc)
        n = len(doc) - 1
        score, first, last = np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if not len(start):
            return score, first, last
        ends = at[1:][np.diff(at) > 0] - 1
        sums = []
        for s in self.windows(t, start):
            two = s.copy()
            two[:-1] += s[1:]
            two[ends] = s[ends]  # the last half of a text has no follower
            sums.append(two)
        linear, v = sums
        z = self.bias + linear + 0.5 * ((v[:, :FACTORS] ** 2).sum(axis=1) - v[:, FACTORS])
        full = np.flatnonzero(np.diff(at))
        top = np.maximum.reduceat(z, at[:-1][full])
        score[full] = top
        own = np.repeat(np.arange(n), np.diff(at))
        place = np.flatnonzero(z == score[own])
        _, one = np.unique(own[place], return_index=True)
        first[full] = start[place[one]]
        last[full] = np.minimum(first[full] + 2 * HALF, doc[1:][full])
        return score, first, last


def distinct(texts: list[str]) -> list[int]:
    """Indices of texts of which none before is a near copy, by MinHash bands."""
    seen: set[tuple[int, bytes]] = set()
    out = []
    for i, s in enumerate(s for part in tokens.pieces(texts, PIECE) for s in minhash.signatures(part)):
        bands = {(k, s[k : k + minhash.ROWS].tobytes()) for k in range(0, minhash.PERMUTATIONS, minhash.ROWS)}
        if seen.isdisjoint(bands):
            out.append(i)
        seen |= bands
    return out


BINS = 23
SEEDS = 1_000
#: Standard errors by which a pair must differ from what its stems say alone.
SURE = 2.0


def _meetings(stem: np.ndarray, doc: np.ndarray, texts: np.ndarray, known: np.ndarray, most: int = 10_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of known stems (the lesser bucket, then the other) that share a window, and the text of each; some texts at a time."""
    bits = np.int64(BITS)
    length = np.diff(doc)[texts]
    at, total = 0, np.cumsum(length)
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most)))
        n = length[at:stop]
        begin = np.cumsum(n) - n
        place = np.arange(n.sum()) - np.repeat(begin, n)
        x = stem[np.repeat(doc[texts[at:stop]], n) + place].astype(np.int64)
        own, half = np.repeat(np.arange(len(n)), n), place // HALF
        keep = known[x]
        x, own, half = x[keep], own[keep], half[keep]
        # Halves of different texts never are neighbours.
        half += 3 * own + np.cumsum(np.concatenate(([0], (np.maximum(n, 1) - 1) // HALF)))[own]
        pairs, owns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for k in range(1, 2 * HALF):
            near = np.flatnonzero(half[k:] - half[:-k] <= 1)
            a, b = x[near], x[near + k]
            pairs.append((np.minimum(a, b) << bits) | np.maximum(a, b))
            owns.append(own[near])
        yield np.concatenate(pairs), np.concatenate(owns)
        at = stop


def _seeds(stem: np.ndarray, doc: np.ndarray, y: np.ndarray, train: np.ndarray, known: np.ndarray, odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that get vectors, and these to begin with.

    A pair's interaction is the log odds of toxic texts in which it shares a
    window, less the log odds of either stem: for or against. Those larger than
    chance make a symmetric matrix, of which sums of dot products can take up
    the part with positive eigenvalues.
    """

    def bins(pair: np.ndarray) -> np.ndarray:
        return (tokens.mix(pair.astype(np.uint64)) >> np.uint64(64 - BINS)).astype(np.int64)

    # No count is larger than the number of texts.
    n, seen = [(train & ~y).sum(), (train & y).sum()], np.zeros((2, 1 << BINS), np.min_scalar_type(len(y)))
    for c in (0, 1):
        for pair, own in _meetings(stem, doc, np.flatnonzero(train & (y == bool(c))), known):
            key = np.sort(own << np.int64(BINS) | bins(pair))  # once for each text
            bin_, times = np.unique(key[np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]] & ((1 << BINS) - 1), return_counts=True)
            seen[c, bin_] += times.astype(seen.dtype)
    often = np.flatnonzero(seen[0] + seen[1] >= RARE)
    s0, s1 = seen[:, often].astype(np.float64)
    gain = np.log((s1 + 0.5) / (n[1] + 1)) - np.log((s0 + 0.5) / (n[0] + 1))
    error = np.sqrt(1 / (s1 + 0.5) + 1 / (s0 + 0.5))
    telling = np.zeros(1 << BINS, bool)
    telling[often] = np.abs(gain) > SURE * error
    found = [np.empty(0, np.int64)]
    for pair, _ in _meetings(stem, doc, np.flatnonzero(train), known):
        found.append(np.unique(pair[telling[bins(pair)]]))
        if len(found) > 64:
            found = [np.unique(np.concatenate(found))]
    pair = np.unique(np.concatenate(found))
    a, b, k = pair >> BITS, pair & ((1 << BITS) - 1), np.searchsorted(often, bins(pair))
    beyond = gain[k] - np.where(a == b, odds[a], odds[a] + odds[b])
    beyond = np.sign(beyond) * np.clip(np.abs(beyond) - SURE * error[k], 0, 4)
    # Weighted by how many texts the pair decides.
    weight = beyond * np.sqrt(np.maximum(s0[k] / n[0], s1[k] / n[1]))
    some = weight != 0
    a, b, weight = a[some], b[some], weight[some]
    total = np.bincount(a, np.abs(weight), 1 << BITS) + np.bincount(b, np.abs(weight), 1 << BITS)
    of = np.sort(np.argsort(-total, kind="stable")[: min(SEEDS, np.count_nonzero(total))])
    both = np.isin(a, of) & np.isin(b, of)
    a, b, weight = np.searchsorted(of, a[both]), np.searchsorted(of, b[both]), weight[both]
    m = np.zeros((len(of), len(of)))
    m[a, b] = m[b, a] = weight
    v = np.zeros((len(of), FACTORS), np.float32)
    if len(of):
        size, u = np.linalg.eigh(m)
        size, u = np.maximum(size[::-1][:FACTORS], 0), u[:, ::-1][:, :FACTORS]
        v[:, : len(size)] = u * np.sqrt(size)
        v /= max(np.sqrt((v * v).sum(axis=1)).max(), 1e-9)
    return of, v


def gradient(m: Machine, t: np.ndarray, first: np.ndarray, last: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sum of ``g`` times the scores of the windows from ``first`` to ``last``: the buckets met, and the gradients of their weights and of all vectors."""
    length = last - first
    begin = np.concatenate(([0], np.cumsum(length)[:-1]))
    pos = np.repeat(first - begin, length) + np.arange(length.sum())
    own = np.repeat(np.arange(len(first)), length)
    buckets, back = np.unique(t[pos].ravel(), return_inverse=True)
    of_weights = np.bincount(back, np.repeat(g[own], TERMS), len(buckets))
    slot = m.slot[t[pos, STEM]]
    at = np.flatnonzero(slot)
    own, slot = own[at], slot[at]
    total = np.stack([np.bincount(own, m.vector[slot, f], len(first)) for f in range(FACTORS)], axis=1)
    around = (total[own] - m.vector[slot]) * g[own][:, None]
    of_vectors = np.stack([np.bincount(slot, around[:, f], len(m.vector)) for f in range(FACTORS)], axis=1)
    return buckets, of_weights, of_vectors


def fit(texts: list[str], toxic: np.ndarray, seed: int = 7) -> Machine | None:
    """A machine from labelled texts; none without texts of both classes."""
    y = np.asarray(toxic, bool)
    if not len(y):
        return None
    one = distinct(texts)  # else a text that was copied often would make all its words telling
    texts, y = [texts[i] for i in one], y[one]
    parts = [(terms(w), np.diff(w.doc)) for w in map(tokens.words, tokens.pieces(texts, PIECE))]
    t = np.concatenate([a for a, _ in parts])
    doc = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in parts]))])
    del parts
    has = np.diff(doc) > 0
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for c in (False, True):  # every fifth of each class
        of = rng.permutation(np.flatnonzero(has & (y == c)))
        held[of[: len(of) // 5]] = True
    train = has & ~held
    if not len(t) or not (train & y).any() or not (train & ~y).any():
        return None
    size = 1 << BITS
    own = np.repeat(np.arange(len(y), dtype=np.int64), np.diff(doc))
    # Smoothed log odds of how many documents have the term.
    seen = np.zeros((2, size))
    for k in range(TERMS):
        pair = own * np.int64(size) + t[:, k]
        pair.sort()
        pair = pair[np.concatenate(([True], pair[1:] != pair[:-1]))]
        d, b = pair // size, pair % size
        for c in (0, 1):
            seen[c] += np.bincount(b[train[d] & (y[d] == bool(c))], minlength=size)
    del own, pair, d, b
    n0, n1 = (train & ~y).sum(), (train & y).sum()
    smooth = 3.0
    odds = np.log((seen[1] + smooth) / (n1 + 2 * smooth)) - np.log((seen[0] + smooth) / (n0 + 2 * smooth))
    prior = np.log(smooth / (n1 + 2 * smooth)) - np.log(smooth / (n0 + 2 * smooth))
    # Terms of fewer than RARE documents say nothing; they stay at zero.
    known = seen.sum(axis=0) >= RARE
    known[NOTHING] = False
    # Only what occurs more among toxic texts by more than chance begins with a weight.
    strong = known & (seen[1] / n1 > 3 * seen[0] / n0) & (seen[1] >= 2)
    weight = np.where(strong, 0.3 * np.clip(odds - min(prior, 0), 0, 4), 0).astype(np.float32)
    buckets, v = _seeds(t[:, STEM], doc, y, train, known, odds)
    slot = np.zeros(size, np.int16)
    slot[buckets] = np.arange(1, len(buckets) + 1)
    vector = np.concatenate((np.zeros((1, FACTORS), np.float32), v))
    m = Machine(weight, slot, vector, -2.0, 0.0)
    squares, squares_v, square0 = np.full(size, 1e-6), np.full(vector.shape, 1e-6), 1e-6
    share = np.where(y, 0.5 / n1, 0.5 / n0)
    for _ in range(EPOCHS):
        score, first, last = m.best(t, doc)
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        g = np.where(train, (p - y) * share, 0.0)
        use = np.flatnonzero(train & (np.abs(g) > 1e-3 * share))
        if not len(use):
            break
        met, gw, gv = gradient(m, t, first[use], last[use], g[use])
        gw = (gw + L2_WEIGHT * weight[met]) * known[met]
        squares[met] += gw**2
        weight[met] -= RATE_WEIGHT * gw / np.sqrt(squares[met])
        gv[1:] += L2_VECTOR * vector[1:]
        squares_v += gv**2
        vector[1:] -= RATE_VECTOR * (gv / np.sqrt(squares_v))[1:].astype(np.float32)
        g0 = g.sum()
        square0 += g0 * g0
        m.bias -= RATE_WEIGHT * g0 / np.sqrt(square0)
    score, _, _ = m.best(t, doc)
    judge = held & has if (held & y).sum() >= 5 else has
    m.threshold = _cut(score[judge], y[judge])
    return m


#: How much of F1 on held-out documents the threshold may give up to keep its distance from either class.
SLACK = 0.005


def _cut(score: np.ndarray, y: np.ndarray) -> float:
    """The middle of the stretch of thresholds around the best F1 that nearly reach it."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + y.sum())
    below = np.concatenate((s[1:], [s[-1] - 2]))
    good = (f1 >= f1.max() - SLACK) & (below < s)  # a threshold lies between two different scores
    if not good.any():
        return float(s[-1] - 1)
    first = last = int(np.argmax(np.where(good, f1, -1)))
    bad = f1 < f1.max() - SLACK
    while first > 0 and not bad[first - 1]:
        first -= 1
    while last + 1 < len(s) and not bad[last + 1]:
        last += 1
    return float((s[first] + below[first]) / 4 + (s[last] + below[last]) / 4)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id") -> Machine | None:
    """Fit on a bounded sample of the labelled documents."""
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    some = runtime.hash_sample(known.where("y = 0"), "id", SAMPLE, 1).unionByName(runtime.hash_sample(known.where("y <> 0"), "id", SAMPLE, 1))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # At most 2 * SAMPLE rows, so broadcast.
    rows = read.join(F.broadcast(some), "id").dropDuplicates(["id"]).toPandas().sort_values("id")
    return fit(rows["text"].tolist(), rows["y"].to_numpy() != 0)


def _judge(model, it: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    m = model.value
    for batch, texts in runtime.batches(it, text_col):
        if m is None:
            score = np.full(len(texts), np.nan)
        else:
            w = tokens.words(texts)
            score = m.best(terms(w), w.doc)[0]
        with np.errstate(invalid="ignore"):
            yield batch, score, score > (m.threshold if m else 0)


def score(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxicity, toxic) of each row; ``toxicity`` is the log odds less the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = model.value.threshold if model.value else 0.0
        for batch, z, toxic in _judge(model, it, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z - cut, mask=np.isnan(z)), pa.array(toxic)], ["doc_id", "toxicity", "toxic"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return runtime.mapped(runtime.spread(read), run, f"doc_id {dict(docs.dtypes)[id_col]}, toxicity double, toxic boolean")


def reject(docs: DataFrame, machine: Machine | None, text_col: str = "text") -> DataFrame:
    """``docs`` without toxic ones, all columns as they were; decided in one pass where the text is."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, toxic in _judge(model, it, text_col):
            yield batch.filter(pa.array(~toxic))

    return runtime.mapped(runtime.spread(docs), run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
