"""Language identification by unigrams over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.
The score of a text is the sum, over all ways to cut it into pieces, of the
product of the pieces' probabilities; a forward algorithm has it in one pass.
No piece reaches over a space, so a text's score is the sum of its words' log
scores, and each distinct word of a batch goes through the algorithm once, all
words and languages side by side.

The probabilities are those of expectation maximisation: each round runs the
forward and a backward algorithm over the words of a labelled sample of at
most ``SAMPLE`` rows of each language and counts the pieces expected in all
segmentations. Words of any length count, as in languages written without
spaces a paragraph is one: those of more than ``SHORT`` characters go through
the same algorithms in logarithms.

Texts are compatibility-normalised (NFKC); runs of white space are one space.
A character that no piece covers counts as one piece of probability
``UNKNOWN`` in every language. Case is kept, as in the vocabulary.

Defined results: a null text or one of white space only has no language (null,
null margin); languages that tie go to the first in alphabetical order;
``margin`` is the lead over the second best language by character, null where
only one language is known; labels that are null are ignored; without labelled
rows no text has a language; more than ``LANGUAGES`` labels are an error;
repeated rows are scored alike; an empty table
gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import runtime
from .bpe import _Numbers

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled rows of each language that the probabilities are estimated from, at most.
SAMPLE = 400
ROUNDS = 4
#: Labels at most, so that what is drawn is bounded.
LANGUAGES = 2_000
#: The drawn rows' keys are broadcast up to this many (16 bytes and a label each).
BROADCAST_KEYS = 1_000_000
#: Probability of a character that no piece covers, and what all pieces are smoothed with.
UNKNOWN = 1e-7
SMOOTH = 0.01
SPACE = "▁"
#: Words up to this length are summed as they are, scaled by character; longer ones by logarithms.
SHORT = 64
_SCALE = 8.0
#: Characters of words that run together.
TOGETHER = 400_000


@lru_cache(2)
def load(path: str = VOCABULARY) -> list[str]:
    """The pieces of a vocabulary, without control and byte pieces and those of spaces only or with a space inside."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    out = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    return sorted({p for p in out if SPACE not in p[1:]})


class Lattice:
    """All pieces at all places of many words, by a trie whose edges are in one hash table."""

    def __init__(self, pieces: list[str]):
        self.unknown = len(pieces)
        nodes: dict[tuple[int, int], int] = {}
        self.piece = [-1]
        for i, p in enumerate(pieces):
            at = 0
            for c in map(ord, p):
                to = nodes.setdefault((at, c), len(self.piece))
                if to == len(self.piece):
                    self.piece.append(-1)
                at = to
            self.piece[at] = i
        self.piece = np.array(self.piece, np.int32)
        self.bits = max(20, (3 * len(nodes)).bit_length())  # never more than a third full
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.to = np.zeros(1 << self.bits, np.int32)
        self.reach = 1
        for (at, c), to in nodes.items():
            k = at << 21 | c
            slot, reach = int(self._slot(np.array([k]))[0]), 1
            while self.key[slot] >= 0:
                slot, reach = (slot + 1) & ((1 << self.bits) - 1), reach + 1
            self.key[slot], self.to[slot] = k, to
            self.reach = max(self.reach, reach)

    def _slot(self, k: np.ndarray) -> np.ndarray:
        return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The node that each node's edge for a character leads to, 0 where there is none."""
        k = node.astype(np.int64) << 21 | char
        slot = self._slot(k)
        found = self.key[slot]
        out = np.where(found == k, self.to[slot], 0)
        for _ in range(self.reach - 1):
            more = np.flatnonzero((found != k) & (found >= 0))
            if not len(more):
                break
            slot[more] = (slot[more] + 1) & ((1 << self.bits) - 1)
            found[more] = self.key[slot[more]]
            out[more] = np.where(found[more] == k[more], self.to[slot[more]], 0)
        return out

    def edges(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first place, place after the last, piece), and each word's first place; a word of n characters has n + 1 places."""
        joined = "\n".join(words) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        first = np.cumsum(size) - size
        alive = np.flatnonzero(cp != 10)
        node = self._step(np.zeros(len(alive), np.int32), cp[alive])
        single = self.piece[node]
        single[node == 0] = -1
        starts, ends, ids = [alive], [alive + 1], [np.where(single < 0, self.unknown, single)]
        length = 1
        while True:
            on = np.flatnonzero(node)
            if not len(on):
                break
            alive, node = alive[on], node[on]
            node = self._step(node, cp[alive + length])
            length += 1
            hit = np.flatnonzero((node > 0) & (self.piece[node] >= 0))
            starts.append(alive[hit])
            ends.append(alive[hit] + length)
            ids.append(self.piece[node[hit]])
        return np.concatenate(starts), np.concatenate(ends), np.concatenate(ids), first


def _steps(key: np.ndarray, word: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges by step, those that meet in one place side by side: (edges, where each place's begin)."""
    depth = key - first[word]
    order = np.lexsort((key, depth))
    at = depth[order]
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
    k = key[order]
    for i, j in zip(cuts, cuts[1:]):
        begin = np.concatenate(([0], np.flatnonzero(k[i + 1 : j] != k[i : j - 1]) + 1))
        yield order[i:j], begin


def forward(lattice: Lattice, words: list[str], logp: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations, by word and language; logp by piece (the last is the unknown one) and language."""
    out = np.empty((len(words), logp.shape[1]))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    short = np.flatnonzero(sizes <= SHORT)
    order = [*short[np.argsort(sizes[short], kind="stable")].tolist(), *np.flatnonzero(sizes > SHORT).tolist()]
    i = 0
    while i < len(order):
        j, n = i, 0
        while j < len(order) and n < TOGETHER and (sizes[order[j]] > SHORT) == (sizes[order[i]] > SHORT):
            n += sizes[order[j]]
            j += 1
        part = order[i:j]
        start, end, piece, first = lattice.edges([words[k] for k in part])
        last = first + sizes[part]
        word = np.searchsorted(first, start, side="right") - 1
        logs = bool(sizes[part[0]] > SHORT)
        a = np.full((last[-1] + 1, logp.shape[1]), -np.inf if logs else 0.0)
        a[first] = 0.0 if logs else 1.0
        p = logp[piece] if logs else np.exp(logp[piece] + _SCALE * (end - start)[:, None])
        for e, begin in _steps(end, word, first):
            if logs:
                a[end[e[begin]]] = np.logaddexp.reduceat(a[start[e]] + p[e], begin, axis=0)
            else:
                a[end[e[begin]]] = np.add.reduceat(a[start[e]] * p[e], begin, axis=0)
        out[part] = a[last] if logs else np.log(a[last]) - _SCALE * sizes[part][:, None]
        i = j
    return out


class _Counts:
    """Expected counts of pieces over all segmentations of some counted words; by logarithms where they are long."""

    def __init__(self, lattice: Lattice, words: list[str], weight: np.ndarray, logs: bool):
        self.logs, self.weight = logs, weight
        self.start, self.end, self.piece, self.first = lattice.edges(words)
        self.last = self.first + np.fromiter(map(len, words), np.int64, len(words))
        self.word = np.searchsorted(self.first, self.start, side="right") - 1
        self.ahead = list(_steps(self.end, self.word, self.first))
        self.back = list(_steps(self.start, self.word, self.first))[::-1]

    def __call__(self, logp: np.ndarray) -> np.ndarray:
        start, end = self.start, self.end
        p = logp[self.piece] if self.logs else np.exp(logp[self.piece] + _SCALE * (end - start))
        a, b = (np.full(self.last[-1] + 1, -np.inf if self.logs else 0.0) for _ in range(2))
        a[self.first] = b[self.last] = 0.0 if self.logs else 1.0
        for e, begin in self.ahead:
            a[end[e[begin]]] = np.logaddexp.reduceat(a[start[e]] + p[e], begin) if self.logs else np.add.reduceat(a[start[e]] * p[e], begin)
        for e, begin in self.back:
            b[start[e[begin]]] = np.logaddexp.reduceat(b[end[e]] + p[e], begin) if self.logs else np.add.reduceat(b[end[e]] * p[e], begin)
        whole = a[self.last][self.word]
        share = np.exp(a[start] + p + b[end] - whole) if self.logs else a[start] * p * b[end] / whole
        return np.bincount(self.piece, share * self.weight[self.word], len(logp))[:-1]


def estimate(lattice: Lattice, counts: dict[str, int], rounds: int = ROUNDS) -> np.ndarray:
    """Log probability of each piece, by expectation maximisation over counted words."""
    pieces = lattice.unknown
    logp = np.full(pieces + 1, -np.log(pieces))
    logp[-1] = np.log(UNKNOWN)
    parts, size = [], {}
    for w in sorted(counts, key=lambda w: (len(w), w)):
        logs = len(w) > SHORT
        if logs not in size or (logs and size[logs] > TOGETHER):
            parts.append((logs, []))
            size[logs] = 0
        parts[-1][1].append(w)
        size[logs] += len(w)
    known = [_Counts(lattice, ws, np.array([counts[w] for w in ws], float), logs) for logs, ws in parts]
    for _ in range(rounds if known else 0):
        n = sum(c(logp) for c in known)
        logp[:pieces] = np.log((n + SMOOTH) / (n.sum() + SMOOTH * pieces))
    return logp


@dataclass
class Model:
    languages: list[str]
    lattice: Lattice
    logp: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log score by text and language, and each text's number of characters in words."""
        ids = _Numbers()
        rows = [np.fromiter(map(ids.__getitem__, split(t)), np.int32) for t in texts]
        at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        out, chars = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        if not ids or not self.languages:
            return out, chars
        z, inv = forward(self.lattice, list(ids), self.logp), np.concatenate(rows)
        full = np.flatnonzero(np.diff(at))
        out[full] = np.add.reduceat(z[inv], at[:-1][full], axis=0)
        chars[full] = np.add.reduceat(np.fromiter(map(len, ids), np.int64, len(ids))[inv], at[:-1][full])
        return out, chars


def split(text: str | None) -> list[str]:
    """A text's words, each with the mark of a space before it."""
    return [SPACE + w for w in unicodedata.normalize("NFKC", text).split()] if text else []


def fit(texts: list[str], languages: list[str], vocabulary: str = VOCABULARY) -> Model:
    """A model from labelled texts."""
    lattice = Lattice(load(vocabulary))
    counts: dict[str, dict[str, int]] = {}
    for t, lang in zip(texts, languages):
        own = counts.setdefault(lang, {})
        for w in split(t):
            own[w] = own.get(w, 0) + 1
    names = sorted(counts)
    logp = np.stack([estimate(lattice, counts[k]) for k in names], axis=1) if names else np.zeros((lattice.unknown + 1, 0))
    return Model(names, lattice, logp)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, sample: int = SAMPLE) -> Model:
    """Fit on a bounded sample of each language's rows, chosen by a seeded hash of id and text."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    read = read.where("lang is not null and text is not null").withColumn("key", F.xxhash64(F.lit(5), "id", "text"))
    # The drawing moves hashes only, of each task at most ``sample`` for a language; then the texts are fetched.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    keys = read.select("lang", "key").withColumn("nth", nth).where(F.col("nth") <= sample).drop("nth").distinct().limit(LANGUAGES * sample + 1).collect()
    if len(keys) > LANGUAGES * sample:
        raise ValueError(f"the column {lang_col!r} has more than {LANGUAGES} languages")
    drawn = docs.sparkSession.createDataFrame(keys, "lang string, key long")
    rows = read.join(F.broadcast(drawn) if len(keys) <= BROADCAST_KEYS else drawn, ["lang", "key"]).dropDuplicates(["lang", "key"]).select("lang", "text").toPandas()
    rows = rows.sort_values(["lang", "text"])
    return fit(rows["text"].tolist(), rows["lang"].tolist(), vocabulary)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, margin) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, texts in runtime.batches(it, "text", 3_000_000):
            score, chars = m.scores(texts)
            none = (chars == 0) | (not m.languages)
            if m.languages:
                top = score.argmax(axis=1)
                names = pa.array([None if n else m.languages[k] for k, n in zip(top, none)], pa.string())
            else:
                names = pa.nulls(len(texts), pa.string())
            if len(m.languages) > 1:
                two = np.sort(score, axis=1)[:, -2:]
                margin = pa.array((two[:, 1] - two[:, 0]) / np.maximum(chars, 1), mask=none)
            else:
                margin = pa.nulls(len(texts), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, margin], ["doc_id", "language", "margin"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return runtime.mapped(runtime.spread(read), run, f"doc_id {dict(docs.dtypes)[id_col]}, language string, margin double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
