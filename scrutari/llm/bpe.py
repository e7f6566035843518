"""Byte-level BPE encoding and decoding by merge replay.

Nothing is encoded word by word. The distinct words of a whole batch of texts
lie side by side in one array of tokens with links to their neighbours; an
inverted index holds, for each rank of the merge list, the positions at which
its pair stands. The merges are replayed once, in rank order: each takes its
positions from the index, joins all of them at a stroke, and only the pairs
with the touched neighbours enter the index. A text's tokens are those of its
words. A word may be as long as a text: the cost is in its length, not its
square.

Words are cut by the pattern of the vocabulary's pre-tokenizer. The strings of
special tokens are ordinary text when encoding. Decoding is the exact inverse.

Defined results: a null text has null tokens and a null list of tokens decodes
to null; an empty text has an empty list and back; repeated rows are encoded
alike; an id that isn't in the vocabulary, or a null in a list, decodes to
U+FFFD, as do bytes that aren't UTF-8; an empty table gives an empty result.
Other columns aren't read; ``encode`` replaces a column of the name it is told
to write, whatever its case, and leaves the others as they were.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of text that are encoded together, whole texts at a time.
TOGETHER = 4_000_000

SENTINEL, GONE = -2, -1


def _alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Vocabulary:
    left: np.ndarray  # by rank: the pair and what it becomes
    right: np.ndarray
    joined: np.ndarray
    byte_id: np.ndarray  # the token of each byte
    pieces: dict[int, bytes]

    def __post_init__(self) -> None:
        n = int(max(self.joined.max(initial=0), self.byte_id.max())) + 2
        ranks = np.arange(len(self.left))
        self.after, self.before = [], []  # by token: (partners, ranks) of pairs that it begins, and that it ends
        for own, other, to in ((self.left, self.right, self.after), (self.right, self.left, self.before)):
            order = np.lexsort((other, own))
            at = np.searchsorted(own[order], np.arange(n))
            a, r = other[order], ranks[order]
            to.extend((a[i:j], r[i:j]) for i, j in zip(at, at[1:]))
        of = {int(t): b for b, t in enumerate(self.byte_id)}
        self.first = np.full((256, 256), -1, np.int32)
        for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist())):
            if a in of and b in of:
                self.first[of[a], of[b]] = r

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all words one after another, and the offsets by word."""
        raw = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        edge = np.concatenate(([0], ends))
        tok = self.byte_id[raw].astype(np.int32)
        tok[edge] = SENTINEL
        n = len(tok)
        nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        rank = self.first[raw[:-1], raw[1:]]
        rank[edge[edge < n - 1]] = -1
        rank[edge[edge > 0] - 1] = -1
        pos = np.flatnonzero(rank >= 0).astype(np.int32)
        order = np.argsort(rank[pos], kind="stable")
        pos, rank = pos[order], rank[pos[order]]
        cuts = np.concatenate(([0], np.flatnonzero(rank[1:] != rank[:-1]) + 1, [len(rank)])) if len(rank) else np.zeros(1, np.int64)
        index: dict[int, list[np.ndarray]] = {int(rank[i]): [pos[i:j]] for i, j in zip(cuts, cuts[1:])}
        heap = sorted(index)

        def add(at: np.ndarray, partner: np.ndarray, of: tuple[np.ndarray, np.ndarray]) -> None:
            partners, ranks = of
            k = np.searchsorted(partners, partner)
            k[k == len(partners)] = 0
            hit = np.flatnonzero(partners[k] == partner)
            if not len(hit):
                return
            at, r = at[hit], ranks[k[hit]]
            if len(r) > 1:
                order = np.argsort(r, kind="stable")
                at, r = at[order], r[order]
            ends = [*(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            i = 0
            for j in ends:
                x = int(r[i])
                if x in index:
                    index[x].append(at[i:j])
                else:
                    index[x] = [at[i:j]]
                    heapq.heappush(heap, x)
                i = j

        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, c = int(self.left[r]), int(self.right[r]), int(self.joined[r])
            q = nxt[p]
            ok = (tok[p] == a) & (tok[q] == b)
            p, q = p[ok], q[ok]
            if not len(p):
                continue
            if a == b and len(p) > 1:  # of a run of equal tokens every second pair, from the left
                order = np.argsort(p)
                p, q = p[order], q[order]
                start = np.concatenate(([True], q[:-1] != p[1:]))
                k = np.arange(len(p))
                even = (k - np.maximum.accumulate(np.where(start, k, 0))) % 2 == 0
                p, q = p[even], q[even]
            after = nxt[q]
            tok[p], tok[q] = c, GONE
            nxt[p], prv[after] = after, p
            if len(self.after[c][0]):
                add(p, tok[after], self.after[c])
            if len(self.before[c][0]):
                before = prv[p]
                t = tok[before]
                new = t != c  # else the pair is already there as that of its left token
                add(before[new], t[new], self.before[c])
        alive = tok >= 0
        return tok[alive], np.concatenate(([0], np.cumsum(alive)[ends]))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all texts one after another, and the offsets by text; a null has none."""
        ids = _Numbers()
        find = _pattern().findall
        rows = [np.fromiter(map(ids.__getitem__, find(t)), np.int32) if t else np.empty(0, np.int32) for t in texts]
        if not ids:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        tokens, at = self.replay([w.encode("utf-8", "surrogatepass") for w in ids])
        inv = np.concatenate(rows)
        size = np.diff(at)[inv]
        total = np.concatenate(([0], np.cumsum(size)))
        out = tokens[np.repeat(at[:-1][inv] - total[:-1], size) + np.arange(total[-1])]
        return out, total[np.concatenate(([0], np.cumsum([len(r) for r in rows])))]

    def decode(self, tokens: list[int | None]) -> str:
        """The text of a list of tokens."""
        get = self.pieces.get
        return b"".join([get(t, b"\xef\xbf\xbd") for t in tokens]).decode("utf-8", "replace")


class _Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


@lru_cache(1)
def _pattern() -> regex.Pattern:
    return regex.compile(PATTERN)


@lru_cache(2)
def load(path: str = VOCABULARY) -> Vocabulary:
    """Merges and pieces of a byte-level vocabulary file; read on the driver, the executors get them by broadcast."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    byte = _alphabet()
    ids = d["model"]["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
    left, right, joined = (np.array(x, np.int32) for x in ([ids[a] for a, _ in pairs], [ids[b] for _, b in pairs], [ids[a + b] for a, b in pairs]))
    byte_id = np.zeros(256, np.int32)
    for c, b in byte.items():
        byte_id[b] = ids[c]
    pieces = {i: bytes(byte[c] for c in s) for s, i in ids.items()}
    pieces |= {t["id"]: t["content"].encode() for t in d.get("added_tokens", ())}
    return Vocabulary(left, right, joined, byte_id, pieces)


def _lists(tokens: np.ndarray, at: np.ndarray, null: np.ndarray) -> pa.ListArray:
    """Lists of tokens; null where the text is."""
    offsets = pa.array(at.astype(np.int32), mask=np.concatenate((null, [False])))
    return pa.ListArray.from_arrays(offsets, pa.array(tokens, pa.int32()))


def encode(docs: DataFrame, text_col: str = "text", out_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``docs`` with the tokens of ``text_col`` as a list of integers in ``out_col``, the last column."""
    model = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    rest = docs.drop(out_col)
    names = rest.columns
    at = names.index(text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            # Columns go by place: names may be any.
            plain = batch.rename_columns([str(i) for i in range(batch.num_columns)])
            for piece, texts in runtime.batches(iter([plain]), str(at), TOGETHER):
                tokens, offsets = model.value.encode(texts)
                null = np.array([t is None for t in texts])
                yield pa.RecordBatch.from_arrays([*piece.columns, _lists(tokens, offsets, null)], [*names, out_col])

    return runtime.mapped(runtime.spread(rest), run, runtime.added(rest, out_col, "array<int>"))


def decode(rows: DataFrame, tokens_col: str = "tokens", out_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` with the text of the tokens in ``tokens_col`` in ``out_col``, the last column."""
    model = rows.sparkSession.sparkContext.broadcast(load(vocabulary))
    rest = rows.drop(out_col)
    names = rest.columns
    at = names.index(tokens_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [None if not t.is_valid else model.value.decode(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, out_col])

    return runtime.mapped(rest, run, runtime.added(rest, out_col, "string"))


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, exact) of each row; ``exact`` tells that decoding gave the text back."""
    model = docs.sparkSession.sparkContext.broadcast(load(vocabulary))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runtime.batches(it, "text", TOGETHER):
            v = model.value
            tokens, at = v.encode(texts)
            null = np.array([t is None for t in texts])
            back = [None if t is None else v.decode(tokens[i:j].tolist()) == t for t, i, j in zip(texts, at, at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at).astype(np.int32), mask=null), _lists(tokens, at, null), pa.array(back, pa.bool_())],
                ["doc_id", "n_tokens", "tokens", "exact"],
            )

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return runtime.mapped(runtime.spread(read), run, f"doc_id {dict(docs.dtypes)[id_col]}, n_tokens int, tokens array<int>, exact boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, decoded again."""
    return coded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
