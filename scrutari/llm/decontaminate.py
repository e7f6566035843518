"""Benchmark decontamination by winnowing.

Of every ``WINDOW`` successive hashes of ``GRAM`` words the smallest is kept,
on both sides; a span of ``GRAM + WINDOW - 1`` words or more that a document
shares with a benchmark text therefore always shares a kept hash at the same
place. Fingerprints are joined, each hit is checked word by word and extended
to the whole shared span. Spans shorter than the guarantee are discarded, so
the result is exactly the set of maximal shared spans of at least ``SPAN``
words: winnowing decides only what it costs.

Words are maximal runs of letters, digits and combining marks of the
lower-cased text. In scripts that don't part words by spaces (Chinese,
Japanese, Thai and some more) each character is a word, and counts half: there
a span has at least 2 * ``SPAN`` characters.

The benchmark goes to the executors in pieces of at most ``PIECE`` words, each
with its own pass over the documents, so that memory doesn't depend on its
size; a usual benchmark is one piece. Documents never move. Items of equal text
are one item. To decide whether a document goes, hits are compared with the
different contexts only that a fingerprint has in the benchmark: a prompt that
begins a hundred thousand items costs, but for its last words, what it costs in one.

Defined results: null, empty and short texts have no span; an item of less
than ``SPAN`` words matches nothing; repeated rows are reported as often as
they occur; items of equal text are reported once, with the least of their ids;
empty tables give an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, tokens

GRAM = 5
WINDOW = 6
#: Words from which a shared span is always found, and reported.
SPAN = GRAM + WINDOW - 1
#: Benchmark words broadcast at a time (8 bytes each, and about as much for fingerprints).
PIECE = 4_000_000


def fingerprints(hashes: np.ndarray, doc: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept gram hashes of all texts and the word at which each begins, in order.

    Windows don't reach over the end of a text; a text with at least one gram
    but less than a window of them keeps its smallest.
    """
    n = len(hashes) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = hashes[:n].copy()
    for k in range(1, gram):
        g = tokens.mix(g) + hashes[k : n + k]
    g = tokens.mix(g)
    # Grams over the end of a text are larger than all others and never kept.
    over = np.zeros(n, bool)
    for k in range(1, gram):
        at = doc[1:-1] - k
        over[at[(at >= 0) & (at < n)]] = True
    g[over] = np.uint64(0xFFFFFFFFFFFFFFFF)
    keep = np.zeros(n, bool)
    pad = np.concatenate((g, np.full(window - 1, 0xFFFFFFFFFFFFFFFF, np.uint64)))
    least, place = pad[:n].copy(), np.zeros(n, np.int8)
    for k in range(1, window):
        after = pad[k : n + k]
        less = after <= least  # the last of equal ones
        place[less] = k
        np.minimum(least, after, out=least)
    pick = np.arange(n) + place
    pick = pick[pick < n]
    keep[pick] = True
    keep &= ~over
    pos = np.flatnonzero(keep)
    return g[pos], pos


#: Words around a gram that decide whether a span is long enough.
REACH = 2 * SPAN - GRAM


class Benchmark:
    """Words and sorted fingerprints of a piece of the benchmark."""

    def __init__(self, ids: list, texts: list[str | None]):
        w = tokens.words(texts)
        self.ids, self.hashes, self.doc = ids, w.hashes, w.doc
        fp, pos = fingerprints(w.hashes, w.doc)
        order = np.argsort(fp, kind="stable")
        self.fp, self.pos = fp[order], pos[order]
        # A table of which low bits occur answers most lookups at the cost of one read.
        self.bits = 22
        self.some = np.zeros(1 << self.bits, bool)
        self.some[(self.fp & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True
        # Of the places of a fingerprint one for each context within REACH.
        item = np.searchsorted(self.doc, self.pos, side="right") - 1
        a, b = np.maximum(self.pos - REACH, self.doc[item]), np.minimum(self.pos + GRAM + REACH, self.doc[item + 1])
        power, inverse = tokens._power(len(w.hashes) + 1)
        sums = np.zeros(len(w.hashes) + 1, np.uint64)
        np.cumsum(tokens.mix(w.hashes) * power[: len(w.hashes)], out=sums[1:])
        context = tokens.mix((sums[b] - sums[a]) * inverse[a]) + (self.pos - a).astype(np.uint64) * np.uint64(REACH + 1) + (b - self.pos).astype(np.uint64)
        order = np.lexsort((context, self.fp))
        f, c = self.fp[order], context[order]
        new = np.ones(len(order), bool)
        new[1:] = (f[1:] != f[:-1]) | (c[1:] != c[:-1])
        one = np.sort(order[new])
        self.one_fp, self.one_pos = self.fp[one], self.pos[one]

    def _hits(self, hashes: np.ndarray, doc: np.ndarray, single: np.ndarray, fps: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, ...]:
        """Place in the texts, place in the benchmark, text and item of each hit that is part of a long enough span."""
        fp, pos = fingerprints(hashes, doc)
        maybe = self.some[(fp & np.uint64((1 << self.bits) - 1)).astype(np.int64)]
        fp, pos = fp[maybe], pos[maybe]
        lo = np.searchsorted(fps, fp, side="left")
        n = np.searchsorted(fps, fp, side="right") - lo
        hit = n > 0
        lo, n, pos = lo[hit], n[hit], pos[hit]
        found = [(np.empty(0, np.int64),) * 4]
        total = np.cumsum(n)
        i = 0
        while i < len(pos):  # some hits at a time, as a fingerprint may have many places
            k = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + 1_000_000)))
            m = n[i:k]
            a = np.repeat(pos[i:k], m)
            b = places[np.repeat(lo[i:k], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
            d, item = np.searchsorted(doc, a, side="right") - 1, np.searchsorted(self.doc, b, side="right") - 1
            weight = np.zeros(len(a), np.int64)
            for step, reach in ((1, GRAM + REACH), (-1, REACH)):
                on = np.arange(len(a))
                for j in range(reach):
                    x, y = (a[on] + j, b[on] + j) if step > 0 else (a[on] - 1 - j, b[on] - 1 - j)
                    inside = (x < doc[d[on] + 1]) & (y < self.doc[item[on] + 1]) if step > 0 else (x >= doc[d[on]]) & (y >= self.doc[item[on]])
                    on, x, y = on[inside], x[inside], y[inside]
                    same = hashes[x] == self.hashes[y]
                    on, x = on[same], x[same]
                    if not len(on):
                        break
                    weight[on] += 2 - single[x]
            good = weight >= 2 * SPAN
            found.append((a[good], b[good], d[good], item[good]))
            i = k
        return tuple(np.concatenate(x) for x in zip(*found))

    def shared(self, w: tokens.Words) -> np.ndarray:
        """Which texts have a span in common with an item."""
        out = np.zeros(len(w.doc) - 1, bool)
        out[self._hits(w.hashes, w.doc, w.single, self.one_fp, self.one_pos)[2]] = True
        return out

    def spans(self, w: tokens.Words) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first word in the document, first word in the item, words), by index, without repeats."""
        hashes, doc = w.hashes, w.doc
        out = []
        done: dict[tuple[int, int], int] = {}  # by diagonal and item: the end of what is reported
        hits = self._hits(hashes, doc, w.single, self.fp, self.pos)
        for x, y, i, j in sorted(zip(*(h.tolist() for h in hits))):
            if done.get((x - y, j), -1) > x:
                continue
            back = min(x - int(doc[i]), y - int(self.doc[j]))
            fore = min(int(doc[i + 1]) - x, int(self.doc[j + 1]) - y)
            differ = np.flatnonzero(hashes[x : x + fore] != self.hashes[y : y + fore])
            right = int(differ[0]) if len(differ) else fore
            differ = np.flatnonzero(hashes[x - back : x][::-1] != self.hashes[y - back : y][::-1])
            left = int(differ[0]) if len(differ) else back
            done[x - y, j] = x + right
            out.append((i, j, x - left - int(doc[i]), y - left - int(self.doc[j]), left + right))
        return out


def _pieces(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """The benchmark, read through the driver in bounded pieces of whole items."""
    ids, texts, size = [], [], 0
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    for r in items.groupBy("text").agg(F.min("id").alias("id")).select("id", "text").toLocalIterator():
        n = len(r[1]) // 2 + 1
        if ids and size + n > PIECE:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += n
    if ids:
        yield ids, texts


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, words) of every maximal shared span of at least ``SPAN`` words."""
    spark = docs.sparkSession
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, item_id {dict(benchmark.dtypes)[item_col]}, doc_start int, item_start int, words int"
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], schema)
    for k, (ids, texts) in enumerate(_pieces(benchmark, item_col, item_text)):
        model = spark.sparkContext.broadcast(Benchmark(ids, texts))

        def find(it: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            b = model.value
            for batch, texts in runtime.batches(it):
                spans = b.spans(tokens.words(texts))
                if not spans:
                    continue
                d, j, x, y, n = (list(c) for c in zip(*spans))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(d)), pa.array([b.ids[i] for i in j]), *(pa.array(c, pa.int32()) for c in (x, y, n))],
                    ["doc_id", "item_id", "doc_start", "item_start", "words"],
                )

        found = runtime.mapped(read, find, schema)
        out = out.unionByName(found) if k else found
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without those that share a span with the benchmark, all columns as they were.

    One pass: the decision is made where the text is, so neither ids nor
    texts are joined. Rows with null or repeated ids are decided by their own text.
    """
    spark = docs.sparkSession
    out = docs
    for ids, texts in _pieces(benchmark, item_col, item_text):
        model = spark.sparkContext.broadcast(Benchmark(ids, texts))

        def clean(it: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for batch, texts in runtime.batches(it, text_col):
                yield batch.filter(pa.array(~model.value.shared(tokens.words(texts))))

        out = runtime.mapped(out, clean, out.schema)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span that a document shares with a benchmark text."""
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = f"""
WITH d AS (SELECT doc_id, {tokens.words_sql("text")} AS w FROM documents),
b AS (SELECT item_id, {tokens.words_sql("text")} AS w FROM (SELECT min(item_id) AS item_id, text FROM benchmark WHERE text IS NOT NULL GROUP BY text)),
dg AS (SELECT doc_id, i AS x, array_to_string(w[i:i + {SPAN - 1}], ' ') AS g
       FROM (SELECT doc_id, w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM d WHERE len(w) >= {SPAN})),
bg AS (SELECT item_id, i AS y, w[i + {SPAN - 1}] AS last, array_to_string(w[i:i + {SPAN - 1}], ' ') AS g, len(list_filter(w[i:i + {SPAN - 1}], lambda t: regexp_matches(t, '^[{tokens.SINGLE}]'))) AS singles
       FROM (SELECT item_id, w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM b WHERE len(w) >= {SPAN})),
hits AS (SELECT doc_id, item_id, x, y, last, singles, x - row_number() OVER (PARTITION BY doc_id, item_id, x - y ORDER BY x) AS island
         FROM dg JOIN bg USING (g)),
spans AS (SELECT doc_id, item_id, min(x) - 1 AS doc_start, min(y) - 1 AS item_start, count(*) + {SPAN - 1} AS words,
          arg_min(singles, x) + count(*) FILTER (WHERE regexp_matches(last, '^[{tokens.SINGLE}]')) - CAST(regexp_matches(arg_min(last, x), '^[{tokens.SINGLE}]') AS INTEGER) AS singles
          FROM hits GROUP BY doc_id, item_id, x - y, island)
SELECT doc_id, item_id, CAST(doc_start AS INTEGER) AS doc_start, CAST(item_start AS INTEGER) AS item_start, CAST(words AS INTEGER) AS words
FROM spans WHERE 2 * words - singles >= {2 * SPAN}
"""
