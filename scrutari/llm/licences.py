"""Licence texts in documents, by the Dice coefficient over word bigrams.

Text and templates are normalised to lower-case words. Compared with a template
are all windows of successive words of a text, across lines and paragraphs, so
that a statement within a line, a notice of several paragraphs and a whole text
are found alike. The similarity is 2 * |A and B| / (|A| + |B|) over the
multisets of their bigrams. Only windows whose size allows ``THRESHOLD`` are
looked at: t / (2 - t) * |B| <= |A| <= (2 - t) / t * |B|; and templates of
which a text has too few bigrams aren't compared at all. Neither changes a result.

Defined results: one row (doc_id, licence, dice) for each row of the table and
each template that a window of it resembles, with the best window's value;
null and empty texts and texts of one word resemble nothing; repeated rows are
reported as often as they occur; texts are covered whole, whatever their
length; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime, tokens
from .licence_texts import TEMPLATES

THRESHOLD = 0.8


class Templates:
    """Bigram counts of all templates."""

    def __init__(self, texts: dict[str, str], threshold: float = THRESHOLD):
        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be above 0 and at most 1")
        grams = {k: _bigrams(tokens.words([t]).hashes) for k, t in texts.items()}
        self.names = sorted((k for k, g in grams.items() if len(g)), key=lambda k: (len(grams[k]), k))
        self.size = np.array([len(grams[k]) for k in self.names], np.int64)
        self.vocabulary = np.unique(np.concatenate([np.empty(0, np.uint64), *(grams[k] for k in self.names)]))
        self.count = np.zeros((len(self.names), len(self.vocabulary)), np.int32)
        for i, k in enumerate(self.names):
            np.add.at(self.count[i], np.searchsorted(self.vocabulary, grams[k]), 1)
        self.low, self.high = self.size * (threshold / (2 - threshold)) - 1e-9, self.size * ((2 - threshold) / threshold) + 1e-9
        self.some = np.zeros(1 << 20, bool)
        self.some[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.threshold = threshold

    def find(self, g: np.ndarray) -> np.ndarray:
        """Place of each bigram in the vocabulary, -1 where it isn't there."""
        out = np.full(len(g), -1, np.int64)
        maybe = np.flatnonzero(self.some[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.searchsorted(self.vocabulary, g[maybe])
        k[k == len(self.vocabulary)] = 0
        good = self.vocabulary[k] == g[maybe]
        out[maybe[good]] = k[good]
        return out

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, float]]:
        """(text, template, dice) of each text's best window for each template, by index."""
        w = tokens.words(texts)
        if not self.names or len(w.hashes) < 2:
            return []
        return self._windows(self.find(_bigrams(w.hashes)), w.doc)

    def _windows(self, at: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, float]]:
        """The best window of each text for each template.

        The best one begins and ends with a bigram of the template, else it
        would be better without. Of a start's windows only those are looked at
        that may hold enough bigrams within the largest size.
        """
        inner = at >= 0
        ends = doc[1:-1] - 1  # bigrams over the end of a text
        inner[ends[(ends >= 0) & (ends < len(at))]] = False
        hits = np.flatnonzero(inner)
        gram, text = at[hits], np.searchsorted(doc, hits, side="right") - 1
        best: dict[tuple[int, int], float] = {}
        for t, b in enumerate(self.size.tolist()):
            mine = np.flatnonzero(self.count[t, gram])
            least, most = max(1, int(np.ceil(self.low[t]))), int(self.high[t])
            if len(mine) < least:
                continue
            p, d, g = hits[mine], text[mine], gram[mine]
            # Beyond its number in the template a bigram counts only if as many before it are outside the window.
            order = np.argsort(g, kind="stable")
            before = np.full(len(g), -1, np.int64)
            place = np.arange(len(g)) - self.count[t, g[order]]
            same = place >= 0
            same[same] = g[order[place[same]]] == g[order[same]]
            before[order[same]] = order[place[same]]
            end = np.minimum(np.searchsorted(p, p + most), np.searchsorted(d, d, side="right"))
            for k in np.flatnonzero(end - np.arange(len(p)) >= least).tolist():
                e = end[k]
                v = float((2 * np.cumsum(before[k:e] < k) / (p[k:e] - p[k] + 1 + b)).max())
                if v >= self.threshold:
                    best[d[k], t] = max(v, best.get((d[k], t), 0.0))
        return [(int(d), t, v) for (d, t), v in sorted(best.items())]


def _bigrams(h: np.ndarray) -> np.ndarray:
    return tokens.mix(tokens.mix(h[:-1]) + h[1:])


@lru_cache(2)
def _standard() -> Templates:
    return Templates(TEMPLATES)


def scan(docs: DataFrame, templates: Templates | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, dice) of all documents."""
    model = docs.sparkSession.sparkContext.broadcast(templates or _standard())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in runtime.batches(it, "text"):
            found = model.value.matches(texts)
            if found:
                d, t, v = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), pa.array([model.value.names[k] for k in t]), pa.array(v)], ["doc_id", "licence", "dice"])

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = runtime.mapped(read, run, f"doc_id {dict(docs.dtypes)[id_col]}, licence string, dice double")
    return found.withColumn("dice", F.round("dice", 6))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in every document."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_quoted = ", ".join("('{}', '{}')".format(k.replace("'", "''"), " ".join(t.split()).replace("'", "''")) for k, t in TEMPLATES.items())
SQL = f"""
WITH t AS (SELECT licence, {tokens.words_sql('x')} AS w FROM (VALUES {_quoted}) AS v(licence, x)),
tg AS (SELECT licence, len(w) - 1 AS size, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM t WHERE len(w) > 1),
tc AS (SELECT licence, size, g, count(*) AS n, CAST(greatest(1, ceil(size * ({THRESHOLD} / (2 - {THRESHOLD})) - 1e-9)) AS INTEGER) AS least,
              CAST(floor(size * ((2 - {THRESHOLD}) / {THRESHOLD}) + 1e-9) AS INTEGER) AS most FROM tg GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, {tokens.words_sql('text')} AS w FROM documents),
dg AS (SELECT r, doc_id, unnest(range(1, len(w))) AS pos, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM d WHERE len(w) > 1),
-- A template's bigrams in the texts, the how-manieth of its kind each is, and how many follow within reach.
h AS (SELECT r, doc_id, licence, size, n, least, most, g, pos, row_number() OVER (PARTITION BY r, licence, g ORDER BY pos) AS k,
             count(*) OVER (PARTITION BY r, licence ORDER BY pos RANGE BETWEEN CURRENT ROW AND most - 1 FOLLOWING) AS ahead
      FROM dg JOIN tc USING (g)),
-- Beyond its number in the template a bigram counts only in windows that begin after the one so many before it.
b AS (SELECT h.*, coalesce(e.pos, 0) AS before FROM h LEFT JOIN h AS e ON e.r = h.r AND e.licence = h.licence AND e.g = h.g AND e.k = h.k - h.n),
w AS (SELECT a.doc_id, a.r, a.licence, a.size, e.pos - a.pos + 1 AS own,
             sum(CAST(e.before < a.pos AS INTEGER)) OVER (PARTITION BY a.r, a.licence, a.pos ORDER BY e.pos) AS same
      FROM (SELECT * FROM h WHERE ahead >= least) AS a JOIN b AS e ON e.r = a.r AND e.licence = a.licence AND e.pos BETWEEN a.pos AND a.pos + a.most - 1)
SELECT doc_id, licence, round(max(2.0e0 * same / (own + size)), 6) AS dice FROM w
GROUP BY r, doc_id, licence HAVING max(2.0e0 * same / (own + size)) >= {THRESHOLD}
"""
