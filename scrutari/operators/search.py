"""Search: postings of the query's terms, scored, summed by document, the best taken.

The terms are pushed down to the scan of the postings; one exchange sums up by
document. Idf and average length join as a table of as many rows as the query
has terms. Deleted documents go before the best are taken, but count in the
statistics. ``search_pruned`` reads only the blocks of postings that can hold
one of the best.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, scoring
from ..plans.query import Query, QueryError, compile_query
from .tables import Tables

#: Terms of all queries together up to which they are broadcast; and compared in the scan.
BROADCAST_TERMS = 100_000
PUSHED_TERMS = 2_000
#: Tombstones, and hits to fetch stored fields of, up to which they are broadcast (16 bytes each, and what a hit carries).
BROADCAST_DELETES = 1_000_000
BROADCAST_HITS = 100_000
#: Hits up to which their places are compared in the scan of the documents, and blocks in that of the postings.
PUSHED_HITS = 1_000
PUSHED_BLOCKS = 2_000
#: Blocks of documents that are scored first, so that others can be left out.
FIRST_BLOCKS = 16


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_TERMS else df


def _of(rows: DataFrame, terms: set[tuple[str, str]]) -> DataFrame:
    """Rows of some terms: as a filter that the scan can use, if they are few."""
    if len(terms) > PUSHED_TERMS:
        return rows
    by: dict[str, list[str]] = {}
    for f, t in sorted(terms):
        by.setdefault(f, []).append(t)
    cond = F.lit(False)
    for f, ts in by.items():
        cond = cond | ((F.col("field") == f) & F.col("term").isin(ts))
    return rows.where(cond)


def averages(index: Tables) -> DataFrame:
    """(field, docs, tokens, average) over all segments."""
    total = index.field_stats.groupBy("field").agg(F.sum("doc_count").alias("docs"), F.sum("sum_tf").alias("tokens"))
    return total.withColumn("average", F.try_divide(F.col("tokens").cast("double"), F.col("docs").cast("double")))


def idfs(index: Tables, terms: set[tuple[str, str]] | None = None) -> DataFrame:
    """(field, term, doc_freq, docs, average, idf) over all segments; of all terms or some."""
    stats = index.term_stats if terms is None else _of(index.term_stats, terms)
    freq = stats.groupBy("field", "term").agg(F.sum("doc_freq").alias("doc_freq"))
    # As many rows as the index has fields.
    rows = freq.join(F.broadcast(averages(index)), "field")
    return rows.withColumn("idf", scoring.idf(F.col("docs"), F.col("doc_freq")))


def norms(index: Tables) -> DataFrame:
    """(field, len_q, norm) of every quantised length that occurs."""
    rows = index.lengths.select("field", "len_q").distinct().join(F.broadcast(averages(index)), "field")
    return rows.select("field", "len_q", scoring.norm(F.col("len_q"), F.col("average")).alias("norm"))


def _weights(index: Tables, queries: dict[object, Query]) -> tuple[DataFrame, set[tuple[str, str]]]:
    """(query, field, term, required, w, average) of each term of each query, and all terms; as many rows as that."""
    plans = {k: compile_query(q, index.schema) for k, q in queries.items()}
    asked = [(n, f, t, float(w), p.required) for n, p in enumerate(plans.values()) for f, t, w in p.terms]
    terms = {(f, t) for _, f, t, _, _ in asked}
    q = index.blocks.sparkSession.createDataFrame(asked, "query int, field string, term string, weight double, required int")
    weights = q.join(_small(idfs(index, terms), len(terms)), ["field", "term"])
    weights = weights.select("query", "field", "term", "required", (F.col("weight") * F.col("idf")).alias("w"), "average")
    return _small(weights, len(asked)), terms


def _scored_postings(rows: DataFrame, weights: DataFrame, blocks: bool) -> DataFrame:
    """(query, segment_id, local_id, required, part) of blocks of postings or of single ones."""
    rows = rows.join(weights, ["field", "term"])
    if blocks:
        rows = rows.select("query", "segment_id", "required", "w", "average", F.inline("entries"))
    part = scoring.contribution(F.col("w"), F.col("tf"), scoring.norm(F.col("len_q"), F.col("average")))
    return rows.select("query", "segment_id", "local_id", "required", part.alias("part"))


def contributions(index: Tables, queries: dict[object, Query]) -> DataFrame:
    """(query, segment_id, local_id, required, part): what each term of each query adds to a document's score."""
    weights, terms = _weights(index, queries)
    whole = index.flat is None
    return _scored_postings(_of(index.blocks if whole else index.flat, terms), weights, whole)


def _live(rows: DataFrame, index: Tables) -> DataFrame:
    """``rows`` without those of deleted documents; no join where none is deleted."""
    if index.deletes is None:
        return rows
    few = index.tombstones is not None and index.tombstones <= BROADCAST_DELETES
    return rows.join(F.broadcast(index.deletes) if few else index.deletes, ["segment_id", "local_id"], "left_anti")


def _summed(parts: DataFrame, index: Tables) -> DataFrame:
    total = parts.groupBy("segment_id", "local_id").agg(F.sum("part").alias("score"), F.count("*").alias("n"), F.first("required").alias("required"))
    hits = _live(total.where("n >= required"), index)
    return hits.select(ids.pack(F.col("segment_id"), F.col("local_id")).alias("doc"), "segment_id", "local_id", F.round("score", scoring.PLACES).alias("score"))


def scored(index: Tables, query: Query) -> DataFrame:
    """(doc, segment_id, local_id, score) of every match; what collectors of any kind begin with."""
    return _summed(contributions(index, {0: query}), index)


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("doc")]


def search(index: Tables, query: Query, n: int | None = 10, min_score: float | None = None) -> DataFrame:
    """The best ``n`` documents, or all: by score, then by id."""
    if n is not None and n < 1:
        raise QueryError("n must be at least 1")
    hits = scored(index, query)
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    return hits.orderBy(*_order()).limit(n) if n is not None else hits


def block_bounds(index: Tables, query: Query) -> DataFrame:
    """(segment_id, block, docs, bound): what no document in a block of places can exceed, of blocks that can hold a match.

    A block covers the same places for all terms, so its bound is the sum of
    its terms' bounds. Only the heads of the blocks are read.
    """
    weights, terms = _weights(index, {0: query})
    heads = _of(index.blocks, terms).drop("entries").join(weights, ["field", "term"])
    upper = scoring.impact_bound(F.col("w"), F.col("impact"), F.col("average_then"), F.col("average"), F.col("max_tf"), F.col("min_len_q"))
    total = heads.groupBy("segment_id", "block").agg(
        F.sum("docs").alias("docs"), F.sum(upper).alias("bound"), F.count("*").alias("n"), F.first("required").alias("required")
    )
    return total.where("n >= required").select("segment_id", "block", "docs", "bound")


def _in_blocks(index: Tables, query: Query, chosen: list | DataFrame) -> DataFrame:
    """Scores of matches in some blocks: compared in the scan if they are a list, else joined."""
    weights, terms = _weights(index, {0: query})
    rows = _of(index.blocks, terms)
    if isinstance(chosen, list):
        by: dict[int, list[int]] = {}
        for r in chosen:
            by.setdefault(r["segment_id"], []).append(r["block"])
        some = F.lit(False)
        for segment, blocks in by.items():
            some = some | ((F.col("segment_id") == segment) & F.col("block").isin(blocks))
        # The blocks of all segments together too, as only this part is pushed down to pages.
        rows = rows.where(F.col("block").isin(sorted({r["block"] for r in chosen})) & some) if chosen else rows.where("false")
    else:
        rows = rows.join(chosen, ["segment_id", "block"], "left_semi")
    return _summed(_scored_postings(rows, weights, True), index)


@dataclass(frozen=True)
class Pruned:
    hits: DataFrame  # as ``search`` gives them
    read: int  # postings in the blocks that were left
    total: int  # postings in all blocks of the query's terms that can hold a match


def pruned(index: Tables, query: Query, n: int = 10) -> Pruned:
    """The best ``n`` documents, exactly, from those blocks only that can hold one of them.

    First the ``FIRST_BLOCKS`` blocks of the highest bounds are scored: their
    n-th best score is one that every result reaches. Then all blocks are left
    out of which the bound is below. Two small jobs more than ``search`` has,
    so for terms of many postings.
    """
    if n < 1:
        raise QueryError("n must be at least 1")
    bounds = block_bounds(index, query)
    first = bounds.orderBy(F.desc("bound"), "segment_id", "block").limit(FIRST_BLOCKS).collect()
    best = _in_blocks(index, query, first).orderBy(*_order()).limit(n).collect()
    # Scores are rounded, and sums depend a little on their order.
    least = best[-1]["score"] - 2 * 10**-scoring.PLACES if len(best) == n else float("-inf")
    kept = bounds.where(F.col("bound") >= least)
    sizes = bounds.agg(F.sum("docs").alias("total"), F.sum(F.when(F.col("bound") >= least, F.col("docs"))).alias("read"), F.count_if(F.col("bound") >= least).alias("blocks")).head()
    if sizes["blocks"] <= PUSHED_BLOCKS:
        chosen = kept.select("segment_id", "block").collect()
    else:
        chosen = _small(kept.select("segment_id", "block"), sizes["blocks"])
    return Pruned(_in_blocks(index, query, chosen).orderBy(*_order()).limit(n), sizes["read"] or 0, sizes["total"] or 0)


def search_pruned(index: Tables, query: Query, n: int = 10) -> DataFrame:
    """What ``search`` gives, by ``pruned``."""
    return pruned(index, query, n).hits


def search_many(index: Tables, queries: dict[object, Query], n: int = 10) -> DataFrame:
    """(query, rank, doc, segment_id, local_id, score): the best ``n`` of each query, in one pass over the postings."""
    if n < 1:
        raise QueryError("n must be at least 1")
    rows = contributions(index, queries)
    total = rows.groupBy("query", "segment_id", "local_id").agg(F.sum("part").alias("score"), F.count("*").alias("n"), F.first("required").alias("required"))
    hits = _live(total.where("n >= required"), index)
    hits = hits.select("query", ids.pack(F.col("segment_id"), F.col("local_id")).alias("doc"), "segment_id", "local_id", F.round("score", scoring.PLACES).alias("score"))
    best = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*_order()))).where(F.col("rank") <= n)
    names = index.blocks.sparkSession.createDataFrame([(k, str(x)) for k, x in enumerate(queries)], "query int, name string")
    return best.join(_small(names, len(queries)), "query").select(F.col("name").alias("query"), "rank", "doc", "segment_id", "local_id", "score")


def exact(index: Tables, field: str, values: list[str], include_deleted: bool = True) -> DataFrame:
    """(doc, segment_id, local_id) of documents of which a field has any of the terms; not scored."""
    index.schema.type_of(field)
    rows = _of(index.postings, {(field, v) for v in values}) if len(values) <= PUSHED_TERMS else index.postings.where(F.col("field") == field).join(
        index.blocks.sparkSession.createDataFrame([(v,) for v in values], "term string"), "term", "left_semi"
    )
    found = rows.select("segment_id", "local_id").distinct()
    found = found if include_deleted else _live(found, index)
    return found.select(ids.pack(F.col("segment_id"), F.col("local_id")).alias("doc"), "segment_id", "local_id")


def fetch(index: Tables, hits: DataFrame, *fields: str) -> DataFrame:
    """``hits`` with stored fields, also of deleted documents.

    The stored documents don't move where the hits are known to be few, as
    after a limit: up to ``PUSHED_HITS`` are run now and their places compared in
    the scan, up to ``BROADCAST_HITS`` are broadcast. Others are joined by place.
    """
    for f in fields:
        if f not in index.documents.columns:
            raise QueryError(f"no such field: {f!r}")
    most = hits._jdf.queryExecution().optimizedPlan().maxRows()
    most = most.get() if most.isDefined() else None
    stored = index.documents.select("segment_id", "local_id", *fields)
    if most is not None and most <= PUSHED_HITS:
        rows = hits.collect()
        hits = index.blocks.sparkSession.createDataFrame(rows, hits.schema)
        stored = stored.where(F.col("local_id").isin(sorted({r["local_id"] for r in rows})) & F.col("segment_id").isin(sorted({r["segment_id"] for r in rows})))
    few = most is not None and most <= BROADCAST_HITS
    # Every hit has a stored document.
    return (F.broadcast(hits) if few else hits).join(stored, ["segment_id", "local_id"])


def value(index: Tables, field: str, doc: int) -> object:
    """One stored value of one document; None where there is none."""
    if field not in index.documents.columns:
        raise QueryError(f"no such field: {field!r}")
    row = index.documents.where((F.col("segment_id") == doc >> 32) & (F.col("local_id") == doc & 0xFFFFFFFF)).select(field).head()
    return row[0] if row else None


def bounds(index: Tables, blocks: DataFrame) -> DataFrame:
    """``blocks`` with what no document of a block can exceed."""
    rows = blocks.join(idfs(index).select("field", "term", "idf", "average"), ["field", "term"])
    top = scoring.contribution(F.col("idf"), F.col("max_tf"), scoring.norm(F.col("min_len_q"), F.col("average")))
    return rows.withColumn("upper", F.round(top, scoring.PLACES))


def facets(index: Tables, query: Query, field: str) -> DataFrame:
    """(value, docs): how often each value of a stored field occurs among all matches."""
    return fetch(index, scored(index, query), field).groupBy(F.col(field).alias("value")).agg(F.count("*").alias("docs"))
