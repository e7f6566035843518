"""The engine's queries over the given tables, and the same in DuckDB's SQL.

Each table is indexed once by application and folder, and its queries run on
the index. Documents are placed by their own number, so both sides agree on ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import analysis, ids, scoring
from .operators import search as ops
from .operators import tables
from .plans.query import Boolean, Compiled, Occur, Query, Schema, Term, match, must, should
from .sources import readers, shared
from .sources.index import Writer, open_index
from .sources.keyvalue import KeyValue
from .streaming.append import append


@dataclass(frozen=True)
class Corpus:
    table: str
    schema: Schema
    number: str  # SQL for a document's number; or, after "by ", what documents are numbered by, from 0
    segments: int = 1


DOCS = Corpus("documents", Schema(("text",), ("lang", "source")), "doc_id")
SPLIT = Corpus("documents", Schema(("text",), ("lang",)), "doc_id", 4)
PARTS = Corpus("part", Schema(("p_name",), ("p_brand", "p_type")), "p_partkey")
CHATS = Corpus("conversations", Schema(("text",), ("role",)), "by conv_id, turn")
PAGES = Corpus("pages", Schema(("html",), ("url",)), "page_id")
ITEMS = Corpus("benchmark", Schema(("text",)), "item_id")

_built: dict[tuple, str] = {}


def path_of(spark: SparkSession, sf_dir: str, c: Corpus) -> str:
    """The folder of the index of a table, which is made if it isn't there."""
    key = (spark.sparkContext.applicationId, sf_dir, c)
    if key not in _built:
        path = f"{shared.folder(spark)}/{c.table}-{len(_built)}"
        rows = spark.read.parquet(f"{sf_dir}/{c.table}.parquet")
        w = Writer(spark, path, c.schema)
        if c.number.startswith("by "):
            w.add(rows.orderBy(*(x.strip() for x in c.number[3:].split(","))))
        for k in range(0 if c.number.startswith("by ") else c.segments):
            rows = rows.withColumn("number", F.expr(c.number).cast("long"))
            w.add(rows.where(F.col("number") % c.segments == k) if c.segments > 1 else rows, local_id="number")
        _built[key] = path
    return _built[key]


def index_of(spark: SparkSession, sf_dir: str, c: Corpus) -> tables.Tables:
    return open_index(spark, path_of(spark, sf_dir, c))


# SQL


def _index_sql(c: Corpus) -> str:
    """Tables d, post, len, fs, ts like those of the index."""
    number = f"(row_number() OVER (ORDER BY {c.number[3:]}) - 1)" if c.number.startswith("by ") else f"({c.number})"
    parts = [f"SELECT seg, id, '{f}' AS field, unnest({analysis.tokens_sql(f)}) AS term FROM d" for f in c.schema.text]
    parts += [f"SELECT seg, id, '{f}' AS field, CAST({f} AS VARCHAR) AS term FROM d WHERE {f} IS NOT NULL" for f in c.schema.keyword]
    return f"""
WITH d AS (SELECT CAST({number} % {c.segments} AS BIGINT) AS seg, CAST({number} AS BIGINT) AS id, * FROM {c.table}),
tok AS MATERIALIZED ({" UNION ALL ".join(parts)}),
len AS (SELECT seg, id, field, count(*) AS len, {analysis.quantise_sql("count(*)")} AS len_q FROM tok GROUP BY seg, id, field),
post AS (SELECT t.seg, t.id, t.field, term, count(*) AS tf, any_value(len_q) AS len_q FROM tok t JOIN len USING (seg, id, field) GROUP BY t.seg, t.id, t.field, term),
fs AS (SELECT field, count(*) AS docs, CAST(sum(len) AS BIGINT) AS tokens, CAST(sum(len) AS DOUBLE) / count(*) AS average FROM len GROUP BY field),
ts AS (SELECT field, term, count(*) AS doc_freq FROM post GROUP BY field, term),
idf AS (SELECT field, term, doc_freq, docs, average, {scoring.idf_sql("docs", "doc_freq")} AS idf FROM ts JOIN fs USING (field))"""


_PART = scoring.contribution_sql("q.weight * idf.idf", "post.tf", scoring.norm_sql("post.len_q", "idf.average"))


def _hits_sql(c: Corpus, terms: list[tuple[str, str]], every: bool = False, without: str = "false") -> str:
    """All hits (doc, seg, id, score)."""
    distinct = sorted(set(terms))
    values = ", ".join(f"('{f}', '{t}', {terms.count((f, t))})" for f, t in distinct)
    q = f"(VALUES {values}) AS q(field, term, weight)" if values else "(SELECT '' AS field, '' AS term, 0 AS weight WHERE false) AS q"
    return f"""{_index_sql(c)},
hits AS (SELECT (post.seg << 32) | post.id AS doc, post.seg, post.id, round(sum({_PART}), {scoring.PLACES}) AS score
  FROM {q} JOIN idf ON idf.field = q.field AND idf.term = q.term JOIN post ON post.field = q.field AND post.term = q.term
  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.seg = post.seg AND d.id = post.id AND ({without}))
  GROUP BY post.seg, post.id HAVING count(*) >= {len(distinct) if every else 1})
"""


def _top(n: int | None = 10) -> str:
    return "SELECT CAST(doc AS BIGINT) AS doc, score FROM hits" + (f" ORDER BY score DESC, doc LIMIT {n}" if n else "")


def _terms(q: Query) -> tuple[list[tuple[str, str]], bool]:
    if isinstance(q, Term):
        return [(q.field, q.term)], False
    inner = [_terms(c.node)[0][0] for c in q.clauses]
    return inner, len(q.clauses) > 1 and q.clauses[0].occur is Occur.MUST


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql


def _search(name: str, c: Corpus, q: Query, n: int | None = 10, min_score: float | None = None) -> None:
    """A search whose result is (doc, score); ``n`` None: all hits."""
    terms, every = _terms(q)
    sql = _hits_sql(c, terms, every) + _top(None) + (f" WHERE score >= {min_score}" if min_score is not None else "") + (f" ORDER BY score DESC, doc LIMIT {n}" if n else "")
    _add(name, lambda spark, d: ops.search(index_of(spark, d, c), q, n, min_score).select("doc", "score"), sql)


_T = lambda *words: [Term("text", w) for w in words]

_search("search_term", DOCS, Term("text", "the"))
_search("search_term_rare", DOCS, Term("text", "licensed"))
_search("search_term_missing", DOCS, Term("text", "nosuchword"))
_search("search_all_hits", DOCS, Term("text", "of"), None)
_search("search_single_clause_must", DOCS, must(*_T("der")))
_search("search_should_2", DOCS, should(*_T("the", "of")))
_search("search_should_3", DOCS, should(*_T("the", "licensed", "der")))
_search("search_should_missing", DOCS, should(*_T("the", "nosuchword")))
_search("search_must_2", DOCS, must(*_T("the", "licensed")))
_search("search_must_3", DOCS, must(*_T("the", "of", "in")))
_search("search_must_missing_term", DOCS, must(*_T("the", "nosuchword")))
_search("search_duplicate_clause", DOCS, should(*_T("the", "the", "of")))
_search("search_duplicate_clause_must", DOCS, must(*_T("the", "the", "of")))
_search("search_nested_single", DOCS, Boolean(must(Term("text", "the")).clauses))
_search("search_case_sensitive_term", DOCS, Term("text", "The"))
_search("search_empty_boolean", DOCS, Boolean())
_search("search_keyword", DOCS, Term("lang", "fr"))
_search("search_keyword_and_text", DOCS, must(Term("lang", "en"), Term("text", "licensed")))
_search("search_min_score", DOCS, Term("text", "licensed"), None, 3.0)
_search("search_multi_segment", SPLIT, should(*_T("the", "der")))
_search("search_multi_segment_must", SPLIT, must(*_T("the", "of")))
_search("search_match", DOCS, match("text", "The licence, of the: WORK"))
_search("search_conversations", CHATS, must(Term("role", "assistant"), Term("text", "the")))
_search("search_pages", PAGES, should(Term("html", "article"), Term("html", "nicht")))
_search("search_benchmark", ITEMS, should(*_T("the", "in")), None)


_FIELDS = (Term("p_name", "widget"), Term("p_brand", "Brand#13"))
_search("search_multi_field_should", PARTS, should(*_FIELDS))
_search("search_multi_field_must", PARTS, must(*_FIELDS))

# The index's tables

_add(
    "tokenize",
    lambda spark, d: tables.positions(spark.read.parquet(f"{d}/documents.parquet").select(F.lit(0).alias("segment_id"), F.col("doc_id").alias("local_id"), "text"), Schema(("text",))).select(F.col("local_id").alias("doc_id"), F.col("position").cast("long").alias("position"), "term"),
    f"SELECT doc_id, CAST(unnest(range(0, len(t))) AS BIGINT) AS position, unnest(t) AS term FROM (SELECT doc_id, {analysis.tokens_sql('text')} AS t FROM documents)",
)
_add("term_frequencies", lambda spark, d: index_of(spark, d, DOCS).postings.select("field", "term", F.col("local_id").alias("doc_id"), "tf"), f"{_index_sql(DOCS)} SELECT field, term, id AS doc_id, tf FROM post")
_add(
    "doc_frequencies",
    lambda spark, d: index_of(spark, d, DOCS).term_stats.select("field", "term", "doc_freq"),
    f"{_index_sql(DOCS)} SELECT field, term, doc_freq FROM ts",
)
_add(
    "top_terms",
    lambda spark, d: index_of(spark, d, DOCS).term_stats.where("field = 'text'").select("term", "doc_freq").orderBy(F.desc("doc_freq"), "term").limit(100),
    f"{_index_sql(DOCS)} SELECT term, doc_freq FROM ts WHERE field = 'text' ORDER BY doc_freq DESC, term LIMIT 100",
)
_add("field_stats", lambda spark, d: ops.averages(index_of(spark, d, DOCS)).withColumn("average", F.round("average", 6)), f"{_index_sql(DOCS)} SELECT field, docs, tokens, round(average, 6) AS average FROM fs")
_add(
    "field_stats_by_segment",
    lambda spark, d: index_of(spark, d, SPLIT).field_stats.select("segment_id", "field", "doc_count", "sum_tf"),
    f"{_index_sql(SPLIT)} SELECT seg AS segment_id, field, count(*) AS doc_count, CAST(sum(len) AS BIGINT) AS sum_tf FROM len GROUP BY seg, field",
)
_add(
    "term_stats_by_segment",
    lambda spark, d: index_of(spark, d, SPLIT).term_stats.where("field = 'text'").select("segment_id", "term", "doc_freq"),
    f"{_index_sql(SPLIT)} SELECT seg AS segment_id, term, count(*) AS doc_freq FROM post WHERE field = 'text' GROUP BY seg, term",
)
_add("field_lengths", lambda spark, d: index_of(spark, d, DOCS).lengths.select("field", F.col("local_id").alias("doc_id"), "len", "len_q"), f"{_index_sql(DOCS)} SELECT field, id AS doc_id, len, CAST(len_q AS BIGINT) AS len_q FROM len")
_add(
    "length_quantised",
    lambda spark, d: spark.range(0, 200_000).select(F.col("id").alias("len"), analysis.quantise(F.col("id")).alias("len_q")),
    f"SELECT CAST(i AS BIGINT) AS len, CAST({analysis.quantise_sql('i')} AS BIGINT) AS len_q FROM range(0, 200000) AS r(i)",
)
_add("idf_table", lambda spark, d: ops.idfs(index_of(spark, d, DOCS)).select("field", "term", "doc_freq", F.round("idf", 6).alias("idf")), f"{_index_sql(DOCS)} SELECT field, term, doc_freq, round(idf, 6) AS idf FROM idf")
_add(
    "norm_table",
    lambda spark, d: ops.norms(index_of(spark, d, DOCS)).withColumn("norm", F.round("norm", 6)),
    f"{_index_sql(DOCS)} SELECT field, CAST(len_q AS BIGINT) AS len_q, round({scoring.norm_sql('len_q', 'average')}, 6) AS norm FROM (SELECT DISTINCT field, len_q FROM len) JOIN fs USING (field)",
)
_add(
    "global_upper_bounds",
    lambda spark, d: ops.idfs(index_of(spark, d, DOCS)).select("field", "term", F.round(scoring.bound(F.col("idf")), 6).alias("upper")),
    f"{_index_sql(DOCS)} SELECT field, term, round(idf * {scoring.K1 + 1}e0, 6) AS upper FROM idf",
)
_BLOCKS = f"""blocks AS (SELECT field, term, block, count(*) AS docs, min(id) AS first_id, max(id) AS last_id, max(tf) AS max_tf, CAST(min(len_q) AS BIGINT) AS min_len_q
  FROM (SELECT *, CAST(floor((row_number() OVER (PARTITION BY field, term ORDER BY id) - 1) / {tables.BLOCK}) AS BIGINT) AS block FROM post) GROUP BY field, term, block)"""
_BLOCK_COLUMNS = ["field", "term", "block", "docs", "first_id", "last_id", "max_tf", "min_len_q"]
_add("posting_blocks", lambda spark, d: tables.successive(index_of(spark, d, DOCS).postings).select(_BLOCK_COLUMNS), f"{_index_sql(DOCS)}, {_BLOCKS} SELECT * FROM blocks")
_add(
    "block_upper_bounds",
    lambda spark, d: ops.bounds(i := index_of(spark, d, DOCS), tables.successive(i.postings)).select("field", "term", "block", "upper"),
    f"{_index_sql(DOCS)}, {_BLOCKS} SELECT field, term, block, round({scoring.contribution_sql('idf', 'max_tf', scoring.norm_sql('min_len_q', 'average'))}, 6) AS upper FROM blocks JOIN idf USING (field, term)",
)

_HEADS = f"SELECT field, term, id >> {tables.BLOCK.bit_length() - 1} AS block, count(*) AS docs, min(id) AS first_id, max(id) AS last_id, max(tf) AS max_tf, CAST(min(len_q) AS BIGINT) AS min_len_q"
_FROM_POST = "FROM post JOIN idf USING (field, term) GROUP BY ALL"
_add(
    "stored_blocks",
    lambda spark, d: index_of(spark, d, DOCS).blocks.select(*_BLOCK_COLUMNS, F.round("impact", 9).alias("impact")),
    f"{_index_sql(DOCS)} {_HEADS}, round(max(tf / (len_q + average * ({1 - scoring.B}e0 / {scoring.B}e0))), 9) AS impact {_FROM_POST}",
)
_BOTH = should(*_T("the", "der"))
_add(
    "stored_block_bounds",
    lambda spark, d: ops.block_bounds(index_of(spark, d, DOCS), _BOTH).select("block", "docs", F.round("bound", 6).alias("bound")),
    f"""{_index_sql(DOCS)}, best AS (SELECT term, id >> {tables.BLOCK.bit_length() - 1} AS block, count(*) AS docs, max({scoring.contribution_sql("idf", "tf", scoring.norm_sql("len_q", "average"))}) AS upper
  FROM post JOIN idf USING (field, term) WHERE field = 'text' AND term IN ('the', 'der') GROUP BY ALL)
SELECT block, CAST(sum(docs) AS BIGINT) AS docs, round(sum(upper), 6) AS bound FROM best GROUP BY block""",
)


def _pruned(name: str, c: Corpus, q: Query, n: int = 10) -> None:
    """Like ``_search``, by the blocks that can hold one of the best."""
    terms, every = _terms(q)
    _add(name, lambda spark, d: ops.search_pruned(index_of(spark, d, c), q, n).select("doc", "score"), _hits_sql(c, terms, every) + _top(n))


_pruned("search_pruned_term", DOCS, Term("text", "the"))
_pruned("search_pruned_should", DOCS, should(*_T("the", "of", "licensed")))
_pruned("search_pruned_must", DOCS, must(*_T("the", "of", "in")))
_pruned("search_pruned_keyword", DOCS, Term("lang", "fr"), 50)
_pruned("search_pruned_missing", DOCS, must(*_T("the", "nosuchword")))
_pruned("search_pruned_multi_segment", SPLIT, should(*_T("the", "der")), 25)
_pruned("search_pruned_multi_field", PARTS, should(*_FIELDS))

# Lookups, stored values, deletes

_add("exact_values", lambda spark, d: ops.exact(index_of(spark, d, SPLIT), "lang", ["fr", "es", "xx"]).select("doc"), "SELECT DISTINCT ((doc_id % 4) << 32) | doc_id AS doc FROM documents WHERE lang IN ('fr', 'es', 'xx')")
_add(
    "exact_values_text",
    lambda spark, d: ops.exact(index_of(spark, d, DOCS), "text", ["licensed", "released"]).select("doc"),
    f"{_index_sql(DOCS)} SELECT DISTINCT id AS doc FROM post WHERE field = 'text' AND term IN ('licensed', 'released')",
)
_add(
    "global_doc_ids",
    lambda spark, d: index_of(spark, d, SPLIT).documents.select(ids.pack(F.col("segment_id"), F.col("local_id")).alias("doc")).select("doc", ids.segment_of(F.col("doc")).alias("seg"), ids.local_of(F.col("doc")).alias("id")),
    "SELECT ((doc_id % 4) << 32) | doc_id AS doc, doc_id % 4 AS seg, doc_id AS id FROM documents",
)
_add(
    "sortable_keys",
    lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.lower(F.hex(ids.sortable(F.col("doc_id")))).alias("key"), ids.number(ids.sortable(F.col("doc_id"))).alias("back")),
    "SELECT doc_id, lower(lpad(hex(doc_id), 16, '0')) AS key, doc_id AS back FROM documents",
)
_add(
    "stored_value_fetch",
    lambda spark, d: ops.fetch(i := index_of(spark, d, DOCS), ops.search(i, Term("text", "der")), "lang", "source", "n_chars").select("doc", "score", "lang", "source", "n_chars"),
    _hits_sql(DOCS, [("text", "der")]) + "SELECT doc, score, lang, source, n_chars FROM (SELECT * FROM hits ORDER BY score DESC, doc LIMIT 10) JOIN d USING (seg, id)",
)


def _deleted(spark: SparkSession, sf_dir: str, *steps: tuple[str, list[str]]) -> tables.Tables:
    """The documents' index after deletes, on a copy of its manifest."""
    key = (spark.sparkContext.applicationId, sf_dir, steps)
    if key not in _built:
        path = f"{shared.folder(spark)}/deleted-{len(_built)}"
        rows = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("number", F.col("doc_id"))
        w = Writer(spark, path, SPLIT.schema)
        for k in range(2):
            w.add(rows.where(F.col("number") % 2 == k), local_id="number")
        for field, values in steps:
            w.delete(field, list(values))
        _built[key] = path
    return open_index(spark, _built[key])


_ONCE = (("lang", ("fr",)),)
_TWICE = (("lang", ("fr",)), ("text", ("licensed",)), ("lang", ("nothing",)))
_HALVES = replace(SPLIT, segments=2)
_LICENSED = f"list_contains({analysis.tokens_sql('d.text')}, 'licensed')"
_Q = should(*_T("the", "der", "le"))
_QS = [("text", "the"), ("text", "der"), ("text", "le")]
_add("delete_then_search", lambda spark, d: ops.search(_deleted(spark, d, *_ONCE), _Q, 50).select("doc", "score"), _hits_sql(_HALVES, _QS, without="d.lang = 'fr'") + _top(50))
_add("delete_twice_then_search", lambda spark, d: ops.search(_deleted(spark, d, *_TWICE), _Q, 50).select("doc", "score"), _hits_sql(_HALVES, _QS, without=f"d.lang = 'fr' OR {_LICENSED}") + _top(50))
_add(
    "delete_then_value",
    lambda spark, d: ops.fetch(i := _deleted(spark, d, *_ONCE), ops.exact(i, "lang", ["fr"]), "lang", "n_chars").select("doc", "lang", "n_chars"),
    "SELECT ((doc_id % 2) << 32) | doc_id AS doc, lang, n_chars FROM documents WHERE lang = 'fr'",
)
_add(
    "deleted_documents",
    lambda spark, d: _deleted(spark, d, *_TWICE).deletes.select("segment_id", "local_id"),
    f"SELECT doc_id % 2 AS segment_id, doc_id AS local_id FROM documents d WHERE lang = 'fr' OR {_LICENSED}",
)
_add("exact_without_deleted", lambda spark, d: ops.exact(_deleted(spark, d, *_ONCE), "text", ["le", "licensed"], include_deleted=False).select("doc"), f"SELECT ((doc_id % 2) << 32) | doc_id AS doc FROM documents d WHERE lang <> 'fr' AND ({_LICENSED} OR list_contains({analysis.tokens_sql('d.text')}, 'le'))")

_add("delete_then_search_pruned", lambda spark, d: ops.search_pruned(_deleted(spark, d, *_TWICE), _Q, 50).select("doc", "score"), _hits_sql(_HALVES, _QS, without=f"d.lang = 'fr' OR {_LICENSED}") + _top(50))


def _compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after the folders of an index with deletes have been put into one."""
    path = f"{shared.folder(spark)}/compacted-{uuid.uuid4().hex[:8]}"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("number", F.col("doc_id"))
    w = Writer(spark, path, _HALVES.schema)
    for k in range(2):
        w.add(rows.where(F.col("number") % 2 == k), local_id="number")
    w.delete("lang", ["fr"])
    w.delete("text", ["licensed"])
    w.compact()
    w.vacuum()
    return ops.search(open_index(spark, path), _Q, 50).select("doc", "score")


_add("compact_then_search", _compacted, _hits_sql(_HALVES, _QS, without=f"d.lang = 'fr' OR {_LICENSED}") + _top(50))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader finds that opened the index before more was added and some deleted."""
    path = f"{shared.folder(spark)}/snapshot-{uuid.uuid4().hex[:8]}"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("number", F.col("doc_id"))
    w = Writer(spark, path, _HALVES.schema)
    w.add(rows.where("number % 2 = 0"), local_id="number")
    index = open_index(spark, path)
    w.add(rows.where("number % 2 = 1"), local_id="number")
    w.delete("lang", ["en"])
    return ops.search(index, Term("text", "the"), 50).select("doc", "score")


_EVEN = replace(SPLIT, table="(SELECT * FROM documents WHERE doc_id % 2 = 0)", segments=1)
_add("snapshot_then_search", _snapshot, _hits_sql(_EVEN, [("text", "the")]) + _top(50))


def _empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of an index to which nothing has been added."""
    return ops.search(open_index(spark, f"{shared.folder(spark)}/no-such-index"), Boolean(), 10).select("doc", "score")


_add("empty_index_search", _empty, "SELECT CAST(0 AS BIGINT) AS doc, 0.0e0 AS score WHERE false")


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a word, and their scores, after two micro-batches have become segments."""
    path = f"{shared.folder(spark)}/streamed-{uuid.uuid4().hex[:8]}"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = Writer(spark, path, Schema(("text",)))
    for k in range(2):
        rows.where(F.col("doc_id") % 2 == k).write.mode("append").parquet(f"{path}-in")
        append(spark.readStream.schema(rows.schema).parquet(f"{path}-in"), w, f"{path}-checkpoint", once=True).awaitTermination()
    index = open_index(spark, path)
    return ops.fetch(index, ops.search(index, Term("text", "licensed"), None), "doc_id").select("doc_id", "score")


_add("stream_then_search", _streamed, _hits_sql(DOCS, [("text", "licensed")]) + "SELECT doc AS doc_id, score FROM hits")

# Many queries at once, facets

_MANY: dict[str, Query] = {"common": Term("text", "the"), "either": should(*_T("the", "of")), "both": must(*_T("the", "licensed")), "german": match("text", "der die das"), "none": Term("text", "nosuchword")}


def _many_sql() -> str:
    rows = [f"('{k}', '{f}', '{t}', {ts.count((f, t))}, {len(set(ts)) if every else 1})" for k, q in _MANY.items() for ts, every in [_terms(q)] for f, t in sorted(set(ts))]
    return f"""{_index_sql(DOCS)},
hits AS (SELECT q.query, post.id AS doc, round(sum({_PART}), 6) AS score FROM (VALUES {", ".join(rows)}) AS q(query, field, term, weight, required)
  JOIN idf ON idf.field = q.field AND idf.term = q.term JOIN post ON post.field = q.field AND post.term = q.term GROUP BY q.query, post.id, q.required HAVING count(*) >= q.required)
SELECT query, CAST(rank AS INTEGER) AS rank, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM hits) WHERE rank <= 10"""


_add("search_many_topk", lambda spark, d: ops.search_many(index_of(spark, d, DOCS), _MANY).select("query", "rank", "doc", "score"), _many_sql())
_add("keyword_facets", lambda spark, d: ops.facets(index_of(spark, d, DOCS), Term("text", "licensed"), "lang"), _hits_sql(DOCS, [("text", "licensed")]) + "SELECT lang AS value, count(*) AS docs FROM hits JOIN d USING (seg, id) GROUP BY lang")

# Analyzers and queries of one's own, further tables

analysis.register("spaces", analysis.Analyzer(lambda text: F.filter(F.split(text, " "), lambda t: t != ""), lambda text: [t for t in text.split(" ") if t]))
SPACED = Corpus("part", Schema(("p_name",), ("p_brand",), (("p_name", "spaces"),)), "p_partkey")
_add("own_analyzer", lambda spark, d: index_of(spark, d, SPACED).term_stats.where("field = 'p_name'").select("term", "doc_freq"), "SELECT t AS term, count(*) AS doc_freq FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS t FROM part) WHERE t <> '' GROUP BY t")


@dataclass(frozen=True)
class AtLeast:
    """Documents that have some of the terms, at least so many."""

    field: str
    terms: tuple[str, ...]
    least: int

    def compiled(self, schema: Schema) -> Compiled:
        return Compiled(tuple((self.field, t, 1.0) for t in self.terms), self.least)


_add(
    "own_node",
    lambda spark, d: ops.search(index_of(spark, d, DOCS), AtLeast("text", ("the", "of", "licensed"), 2)).select("doc", "score"),
    _hits_sql(DOCS, [("text", t) for t in ("the", "of", "licensed")]).replace("count(*) >= 1", "count(*) >= 2") + _top(10),
)


def _extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A further table that is made of each segment: how many characters each language has."""
    path = f"{shared.folder(spark)}/extra-{uuid.uuid4().hex[:8]}"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("number", F.col("doc_id"))
    w = Writer(spark, path, _HALVES.schema, {"sizes": lambda docs: docs.groupBy("segment_id", "lang").agg(F.sum("n_chars").alias("chars"))})
    for k in range(2):
        w.add(rows.where(F.col("number") % 2 == k), local_id="number")
    return open_index(spark, path).extra["sizes"]


_add("extra_table", _extra, "SELECT doc_id % 2 AS segment_id, lang, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
_add(
    "invalid_utf8",
    lambda spark, d: spark.sql("SELECT CAST(X'41FF62632D64' AS STRING) AS t").select(F.explode(analysis.tokens(F.col("t"))).alias("term")),
    "SELECT unnest(['a\ufffdbc', 'd']) AS term",
)

# Sources


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts written as lines of one file and read again."""
    path = f"{shared.folder(spark)}/lines"
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").select(F.regexp_replace("text", r"[\r\n]+", " ")).coalesce(1).write.mode("overwrite").text(path)
    return readers.read_lines(spark, path).select("line_no", "text")


def _jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as lines of JSON, with lines that aren't, and read again."""
    path = f"{shared.folder(spark)}/jsonl"
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    lines = rows.select(F.to_json(F.struct("url", F.col("page_id").cast("string").alias("title"), F.col("html").alias("body"))).alias("value"))
    lines.unionByName(spark.createDataFrame([("{not json",), ("",)], "value string")).write.mode("overwrite").text(path)
    return readers.read_jsonl(spark, path)


def _key_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of every third key of a table, and of one that isn't there."""
    path = f"{shared.folder(spark)}/kv-{uuid.uuid4().hex[:8]}"
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = lambda n: F.encode(F.concat(F.lit("k"), n.cast("string")), "UTF-8")
    KeyValue.write(rows.select(key(F.col("doc_id")).alias("key"), F.encode("lang", "UTF-8").alias("value")), path)
    keys = rows.where("doc_id % 3 = 0").select(key(F.col("doc_id")).alias("key")).unionByName(spark.range(1).select(key(F.lit(-1)).alias("key")))
    return KeyValue(spark, path).get_many(keys).select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"))


_add("key_value_get", _key_value, "SELECT 'k' || doc_id AS key, lang AS value FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'k-1', NULL")
_add("lines_source", _lines, "SELECT row_number() OVER (ORDER BY item_id) - 1 AS line_no, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS text FROM benchmark")
_add("jsonl_roundtrip", _jsonl, "SELECT url, CAST(page_id AS VARCHAR) AS title, html AS body FROM pages")
