"""The tables of an index, made from documents.

Documents have ``segment_id`` and ``local_id``. A document's terms are counted
in its own row, so what moves is one row a posting; and postings are kept in
blocks, one row for each term and each ``BLOCK`` successive places, with what a
search needs to know whether it may skip the block.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analysis, scoring
from ..plans.query import FieldType, Schema

#: Documents of a block of postings; a power of two.
BLOCK = 1 << 7

POSTINGS = "segment_id long, field string, term string, block long, docs long, first_id long, last_id long, max_tf long, min_len_q long, average_then double, impact double, entries array<struct<local_id: long, tf: long, len_q: long>>"
LENGTHS = "segment_id long, field string, local_id long, len long, len_q long"
TERM_STATS = "segment_id long, field string, term string, doc_freq long"
FIELD_STATS = "segment_id long, field string, doc_count long, sum_tf long"


@dataclass(frozen=True)
class Tables:
    """
    documents      segment_id, local_id and all columns
    blocks         segment_id, field, term, block, docs, first_id, last_id, max_tf, min_len_q, average_then, impact, entries
    term_stats     segment_id, field, term, doc_freq
    field_stats    segment_id, field, doc_count, sum_tf
    lengths        segment_id, field, local_id, len, len_q
    deletes        segment_id, local_id; None where nothing has been deleted
    tombstones     how many rows ``deletes`` has, if that is known
    extra          tables that the schema's hooks have made, by name
    """

    schema: Schema
    documents: DataFrame
    blocks: DataFrame
    term_stats: DataFrame
    field_stats: DataFrame
    lengths: DataFrame
    deletes: DataFrame | None = None
    tombstones: int | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)
    flat: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        """segment_id, field, term, local_id, tf, len_q"""
        if self.flat is not None:
            return self.flat
        return self.blocks.select("segment_id", "field", "term", F.inline("entries"))


def terms_of(name: str, schema: Schema) -> Column:
    """A field's terms in order; a null field has none."""
    value = F.col(f"`{name}`")
    if schema.type_of(name) is FieldType.TEXT:
        return analysis.analyzer(schema.analyzer_of(name)).column(value)
    return F.when(value.isNull(), F.array().cast("array<string>")).otherwise(F.array(value.cast("string")))


def analysed(documents: DataFrame, schema: Schema) -> DataFrame:
    """(segment_id, local_id, field, terms, len): each document's fields."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), terms_of(f, schema).alias("terms")) for f in schema.fields))
    rows = documents.select("segment_id", "local_id", F.explode(fields).alias("f"))
    return rows.select("segment_id", "local_id", "f.field", "f.terms", F.size("f.terms").cast("long").alias("len"))


def positions(documents: DataFrame, schema: Schema) -> DataFrame:
    """(segment_id, local_id, field, position, term) of every token."""
    return analysed(documents, schema).select("segment_id", "local_id", "field", F.posexplode("terms").alias("position", "term"))


def forward(documents: DataFrame, schema: Schema) -> DataFrame:
    """(segment_id, field, local_id, len, len_q, terms): each field's length and its terms with their counts.

    Counted within the row: the sorted tokens are cut where they change.
    """
    rows = analysed(documents, schema).where("len > 0").withColumn("terms", F.sort_array("terms"))
    first = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    rows = rows.withColumn("first", first)
    entry = lambda at, k: F.struct(F.get("terms", at).alias("term"), (F.coalesce(F.get("first", k + 1), F.size("terms")) - at).cast("long").alias("tf"))
    return rows.select("segment_id", "field", "local_id", "len", analysis.quantise(F.col("len")).alias("len_q"), F.transform("first", entry).alias("terms"))


def lengths(forward_: DataFrame) -> DataFrame:
    return forward_.select("segment_id", "field", "local_id", "len", "len_q")


def flat(forward_: DataFrame) -> DataFrame:
    """(segment_id, field, term, local_id, tf, len_q): a row for each posting."""
    return forward_.select("segment_id", "field", "local_id", "len_q", F.inline("terms")).select("segment_id", "field", "term", "local_id", "tf", "len_q")


def field_stats(lengths_: DataFrame) -> DataFrame:
    return lengths_.groupBy("segment_id", "field").agg(F.count("*").alias("doc_count"), F.sum("len").alias("sum_tf"))


def term_stats(blocks_: DataFrame) -> DataFrame:
    return blocks_.groupBy("segment_id", "field", "term").agg(F.sum("docs").alias("doc_freq"))


def stored(postings: DataFrame, field_stats_: DataFrame) -> DataFrame:
    """Postings in blocks of ``BLOCK`` successive places, so that blocks of different terms cover the same documents.

    ``impact`` is the largest part of a score in the block, for the average
    length at this time. One exchange, by ranges of (field, term, block): the
    most frequent term is spread over as many tasks as it needs.
    """
    # As many rows as the schema has fields.
    average = field_stats_.groupBy("field").agg((F.sum("sum_tf") / F.sum("doc_count")).alias("average_then"))
    rows = postings.withColumn("block", F.shiftright("local_id", BLOCK.bit_length() - 1)).repartitionByRange("field", "term", "block")
    rows = rows.groupBy("field", "term", "block", "segment_id").agg(
        F.count("*").alias("docs"),
        F.min("local_id").alias("first_id"),
        F.max("local_id").alias("last_id"),
        F.max("tf").alias("max_tf"),
        F.min("len_q").alias("min_len_q"),
        F.sort_array(F.collect_list(F.struct("local_id", "tf", "len_q"))).alias("entries"),
    )
    rows = rows.join(F.broadcast(average), "field")
    impact = F.array_max(F.transform("entries", lambda e: scoring.impact(e["tf"], e["len_q"], F.col("average_then"))))
    return rows.withColumn("impact", impact).select("segment_id", "field", "term", "block", "docs", "first_id", "last_id", "max_tf", "min_len_q", "average_then", "impact", "entries")


def successive(postings_: DataFrame) -> DataFrame:
    """Blocks of ``BLOCK`` successive postings of a term, whatever their places: first and last document, largest tf, least length."""
    place = F.row_number().over(Window.partitionBy("segment_id", "field", "term").orderBy("local_id"))
    rows = postings_.withColumn("block", F.floor((place - 1) / BLOCK).cast("long"))
    return rows.groupBy("segment_id", "field", "term", "block").agg(
        F.count("*").alias("docs"), F.min("local_id").alias("first_id"), F.max("local_id").alias("last_id"), F.max("tf").alias("max_tf"), F.min("len_q").alias("min_len_q")
    )


def build(documents: DataFrame, schema: Schema) -> Tables:
    """All tables, unwritten; for small inputs and tests. ``Writer`` keeps them."""
    f = forward(documents, schema)
    n, p = lengths(f), flat(f)
    s = field_stats(n)
    terms = p.groupBy("segment_id", "field", "term").agg(F.count("*").alias("doc_freq"))
    return Tables(schema, documents, stored(p, s), terms, s, n, flat=p)
