"""Postings of large batches of documents, in Arrow: counted where the documents lie, moved once, merged where they go.

What moves are pieces: a term's postings in ``CHUNK`` successive places, four
bytes each. They are sorted by (field, term, chunk) in parts of bounded size,
so that no sort has to spill, and whatever order the documents came in, the
pieces of a chunk meet and are cut into blocks of ``BLOCK`` places. An entry
holds the place in the chunk, a count and the length's byte; a count that is
too large for one is the sum of several.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import analysis, scoring
from ..plans.query import FieldType, Schema
from ..sources import shared
from .tables import BLOCK, POSTINGS, TERM_STATS, terms_of

#: Places of a piece: so many blocks that a worker's documents have few pieces of a term. An entry's place, count and length's byte take 13, 11 and 8 bits.
CHUNK = 64 * BLOCK
PLACE = 33 - CHUNK.bit_length()
#: The largest count of one entry.
MOST = (1 << PLACE - 8) - 1
#: Bytes of stored pieces that a task sorts.
PART = 8 << 20
#: Rows of pieces, and postings in blocks, that a worker gives at a time.
ROWS, ENTRIES = 100_000, 500_000
#: Tokens that a worker counts at a time, and bytes of text that stand for one before it is cut.
TOKENS, TOKEN = 4_000_000, 6

#: Rows, and postings, of a row group where workers write files.
GROUP_ROWS, GROUP_ENTRIES = 500_000, 2_000_000

PIECES = "segment_id long, field int, term string, chunk long, entries binary, lengths array<struct<local_id: long, len: long>>"
SUMS = "segment_id long, field string, term string, docs long, file string"
_KEY = ["field", "term", "chunk", "segment_id"]
_LENGTHS = np.array([analysis.decode_byte(b) for b in range(256)], dtype=np.int64)
_LIST = pa.list_(pa.struct([("local_id", pa.int64()), ("len", pa.int64())]))


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _packed(place: np.ndarray, tf: np.ndarray, length: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Entries, from each of ``starts`` to the next, as bytes."""
    ends = np.append(starts, len(tf))
    if len(tf) and tf.max() > MOST:
        times = (tf + MOST - 1) // MOST
        last = np.cumsum(times)
        place, length = np.repeat(place, times), np.repeat(length, times)
        rest = tf - (times - 1) * MOST
        tf = np.full(len(place), MOST)
        tf[last - 1] = rest
        ends = np.append(0, last)[ends]
    values = (place << PLACE | tf << 8 | length).astype(np.uint32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(values)])


def _batch(segment: np.ndarray, field: int | np.ndarray, term: pa.Array, chunk: np.ndarray, entries: pa.Array) -> Iterator[pa.RecordBatch]:
    n = len(chunk)
    fields = np.full(n, field, dtype=np.int32) if isinstance(field, int) else field.astype(np.int32)
    out = pa.record_batch([pa.array(segment), pa.array(fields), term, pa.array(chunk), entries, pa.nulls(n, _LIST)], ["segment_id", "field", "term", "chunk", "entries", "lengths"])
    for a in range(0, n, ROWS):
        yield out.slice(a, ROWS)


def _tokens(c: pa.Array) -> np.ndarray:
    """How many tokens each row has, about as many where it is text."""
    text = not pa.types.is_nested(c.type)
    n = pc.fill_null(pc.binary_length(c) if text else pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return -(-n // TOKEN) if text else n


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (local_id, each field) of up to ``TOKENS`` tokens, or of one row."""
    for b in batches:
        total = np.cumsum(sum(map(_tokens, b.columns[1:])))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + TOKENS, side="right")))
            yield b.slice(a, z - a)
            a = z


def _counted(batches: Iterator[pa.RecordBatch], segment: int, splits: list[Callable[[pa.Array], pa.ListArray] | None]) -> Iterator[pa.RecordBatch]:
    """Pieces, and lengths, of batches of (local_id, the terms of each field, or the text that its function in ``splits`` cuts)."""
    for b in _cut(batches):
        n = b.num_rows
        local = b.column(0).to_numpy()
        order = np.argsort(local, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        for k in range(b.num_columns - 1):
            lists = splits[k](b.column(k + 1)) if splits[k] else b.column(k + 1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            some = np.flatnonzero(sizes)
            if not len(some):
                continue
            pairs = pa.StructArray.from_arrays([pa.array(local[some]), pa.array(sizes[some])], ["local_id", "len"])
            yield pa.record_batch(
                [pa.array([segment], pa.int64()), pa.array([k], pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), pairs)],
                ["segment_id", "field", "term", "chunk", "entries", "lengths"],
            )
            words = lists.flatten().cast(pa.string()).dictionary_encode()
            key = np.repeat(rank, sizes)
            if words.null_count:
                known = words.is_valid().to_numpy(zero_copy_only=False)
                key, words = key[known], words.drop_null()
            key += words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n
            key.sort()
            first = _starts(key)
            tf = np.diff(np.append(first, len(key)))
            code, at = np.divmod(key[first], n)
            at = order[at]
            chunk, place = np.divmod(local[at], CHUNK)
            starts = _starts(code, chunk)
            length = np.searchsorted(_LENGTHS, sizes, side="right")[at] - 1
            term = words.dictionary.take(pa.array(code[starts]))
            yield from _batch(np.full(len(starts), segment), k, term, chunk[starts], _packed(place, tf, length, starts))


def _unblocked(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Pieces of batches of (segment_id, field, term, block, entries)."""
    for b in batches:
        if not b.num_rows:
            continue
        segment, block = b.column("segment_id").to_numpy(), b.column("block").to_numpy()
        field = pc.index_in(b.column("field"), pa.array(fields)).to_numpy(zero_copy_only=False)
        sizes = pc.list_value_length(b.column("entries")).to_numpy(zero_copy_only=False).astype(np.int64)
        local, tf, length = (b.column("entries").flatten().field(x).to_numpy(zero_copy_only=False) for x in ("local_id", "tf", "len_q"))
        length = np.searchsorted(_LENGTHS, length, side="right") - 1
        yield from _batch(segment, field, b.column("term").cast(pa.string()), block * BLOCK // CHUNK, _packed(local % CHUNK, tf, length, np.cumsum(sizes) - sizes))


def _blocks(b: pa.RecordBatch, starts: np.ndarray, fields: list[str], averages: dict[tuple[int, str], float]) -> Iterator[pa.RecordBatch]:
    """Blocks of whole chunks; each of ``starts`` is the first row of one."""
    entries = b.column("entries").cast(pa.binary())
    offsets = np.frombuffer(entries.buffers()[1], dtype=np.int32)[entries.offset : entries.offset + b.num_rows + 1].astype(np.int64)
    values = np.frombuffer(entries.buffers()[2], dtype=np.uint32, count=(offsets[-1] - offsets[0]) // 4, offset=offsets[0]).astype(np.int64)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(offsets[:-1][starts], offsets[-1])) // 4)
    key = group * CHUNK + (values >> PLACE)
    tf, length = values >> 8 & MOST, values & 255
    if np.any(key[1:] < key[:-1]):
        order = np.argsort(key, kind="stable")
        key, tf, length = key[order], tf[order], length[order]
    first = _starts(key)
    if len(first) < len(key):
        key, tf, length = key[first], np.add.reduceat(tf, first), length[first]
    length = _LENGTHS[length]
    group = key // CHUNK
    segment, field, chunk = (b.column(x).to_numpy()[starts].astype(np.int64) for x in ("segment_id", "field", "chunk"))
    local = chunk[group] * CHUNK + key % CHUNK
    head = _starts(key // BLOCK)
    ends = np.append(head, len(key))
    of = group[head]
    kinds, kind = np.unique(segment * len(fields) + field, return_inverse=True)
    average = np.array([averages[int(k) // len(fields), fields[int(k) % len(fields)]] for k in kinds])[kind][of]
    free = np.repeat(average * ((1 - scoring.B) / scoring.B), np.diff(ends))
    postings = pa.StructArray.from_arrays([pa.array(local), pa.array(tf), pa.array(length)], ["local_id", "tf", "len_q"])
    out = pa.record_batch(
        {
            "segment_id": pa.array(segment[of]),
            "field": pa.array(fields).take(pa.array(field[of])),
            "term": b.column("term").cast(pa.string()).take(pa.array(starts[of])),
            "block": pa.array(local[head] // BLOCK),
            "docs": pa.array(np.diff(ends)),
            "first_id": pa.array(local[head]),
            "last_id": pa.array(local[ends[1:] - 1]),
            "max_tf": pa.array(np.maximum.reduceat(tf, head)),
            "min_len_q": pa.array(np.minimum.reduceat(length, head)),
            "average_then": pa.array(average),
            "impact": pa.array(np.maximum.reduceat(tf / (length + free), head)),
            "entries": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), postings),
        }
    )
    a = 0
    while a < len(head):
        z = max(a + 1, int(np.searchsorted(ends, ends[a] + ENTRIES, side="right")) - 1)
        yield out.slice(a, z - a)
        a = z


def _merged(batches: Iterator[pa.RecordBatch], fields: list[str], averages: dict[tuple[int, str], float]) -> Iterator[pa.RecordBatch]:
    """Blocks of pieces that are sorted; the last chunk of a batch waits for the next."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        b = pa.Table.from_batches([held, b] if held else [b]).combine_chunks().to_batches()[0]
        term = b.column("term")
        other = np.append(True, pc.not_equal(term.slice(1), term.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)).cumsum()
        starts = _starts(other, *(b.column(x).to_numpy() for x in ("field", "chunk", "segment_id")))
        held = b.slice(starts[-1])
        if len(starts) > 1:
            yield from _blocks(b.slice(0, starts[-1]), starts[:-1], fields, averages)
    if held:
        yield from _blocks(held, np.array([0]), fields, averages)


def _stored(batches: Iterator[pa.RecordBatch], at: str, codec: str) -> Iterator[pa.RecordBatch]:
    """Write blocks into one file in ``at``, under a name that no other attempt has; rows of (segment_id, field, term, docs, file)."""
    name = f"part-{uuid.uuid4().hex}.parquet"
    path, writer = os.path.join(at, name), None
    held: list[pa.RecordBatch] = []
    try:
        for b in batches:
            held.append(b)
            if writer is None:
                writer = pq.ParquetWriter(path, b.schema, compression=codec, write_page_index=True)
            if sum(x.num_rows for x in held) >= GROUP_ROWS or sum(len(x.column("entries").flatten()) for x in held) >= GROUP_ENTRIES:
                writer.write_table(pa.Table.from_batches(held))
                held = []
            for x in _runs(iter([b.select(["segment_id", "field", "term", "docs"])])):
                yield pa.record_batch([*x.columns[:3], x.column(3), pa.array([name] * x.num_rows)], ["segment_id", "field", "term", "docs", "file"])
        if held:
            writer.write_table(pa.Table.from_batches(held))
    finally:
        if writer:
            writer.close()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``docs`` of successive rows of one term."""
    for b in batches:
        if not b.num_rows:
            continue
        changes = [np.append(True, pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)).cumsum() for c in b.columns[:3]]
        starts = _starts(*changes)
        kept = [c.take(pa.array(starts)) for c in b.columns[:3]]
        yield pa.record_batch([kept[0], *(c.cast(pa.string()) for c in kept[1:]), pa.array(np.add.reduceat(b.column(3).to_numpy(), starts))], ["segment_id", "field", "term", "doc_freq"])


def parts(df: DataFrame, size: int) -> int:
    """Into how many parts what is stored in ``size`` bytes goes: of bounded size, and if that is few, up to one for each core."""
    return max(1, -(-size // PART), min(df.sparkSession.sparkContext.defaultParallelism, size >> 20))


def counted(documents: DataFrame, schema: Schema, segment: int) -> DataFrame:
    """Pieces of a segment's documents; and rows that have ``lengths`` instead, of some documents each. Fields by number in ``schema.fields``."""
    shared.ship(documents.sparkSession)
    cuts = [analysis.analyzer(schema.analyzer_of(f)) if schema.type_of(f) is FieldType.TEXT else None for f in schema.fields]
    splits = [a.splitter(documents.sparkSession) if a and a.splitter else None for a in cuts]
    # Text goes to the worker as one value a row, not one a token.
    fields = [(a.prepared(F.col(f"`{f}`")) if a and a.splitter else terms_of(f, schema)).alias(f"f{k}") for k, (f, a) in enumerate(zip(schema.fields, cuts))]
    return documents.select("local_id", *fields).mapInArrow(lambda it: _counted(it, segment, splits), PIECES)


def unblocked(blocks: DataFrame, schema: Schema) -> DataFrame:
    """The pieces that blocks were made of."""
    shared.ship(blocks.sparkSession)
    fields = list(schema.fields)
    return blocks.select("segment_id", "field", "term", "block", "entries").mapInArrow(lambda it: _unblocked(it, fields), PIECES)


def lengths(counted_: DataFrame, schema: Schema) -> DataFrame:
    """(segment_id, field, local_id, len, len_q); reads no postings."""
    name = F.element_at(F.array(*map(F.lit, schema.fields)), F.col("field") + 1)
    rows = counted_.where(F.col("lengths").isNotNull()).select("segment_id", name.alias("field"), F.inline("lengths"))
    return rows.withColumn("len_q", analysis.quantise(F.col("len")))


def merged(pieces: DataFrame, schema: Schema, field_stats: DataFrame, n: int) -> DataFrame:
    """Blocks, sorted by field, term and block, from pieces, by one exchange into ``n`` parts."""
    return _parts(pieces, schema, field_stats, n, lambda it: it, POSTINGS)


def stored(pieces: DataFrame, schema: Schema, field_stats: DataFrame, n: int, at: str, codec: str) -> DataFrame:
    """The same, written by the workers to a folder ``at`` that all of them mount; when it runs, a file for each part.

    There are many more blocks than terms, and Spark's rows of them cost most of
    the time. What is returned is (segment_id, field, term, docs, file): sums over
    some of a term's blocks, and the name of the file that has them. A task
    that is repeated leaves a file that no row of the last attempt names.
    """
    return _parts(pieces, schema, field_stats, n, lambda it: _stored(it, at, codec), SUMS)


def _parts(pieces: DataFrame, schema: Schema, field_stats: DataFrame, n: int, then: Callable, kind: str) -> DataFrame:
    shared.ship(pieces.sparkSession)
    fields = list(schema.fields)
    # As many rows as there are segments and fields.
    averages = {(r["segment_id"], r["field"]): r["sum_tf"] / r["doc_count"] for r in field_stats.collect()}
    rows = pieces.where(F.col("term").isNotNull()).select("segment_id", "field", "term", "chunk", "entries")
    rows = rows.repartitionByRange(n, *_KEY[:3]).sortWithinPartitions(*_KEY)
    return rows.mapInArrow(lambda it: then(_merged(it, fields, averages)), kind)


def term_stats(blocks: DataFrame, n: int) -> DataFrame:
    """(segment_id, field, term, doc_freq) from sorted blocks or their sums: what moves is a row for each term and task."""
    shared.ship(blocks.sparkSession)
    sums = blocks.select("segment_id", "field", "term", "docs").mapInArrow(_runs, TERM_STATS)
    return sums.repartition(n, "field", "term").groupBy("segment_id", "field", "term").agg(F.sum("doc_freq").alias("doc_freq"))
