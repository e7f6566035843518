"""Global document ids: the segment in the upper 32 bits, the place in it in the lower; and sortable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(segment: Column, local: Column) -> Column:
    return F.shiftleft(segment.cast("long"), 32).bitwiseOR(local.cast("long"))


def segment_of(doc: Column) -> Column:
    return F.shiftright(doc, 32)


def local_of(doc: Column) -> Column:
    return doc.bitwiseAND(F.lit((1 << 32) - 1))


def sortable(number: Column, size: int = 8) -> Column:
    """A number that isn't negative as ``size`` big-endian bytes, which sort like it."""
    return F.unhex(F.lpad(F.hex(number), 2 * size, "0"))


def number(key: Column) -> Column:
    """The inverse of ``sortable``."""
    return F.conv(F.hex(key), 16, 10).cast("long")
