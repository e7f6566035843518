"""BM25 in parts, as Column expressions and as DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Decimal places of a score; documents are ordered by the rounded one.
PLACES = 6


def idf(docs: Column, doc_freq: Column) -> Column:
    return F.log(1 + (docs - doc_freq + 0.5) / (doc_freq + 0.5))


def norm(length: Column, average: Column) -> Column:
    """What a field's (quantised) length adds to the denominator."""
    return K1 * (1 - B + B * F.try_divide(length, average))


def contribution(idf_: Column, tf: Column, norm_: Column) -> Column:
    return idf_ * tf * (K1 + 1) / (tf + norm_)


def bound(idf_: Column) -> Column:
    """What no contribution of a term exceeds."""
    return idf_ * (K1 + 1)


def _free(average: Column) -> Column:
    """The length that a field of no length seems to have."""
    return average * ((1 - B) / B)


def impact(tf: Column, length: Column, average: Column) -> Column:
    """Of postings of one term the one with the larger impact contributes more; see ``impact_bound``."""
    return tf / (length + _free(average))


def impact_bound(idf_: Column, impact_: Column, then: Column, now: Column, max_tf: Column, min_length: Column) -> Column:
    """What no posting of a block contributes more than, from the block's largest impact at the average length ``then``.

    tf / (tf + norm) is 1 / (1 + K1 * B / average / impact). The impact of a
    posting changes with the average by the factor (length + free then) /
    (length + free now), at most that of the shortest one, or 1.
    """
    grown = impact_ * F.greatest(F.lit(1.0), (min_length + _free(then)) / (min_length + _free(now)))
    most = F.least(grown, impact(max_tf, min_length, now))
    return idf_ * (K1 + 1) / (1 + K1 * B / now / most)


def idf_sql(docs: str, doc_freq: str) -> str:
    return f"ln(1 + ({docs} - {doc_freq} + 0.5e0) / ({doc_freq} + 0.5e0))"


def norm_sql(length: str, average: str) -> str:
    return f"({K1}e0 * ({1 - B}e0 + {B}e0 * {length} / {average}))"


def contribution_sql(idf_: str, tf: str, norm_: str) -> str:
    return f"({idf_} * {tf} * {K1 + 1}e0 / ({tf} + {norm_}))"
