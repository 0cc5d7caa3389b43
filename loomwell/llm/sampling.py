"""Bounded samples of labelled rows, chosen by a hash of the id and so the same every time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_order(id_col: str) -> Column:
    return F.xxhash64(F.lit("sample"), F.col(id_col))


def labelled_sample(rows: DataFrame, id_col: str, bound: int) -> DataFrame:
    """At most about ``bound`` of the distinct ids in ``rows`` (a narrow frame).

    An id is taken when its hash lies below the share of the range that gives ``bound`` ids
    (all, if there are no more than that). The count is the only thing the driver learns.
    """
    ids = rows.groupBy(id_col).agg(*[F.max(c).alias(c) for c in rows.columns if c != id_col])
    n = ids.count()
    if n <= bound:
        return ids
    share = int(bound / n * (1 << 62))
    return ids.where(hash_order(id_col).bitwiseAND(F.lit((1 << 62) - 1)) < share)


def bounded_texts(rows: DataFrame, id_col: str, most_chars: int):
    """The rows (with ``text``) as an Arrow table in the order of ids, of about ``most_chars`` characters at most.

    Where the rows have more, a share of their ids by hash is taken, so that what reaches the
    driver is bounded in bytes, too. A single text above the bound is never taken.
    """
    size = F.length("text")
    total = rows.agg(F.sum(size)).first()[0] or 0
    if total > most_chars:
        share = int(most_chars / total * (1 << 62))
        rows = rows.where((size <= most_chars) & (F.xxhash64(F.lit("bytes"), F.col(id_col)).bitwiseAND(F.lit((1 << 62) - 1)) < share))
    taken = rows.toArrow()
    return taken.sort_by([(c, "ascending") for c in taken.column_names])
