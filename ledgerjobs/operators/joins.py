"""Joins to a table with one row per key that no frequent key slows down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, *, most: int = 10_000) -> DataFrame:
    """``rows`` with the columns of ``table`` (unique by ``keys``, which holds all keys of ``rows``) but for ``weight``.

    ``weight`` is how many of ``rows`` have the key. Keys with more than one part in ``most`` of
    all rows, which are fewer than ``most``, are broadcast, and so is a table of no more rows;
    the rest is joined by a shuffle in which each key is rare. Both inputs are read more than
    once and should be written tables. Null keys do not match; wrap what may be null in a struct.
    """
    size, total = table.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    slim = table.drop(weight)
    if size <= most:
        return rows.join(F.broadcast(slim), keys)
    often = F.col(weight).cast("decimal(38,0)") * most > F.lit(total)
    heavy = table.where(often).drop(weight)
    light = table.where(~often).drop(weight)
    rare = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rare.hint("merge").join(light, keys))
