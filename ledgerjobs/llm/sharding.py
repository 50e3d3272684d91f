"""Sharding by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import math
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import attach
from .common import Workspace, one_by_one


class CapacityTree:
    """A balanced search tree (treap) of (remaining capacity, bin)."""

    def __init__(self):
        self.root = None

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] > high[1]:
            return [low[0], low[1], low[2], self._merge(low[3], high)]
        return [high[0], high[1], self._merge(low, high[2]), high[3]]

    def add(self, remaining: int, number: int) -> None:
        low, high = self._split(self.root, (remaining, number))
        node = [(remaining, number), crc32(b"%d" % number), None, None]
        self.root = self._merge(self._merge(low, node), high)

    def take(self, size: int):
        """Remove and return the bin with the least remaining capacity that holds ``size``, else None."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        first = high
        while first[2] is not None:
            first = first[2]
        one, rest = self._split(high, (first[0][0], first[0][1] + 1))
        self.root = self._merge(low, rest)
        return first[0]


def best_fit(runs: list[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """Places runs (size, how many of it), sizes in descending order: (run, how many, bin) in order; None once more than ``most`` bins are open.

    Each item enters the bin with the least remaining capacity that holds it, of equal ones the
    first. A bin that took an item stays the tightest for the next of the same size while it
    holds one more, so as many of a run as fit are placed in one step. A size above the
    capacity gets a bin of its own.
    """
    tree, opened, placed = CapacityTree(), 0, []
    for run, (size, left) in enumerate(runs):
        while left:
            found = tree.take(size)
            if found is None:
                if opened == most:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            some = min(left, found[0] // size)
            placed.append((run, some, found[1]))
            tree.add(found[0] - some * size, found[1])
            left -= some
    return placed


def pack(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Bins 0 to ``shards`` - 1 of near equal content: the smallest capacity for which best fit needs no more.

    Runs (size, how many) descend in size. An item larger than an equal share of what is left has a bin alone.
    """
    total, bins, placed, rest = sum(s * n for s, n in runs), 0, [], []
    for run, (size, left) in enumerate(runs):
        while left and not rest and bins < shards - 1 and size * (shards - bins) > total:
            placed.append((run, 1, bins))
            total, bins, left = total - size, bins + 1, left - 1
        if left:
            rest.append((run, size, left))
    sized = [(size, left) for _, size, left in rest]
    low = max([math.ceil(total / (shards - bins)), *[size for size, _ in sized[:1]]])
    high, best = low, None
    while (best := best_fit(sized, high, shards - bins)) is None:
        high += max(1, low // 64)
    for _ in range(12):
        middle = (low + high) // 2
        if middle >= high:
            break
        if (found := best_fit(sized, middle, shards - bins)) is None:
            low = middle + 1
        else:
            high, best = middle, found
    return placed + [(rest[i][0], some, bins + b) for i, some, b in best]


def size_class(size: str, digits: int) -> str:
    """SQL of a positive whole number rounded up to ``digits`` binary digits; smaller numbers stay."""
    unit = f"shiftleft(1L, greatest(length(bin({size})) - {digits}, 0))"
    return f"(({size} + {unit} - 1) div {unit}) * {unit}"


def placement(spark: SparkSession, runs: list[tuple[int, int]], placed: list[tuple[int, int, int]]) -> DataFrame:
    """(class, upto, bins): per size class its bins in turn, and up to which of its groups each is for."""
    upto, bins = [[] for _ in runs], [[] for _ in runs]
    for run, some, number in placed:
        upto[run].append((upto[run][-1] if upto[run] else 0) + some)
        bins[run].append(number)
    return spark.createDataFrame([(size, u, b) for (size, _), u, b in zip(runs, upto, bins, strict=True)], "class long, upto array<long>, bins array<int>")


def running(df: DataFrame, keys: list[str], slice_: str, order: list[str], n: Column) -> DataFrame:
    """Adds ``before``: the sum of ``n`` over the rows of the same ``keys`` that come earlier by ``slice_``, then ``order``.

    Rows of one slice are sorted in one task, slices are only summed up.
    """
    counts = df.groupBy(*keys, slice_).agg(F.sum(n).alias("in_slice"))
    earlier = F.sum("in_slice").over(Window.partitionBy(*keys).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1))
    sums = counts.select(*keys, slice_, F.coalesce(earlier, F.lit(0)).alias("slices_before"))
    inside = F.sum(n).over(Window.partitionBy(*keys, slice_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - n
    return df.withColumn("inside", inside).join(sums, [*keys, slice_]).withColumn("before", F.col("slices_before") + F.col("inside"))


def shard(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    shards: int | None = 16,
    capacity: int | None = None,
    digits: int = 16,
    rows_per_slice: int = 50_000,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Equal texts form a group, which no shard boundary cuts. All groups are packed by size: the
    driver gets how many groups there are of each size class and places them by
    best-fit-decreasing; where a class is dealt over several bins, its groups are counted off
    in order of their digests. A class is one size up to 2 ** ``digits`` bytes; larger sizes are
    rounded up to ``digits`` binary digits, so there are at most (48 - ``digits``) * 2 **
    (``digits`` - 1) + 2 ** ``digits`` classes (1.1 million by default), however many groups.
    Law ``bytes``: sizes of shards near equal, as far as a single group does not exceed a
    shard's share (then it has one alone). With ``capacity`` in bytes instead of ``shards``, as
    few shards of that capacity as best fit finds; the driver then also holds a number per shard.

    ``slot`` numbers a shard's rows from 0 without gaps: by slices of a hash of (doc_id, text),
    then by both. Rows that are alike in both are counted before anything is sorted, so neither
    a text nor an id with a third of all rows needs a task of its own.
    Null texts count as empty: size 1, one group. Null ids and repeated rows get slots of
    their own; groups with more than one in 10,000 rows are broadcast, so that they meet no
    shuffle. An empty table gives an empty result.
    """
    spark, space = docs.sparkSession, Workspace(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    one = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.unhex(F.md5(body)).alias("g"))
    rows = space.stage(one.groupBy("doc_id", "g", "size", "text_crc32").agg(F.count("*").alias("n")), "rows")
    count, largest = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    groups = space.stage(rows.groupBy("g").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.count("*").alias("rows")).select("g", "rows", F.expr(size_class("bytes", digits)).alias("class")), "groups")
    runs = sorted(((r["class"], r["count"]) for r in groups.groupBy("class").count().collect()), reverse=True)
    placed = pack(runs, shards) if shards else best_fit(runs, capacity)
    dealt = groups.join(space.stage(placement(spark, runs, placed), "placement"), "class")
    whole = dealt.where(F.size("bins") == 1).select("g", "rows", F.col("bins")[0].alias("shard"))
    slices = max(1, math.ceil(sum(n for _, n in runs) / rows_per_slice))
    split = running(dealt.where(F.size("bins") > 1).withColumn("slice", F.pmod(F.xxhash64("g"), F.lit(slices))), ["class"], "slice", ["g"], F.lit(1))
    turn = F.size(F.filter("upto", lambda u: u <= F.col("before"))) + 1
    of_group = space.stage(whole.union(split.select("g", "rows", F.element_at("bins", turn).alias("shard"))), "of_group")
    slices = max(1, math.ceil(count / rows_per_slice))
    at = attach(rows, of_group, ["g"], "rows").withColumn("slice", F.pmod(F.xxhash64("doc_id", "g"), F.lit(slices)))
    numbered = one_by_one(running(at, ["shard"], "slice", ["doc_id", "g"], F.col("n")), "n", "k", rows_per_slice, largest)
    out = numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("k") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    out = space.stage(out, "shards")
    space.drop(out)
    return out
