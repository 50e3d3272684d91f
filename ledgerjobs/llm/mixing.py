"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import small
from .common import Workspace, one_by_one, packed, spread, word_count


def source_targets(sources: DataFrame, weights=(5, 2, 1), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """Words that each source is to give: ``sources`` has (source, source_size), one row each.

    Sources by code point, null last, get ``weights`` in turn and divide ``share`` times all
    words; no target exceeds ``max_repeats`` times its source, and what is cut off goes to the
    others by weight. In the order of cap / weight the capped ones come first, so running sums
    over the table of sources (a row for each source, nothing per document) find the level.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn(
        "w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)
    )
    ranked = (
        ranked.withColumn("cap", F.col("source_size").cast("double") * F.lit(float(max_repeats)))
        .withColumn("level_at", F.col("cap") / F.col("w"))
        .withColumn("budget", F.sum("source_size").over(everything).cast("double") * F.lit(float(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", (F.col("budget") - F.col("cap_before")) / F.col("w_left") * F.col("w") >= F.col("cap"))
    )
    left = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    taken = F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    level = (F.col("budget") - taken) / left
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("w")).alias("target"), "budget")


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=(5, 2, 1),
    share: float = 1.5,
    max_repeats: int = 2,
    rows_per_bucket: int = 20_000,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    A document's order in its source is that of (md5(doc_id), doc_id, size), a fixed shuffle. Its n-th copy
    finishes at ((n - 1) * source_size + words of its source up to and with it) / target; all
    copies of all sources stand in one queue by finish time, cut where the words reach the
    budget. Both running sums are taken over slices of the sorted range: sums by slice, then
    rows within a slice, so neither a source nor an id with a third of all rows needs a task of its own.

    Null or empty texts have size 0 and take nothing; null sources are one source; documents
    that tie in (md5, doc_id, size) are alike in every column returned and counted before they
    are sorted; an id that many rows share is sliced by size; repeated rows count each; an empty table gives an empty result. ``extra`` are further columns of ``docs`` to carry, which also break such ties.
    """
    space = Workspace(docs.sparkSession)
    extra = extra or {}
    base = space.stage(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            word_count(F.col(text)).alias("size"),
            F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("key"),
            *[c.alias(n) for n, c in extra.items()],
        ),
        "sizes",
    )
    # rows that tie in all of the order are one row with a count
    base = space.stage(base.groupBy(*base.columns).agg(F.count("*").alias("rows")), "counted")
    n, largest = base.agg(F.count("*"), F.coalesce(F.max("rows"), F.lit(0))).first()
    slices = max(1, math.ceil(n / rows_per_bucket))
    base = base.withColumn("of_key", spread(F.col("key"), slices))
    # an id that fills a slice by itself is sliced by size, what lies before and after it in its slice is apart
    often = base.groupBy("of_key", "key").count().where(F.col("count") > rows_per_bucket)
    often = space.stage(often.groupBy("of_key").agg(F.sort_array(F.collect_list("key")).alias("often")), "often")
    base = base.join(small(often), "of_key", "left")
    at = F.coalesce(F.array_max(F.filter("often", lambda k: k <= F.col("key"))), F.lit(""))
    base = base.withColumn("slice", F.struct("of_key", at.alias("at"), (at != F.col("key")).alias("beyond"), F.when(at == F.col("key"), F.col("size")).otherwise(0).alias("of_size"))).drop("often", "of_key")
    sums = space.stage(base.groupBy("source", "slice").agg(F.sum(F.col("size") * F.col("rows")).alias("words")), "slices")
    targets = space.stage(source_targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_repeats), "targets")
    before = sums.select(
        F.col("source").alias("b_source"),
        F.col("slice").alias("b_slice"),
        F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    before = before.join(t, F.col("b_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", *extra).rowsBetween(Window.unboundedPreceding, -1)
    queued = base.withColumn("within", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(inside), F.lit(0))).join(before, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("slice") == F.col("b_slice")))
    queued = one_by_one(queued, "rows", "nth", rows_per_bucket, largest).withColumn("within", F.col("within") + F.col("nth") * F.col("size"))
    finish = [
        F.when(F.col("size") > 0, (F.lit(r) * F.col("source_size") + F.col("before") + F.col("within")).cast("double") / F.col("target"))
        for r in range(max_repeats)
    ]
    queued = space.stage(queued.select("doc_id", "size", "source_size", "target", F.array(*finish).alias("finish"), *extra), "queue")
    cut = _cut(queued, targets, slices)
    copies = F.size(F.filter("finish", lambda f: f <= F.lit(cut)))
    out = queued.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"), *extra)
    space.drop(queued)
    return out


def _cut(queued: DataFrame, targets: DataFrame, slices: int) -> float:
    """The last finish time up to which all copies together stay within the budget."""
    row = targets.select("budget").first()
    if row is None or not row[0]:
        return math.inf
    budget = row[0]
    entries = queued.select("size", F.explode("finish").alias("f")).where("f is not null").withColumn("slot", F.least(F.floor(F.col("f") * slices), F.lit(4 * slices)).cast("long"))
    running = F.sum("words").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0))
    slots = entries.groupBy("slot").agg(F.sum("size").alias("words")).withColumn("upto", running)
    first = slots.where(F.col("upto") > budget).orderBy("slot").select("slot", (F.col("upto") - F.col("words")).alias("done")).first()
    if first is None:
        return math.inf
    within = entries.where(F.col("slot") == first["slot"]).groupBy("f").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(first["done"])
    last = within.withColumn("upto", upto).where(F.col("upto") <= budget).agg(F.max("f")).first()[0]
    # none of this slot fits: the cut lies before it
    return last if last is not None else first["slot"] / slices - 1e-12


def repeated(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", max_repeats: int = 2, **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with the same columns.

    Only sizes, ids and hashes of texts go through the queue. Finish times rise with (md5,
    doc_id, size, hash) in a source, so for each source and copy the first place that is not
    taken tells all rows; the rows meet a table of one row per source and do not move. Of rows of
    equal id and text that tie at such a place as many are taken as the queue takes there; only
    these are grouped, and equal ones counted. Rows without words are not taken; an empty table gives an empty one.
    """
    space = Workspace(docs.sparkSession)
    queued = mix(docs, doc_id=doc_id, text=text, source=source, max_repeats=max_repeats, extra={"src": F.col(source).cast("string"), "mark": F.xxhash64(F.col(text))}, **options)

    def place(id_: Column, mark: Column) -> Column:
        key = F.md5(F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))
        return F.struct(key.alias("key"), id_.alias("id"), F.col("size"), mark.alias("mark"))

    here = place(F.col("doc_id"), F.col("mark"))
    ends = [F.min(F.when((F.col("size") > 0) & (F.col("copies") <= r), here)).alias(f"end{r}") for r in range(max_repeats)]
    ends = queued.groupBy(F.col("src").alias("e_source")).agg(*ends)
    # how many of those that tie at an end are taken all the same
    at_end = queued.join(ends, F.col("src").eqNullSafe(F.col("e_source")))
    left = [F.sum(F.when((here == F.col(f"end{r}")) & (F.col("copies") > r), 1).otherwise(0)).alias(f"left{r}") for r in range(max_repeats)]
    ends = space.stage(at_end.groupBy("e_source", *[f"end{r}" for r in range(max_repeats)]).agg(*left), "ends")
    rows = packed(docs).withColumn("size", word_count(F.col(f"row.`{text}`"))).where("size > 0")
    rows = rows.withColumn("place", place(F.col(f"row.`{doc_id}`"), F.xxhash64(F.col(f"row.`{text}`"))))
    rows = rows.join(ends, F.col(f"row.`{source}`").cast("string").eqNullSafe(F.col("e_source")))
    copies = sum((F.when(F.col(f"end{r}").isNull() | (F.col("place") < F.col(f"end{r}")), 1).otherwise(0) for r in range(max_repeats)), F.lit(0))
    out = rows.select(F.explode(F.array_repeat("row", copies)).alias("row"))
    most = ends.agg(*[F.coalesce(F.max(f"left{r}"), F.lit(0)) for r in range(max_repeats)]).first()
    for r in range(max_repeats):
        if most[r]:
            tied = rows.where((F.col("place") == F.col(f"end{r}")) & (F.col(f"left{r}") > 0)).groupBy("e_source", f"left{r}", "row").agg(F.count("*").alias("n"))
            before = F.sum("n").over(Window.partitionBy("e_source").orderBy(F.xxhash64(F.to_json("row")), "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
            taken = F.greatest(F.least(F.col("n"), F.col(f"left{r}") - F.col("before")), F.lit(0)).cast("int")
            out = out.union(tied.withColumn("before", before).select(F.explode(F.array_repeat("row", taken)).alias("row")))
    return out.select("row.*")
