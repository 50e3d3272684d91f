"""Coverage of accounts and reconciliation between balance snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerjobs.functions import exprs as X

KEY = ("portfolio_id", "account_id")


def coverage_summary(transactions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per account: dates, numbers of transactions, files and snapshots, and the months without any transaction."""
    seen = transactions.groupBy(*KEY).agg(
        F.min("institution").alias("institution"),
        F.min("transaction_date").alias("coverage_start"),
        F.max("transaction_date").alias("coverage_end"),
        F.count("*").alias("transaction_count"),
        F.countDistinct("source_file").alias("source_file_count"),
        F.collect_set(X.month_key(F.col("transaction_date"))).alias("months"),
    )
    every = F.transform(F.sequence(F.trunc("coverage_start", "MM"), F.trunc("coverage_end", "MM"), F.expr("interval 1 month")), lambda d: F.date_format(d, "yyyy-MM"))
    counts = snapshots.groupBy(*KEY).agg(F.count("*").alias("snapshot_count"))
    gaps = F.array_join(F.array_sort(F.array_except(every, "months")), ";")
    return seen.join(counts, list(KEY), "left").select(
        *KEY, "institution", "coverage_start", "coverage_end", "transaction_count", "source_file_count", F.coalesce("snapshot_count", F.lit(0)).cast("long").alias("snapshot_count"), gaps.alias("months_without_transactions")
    )


def reconciliation(transactions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Each two successive snapshots with the movements after the first up to the second.

    No range join: sums by day and snapshots form one sequence per account, whose running sum
    is read at the snapshots.
    """
    days = transactions.groupBy(*KEY, F.col("transaction_date").alias("day")).agg(F.sum("amount_cents").alias("moved"))
    marks = snapshots.select(*KEY, F.col("balance_date").alias("day"), "balance_cents")
    line = days.withColumn("balance_cents", F.lit(None).cast("long")).unionByName(marks.withColumn("moved", F.lit(0).cast("long")))
    upto = Window.partitionBy(*KEY).orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    read = line.withColumn("total", F.sum("moved").over(upto)).where("balance_cents IS NOT NULL")
    nxt = Window.partitionBy(*KEY).orderBy("day")
    both = read.select(
        *KEY,
        F.col("day").alias("opening_date"),
        F.col("balance_cents").alias("opening_balance_cents"),
        F.lead("day").over(nxt).alias("closing_date"),
        F.lead("balance_cents").over(nxt).alias("closing_balance_cents"),
        (F.lead("total").over(nxt) - F.col("total")).alias("movement_cents"),
    ).where("closing_date IS NOT NULL")
    diff = F.col("closing_balance_cents") - F.col("opening_balance_cents") - F.col("movement_cents")
    return both.withColumn("difference_cents", diff).withColumn("status", F.when(F.col("difference_cents") == 0, "balanced").otherwise("mismatch"))
