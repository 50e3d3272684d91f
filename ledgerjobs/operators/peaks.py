"""Spending peaks by modified z-score over episodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerjobs.functions import exprs as X

from .metrics import ALL
from .ranks import twice_median

# Factor and threshold of the modified z-score, and the recurrences that count.
FACTOR, THRESHOLD = 6745, 35000
RECURRENCES = ("non_recurring", "not_applicable")
SEVERAL = "Múltiplas"


def episodes(rows: DataFrame, events: DataFrame) -> DataFrame:
    """Linked events and single transactions with an eligible outflow and a positive net spending.

    Only rows of linked events are grouped; every other analytical row is an episode by itself
    and needs no shuffle.
    """
    labels = events.groupBy("portfolio_id", "event_id").agg(F.min_by("event_label", "transaction_id").alias("event_label"))
    links = events.select("portfolio_id", F.col("transaction_id").alias("parent_transaction_id"), "event_id").distinct()
    eligible = F.coalesce(F.col("peak_eligible").cast("boolean"), F.lit(False)) & F.col("recurrence").isin(*RECURRENCES) & (F.col("amount_cents") < 0)
    relevant = F.col("nature").isin(*X.EXPENSE, *X.REFUND, "outflow_unclassified")
    flat = rows.join(links, ["portfolio_id", "parent_transaction_id"], "left").withColumn("eligible", F.coalesce(eligible, F.lit(False))).withColumn("spent", F.when(relevant, -F.col("amount_cents")).otherwise(0).cast("long"))
    unknown = F.col("nature") == "outflow_unclassified"
    single = flat.where("event_id IS NULL AND eligible AND spent > 0").select(
        "portfolio_id", F.concat(F.lit("transaction:"), "analytical_transaction_id").alias("episode_id"), F.col("operation_date").alias("start_date"), F.col("operation_date").alias("end_date"),
        F.lit("single_transaction").alias("episode_type"), F.col("counterparty_display").alias("label"), F.col("spent").alias("amount_cents"), "category", "subcategory",
        F.when(unknown, "unknown").otherwise("known").alias("classification_status"), F.lit(1).cast("long").alias("transaction_count"),
    )
    e = F.col("eligible")
    one = lambda c: F.when(F.min(F.when(e, F.col(c))) == F.max(F.when(e, F.col(c))), F.min(F.when(e, F.col(c)))).otherwise(SEVERAL)
    order = F.struct(~e, "operation_date", "account_id", "analytical_transaction_id")
    linked = flat.where("event_id IS NOT NULL").groupBy("portfolio_id", "event_id").agg(
        F.max(e).alias("any"), F.min("operation_date").alias("start_date"), F.max("operation_date").alias("end_date"), F.min_by("counterparty_display", order).alias("shown"),
        F.sum("spent").alias("amount_cents"), one("category").alias("category"), one("subcategory").alias("subcategory"),
        F.when(F.max(e & unknown), "unknown").otherwise("known").alias("classification_status"), F.countDistinct("parent_transaction_id").alias("transaction_count"),
    ).where("any AND amount_cents > 0")
    linked = linked.join(labels, ["portfolio_id", "event_id"], "left").select(
        "portfolio_id", F.concat(F.lit("event:"), "event_id").alias("episode_id"), "start_date", "end_date", F.lit("linked_event").alias("episode_type"),
        F.coalesce(X.blank_to_null(F.col("event_label")), "shown").alias("label"), "amount_cents", "category", "subcategory", "classification_status", "transaction_count",
    )
    return single.unionByName(linked)


def peak_candidates(rows: DataFrame, events: DataFrame, keep=None) -> DataFrame:
    """Episodes with median, median absolute deviation and score of their portfolio; peaks lie above 3.5.

    Twice the median and four times the deviation are whole numbers, so the test is exact.
    Episodes are read five times; ``keep`` (table, name) may write them down first.
    """
    found, key = episodes(rows, events), ["portfolio_id"]
    found = keep(found, "episodes") if keep else found
    centred = found.join(twice_median(found, key, "amount_cents", "med2"), key).withColumn("off2", 2 * F.col("amount_cents") - F.col("med2"))
    both = centred.join(twice_median(centred.select(*key, F.abs("off2").alias("off")), key, "off", "mad4"), key)
    # 0.6745 * (off2 / 2) / (mad4 / 4)
    score = (F.col("off2").cast("decimal(20,0)") * F.lit(2 * FACTOR).cast("decimal(6,0)")).cast("decimal(26,0)") / (F.col("mad4").cast("decimal(20,0)") * F.lit(10000).cast("decimal(5,0)"))
    z = F.when(F.col("mad4") > 0, F.bround(score, 4)).when(F.col("off2") == 0, F.lit(0)).cast("decimal(18,4)")
    peak = (F.col("mad4") > 0) & (F.col("off2").cast("decimal(20,0)") * (2 * FACTOR) > F.col("mad4").cast("decimal(20,0)") * THRESHOLD)
    cents = lambda c, k: X.half_up(F.col(c).cast("decimal(20,2)") / k)
    return both.select(
        *found.columns, cents("med2", 2).alias("population_median_cents"), cents("mad4", 4).alias("population_mad_cents"), z.alias("modified_z_score"), F.lit("3.5").cast("decimal(3,1)").alias("threshold"), peak.alias("is_peak")
    )


def _median(high: DataFrame, key: list[str]) -> DataFrame:
    twice = twice_median(high, key, "amount_cents", "twice")
    return twice.select(*key, X.half_up(F.col("twice").cast("decimal(20,2)") / 2).alias("median_peak_cents"))


def peaks_monthly(candidates: DataFrame, monthly: DataFrame) -> DataFrame:
    """Every month with the peaks that begin in it."""
    a = F.col("amount_cents")
    key, high = ["portfolio_id", "month"], candidates.where("is_peak").withColumn("month", X.month_key(F.col("start_date")))
    found = high.groupBy(*key).agg(
        F.count("*").alias("peak_count"), F.sum(a).alias("peak_total_cents"), X.half_up(F.sum(a).cast("decimal(30,10)") / F.count("*")).alias("average_peak_cents"),
        F.max(a).alias("largest_peak_cents"),
    )
    found = found.join(_median(high, key), key)
    full = monthly.join(found, ["portfolio_id", "month"], "left").fillna(0, [c for c in found.columns if c not in ("portfolio_id", "month")])
    return full.select(
        "portfolio_id", "month", "is_complete_month", "account_coverage", "peak_count", "peak_total_cents", "average_peak_cents", "median_peak_cents", "largest_peak_cents",
        X.ratio(F.col("peak_total_cents"), F.col("gross_external_expense_cents")).alias("peak_share_of_gross_expense"),
    )


def peaks_summary(candidates: DataFrame, monthly: DataFrame) -> DataFrame:
    """One row per portfolio; amounts are null without peaks."""
    full = F.col("is_complete_month") & (F.col("account_coverage") == ALL)
    months = monthly.groupBy("portfolio_id").agg(F.count_if("is_complete_month").alias("complete_month_count"), F.count_if(full).alias("full_coverage_complete_month_count"))
    covered = monthly.where(full).select("portfolio_id", "month", F.lit(True).alias("covered"))
    rows = candidates.withColumn("month", X.month_key(F.col("start_date"))).join(covered, ["portfolio_id", "month"], "left")
    p, a = F.col("is_peak"), F.when(F.col("is_peak"), F.col("amount_cents"))
    facts = rows.groupBy("portfolio_id").agg(
        F.count("*").alias("candidate_count"), F.count_if(p).alias("peak_count"), F.count_if(p & (F.col("classification_status") == "known")).alias("known_peak_count"),
        F.count_if(p & (F.col("classification_status") == "unknown")).alias("unknown_peak_count"), F.count_if(p & F.col("covered")).alias("full_coverage_peak_count"),
        F.coalesce(F.sum(a), F.lit(0)).alias("peak_total_cents"), X.half_up(F.sum(a).cast("decimal(30,10)") / F.count(a)).alias("average_peak_cents"),
        F.max(a).alias("largest_peak_cents"), F.min(a).alias("smallest_peak_cents"),
    )
    counts = [c for c in facts.columns if c.endswith("_count")] + ["peak_total_cents"]
    out = months.join(facts, "portfolio_id", "left").join(_median(candidates.where("is_peak"), ["portfolio_id"]), "portfolio_id", "left").fillna(0, counts)
    return out.select(
        "portfolio_id", F.lit("upper_modified_z_score_on_non_recurring_amounts").alias("method"), F.lit("3.5").cast("decimal(3,1)").alias("threshold"),
        "candidate_count", "peak_count", "known_peak_count", "unknown_peak_count", "complete_month_count", X.ratio(F.col("peak_count"), F.col("complete_month_count")).alias("peaks_per_complete_month"),
        "full_coverage_complete_month_count", "full_coverage_peak_count", X.ratio(F.col("full_coverage_peak_count"), F.col("full_coverage_complete_month_count")).alias("peaks_per_full_coverage_month"),
        "peak_total_cents", "average_peak_cents", "median_peak_cents", "largest_peak_cents", "smallest_peak_cents",
    )
