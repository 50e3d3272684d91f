"""The report summary: one row per portfolio over its comparable months."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerjobs.functions import exprs as X

from .metrics import comparable

COPIED = {
    "analysis_start_month": "first_month",
    "analysis_end_month": "last_month",
    "last_complete_month": "last_complete_month",
    "average_recurring_living_cost_cents": "average_living_cost_cents",
    "median_recurring_living_cost_cents": "median_living_cost_cents",
    "standard_deviation_living_cost_cents": "standard_deviation_living_cost_cents",
    "coefficient_of_variation": "living_cost_cv",
    "last_complete_recurring_living_cost_cents": "latest_living_cost_cents",
    "last_complete_reserve_balance_cents": "latest_reserve_cents",
    "last_complete_survival_index_months": "latest_survival_months",
}
PEAKS = ("peak_count", "peak_total_cents", "average_peak_cents", "median_peak_cents", "largest_peak_cents", "smallest_peak_cents", "unknown_peak_count")


def top(df: DataFrame, order, n: int, fields: list[str], name: str) -> DataFrame:
    """The first ``n`` rows of each portfolio as an array."""
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy("portfolio_id").orderBy(*order))).where(F.col("r") <= n)
    return ranked.groupBy("portfolio_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", F.struct(*fields).alias("v")))), lambda x: x.v).alias(name))


def report_summary(rows: DataFrame, monthly: DataFrame, categories: DataFrame, summary: DataFrame, candidates: DataFrame, peaks: DataFrame, reserve: DataFrame) -> DataFrame:
    """Totals, extremes, shares and two top lists; of equal months the earliest counts. Portfolios without comparable months have nulls."""
    months = comparable(monthly)
    keys = months.select("portfolio_id", "month")
    c = F.col
    saving, cost = c("savings_cents"), c("recurring_living_cost_cents")
    early = F.struct(saving.alias("v"), c("month").alias("m"))
    late = -F.replace("month", F.lit("-"), F.lit("")).cast("int")
    worst = F.struct("month", "savings_cents", "gross_external_expense_cents", "atypical_expense_cents")
    main = months.groupBy("portfolio_id").agg(
        F.count("*").alias("comparable_months"),
        F.min_by(worst, early).alias("w"),
        F.min_by(F.struct("month", cost.alias("v")), F.struct(cost, "month")).alias("lo"),
        F.max_by(F.struct("month", cost.alias("v")), F.struct(cost.alias("v"), late.alias("m"))).alias("hi"),
        F.percentile("survival_index_months", 0.5).cast("decimal(18,5)").alias("median_survival_months"),
        F.sum("external_income_cents").alias("total_income_cents"),
        F.sum("gross_external_expense_cents").alias("total_gross_expense_cents"),
        F.sum("net_external_expense_cents").alias("total_net_expense_cents"),
        F.sum(saving).alias("total_savings_cents"),
        F.count_if(saving > 0).alias("positive_savings_months"),
        F.sum("reserve_contribution_cents").alias("reserve_contribution_cents"),
        F.sum("deporte_cents").alias("deportes_cents"),
        F.sum("net_reserve_contribution_cents").alias("net_reserve_contribution_cents"),
    )
    held = reserve.where("is_complete_month").join(keys, ["portfolio_id", "month"], "left_semi").groupBy("portfolio_id").agg(
        F.min_by("opening_balance_cents", "month").alias("reserve_opening_cents"), F.max_by("closing_balance_cents", "month").alias("reserve_closing_cents"), F.sum("estimated_interest_cents").alias("reserve_interest_cents")
    )
    out, unknown = c("amount_cents") < 0, c("nature") == "outflow_unclassified"
    marked = keys.withColumn("in", F.lit(True))
    seen = rows.withColumn("month", X.month_key(c("operation_date"))).join(marked, ["portfolio_id", "month"], "left").groupBy("portfolio_id").agg(
        F.count_if(c("nature").isin("inflow_unclassified", "outflow_unclassified")).alias("unknown_transactions"), F.count("*").alias("transaction_count"), F.count_if(out & unknown).alias("unknown_outflows"),
        F.count_if(out).alias("outflow_count"), F.count_if(out & unknown & c("in")).alias("comparable_unknown_outflow_count"), F.count_if(out & c("in")).alias("comparable_outflow_count"),
    )
    spent = categories.join(keys, ["portfolio_id", "month"], "left_semi")
    shares = spent.groupBy("portfolio_id").agg(F.sum("unclassified_outflow_cents").alias("comparable_unknown_outflow_cents"), F.sum("total_observed_outflow_cents").alias("comparable_observed_outflow_cents"))
    totals = spent.groupBy("portfolio_id", "category").agg(F.sum("total_observed_outflow_cents").alias("amount_cents"), F.min(F.struct("month", "category")).alias("seen"))
    top_categories = top(totals, [F.desc("amount_cents"), "seen"], 6, ["category", "amount_cents"], "top_categories")
    high = candidates.where("is_peak")
    top_peaks = top(high, [F.desc("amount_cents"), "episode_id"], 5, ["start_date", "label", "category", "amount_cents"], "top_peaks")
    within = high.withColumn("month", X.month_key(c("start_date"))).join(keys, ["portfolio_id", "month"], "left_semi").groupBy("portfolio_id").agg(F.count("*").alias("comparable_peak_count"))
    base = summary.select("portfolio_id", *[c(a).alias(b) for a, b in COPIED.items()])
    joined = reduce(lambda a, b: a.join(b, "portfolio_id", "left"), [base, main, held, seen, shares, peaks.select("portfolio_id", *PEAKS), within, top_categories, top_peaks])
    share = lambda n, d: X.ratio_or_zero(c(n), c(d))
    two = F.aggregate(F.slice("top_categories", 1, 2), F.lit(0).cast("long"), lambda s, x: s + x.amount_cents)
    return joined.select(
        "portfolio_id", *COPIED.values(), "comparable_months",
        c("lo.v").alias("minimum_living_cost_cents"), c("lo.month").alias("minimum_living_cost_month"), c("hi.v").alias("maximum_living_cost_cents"), c("hi.month").alias("maximum_living_cost_month"),
        "median_survival_months", X.ratio_or_zero(c("latest_reserve_cents"), c("hi.v")).alias("conservative_survival_months"),
        "total_income_cents", "total_gross_expense_cents", "total_net_expense_cents", "total_savings_cents", "positive_savings_months",
        c("w.month").alias("worst_savings_month"), c("w.savings_cents").alias("worst_savings_cents"), c("w.gross_external_expense_cents").alias("worst_month_gross_expense_cents"), c("w.atypical_expense_cents").alias("worst_month_atypical_expense_cents"),
        (c("total_savings_cents") - c("w.savings_cents")).alias("savings_without_worst_month_cents"),
        "reserve_opening_cents", "reserve_closing_cents", "reserve_interest_cents", "reserve_contribution_cents", "deportes_cents", "net_reserve_contribution_cents",
        "unknown_transactions", "transaction_count", "unknown_outflows", "outflow_count", "comparable_unknown_outflow_count", "comparable_outflow_count", "comparable_unknown_outflow_cents", "comparable_observed_outflow_cents",
        *PEAKS, F.coalesce("comparable_peak_count", F.lit(0)).cast("long").alias("comparable_peak_count"),
        share("unknown_transactions", "transaction_count").alias("unknown_transaction_share"), share("comparable_unknown_outflow_cents", "comparable_observed_outflow_cents").alias("unknown_outflow_share"),
        X.ratio_or_zero(two, c("comparable_observed_outflow_cents")).alias("top_two_category_share"), "top_categories", "top_peaks",
    )
