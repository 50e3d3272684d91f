"""Monthly metrics, category spending, their summary and their checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerjobs.functions import exprs as X

ALL, PARTIAL = "all_available_accounts", "partial_accounts"


def _total(cond, value):
    return F.sum(F.when(cond, value).otherwise(F.lit(0))).cast("long")


def monthly_metrics(rows: DataFrame, balances: DataFrame | None = None, reserve: DataFrame | None = None) -> DataFrame:
    """One row per portfolio and month between its first and last operation, months without any included.

    One aggregation of conditional sums; month-end balances and reserve months are joined on.
    """
    n, c = F.col("nature"), F.col("amount_cents")
    spent, size = n.isin(*X.EXPENSE) & (c < 0), F.abs(c)
    cost = lambda t: spent & (F.col("cost_treatment") == t)
    month = X.month_key(F.col("operation_date"))
    facts = rows.groupBy("portfolio_id", month.alias("month")).agg(
        _total(n.isin(*X.INCOME) & (c > 0), c).alias("external_income_cents"),
        _total(spent, size).alias("gross_external_expense_cents"),
        _total(n.isin(*X.REFUND), c).alias("refund_cents"),
        _total(cost("recurring"), size).alias("recurring_living_cost_cents"),
        _total(cost("expanded"), size).alias("atypical_expense_cents"),
        _total(cost("outside"), size).alias("outside_living_cost_cents"),
        _total((n == "outflow_unclassified") & (c < 0), size).alias("unclassified_outflow_cents"),
        _total((n == "inflow_unclassified") & (c > 0), c).alias("unclassified_inflow_cents"),
        _total(n == "investment_return", c).alias("investment_return_cents"),
        _total(n == "reserve_contribution", size).alias("reserve_contribution_cents"),
        _total(n == "deporte", size).alias("deporte_cents"),
    )
    names = [f for f in facts.columns if f.endswith("_cents")]
    starts = rows.groupBy("portfolio_id", "account_id").agg(F.min("operation_date").alias("first"), F.max("operation_date").alias("last"))
    span = starts.groupBy("portfolio_id").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("first").alias("all_from"))
    months = span.select("portfolio_id", "last", "all_from", F.explode(F.sequence(F.trunc("first", "MM"), F.trunc("last", "MM"), F.expr("interval 1 month"))).alias("m"))
    full = months.withColumn("month", X.month_key(F.col("m"))).join(facts, ["portfolio_id", "month"], "left").fillna(0, names)
    if balances is None:
        full = full.withColumn("current_accounts_balance_cents", F.lit(None).cast("long"))
    else:
        own = balances.where(F.col("account_id") == X.CONSOLIDATED_ACCOUNT)
        ends = own.groupBy("portfolio_id", X.month_key(F.col("date")).alias("month")).agg(F.max_by("analysis_balance_cents", "date").alias("current_accounts_balance_cents"))
        full = full.join(ends, ["portfolio_id", "month"], "left")
    if reserve is None:
        full = full.withColumn("reserve_balance_cents", F.lit(None).cast("long"))
    else:
        full = full.join(reserve.select("portfolio_id", "month", F.col("closing_balance_cents").alias("reserve_balance_cents")), ["portfolio_id", "month"], "left")
    c = F.col
    net = c("gross_external_expense_cents") - c("refund_cents")
    end = F.last_day("m")
    complete = end <= c("last")
    return full.select(
        "portfolio_id",
        "month",
        complete.alias("is_complete_month"),
        F.when(end >= c("all_from"), ALL).otherwise(PARTIAL).alias("account_coverage"),
        "external_income_cents",
        "gross_external_expense_cents",
        "refund_cents",
        net.alias("net_external_expense_cents"),
        (c("external_income_cents") - net).alias("savings_cents"),
        X.ratio(c("external_income_cents") - net, c("external_income_cents")).alias("savings_rate"),
        "recurring_living_cost_cents",
        (c("recurring_living_cost_cents") + c("atypical_expense_cents")).alias("expanded_living_cost_cents"),
        "atypical_expense_cents",
        "outside_living_cost_cents",
        "unclassified_outflow_cents",
        "unclassified_inflow_cents",
        "investment_return_cents",
        "reserve_contribution_cents",
        "deporte_cents",
        (c("reserve_contribution_cents") - c("deporte_cents")).alias("net_reserve_contribution_cents"),
        "current_accounts_balance_cents",
        "reserve_balance_cents",
        (c("current_accounts_balance_cents") + c("reserve_balance_cents")).alias("tracked_financial_assets_cents"),
        F.when(complete, X.ratio(c("reserve_balance_cents"), c("recurring_living_cost_cents"))).alias("survival_index_months"),
    )


def monthly_category_spending(rows: DataFrame) -> DataFrame:
    """Outflows by month, category and subcategory: known, unclassified, and by cost treatment."""
    known, size = F.col("nature").isin(*X.EXPENSE), F.abs("amount_cents")
    spent = rows.where((F.col("amount_cents") < 0) & F.col("nature").isin(*X.EXPENSE, "outflow_unclassified"))
    return spent.groupBy("portfolio_id", X.month_key(F.col("operation_date")).alias("month"), "category", "subcategory").agg(
        F.count("*").alias("transaction_count"),
        _total(known, size).alias("known_expense_cents"),
        _total(~known, size).alias("unclassified_outflow_cents"),
        F.sum(size).cast("long").alias("total_observed_outflow_cents"),
        _total(known & (F.col("cost_treatment") == "recurring"), size).alias("recurring_cost_cents"),
        _total(known & (F.col("cost_treatment") == "expanded"), size).alias("atypical_expense_cents"),
        _total(known & (F.col("cost_treatment") == "outside"), size).alias("outside_living_cost_cents"),
    )


def comparable(monthly: DataFrame, or_complete: bool = False) -> DataFrame:
    """Complete months that cover all accounts; with ``or_complete``, all complete ones where a portfolio has none of those."""
    full = F.col("is_complete_month") & (F.col("account_coverage") == ALL)
    if not or_complete:
        return monthly.where(full)
    some = F.max(full).over(Window.partitionBy("portfolio_id"))
    return monthly.withColumn("some", some).where(F.when(F.col("some"), full).otherwise(F.col("is_complete_month"))).drop("some")


def metrics_summary(monthly: DataFrame) -> DataFrame:
    """Living cost per portfolio: mean, median and population deviation around the mean in whole cents; the last complete month. Null without comparable months."""
    cost = F.col("recurring_living_cost_cents")
    some = comparable(monthly)
    first = some.groupBy("portfolio_id").agg(
        F.count("*").alias("comparable_complete_months"), X.half_up(F.sum(cost).cast("decimal(30,10)") / F.count("*")).alias("mean"), X.half_up(F.percentile(cost, 0.5)).alias("median")
    )
    spread = some.join(first, "portfolio_id").groupBy("portfolio_id").agg(X.half_up(F.sqrt(F.avg(F.pow((cost - F.col("mean")).cast("double"), F.lit(2.0))))).alias("deviation"))
    ends = monthly.groupBy("portfolio_id").agg(F.min("month").alias("analysis_start_month"), F.max("month").alias("analysis_end_month"))
    last = monthly.where("is_complete_month").groupBy("portfolio_id").agg(F.max_by(F.struct("month", cost.alias("cost"), "reserve_balance_cents", "survival_index_months"), "month").alias("l"))
    out = ends.join(first, "portfolio_id", "left").join(spread, "portfolio_id", "left").join(last, "portfolio_id", "left")
    return out.select(
        "portfolio_id", "analysis_start_month", "analysis_end_month", F.col("l.month").alias("last_complete_month"), F.coalesce("comparable_complete_months", F.lit(0)).cast("long").alias("comparable_complete_months"),
        F.col("mean").alias("average_recurring_living_cost_cents"), F.col("median").alias("median_recurring_living_cost_cents"), F.col("deviation").alias("standard_deviation_living_cost_cents"),
        X.ratio(F.col("deviation"), F.col("mean")).alias("coefficient_of_variation"), F.col("l.cost").alias("last_complete_recurring_living_cost_cents"),
        F.col("l.reserve_balance_cents").alias("last_complete_reserve_balance_cents"), F.col("l.survival_index_months").alias("last_complete_survival_index_months"),
    )


def metrics_quality(monthly: DataFrame, categories: DataFrame) -> DataFrame:
    """Three identities per portfolio, each with the number of months that break it."""
    sums = categories.groupBy("portfolio_id", "month").agg(F.sum("known_expense_cents").alias("known"))
    both = monthly.join(sums, ["portfolio_id", "month"], "left")
    c = F.col
    facts = both.groupBy("portfolio_id").agg(
        F.count_if(F.coalesce("known", F.lit(0)) != c("gross_external_expense_cents")).alias("a"),
        F.count_if(c("recurring_living_cost_cents") + c("atypical_expense_cents") != c("expanded_living_cost_cents")).alias("b"),
        F.count_if(c("external_income_cents") - c("net_external_expense_cents") != c("savings_cents")).alias("s"),
        F.count("*").alias("months"),
    )
    row = lambda kind, n, details: F.struct(F.lit(kind).alias("check_type"), F.when(c(n) == 0, "balanced").otherwise("mismatch").alias("status"), c(n).alias("observed_value"), F.lit(0).cast("long").alias("expected_value"), details.alias("details"))
    checks = F.array(
        row("category_expense_reconciliation", "a", F.concat(c("months").cast("string"), F.lit(" months"))),
        row("living_cost_partition", "b", F.lit("expanded = recurring + atypical")),
        row("savings_identity", "s", F.lit("savings = income - net expense")),
    )
    return facts.select("portfolio_id", F.explode(checks).alias("r")).select("portfolio_id", "r.*")


def category_ranking(categories: DataFrame, monthly: DataFrame) -> DataFrame:
    """Totals of each category over comparable months, split by cost treatment."""
    fields = ("recurring_cost_cents", "atypical_expense_cents", "outside_living_cost_cents", "unclassified_outflow_cents")
    kept = categories.join(comparable(monthly, or_complete=True), ["portfolio_id", "month"], "left_semi")
    sums = kept.groupBy("portfolio_id", "category").agg(*[F.sum(f).alias(f) for f in fields])
    return sums.withColumn("total_cents", reduce(lambda a, b: a + b, [F.col(f) for f in fields]))
