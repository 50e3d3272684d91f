"""Daily balances and flows, dense by day, per account and per portfolio."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerjobs.functions import exprs as X

KEY = ("portfolio_id", "account_id")
MEASURES = (
    "bank_inflows_cents",
    "bank_outflows_cents",
    "net_bank_flow_cents",
    "external_income_cents",
    "external_expense_cents",
    "refund_cents",
    "investment_return_cents",
    "reserve_contribution_cents",
    "deporte_cents",
    "internal_transfer_net_cents",
    "unclassified_inflow_cents",
    "unclassified_outflow_cents",
)


def measures(nature, cents) -> dict:
    """The twelve flow measures of a row, 0 where one does not apply."""
    when = lambda cond, value: F.when(cond, value).otherwise(F.lit(0)).cast("long")
    up, down, size = cents > 0, cents < 0, F.abs(cents)
    return {
        "bank_inflows_cents": when(up, cents),
        "bank_outflows_cents": when(down, size),
        "net_bank_flow_cents": cents,
        "external_income_cents": when(nature.isin(*X.INCOME) & up, cents),
        "external_expense_cents": when(nature.isin(*X.EXPENSE) & down, size),
        "refund_cents": when(nature.isin(*X.REFUND), cents),
        "investment_return_cents": when(nature == "investment_return", cents),
        "reserve_contribution_cents": when(nature == "reserve_contribution", size),
        "deporte_cents": when(nature == "deporte", size),
        "internal_transfer_net_cents": when(nature.isin(*X.INTERNAL), cents),
        "unclassified_inflow_cents": when((nature == "inflow_unclassified") & up, cents),
        "unclassified_outflow_cents": when((nature == "outflow_unclassified") & down, size),
    }


def attach_channel(canonical: DataFrame, classified: DataFrame) -> DataFrame:
    """Canonical rows with the channel that classification found for their transaction."""
    channels = classified.select(F.col("parent_transaction_id").alias("transaction_id"), "channel").distinct()
    return canonical.drop("channel").join(channels, "transaction_id", "left")


def day_spine(spans: DataFrame, keys: tuple[str, ...], first: str, last: str, day: str = "date") -> DataFrame:
    return spans.select(*keys, F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias(day))


def anchors(transactions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(kind, key): accounts without a balance to start from, or with transactions after it."""
    last = transactions.groupBy(*KEY).agg(F.max("transaction_date").alias("last"))
    anchor = snapshots.groupBy(*KEY).agg(F.max("balance_date").alias("anchor"))
    both = last.join(anchor, list(KEY), "left")
    bad = F.when(F.col("anchor").isNull(), "no_anchor").when(F.col("last") > F.col("anchor"), "transactions_after_anchor")
    return both.select(bad.alias("kind"), F.col("account_id").alias("key")).where("kind IS NOT NULL")


def ledger_balances(transactions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Closing balance of every day from an account's first transaction to its last snapshot.

    The last snapshot is carried back over later movements; movements of the sweep account are
    carried forward as principal. Windows run over account days, not transactions.
    """
    sweep = F.col("name_raw") == X.SWEEP_NAME
    if "channel" in transactions.columns:
        sweep = sweep | (F.col("channel") == "bb_rende_facil")
    days = transactions.groupBy(*KEY, F.col("transaction_date").alias("date")).agg(
        F.min("institution").alias("institution"), F.sum("amount_cents").alias("moved"), F.sum(F.when(sweep, F.col("amount_cents")).otherwise(0)).alias("swept")
    )
    first = days.groupBy(*KEY).agg(F.min("date").alias("first"), F.min("institution").alias("institution"))
    last = snapshots.groupBy(*KEY).agg(F.max("balance_date").alias("last"), F.max_by("balance_cents", "balance_date").alias("anchor_cents"))
    spans = first.join(last, list(KEY)).where("first <= last")
    spine = spans.select(*KEY, "institution", "anchor_cents", F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date"))
    snaps = snapshots.select(*KEY, F.col("balance_date").alias("date"), F.col("balance_cents").alias("snapshot_balance_cents"))
    full = spine.join(days.drop("institution"), [*KEY, "date"], "left").join(snaps, [*KEY, "date"], "left")
    w = Window.partitionBy(*KEY).orderBy("date")
    after = F.coalesce(F.sum("moved").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    swept = F.coalesce(F.sum("swept").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    out = full.withColumn("ledger_balance_cents", F.col("anchor_cents") - after).withColumn("liquidity_adjustment_cents", -swept)
    basis = F.when(F.col("account_id") == X.BB_ACCOUNT, "ledger_plus_bb_rende_facil_principal_proxy").otherwise("ledger_balance")
    return out.select(
        *KEY,
        "date",
        "institution",
        basis.alias("balance_basis"),
        "ledger_balance_cents",
        "liquidity_adjustment_cents",
        (F.col("ledger_balance_cents") + F.col("liquidity_adjustment_cents")).alias("analysis_balance_cents"),
        "snapshot_balance_cents",
        (F.col("snapshot_balance_cents") - F.col("ledger_balance_cents")).alias("snapshot_difference_cents"),
        F.lit(True).alias("coverage_complete"),
    )


def daily_balances(transactions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Account balances and, per portfolio and day, their sum; complete once every account has begun."""
    own = ledger_balances(transactions, snapshots)
    starts = own.groupBy(*KEY).agg(F.min("date").alias("s"), F.min("institution").alias("i")).groupBy("portfolio_id").agg(F.max("s").alias("all_started"), F.array_join(F.array_sort(F.collect_set("i")), " + ").alias("names"))
    total = own.groupBy("portfolio_id", "date").agg(*[F.sum(c).alias(c) for c in ("ledger_balance_cents", "liquidity_adjustment_cents", "analysis_balance_cents")])
    none = F.lit(None).cast("long")
    consolidated = total.join(starts, "portfolio_id").select(
        "portfolio_id", F.lit(X.CONSOLIDATED_ACCOUNT).alias("account_id"), "date", F.col("names").alias("institution"), F.lit("sum_available_analysis_balances").alias("balance_basis"),
        "ledger_balance_cents", "liquidity_adjustment_cents", "analysis_balance_cents", none.alias("snapshot_balance_cents"), none.alias("snapshot_difference_cents"), (F.col("date") >= F.col("all_started")).alias("coverage_complete"),
    )
    return own.unionByName(consolidated)


def daily_flows(rows: DataFrame) -> DataFrame:
    """Twelve measures and the number of transactions per operation day, for each account and the portfolio.

    One aggregation by grouping sets; every day of a span has a row. A portfolio day is
    complete if all of its accounts have begun and none has ended.
    """
    amounts = rows.select(*KEY, "institution", F.col("operation_date").alias("date"), *[v.alias(k) for k, v in measures(F.col("nature"), F.col("amount_cents")).items()])
    sets = [["portfolio_id", "date", "account_id"], ["portfolio_id", "date"]]
    facts = amounts.groupingSets([[F.col(c) for c in s] for s in sets], "portfolio_id", "date", "account_id").agg(
        F.count("*").alias("transaction_count"), *[F.sum(m).alias(m) for m in MEASURES], F.grouping("account_id").alias("g")
    )
    facts = facts.withColumn("account_id", F.when(F.col("g") == 1, X.CONSOLIDATED_ACCOUNT).otherwise(F.col("account_id"))).drop("g")
    spans = amounts.groupBy(*KEY).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.min("institution").alias("institution"))
    whole = spans.groupBy("portfolio_id").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.array_join(F.array_sort(F.collect_set("institution")), " + ").alias("institution"), F.max("first").alias("from"), F.min("last").alias("to")
    )
    both = spans.withColumn("from", F.col("first")).withColumn("to", F.col("last")).unionByName(whole.withColumn("account_id", F.lit(X.CONSOLIDATED_ACCOUNT)))
    spine = both.select(*KEY, "institution", "from", "to", F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date"))
    full = spine.join(facts, [*KEY, "date"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return full.select(*KEY, "date", "institution", F.col("date").between(F.col("from"), F.col("to")).alias("coverage_complete"), zero("transaction_count"), *[zero(m) for m in MEASURES])


def flow_feed(flows: DataFrame) -> DataFrame:
    """Daily income, expense and net external flow of the portfolios in currency units."""
    net = F.col("external_income_cents") - F.col("external_expense_cents")
    return flows.where(F.col("account_id") == X.CONSOLIDATED_ACCOUNT).select(
        "portfolio_id", "date", X.to_units(F.col("external_income_cents")).alias("income"), X.to_units(F.col("external_expense_cents")).alias("expense"), X.to_units(net).alias("net")
    )


def data_quality(dated: DataFrame, balances: DataFrame) -> DataFrame:
    """Operation dates by account, and each snapshot against the rebuilt balance."""
    none = F.lit(None)
    dates = dated.groupBy(*KEY).agg(
        F.count_if(F.col("operation_date_source") != "posting_date").alias("observed_value"),
        F.count("*").alias("expected_value"),
        F.count_if(F.col("operation_posting_lag_days") != 0).alias("shifted"),
        F.max(-F.col("operation_posting_lag_days")).alias("most"),
    )
    a = dates.select(
        *KEY, F.lit("operation_dates").alias("check_type"), none.cast("date").alias("reference_date"), F.lit("ok").alias("status"), "observed_value", "expected_value",
        none.cast("long").alias("difference_cents"), F.concat("shifted", F.lit(" shifted; most days: "), "most").alias("details"),
    )
    b = balances.where("snapshot_balance_cents IS NOT NULL").select(
        *KEY, F.lit("balance_snapshot").alias("check_type"), F.col("date").alias("reference_date"), F.when(F.col("snapshot_difference_cents") == 0, "balanced").otherwise("mismatch").alias("status"),
        F.col("ledger_balance_cents").alias("observed_value"), F.col("snapshot_balance_cents").alias("expected_value"), F.col("snapshot_difference_cents").alias("difference_cents"), F.lit("rebuilt against stated balance").alias("details"),
    )
    return reduce(DataFrame.unionByName, [a, b])
