"""The interest-bearing reserve, rebuilt from an anchor balance."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerjobs.functions import exprs as X
from ledgerjobs.sources.tables import small

# The channels of the reserve.
CONTRIBUTION, WITHDRAWAL = "cofrinho_application", "cofrinho_redemption"
SCALE = 10**14  # a percentage with 12 places as a fraction


def reserve_events(rows: DataFrame) -> DataFrame:
    """Movements of the reserve as it sees them: contributions positive, withdrawals negative."""
    kind = F.when(F.col("channel") == CONTRIBUTION, "contribution").otherwise("deporte")
    size = F.abs("amount_cents")
    return rows.where(F.col("channel").isin(CONTRIBUTION, WITHDRAWAL)).select(
        "portfolio_id", F.col("operation_date").alias("date"), "analytical_transaction_id", "parent_transaction_id", kind.alias("event_type"), size.alias("amount_cents"),
        F.when(F.col("channel") == CONTRIBUTION, size).otherwise(-size).alias("reserve_cashflow_cents"), "account_id", "description_raw", "source_file", "source_position",
    )


def sign_violations(rows: DataFrame) -> DataFrame:
    """(kind, key): contributions that do not leave the account, withdrawals that do not enter it."""
    bad = ((F.col("channel") == CONTRIBUTION) & (F.col("amount_cents") >= 0)) | ((F.col("channel") == WITHDRAWAL) & (F.col("amount_cents") <= 0))
    return rows.where(bad).select(F.lit("reserve_sign").alias("kind"), F.col("analytical_transaction_id").alias("key"))


def _spine(events: DataFrame, assumptions: DataFrame) -> DataFrame:
    span = events.groupBy("portfolio_id").agg(F.trunc(F.min("date"), "MM").alias("first"), F.max("date").alias("last_event"))
    span = span.join(assumptions, "portfolio_id").withColumn("last", F.greatest("anchor_date", "last_event")).where("anchor_date >= first")
    return span.select("portfolio_id", "anchor_date", "anchor_balance_cents", "yield_percentage", F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("date"))


def reserve_daily(events: DataFrame, rates: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Opening, interest, cash flow and closing of every day of every portfolio's reserve.

    Back from the anchor the opening is (closing - cash flow) / (1 + rate), after it interest is
    on the opening; each day is rounded to cents, half up, which makes it a fold in order: one
    group per portfolio holds its days, computed in whole numbers. ``assumptions`` has
    (portfolio_id, anchor_date, anchor_balance_cents, yield_percentage), ``rates`` (date, daily_rate_percent).
    """
    cash = events.groupBy("portfolio_id", "date").agg(
        F.sum(F.when(F.col("event_type") == "contribution", F.col("amount_cents")).otherwise(0)).alias("contribution_cents"),
        F.sum(F.when(F.col("event_type") == "deporte", F.col("amount_cents")).otherwise(0)).alias("deporte_cents"),
    )
    effective = (F.col("daily_rate_percent").cast("decimal(18,6)") * F.col("yield_percentage").cast("decimal(9,4)") / F.lit(100)).cast("decimal(20,12)")
    days = _spine(events, assumptions).join(small(rates.select("date", "daily_rate_percent")), "date", "left").join(cash, ["portfolio_id", "date"], "left")
    days = days.select(
        "portfolio_id", "date", "anchor_date", "anchor_balance_cents", F.coalesce(effective, F.lit(0)).cast("decimal(20,12)").alias("rate"),
        F.coalesce("contribution_cents", F.lit(0)).alias("contribution_cents"), F.coalesce("deporte_cents", F.lit(0)).alias("deporte_cents"),
    )
    days = days.withColumn("units", (F.col("rate") * F.lit(10**12).cast("decimal(13,0)")).cast("long"))

    def half_up(n: int, d: int) -> int:
        q = (2 * abs(n) + d) // (2 * d)
        return q if n >= 0 else -q

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("date").reset_index(drop=True)
        n, anchor = len(frame), frame["anchor_date"].iloc[0]
        at = int((frame["date"] <= anchor).sum()) - 1
        cash = [int(a) - int(b) for a, b in zip(frame["contribution_cents"], frame["deporte_cents"], strict=True)]
        units = frame["units"].tolist()
        opening, interest, closing = [0] * n, [0] * n, [0] * n
        now = int(frame["anchor_balance_cents"].iloc[0])
        for i in range(at, -1, -1):
            closing[i] = now
            opening[i] = half_up((now - cash[i]) * SCALE, SCALE + units[i])
            interest[i] = now - opening[i] - cash[i]
            now = opening[i]
        now = int(frame["anchor_balance_cents"].iloc[0])
        for i in range(at + 1, n):
            opening[i] = now
            interest[i] = half_up(now * units[i], SCALE)
            closing[i] = now = now + interest[i] + cash[i]
        return pd.DataFrame({"portfolio_id": frame["portfolio_id"], "date": frame["date"], "o": opening, "i": interest, "c": closing})

    folded = days.groupBy("portfolio_id").applyInPandas(fold, "portfolio_id string, date date, o long, i long, c long")
    out = days.join(folded, ["portfolio_id", "date"])
    return out.select(
        "portfolio_id", "date", F.col("o").alias("opening_balance_cents"), F.when(F.col("rate") != 0, F.col("rate")).alias("cdi_daily_rate_percent"), F.col("i").alias("estimated_interest_cents"),
        "contribution_cents", "deporte_cents", (F.col("contribution_cents") - F.col("deporte_cents")).alias("net_cashflow_cents"), F.col("c").alias("closing_balance_cents"),
        (F.col("date") == F.col("anchor_date")).alias("is_anchor_date"), F.when(F.col("date") <= F.col("anchor_date"), "backward_from_anchor").otherwise("forward_from_anchor").alias("estimation_method"),
    )


def reserve_monthly(daily: DataFrame) -> DataFrame:
    """The days by month; a month is complete if the reserve's last day is not before its end. ``daily`` is read once."""
    month = X.month_key(F.col("date"))
    rows = daily.groupBy("portfolio_id", month.alias("month")).agg(
        F.min_by("opening_balance_cents", "date").alias("opening_balance_cents"),
        F.sum("contribution_cents").alias("contribution_cents"),
        F.sum("deporte_cents").alias("deporte_cents"),
        F.sum("net_cashflow_cents").alias("net_contribution_cents"),
        F.sum("estimated_interest_cents").alias("estimated_interest_cents"),
        F.max_by("closing_balance_cents", "date").alias("closing_balance_cents"),
        F.max("is_anchor_date").alias("is_anchor_month"),
        F.max("date").alias("last"),
    )
    model_end = F.max("last").over(Window.partitionBy("portfolio_id"))
    return rows.withColumn("is_complete_month", X.month_end(F.col("month")) <= model_end).drop("last")


def reserve_quality(daily: DataFrame, events: DataFrame, rates: DataFrame, assumptions: DataFrame) -> DataFrame:
    """Five checks per portfolio."""
    facts = daily.groupBy("portfolio_id").agg(
        F.max(F.when(F.col("is_anchor_date"), F.col("closing_balance_cents"))).alias("at_anchor"),
        F.count_if(F.col("opening_balance_cents") + F.col("estimated_interest_cents") + F.col("net_cashflow_cents") != F.col("closing_balance_cents")).alias("broken"),
        F.count("*").alias("days"),
    )
    seen = events.groupBy("portfolio_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "contribution").alias("ins"), F.count_if(F.col("event_type") == "deporte").alias("outs"))
    n, r0, r1 = rates.agg(F.count("*"), F.min("date"), F.max("date")).first()
    both = facts.join(assumptions, "portfolio_id").join(seen, "portfolio_id").withColumns({"rates": F.lit(n).cast("long"), "r0": F.lit(r0), "r1": F.lit(r1)})
    row = lambda kind, status, seen, want, details: F.struct(F.lit(kind).alias("check_type"), status.alias("status"), seen.cast("long").alias("observed_value"), want.cast("long").alias("expected_value"), details.cast("string").alias("details"))
    same = lambda a, b: F.when(a == b, "balanced").otherwise("mismatch")
    c, zero = F.col, F.lit(0)
    later = c("exclude_unrecorded_later_contributions") if "exclude_unrecorded_later_contributions" in assumptions.columns else F.lit(True)
    checks = F.array(
        row("anchor_balance", same(c("at_anchor"), c("anchor_balance_cents")), c("at_anchor"), c("anchor_balance_cents"), F.date_format("anchor_date", "yyyy-MM-dd")),
        row("daily_roll_forward", same(c("broken"), zero), c("broken"), zero, F.concat("days", F.lit(" days"))),
        row("recorded_events", F.lit("ok"), c("events"), c("events"), F.concat("ins", F.lit(" contributions; "), "outs", F.lit(" withdrawals"))),
        row("cdi_rates", F.lit("ok"), c("rates"), c("rates"), F.concat(F.lit("SGS 12; "), F.date_format("r0", "yyyy-MM-dd"), F.lit(" to "), F.date_format("r1", "yyyy-MM-dd"))),
        row("unrecorded_post_anchor_contributions", F.when(later, "excluded").otherwise("included"), zero, zero, F.lit("later contributions outside the statements are not estimated")),
    )
    return both.select("portfolio_id", F.explode(checks).alias("r")).select("portfolio_id", "r.*")


def input_violations(events: DataFrame, rates: DataFrame, assumptions: DataFrame, most_missing: int = 25) -> DataFrame:
    """(kind, key): reserves without events, anchors before the first month, too many weekdays without a rate."""
    none = assumptions.join(events.select("portfolio_id").distinct(), "portfolio_id", "left_anti").select(F.lit("no_events").alias("kind"), F.col("portfolio_id").alias("key"))
    first = events.groupBy("portfolio_id").agg(F.trunc(F.min("date"), "MM").alias("first")).join(assumptions, "portfolio_id")
    early = first.where("anchor_date < first").select(F.lit("anchor_before_events"), "portfolio_id")
    missing = _spine(events, assumptions).where(F.weekday("date") < 5).join(rates.select("date"), "date", "left_anti").groupBy("portfolio_id").count()
    return reduce(DataFrame.union, [none, early, missing.where(F.col("count") > most_missing).select(F.lit("missing_rates"), "portfolio_id")])


def tracked_assets(reserve: DataFrame, balances: DataFrame) -> DataFrame:
    """Reserve and consolidated balance on the days that both have."""
    current = balances.where(F.col("account_id") == X.CONSOLIDATED_ACCOUNT).select("portfolio_id", "date", F.col("analysis_balance_cents").alias("current_cents"))
    both = reserve.select("portfolio_id", "date", F.col("closing_balance_cents").alias("reserve_cents")).join(current, ["portfolio_id", "date"])
    return both.withColumn("total_cents", F.col("reserve_cents") + F.col("current_cents"))
