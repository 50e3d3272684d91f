"""Rule-based classification: identity, rules, overrides, allocations, groups, checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerjobs.functions import exprs as X
from ledgerjobs.functions.helpers import normalize

from ledgerjobs.sources.tables import load_order

from .joins import attach
from .ranks import middles_of_counts, running

# The dimensions of a classification, statuses of inquiries and what rules may match.
DIMENSIONS = ("nature", "category", "subcategory", "recurrence", "flexibility", "cost_treatment", "peak_eligible")
STATUSES = ("needs_investigation", "deprioritized", "resolved")
MATCH_TYPES = ("group_id", "channel", "counterparty_key")
#: What ``identify`` adds, and what groups are made of.
IDENTITY = ("channel", "counterparty_key", "counterparty_display", "group_id")
GROUPED = ("portfolio_id", *IDENTITY, "transaction_date", "account_id", "transaction_id", "amount_cents", "description_raw")


def identify(rows: DataFrame) -> DataFrame:
    """Adds channel, counterparty_key, counterparty_display and group_id; texts are normalised row by row, so no row is moved for it."""
    layout = F.col("layout") if "layout" in rows.columns else X.layout_of(F.col("account_id"))
    known = X.with_counterparty(rows, layout).withColumn("counterparty_display", F.col("party.display"))
    keyed = known.withColumn("normal", normalize("counterparty_display"))
    key = F.when(F.col("party.id_hash") != "", F.concat(F.lit("ID "), "party.id_hash")).otherwise(F.col("normal"))
    return keyed.withColumn("counterparty_key", key).withColumn("group_id", X.group_id(F.col("channel"), F.col("counterparty_key"))).drop("party", "normal")


def load_rules(base: DataFrame, private: DataFrame | None = None) -> DataFrame:
    """Base rules before private ones; ``load_order`` (layer, then place in its table's files, see ``sources.tables.load_order``) breaks ties of priority."""
    layers = [base] if private is None else [base, private]
    placed = [df.withColumn("load_order", F.struct(F.lit(i).alias("layer"), load_order(df).alias("place"))) for i, df in enumerate(layers)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)


def last_overrides(overrides: DataFrame) -> DataFrame:
    """One row per transaction: of repeated overrides the last by its place in the files, see ``sources.tables.load_order``."""
    row = F.struct(*[F.nullif(F.col(f), F.lit("")).alias(f"o_{f}") for f in DIMENSIONS])
    placed = overrides.where(F.col("transaction_id").isNotNull()).select(F.col("transaction_id").alias("o_id"), row.alias("o"), load_order(overrides).alias("place"))
    return placed.groupBy("o_id").agg(F.max_by("o", "place").alias("o")).select("o_id", "o.*")


def groups_of(rows: DataFrame) -> DataFrame:
    """(portfolio_id, group_id, channel, counterparty_key, rows): the distinct groups and how many rows each has."""
    return rows.groupBy("portfolio_id", "group_id", "channel", "counterparty_key").agg(F.count("*").alias("rows"))


def _as_structs(rules: DataFrame) -> DataFrame:
    """(match_type, match_value, rule, r_portfolio): the fields of each rule, those that decide its place first, and its portfolio, null if it holds in all."""
    fields = ["rule_id", "valid_from", "valid_to", "min_amount_cents", "max_amount_cents", *DIMENSIONS]
    rule = F.struct(F.coalesce("priority", F.lit(0)).alias("priority"), "load_order", *fields)
    of = F.col("portfolio_id") if "portfolio_id" in rules.columns else F.lit(None).cast("string")
    return rules.select("match_type", "match_value", rule.alias("rule"), of.alias("r_portfolio"))


def rules_by_group(groups: DataFrame, rules: DataFrame) -> DataFrame:
    """(portfolio_id, group_id, rules): the rules whose key matches, by priority, then load order. One row per distinct group that has any."""
    groups = groups.select("portfolio_id", "group_id", "channel", "counterparty_key").distinct()
    pairs = F.array(*[F.struct(F.lit(t).alias("match_type"), F.col(t).alias("match_value")) for t in MATCH_TYPES])
    keyed = groups.select("portfolio_id", "group_id", F.explode(pairs).alias("m")).select("portfolio_id", "group_id", "m.*")
    joined = keyed.join(_as_structs(rules), ["match_type", "match_value"]).where("r_portfolio IS NULL OR r_portfolio = portfolio_id")
    return joined.groupBy("portfolio_id", "group_id").agg(F.array_sort(F.collect_list("rule")).alias("rules"))


def with_few_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` with the ``rules`` of their group as ``rules_by_group`` has them (null without any): the rules of each value that they match are broadcast, so no row is moved."""
    by_value = _as_structs(rules).groupBy("match_type", "match_value").agg(F.array_sort(F.collect_list(F.struct("rule.*", "r_portfolio"))).alias("of_value"))
    held = rows
    for t in MATCH_TYPES:
        found = by_value.where(F.col("match_type") == t).select(F.col("match_value").alias(f"v_{t}"), F.col("of_value").alias(f"of_{t}"))
        held = held.join(F.broadcast(found), F.col(t) == F.col(f"v_{t}"), "left").drop(f"v_{t}")
    found = [F.col(f"of_{t}") for t in MATCH_TYPES]
    several = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in found]) > 1
    kind = by_value.schema["of_value"].dataType
    all_found = F.concat(*[F.coalesce(c, F.array().cast(kind)) for c in found])
    held = held.withColumn("rules", F.when(several, F.array_sort(all_found)).otherwise(F.coalesce(*found)))
    here = F.when(F.col("portfolio_id").isNotNull() & F.col("group_id").isNotNull(), F.col("rules"))
    if "portfolio_id" in rules.columns:
        here = F.filter(here, lambda r: r.r_portfolio.isNull() | (r.r_portfolio == F.col("portfolio_id")))
    return held.withColumn("rules", here).drop(*[f"of_{t}" for t in MATCH_TYPES])


def classify(rows: DataFrame, rules: DataFrame, overrides: DataFrame | None = None, staged: Callable[[DataFrame, str], DataFrame] | None = None, *, few: int = 10_000) -> DataFrame:
    """Each identified row with its seven dimensions and the ids of what decided them.

    A row keeps the rules of its group whose dates and signed amounts hold, and the last
    non-blank value by priority wins, an override over all.

    Up to ``few`` rules are broadcast by what they match. More of them meet groups, not rows;
    with ``staged``, which writes a table and reads it back, and ``rows`` written themselves,
    they are then attached to rows so that no group, whatever share of the rows it has, is
    dealt to one task.
    """
    if rules.limit(few + 1).count() <= few:
        held = with_few_rules(rows, rules)
    elif staged is None:
        held = rows.join(rules_by_group(groups_of(rows), rules), ["portfolio_id", "group_id"], "left")
    else:
        groups = groups_of(rows)
        key = F.struct("portfolio_id", "group_id")
        sizes = groups.groupBy("portfolio_id", "group_id").agg(F.sum("rows").alias("rows"))
        every = staged(sizes.join(rules_by_group(groups, rules), ["portfolio_id", "group_id"], "left").select(key.alias("of_group"), "rules", "rows"), "rules_of_groups")
        held = attach(rows.withColumn("of_group", key), every, ["of_group"], "rows").drop("of_group")
    date, cents = F.col("transaction_date"), F.col("amount_cents")

    def fits(r: Column) -> Column:
        return (
            (r.valid_from.isNull() | (date >= r.valid_from))
            & (r.valid_to.isNull() | (date <= r.valid_to))
            & (r.min_amount_cents.isNull() | (cents >= r.min_amount_cents))
            & (r.max_amount_cents.isNull() | (cents <= r.max_amount_cents))
        )

    held = held.withColumn("rules", F.filter(F.coalesce("rules", F.array().cast(held.schema["rules"].dataType)), fits))
    none = F.struct(*[F.lit(None).cast("string").alias(f) for f in DIMENSIONS])
    last = F.aggregate("rules", none, lambda so_far, r: F.struct(*[F.coalesce(F.nullif(r[f], F.lit("")), so_far[f]).alias(f) for f in DIMENSIONS]))
    by_rule = {f"by_{f}": F.col("by_rule")[f] for f in DIMENSIONS}
    held = held.withColumn("by_rule", last).withColumns(by_rule).withColumn("rule_ids", F.transform("rules", lambda r: r.rule_id)).drop("rules", "by_rule", *[f for f in DIMENSIONS if f in rows.columns])
    if overrides is None:
        out = held.withColumns({f: F.col(f"by_{f}") for f in DIMENSIONS})
        given = F.array().cast("array<string>")
    else:
        held = held.join(last_overrides(overrides), F.col("transaction_id") == F.col("o_id"), "left")
        out = held.withColumns({f: F.coalesce(f"o_{f}", f"by_{f}") for f in DIMENSIONS})
        given = F.when(F.col("o_id").isNotNull(), F.array(F.concat(F.lit("override:"), "transaction_id"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumn("classification_provenance", F.array_join(F.concat("rule_ids", given), ";"))
    return out.drop("rule_ids", "o_id", *by_rule, *[f"o_{f}" for f in DIMENSIONS])


def expand_allocations(classified: DataFrame, allocations: DataFrame) -> DataFrame:
    """A transaction with allocations gives way to its parts, which inherit what they leave blank."""
    a = allocations.select(F.col("transaction_id").alias("a_tx"), F.col("allocation_id").alias("a_id"), F.col("amount_cents").alias("a_cents"), *[F.nullif(F.col(f), F.lit("")).alias(f"a_{f}") for f in DIMENSIONS])
    both = classified.join(a, F.col("transaction_id") == F.col("a_tx"), "left")
    part = F.col("a_id").isNotNull()
    trail = F.concat_ws(";", X.blank_to_null(F.col("classification_provenance")), F.when(part, F.concat(F.lit("allocation:"), "a_id")))
    out = both.withColumns(
        {
            "original_amount_cents": F.col("amount_cents"),
            "analytical_transaction_id": F.coalesce("a_id", "transaction_id"),
            "parent_transaction_id": F.col("transaction_id"),
            "is_allocation": part,
            "classification_provenance": trail,
            **{f: F.coalesce(f"a_{f}", f) for f in DIMENSIONS},
        }
    )
    return out.withColumn("amount_cents", F.coalesce("a_cents", "amount_cents")).drop("a_tx", "a_id", "a_cents", *[f"a_{f}" for f in DIMENSIONS])


def is_blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def any_blank() -> Column:
    """A row without one of its dimensions: the final output is refused while there is any (``refuse`` of ``write_table``)."""
    return reduce(lambda a, b: a | b, [is_blank(f) for f in DIMENSIONS])


def unclassified(rows: DataFrame) -> DataFrame:
    """Rows with any dimension blank."""
    return rows.where(any_blank())


def group_statistics(rows: DataFrame, expanded: DataFrame) -> DataFrame:
    """Per (portfolio, group): counts, dates, months, low median and other amounts, three sample texts, missing dimensions.

    Counts are over ``rows``, missing dimensions over ``expanded``. Distinct months, texts and
    amounts are first brought to one row each, so a hot group is small before it meets itself;
    counts and dates are taken with the amounts, and who a group is with the texts.
    """
    key = ["portfolio_id", "group_id"]
    size = F.abs("amount_cents")
    amounts = rows.groupBy(*key, size.alias("v")).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("amount_cents") > 0).alias("inflows"),
        F.count_if(F.col("amount_cents") < 0).alias("outflows"),
        F.min("transaction_date").alias("first"),
        F.max("transaction_date").alias("last"),
    )
    main = amounts.groupBy(*key).agg(
        F.sum("n").alias("transaction_count"),
        F.sum("inflows").alias("inflow_count"),
        F.sum("outflows").alias("outflow_count"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
        F.min("v").alias("minimum_abs_cents"),
        F.max("v").alias("maximum_abs_cents"),
        F.sum(F.col("v") * F.col("n")).alias("total_abs_cents"),
    )
    months = rows.select(*key, F.trunc("transaction_date", "MM").alias("m")).distinct().groupBy(*key).agg(F.count("*").alias("active_months"))
    low = middles_of_counts(amounts.where("v IS NOT NULL").select(*key, "v", "n"), key, "v").select(*key, F.col("low").alias("median_abs_cents"))
    order = F.struct("transaction_date", "account_id", "transaction_id", "channel", "counterparty_key", "counterparty_display")
    texts = rows.groupBy(*key, F.coalesce("description_raw", F.lit("")).alias("d")).agg(F.min(order).alias("o"))
    top = texts.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("o"))).where("n <= 3")
    firsts = F.array_sort(F.collect_list(F.struct("n", "d", "o.channel", "o.counterparty_key", "o.counterparty_display")))
    who = [F.col("firsts")[0][c].alias(c) for c in ("channel", "counterparty_key", "counterparty_display")]
    samples = top.groupBy(*key).agg(firsts.alias("firsts")).select(*key, *who, F.array_join(F.transform("firsts", lambda x: x.d), " || ").alias("sample_descriptions"))
    flags = expanded.groupBy(*key).agg(*[F.max(is_blank(f)).alias(f"no_{f}") for f in DIMENSIONS])
    names = F.array_join(F.filter(F.array(*[F.when(F.col(f"no_{f}"), f) for f in sorted(DIMENSIONS)]), lambda x: x.isNotNull()), ";")
    missing = flags.select(*key, names.alias("missing_fields"))
    out = main.join(months, key).join(low, key).join(samples, key).join(missing, key, "left")
    return out.select(
        *key, "channel", "counterparty_key", "counterparty_display", "transaction_count", "inflow_count", "outflow_count", "first_date", "last_date", "active_months", "minimum_abs_cents", "median_abs_cents", "maximum_abs_cents", "total_abs_cents", "sample_descriptions", "missing_fields"
    )


def review_queue(groups: DataFrame) -> DataFrame:
    """Groups with missing dimensions, ranked by materiality: largest single amount, then total, then key."""
    order = [F.desc("maximum_abs_cents"), F.desc("total_abs_cents"), F.col("counterparty_key"), F.col("group_id")]
    placed = running(groups.where("missing_fields <> ''"), ["portfolio_id"], "maximum_abs_cents", F.lit(1), order, falling=True)
    return placed.withColumn("rank", (F.col("before") + 1).cast("int")).drop("before")


def _twice(df: DataFrame, column: str, kind: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).count().where("count > 1").select(F.lit(kind).alias("kind"), "key")


def knowledge_violations(transactions: DataFrame, rules: DataFrame, overrides: DataFrame, allocations: DataFrame, investigations: DataFrame, events: DataFrame) -> DataFrame:
    """(kind, key): missing or repeated ids, values out of domain, dangling references, allocations that do not add up."""
    blank = lambda df, c, kind: df.where(is_blank(c)).select(F.lit(kind).alias("kind"), F.lit("").alias("key"))

    def dangling(df: DataFrame, c: str, target: str, kind: str) -> DataFrame:
        """Keys that nothing in their portfolio has; without a portfolio, nothing at all."""
        of = F.col("portfolio_id") if "portfolio_id" in df.columns else F.lit(None).cast("string")
        given = df.select(F.col(c).alias("key"), of.alias("of")).where(F.col("key").isNotNull()).distinct()
        known = transactions.select(F.col(target).alias("key"), F.col("portfolio_id").alias("of")).distinct()
        lost = given.where("of IS NOT NULL").join(known, ["key", "of"], "left_anti").union(given.where("of IS NULL").join(known, "key", "left_anti"))
        return lost.select(F.lit(kind).alias("kind"), "key").distinct()

    sums = allocations.groupBy("transaction_id").agg(F.sum("amount_cents").alias("total"))
    wrong = sums.join(transactions.select("transaction_id", F.col("amount_cents").alias("whole")), "transaction_id").where("total <> whole")
    found = [
        blank(rules, "rule_id", "rule_without_id"),
        _twice(rules, "rule_id", "duplicate_rule_id"),
        rules.where(~F.col("match_type").isin(*MATCH_TYPES)).select(F.lit("bad_match_type"), "rule_id"),
        blank(allocations, "allocation_id", "allocation_without_id"),
        _twice(allocations, "allocation_id", "duplicate_allocation_id"),
        allocations.where("amount_cents IS NULL").select(F.lit("allocation_without_amount"), "allocation_id"),
        blank(allocations, "transaction_id", "allocation_without_transaction"),
        wrong.select(F.lit("allocation_sum"), "transaction_id"),
        blank(investigations, "investigation_id", "investigation_without_id"),
        _twice(investigations, "investigation_id", "duplicate_investigation_id"),
        investigations.where(~F.col("status").isin(*STATUSES)).select(F.lit("bad_status"), "investigation_id"),
        blank(events, "event_id", "event_without_id"),
        _twice(events, "transaction_id", "transaction_in_several_events"),
        dangling(rules.where("match_type = 'group_id'"), "match_value", "group_id", "rule_group"),
        dangling(investigations, "group_id", "group_id", "investigation_group"),
        dangling(overrides, "transaction_id", "transaction_id", "override_transaction"),
        dangling(allocations, "transaction_id", "transaction_id", "allocation_transaction"),
        dangling(events, "transaction_id", "transaction_id", "event_transaction"),
    ]
    return reduce(DataFrame.union, found)
