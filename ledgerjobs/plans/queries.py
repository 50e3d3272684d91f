"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerjobs.functions.helpers import normalize
from ledgerjobs.operators import classify as C
from ledgerjobs.operators import coverage, daily, dates, metrics, peaks, reserve, summary
from ledgerjobs.sources import rates as R
from ledgerjobs.sources import statements as S
from ledgerjobs.sources.tables import ORDERS, order_violations, read_ordered, read_table, write_table

from .oracles import SQL  # noqa: F401
from .statements import accounts, broken_files, files, shared_prefixes, written_files
from .views import Ledger


class Jobs:
    """The tables of one run. Each is a plan; ``kept`` ones, which several others read, are written to the shared folder first."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.v = Ledger(spark, sf_dir)
        self._made: dict[str, DataFrame] = {}
        self._kept: set[str] = set()

    def get(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = getattr(self, f"_{name}")()
        return self._made[name]

    def kept(self, *names: str) -> Jobs:
        for name in names:
            if name not in self._kept:
                self._made[name] = self.v.staging.table(self.get(name), name)
                self._kept.add(name)
        return self

    def _dated(self):
        return dates.add_operation_dates(self.v.ledger)

    def _balances(self):
        return daily.daily_balances(self.v.ledger, self.v.snapshots)

    def _flows(self):
        return daily.daily_flows(self.get("dated"))

    def _identified(self):
        return C.identify(self.v.ledger.drop("nature", "category", "subcategory", "recurrence", "cost_treatment", "peak_eligible", "channel", "counterparty_display", "analytical_transaction_id", "parent_transaction_id"))

    def _classified(self):
        return C.classify(self.kept("identified").get("identified"), self.v.rules, self.v.overrides, self.v.staging.table)

    def _expanded(self):
        return C.expand_allocations(self.get("classified"), self.v.allocations)

    def _groups(self):
        return C.group_statistics(self.get("identified"), self.get("expanded"))

    def _queue(self):
        return C.review_queue(self.get("groups"))

    def _rates(self):
        """A rate for each weekday of the orders' span, by way of a JSON payload per month."""
        span = self.v.table("orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
        days = span.select(F.explode(F.sequence(F.trunc("a", "MM"), F.col("b"), F.expr("interval 1 day"))).alias("d")).where(F.weekday("d") < 5)
        text = F.concat(F.lit("0"), F.lit(","), F.lpad((F.lit(20000) + F.pmod(F.date_diff("d", F.lit("1990-01-01").cast("date")) * 37, F.lit(30000))).cast("string"), 6, "0"))
        item = F.struct(F.date_format("d", "dd/MM/yyyy").alias("data"), text.alias("valor"))
        payloads = days.groupBy(F.trunc("d", "MM")).agg(F.to_json(F.collect_list(item)).alias("value"))
        return R.parse_payload(payloads).drop("fault", "raw")

    def _assumptions(self):
        """The anchor lies at the start of the last year of the ledger."""
        return self.v.ledger.groupBy("portfolio_id").agg(F.trunc(F.max("transaction_date"), "YEAR").alias("anchor_date")).select(
            "portfolio_id", "anchor_date", F.lit(1_000_000_000).cast("long").alias("anchor_balance_cents"), F.lit("100.0000").cast("decimal(9,4)").alias("yield_percentage")
        )

    def _reserve_events(self):
        return reserve.reserve_events(self.get("dated"))

    def _reserve_daily(self):
        return reserve.reserve_daily(self.get("reserve_events"), self.get("rates"), self.get("assumptions"))

    def _reserve_monthly(self):
        return reserve.reserve_monthly(self.get("reserve_daily"))

    def _monthly(self):
        return metrics.monthly_metrics(self.get("dated"), self.get("balances"), self.get("reserve_monthly"))

    def _categories(self):
        return metrics.monthly_category_spending(self.get("dated"))

    def _candidates(self):
        return peaks.peak_candidates(self.get("dated"), self.v.tx_events, self.v.staging.table)

    def _accounts(self):
        return accounts(self.v.ledger)

    def _contents(self):
        return files(self.v)

    def _files(self):
        return S.with_account(S.identified(self.kept("contents", "digests").get("digests")), self.get("accounts"))

    def _digests(self):
        return S.digested_pieces(self.v.staging.in_order("contents"))

    def _parsed(self):
        return S.parse(S.records_of(self.get("contents")))

    def _statements(self):
        return S.statements(self.get("files"), self.get("parsed"))

    def _statement_rows(self):
        return S.transactions(self.get("parsed"), self.get("statements"))

    def _derived(self):
        """Classified rows with their operation dates: what metrics are made of when natures come from rules."""
        return dates.add_operation_dates(self.get("expanded"))

    def _canonical(self):
        return S.canonical(self.get("statement_rows"))

    def _read_snapshots(self):
        return S.snapshots(self.get("statements"))

    def grouped(self) -> Jobs:
        """Identified rows, for jobs that need groups: of the ledger and of these rows only what groups, overrides and allocations are made of is written, and classified rows are not."""
        self.v.only = ("layout", "name_raw", "memo_raw", "subcategory", *[c for c in C.GROUPED if c not in C.IDENTITY])
        self._made["identified"] = self.get("identified").select(*C.GROUPED)
        return self.kept("identified")

    def read(self) -> Jobs:
        """Each file's content, record and header written once: contents are read from there for digests and for records."""
        return self.kept("contents", "files", "parsed", "statements")

    def read_heads(self) -> Jobs:
        """As ``read``, for jobs that need no fields of transactions: every record is read, but its fields are neither parsed nor written."""
        return self.kept("contents", "files", "statements")


def _query(make):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        jobs = Jobs(spark, sf_dir)
        out = make(jobs)
        jobs.v.staging.drop(out)
        return out

    return run


def _report(j: Jobs) -> DataFrame:
    j.kept("dated", "reserve_monthly", "monthly", "categories", "candidates")
    m, c = j.get("monthly"), j.get("candidates")
    out = summary.report_summary(j.get("dated"), m, j.get("categories"), metrics.metrics_summary(m), c, peaks.peaks_summary(c, m), j.get("reserve_monthly"))
    cats = F.array_join(F.transform("top_categories", lambda x: F.concat_ws(":", x.category, x.amount_cents.cast("string"))), ",")
    tops = F.array_join(F.transform("top_peaks", lambda x: F.concat_ws(":", F.date_format(x.start_date, "yyyy-MM-dd"), x.label, x.category, x.amount_cents.cast("string"))), ",")
    return out.withColumn("top_categories", cats).withColumn("top_peaks", tops)


def _event_flows(j: Jobs) -> DataFrame:
    """The second flow table: the users of the event stream as accounts of one portfolio."""
    rows = j.v.table("events").select(
        F.lit("web").alias("portfolio_id"), F.col("user_id").cast("string").alias("account_id"), F.lit("events").alias("institution"), F.to_date("ts").alias("operation_date"),
        (F.round(F.col("value") * 100).cast("long") * F.when(F.col("event_type") == "purchase", 1).otherwise(-1)).alias("amount_cents"),
        F.when(F.col("event_type") == "purchase", "income").otherwise("expense").alias("nature"),
    )
    return daily.daily_flows(rows)


def _inventory(j: Jobs) -> DataFrame:
    return S.inventory(j.read().get("files"), j.get("statements"), j.get("statement_rows"))


def _statement_files(j: Jobs) -> DataFrame:
    """Statements written to a folder, listed, digested and read back record by record."""
    folder, keep = written_files(j.v), j.v.staging.table
    known = j.kept("accounts").get("accounts").withColumn("path_prefix", F.concat(F.lit("account_id="), "account_id"))
    found = keep(S.with_account(S.identified(S.read_digests(j.v.spark, folder)), known), "found")
    parsed = keep(S.parse(S.read_records(j.v.spark, folder)), "records")
    heads = keep(S.statements(found, parsed), "heads")
    out = S.inventory(found, heads, S.transactions(parsed, heads))
    return out.select("portfolio_id", F.substring_index("source_file", "/", 1).alias("folder"), "source_sha256", "file_size_bytes", "format", "status", "account_fingerprint", "coverage_start", "coverage_end", "transaction_rows")


def _source_checks(j: Jobs) -> DataFrame:
    """All statements, and for each account one more of every unfit kind."""
    j.kept("accounts")
    known = j.get("accounts")
    every = j.v.staging.table(files(j.v).union(broken_files(known)), "every_file")
    digests = j.v.staging.table(S.digested_pieces(j.v.staging.in_order("every_file")), "every_digest")
    found = j.v.staging.table(S.with_account(S.identified(digests), shared_prefixes(known)), "every_found")
    parsed = j.v.staging.table(S.parse(S.records_of(every)), "every_parsed")
    heads = j.v.staging.table(S.statements(found, parsed), "every_statement")
    return S.violations(found, heads, S.transactions(parsed, heads))


def _knowledge(j: Jobs) -> DataFrame:
    """The knowledge tables with faults of most kinds worked in, chosen by the last digits of ids."""
    j.kept("identified")
    ids, v = j.get("identified"), j.v
    groups = ids.select("group_id", "channel").distinct()
    inquiries = groups.select(F.concat(F.lit("i-"), "group_id").alias("investigation_id"), "group_id", F.when(F.col("channel") == "pix_transfer", "open").otherwise("resolved").alias("status"))
    inquiries = inquiries.union(groups.where("channel = 'pix_received'").select(F.concat(F.lit("i-"), "group_id"), F.concat(F.lit("no-"), "group_id"), F.lit("resolved")))
    twice = v.rules.where("rule_id = 'r01'")
    rules = v.rules.union(twice).union(twice.withColumns({"rule_id": F.lit("r12"), "match_type": F.lit("name")})).union(twice.withColumn("rule_id", F.lit("")))
    lost = lambda df, end: df.where(F.col("transaction_id").endswith(end)).withColumn("transaction_id", F.concat(F.lit("none-"), "transaction_id"))
    elsewhere = v.overrides.where("transaction_id LIKE '%6'").withColumn("portfolio_id", F.concat(F.lit("other-"), "portfolio_id"))
    overrides = v.overrides.union(lost(v.overrides, "5")).union(elsewhere)
    parts = v.allocations.where("NOT allocation_id LIKE '%7-2'").union(lost(v.allocations, "3").withColumn("allocation_id", F.concat(F.lit("x"), "allocation_id")))
    parts = parts.union(v.allocations.where("allocation_id LIKE '%11-1'").withColumn("amount_cents", F.lit(None).cast("long")))
    events = v.tx_events.union(lost(v.tx_events, "1")).union(v.tx_events.where("transaction_id LIKE '%9'").withColumn("event_id", F.lit("again")))
    return C.knowledge_violations(ids, rules, overrides, parts, inquiries, events)


def _rate_checks(j: Jobs) -> DataFrame:
    """A payload for each order date of five years; some are broken, by the day of the month."""
    days = j.v.table("orders").select(F.to_date("o_orderdate").alias("d")).where("year(d) < 1997").distinct()
    day = F.dayofmonth("d")
    item = F.to_json(F.struct(F.when(day == 7, "soon").otherwise(F.date_format("d", "dd/MM/yyyy")).alias("data"), F.when(day == 8, "-0,05").when(day == 9, "none").otherwise("0,05").alias("valor")))
    text = F.when(day == 1, F.concat(F.lit("[{"), F.date_format("d", "yyyyMMdd"))).when(day == 2, item).when(day == 3, F.concat(F.lit("["), item, F.lit(","), item, F.lit("]")))
    text = text.when(day == 4, F.concat(F.lit("["), item, F.lit(',{"data":"'), F.date_format("d", "yyyy"), F.lit('"}]'))).when(day == 5, "[]").otherwise(F.concat(F.lit("["), item, F.lit("]")))
    return R.violations(j.v.staging.table(R.parse_payload(days.select(text.alias("value"))), "payload_rates"))


def _classified_from_files(j: Jobs) -> DataFrame:
    """Rules and overrides written to several files of unlike size and read back: their order is that of the files."""
    v, folder = j.v, j.v.staging.root
    write = lambda df, name: df.coalesce(1).write.option("header", True).csv(f"{folder}/{name}")
    rules = v.rules.drop("load_order")
    for name, some in (("rules/1", "rule_id < 'r03'"), ("rules/2", "rule_id BETWEEN 'r03' AND 'r09'"), ("rules/3", "rule_id > 'r09'")):
        write(rules.where(some).orderBy("rule_id"), name)
    write(rules.where("rule_id = 'r01'").withColumns({"rule_id": F.lit("p01"), "category": F.lit("private")}), "private/1")
    large = v.overrides.where("transaction_id LIKE '%3'")
    write(large, "overrides/a")
    write(v.overrides.withColumns({"category": F.lit("second"), "subcategory": F.lit("s" * 20)}), "overrides/b")
    write(large.withColumns({"category": F.lit("third")}).where("transaction_id LIKE '%33'"), "overrides/c")
    read = lambda name, like: read_table(v.spark, f"{folder}/{name}", T.StructType([f for f in like.schema if f.name != "load_order"]), placed=True)
    rows = C.classify(j.kept("identified").get("identified"), C.load_rules(read("rules", v.rules), read("private", v.rules)), read("overrides", v.overrides))
    return rows.select("transaction_id", "category", "subcategory", "recurrence", "classification_provenance")


def _written(name: str, table: str, *needs: str, before: Callable[[Jobs], Jobs] = lambda j: j):
    """The table written in its order, read back, and where its keys stand: ties have one place."""

    def make(j: Jobs) -> DataFrame:
        path, order = f"{j.v.staging.root}/written", ORDERS[name]
        df = before(j).kept(*needs).get(table)
        keys = [c.lstrip("-") for c in order]
        write_table(df, path, tuple(df.columns), order=order)
        rows = read_ordered(j.v.spark, path)
        wrong = order_violations(rows, order).count()
        return rows.groupBy(*keys).agg(F.min("position").alias("first_position"), F.count("*").alias("rows")).withColumn("out_of_order", F.lit(wrong).cast("long"))

    return make


def _reserve_checks(j: Jobs) -> DataFrame:
    """Movements of the wrong sign, and what makes a reserve impossible, with the events and rates of some portfolios cut."""
    j.kept("dated", "rates", "assumptions")
    events, early = j.get("reserve_events"), j.get("assumptions").withColumn("anchor_date", F.when(F.col("portfolio_id") == "p1", F.lit("1980-01-01").cast("date")).otherwise(F.col("anchor_date")))
    found = reserve.input_violations(events.where("portfolio_id <> 'p0'"), j.get("rates").where("year(date) <> 1995"), early)
    wrong = j.get("dated").withColumn("amount_cents", F.when(F.year("operation_date") == 1996, -F.col("amount_cents")).otherwise(F.col("amount_cents")))
    return found.union(reserve.sign_violations(wrong))


QUERIES = {
    name: _query(make)
    for name, make in {
        "monthly_metrics": lambda j: j.kept("dated").get("monthly"),
        "monthly_category_spending": lambda j: j.get("categories"),
        "metrics_summary": lambda j: metrics.metrics_summary(j.kept("monthly").get("monthly")),
        "metrics_quality": lambda j: metrics.metrics_quality(j.kept("dated").get("monthly"), j.get("categories")),
        "category_ranking": lambda j: metrics.category_ranking(j.kept("dated").get("categories"), j.get("monthly")),
        "operation_dates": lambda j: j.get("dated").select("transaction_id", "posting_date", "operation_date", "operation_date_source", "operation_posting_lag_days"),
        "daily_flows": lambda j: j.get("flows"),
        "flow_feed": lambda j: daily.flow_feed(j.get("flows")),
        "event_flows": _event_flows,
        "daily_balances": lambda j: j.get("balances"),
        "data_quality": lambda j: daily.data_quality(j.get("dated"), j.get("balances")),
        "anchor_checks": lambda j: daily.anchors(j.v.ledger, j.v.snapshots.where("year(balance_date) < 2000")),
        "source_inventory": _inventory,
        "canonical_transactions": lambda j: j.read().get("canonical").drop("source_sha256", "source_position", "source_file"),
        "statement_files": _statement_files,
        "source_checks": _source_checks,
        "statement_snapshots": lambda j: j.read_heads().get("read_snapshots").drop("source_sha256"),
        "coverage_summary": lambda j: coverage.coverage_summary(j.v.ledger, j.v.snapshots),
        "reconciliation": lambda j: coverage.reconciliation(j.v.ledger, j.v.snapshots),
        "transactions_classified": lambda j: j.get("expanded").select("analytical_transaction_id", "parent_transaction_id", "amount_cents", "original_amount_cents", "is_allocation", "group_id", "channel", "counterparty_key", "counterparty_display", *C.DIMENSIONS, "classification_provenance"),
        "classification_groups": lambda j: j.grouped().get("groups"),
        "review_queue": lambda j: C.review_queue(j.grouped().kept("groups").get("groups")).select("portfolio_id", "rank", "group_id", "maximum_abs_cents", "total_abs_cents", "missing_fields"),
        "unclassified_rows": lambda j: C.unclassified(j.get("expanded")).select("analytical_transaction_id", "amount_cents", *C.DIMENSIONS),
        "channel_of_canonical": lambda j: daily.attach_channel(j.v.ledger, j.get("expanded")).select("transaction_id", "channel"),
        "knowledge_checks": _knowledge,
        "normalized_text": lambda j: j.v.table("documents").select("doc_id", normalize("text").alias("normalized")),
        "daily_rates": lambda j: j.get("rates"),
        "reserve_events": lambda j: j.get("reserve_events"),
        "reserve_daily": lambda j: j.get("reserve_daily"),
        "reserve_monthly": lambda j: j.get("reserve_monthly"),
        "reserve_quality": lambda j: reserve.reserve_quality(j.kept("dated", "rates", "reserve_daily").get("reserve_daily"), j.get("reserve_events"), j.get("rates"), j.get("assumptions")),
        "tracked_assets": lambda j: reserve.tracked_assets(j.get("reserve_daily"), j.get("balances")),
        "peak_candidates": lambda j: peaks.peak_candidates(j.get("dated"), j.v.tx_events, j.v.staging.table),
        "peaks_monthly": lambda j: peaks.peaks_monthly(j.kept("dated", "candidates").get("candidates"), j.get("monthly")),
        "peaks_summary": lambda j: peaks.peaks_summary(j.kept("dated", "candidates").get("candidates"), j.kept("monthly").get("monthly")),
        "report_summary": _report,
        "written_transactions": _written("transactions", "canonical", "contents", "files", "parsed", "statements"),
        "written_snapshots": _written("snapshots", "read_snapshots", "contents", "files", "statements"),
        "written_groups": _written("groups", "groups", "groups", before=Jobs.grouped),
        "written_review_queue": _written("review_queue", "queue", "groups", "queue", before=Jobs.grouped),
        "rate_checks": _rate_checks,
        "classified_from_files": _classified_from_files,
        "reserve_checks": _reserve_checks,
        "classified_metrics": lambda j: metrics.monthly_metrics(j.kept("derived").get("derived")),
        "classified_categories": lambda j: metrics.monthly_category_spending(j.get("derived")),
    }.items()
}
