"""The driver's tables read as a ledger: views in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerjobs.sources.tables import Staging

#: orders as transactions of 25 accounts (nations) in 5 portfolios (regions). The last digits of
#: the order number choose nature and channel, so that every measure has rows.
LEDGER = """
SELECT 'p' || CAST(n_regionkey AS STRING) AS portfolio_id,
       'a' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS account_id,
       'bank ' || CAST(n_nationkey % 3 AS STRING) AS institution,
       CASE n_nationkey % 3 WHEN 0 THEN 'bb' WHEN 1 THEN 'itau' ELSE 'other' END AS layout,
       CAST(o_orderkey AS STRING) AS transaction_id, CAST(o_orderkey AS STRING) AS analytical_transaction_id, CAST(o_orderkey AS STRING) AS parent_transaction_id,
       CAST(o_orderdate AS DATE) AS transaction_date,
       CAST(round(o_totalprice * 100) AS BIGINT) * CASE WHEN o_orderkey % 20 IN (0, 1, 2, 3, 4, 12, 13, 15, 17, 18) THEN 1 ELSE -1 END AS amount_cents,
       CASE WHEN o_orderkey % 20 < 4 THEN 'income' WHEN o_orderkey % 20 = 4 THEN 'family_support' WHEN o_orderkey % 20 < 10 THEN 'expense'
            WHEN o_orderkey % 20 = 10 THEN 'business_expense' WHEN o_orderkey % 20 = 11 THEN 'fee' WHEN o_orderkey % 20 = 12 THEN 'refund'
            WHEN o_orderkey % 20 = 13 THEN 'investment_return' WHEN o_orderkey % 20 = 14 THEN 'reserve_contribution' WHEN o_orderkey % 20 = 15 THEN 'deporte'
            WHEN o_orderkey % 20 = 16 THEN 'self_transfer_unresolved' WHEN o_orderkey % 20 = 17 THEN 'reversed_transfer'
            WHEN o_orderkey % 20 = 18 THEN 'inflow_unclassified' ELSE 'outflow_unclassified' END AS nature,
       c_mktsegment AS category, o_orderpriority AS subcategory,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'expanded' WHEN o_orderpriority = '2-HIGH' THEN 'outside' ELSE 'recurring' END AS cost_treatment,
       CASE o_orderstatus WHEN 'F' THEN 'non_recurring' WHEN 'O' THEN 'not_applicable' ELSE 'fixed_contractual' END AS recurrence,
       CAST(CASE WHEN c_mktsegment = 'MACHINERY' THEN 'false' ELSE 'true' END AS STRING) AS peak_eligible,
       CASE WHEN o_orderkey % 20 = 14 THEN 'cofrinho_application' WHEN o_orderkey % 20 = 15 THEN 'cofrinho_redemption'
            WHEN o_orderkey % 20 = 16 THEN 'bb_rende_facil' ELSE 'other' END AS channel,
       CASE WHEN n_nationkey % 3 <> 0 THEN '' WHEN o_orderkey % 20 < 5 THEN 'Pix - Recebido' WHEN o_orderkey % 20 < 10 THEN 'Compra com Cartão'
            WHEN o_orderkey % 20 = 10 THEN 'Pagamento de Boleto' WHEN o_orderkey % 20 = 11 THEN 'Cobrança de I.O.F.' WHEN o_orderkey % 20 = 16 THEN 'BB Rende Fácil' ELSE 'Pix - Enviado' END AS name_raw,
       CASE n_nationkey % 3
            WHEN 0 THEN lpad(CAST(day(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 7 AS INT)) AS STRING), 2, '0') || '/' || lpad(CAST(month(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 7 AS INT)) AS STRING), 2, '0') || ' 10:30 ' || c_name
            ELSE CASE WHEN o_orderkey % 20 = 14 THEN 'APLICACAO COFRINHOS' WHEN o_orderkey % 20 = 15 THEN 'RESGATE CDB COFRINHOS' WHEN o_orderkey % 20 < 10 THEN 'PIX QRS ' || c_name || ' X'
                 WHEN o_orderkey % 20 = 10 THEN 'PAG BOLETO ' || c_name || ' X' ELSE 'PIX TRANSF ' || c_name || ' X' END
                 || CASE WHEN o_orderkey % 20 IN (14, 15) THEN '' ELSE lpad(CAST(day(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 7 AS INT)) AS STRING), 2, '0') || ' ' || lpad(CAST(month(CAST(o_orderdate AS DATE) - CAST(o_orderkey % 7 AS INT)) AS STRING), 2, '0') END
            END AS memo_raw,
       c_name AS counterparty_display, c_name AS description_raw, 'orders' AS source_file, CAST(1 AS INT) AS source_position, c_custkey
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

#: The last balance of each account and year; one year of some accounts is off by a euro, so checks find something.
SNAPSHOTS = """
SELECT portfolio_id, account_id, institution, balance_date,
       CAST(balance + CASE WHEN year(balance_date) = 1997 AND institution = 'bank 2' THEN 100 ELSE 0 END AS BIGINT) AS balance_cents
FROM (SELECT portfolio_id, account_id, institution, transaction_date AS balance_date,
             sum(moved) OVER (PARTITION BY portfolio_id, account_id ORDER BY transaction_date) AS balance,
             row_number() OVER (PARTITION BY portfolio_id, account_id, year(transaction_date) ORDER BY transaction_date DESC) AS r
      FROM (SELECT portfolio_id, account_id, institution, transaction_date, sum(amount_cents) AS moved FROM ledger GROUP BY portfolio_id, account_id, institution, transaction_date) d) s
WHERE r = 1"""

#: Purchases of one customer of a segment in one month belong together.
TX_EVENTS = """
SELECT portfolio_id, 'e' || CAST(c_custkey AS STRING) || '-' || CAST(year(transaction_date) * 100 + month(transaction_date) AS STRING) AS event_id,
       transaction_id, 'trip' AS event_type, 'trip of ' || counterparty_display AS event_label
FROM ledger WHERE category = 'BUILDING'"""

#: Urgent purchases are split in two parts.
ALLOCATIONS = """
SELECT portfolio_id, transaction_id || '-' || CAST(part AS STRING) AS allocation_id, transaction_id,
       CASE part WHEN 1 THEN amount_cents - CAST(floor(amount_cents / 3.0) AS BIGINT) ELSE CAST(floor(amount_cents / 3.0) AS BIGINT) END AS amount_cents,
       CAST(NULL AS STRING) AS nature, CASE part WHEN 2 THEN 'shared' END AS category, CAST(NULL AS STRING) AS subcategory, CAST(NULL AS STRING) AS recurrence,
       CAST(NULL AS STRING) AS flexibility, CASE part WHEN 2 THEN 'outside' END AS cost_treatment, CAST(NULL AS STRING) AS peak_eligible
FROM ledger JOIN (SELECT 1 AS part UNION ALL SELECT 2 AS part) parts ON subcategory = '1-URGENT'"""

#: Decisions on single transactions: large ones.
OVERRIDES = """
SELECT portfolio_id, transaction_id, CAST(NULL AS STRING) AS nature, 'large' AS category, CAST(NULL AS STRING) AS subcategory, 'non_recurring' AS recurrence,
       CAST(NULL AS STRING) AS flexibility, CAST(NULL AS STRING) AS cost_treatment, 'true' AS peak_eligible
FROM ledger WHERE abs(amount_cents) >= 40000000"""

#: Rules in load order: by channel, by counterparty key, with windows of dates and amounts.
RULES = """
SELECT rule_id, CAST(priority AS INT) AS priority, match_type, match_value, CAST(valid_from AS DATE) AS valid_from, CAST(valid_to AS DATE) AS valid_to,
       CAST(min_amount_cents AS BIGINT) AS min_amount_cents, CAST(max_amount_cents AS BIGINT) AS max_amount_cents, nature, category, subcategory, recurrence, flexibility, cost_treatment, peak_eligible,
       CAST(load_order AS INT) AS load_order
FROM (VALUES
  (1, 'r01', 10, 'channel', 'debit_card_purchase', NULL, NULL, NULL, NULL, 'expense', 'shopping', 'card', 'non_recurring', 'flexible', 'recurring', 'true'),
  (2, 'r02', 10, 'channel', 'pix_received', NULL, NULL, NULL, NULL, 'income', 'income', NULL, NULL, NULL, NULL, 'false'),
  (3, 'r03', 10, 'channel', 'pix_qr_sent', NULL, NULL, NULL, NULL, 'expense', 'shopping', 'qr', 'non_recurring', 'flexible', 'recurring', 'true'),
  (4, 'r04', 10, 'channel', 'pix_transfer', NULL, NULL, NULL, -1, 'outflow_unclassified', NULL, NULL, NULL, NULL, NULL, NULL),
  (5, 'r05', 10, 'channel', 'pix_transfer', NULL, NULL, 0, NULL, 'inflow_unclassified', NULL, NULL, NULL, NULL, NULL, NULL),
  (6, 'r06', 20, 'channel', 'debit_card_purchase', '1996-01-01', '1997-12-31', NULL, NULL, NULL, 'travel', NULL, NULL, NULL, 'expanded', NULL),
  (7, 'r07', 20, 'channel', 'pix_qr_sent', NULL, NULL, NULL, -20000000, NULL, 'durable', NULL, NULL, 'fixed', 'outside', NULL),
  (8, 'r08', NULL, 'channel', 'cofrinho_application', NULL, NULL, NULL, NULL, 'reserve_contribution', 'reserve', 'reserve', 'not_applicable', 'flexible', 'outside', 'false'),
  (9, 'r09', 30, 'counterparty_key', 'CUSTOMER 000000007 X', NULL, NULL, NULL, NULL, NULL, 'family', 'family', NULL, NULL, NULL, NULL),
  (10, 'r10', 30, 'counterparty_key', 'CUSTOMER 000000003', NULL, NULL, NULL, NULL, NULL, 'rent', 'rent', 'fixed_contractual', 'fixed', 'recurring', 'false'),
  (11, 'r11', 30, 'group_id', 'no such group', NULL, NULL, NULL, NULL, 'fee', NULL, NULL, NULL, NULL, NULL, NULL)
) r(load_order, rule_id, priority, match_type, match_value, valid_from, valid_to, min_amount_cents, max_amount_cents, nature, category, subcategory, recurrence, flexibility, cost_treatment, peak_eligible)"""

VIEWS = {"ledger": LEDGER, "snapshots": SNAPSHOTS, "tx_events": TX_EVENTS, "allocations": ALLOCATIONS, "overrides": OVERRIDES, "rules": RULES}
TABLES = ("orders", "customer", "nation", "documents", "events")


class Ledger:
    """The views over one folder of tables, as DataFrames. The ledger is written to the shared folder, as most jobs read it several times; of its columns ``only`` those, if any are named."""

    only: tuple[str, ...] = ()

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._known, self.staging = spark, sf_dir, {}, Staging(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in VIEWS:
            raise AttributeError(name)
        if name not in self._known:
            sql = VIEWS[name]
            if name == "ledger":
                joined = self.spark.sql(sql.replace("FROM orders JOIN customer", "FROM {orders} orders JOIN {customer} customer").replace("JOIN nation", "JOIN {nation} nation"), **{t: self.table(t) for t in TABLES[:3]})
                self._known[name] = self.staging.table(joined.select(*self.only) if self.only else joined, name)
            elif name == "rules":
                self._known[name] = self.spark.sql(sql)
            else:
                self._known[name] = self.spark.sql(sql.replace("FROM ledger", "FROM {ledger} ledger"), ledger=self.ledger)
        return self._known[name]
