"""The same results in SQL, for DuckDB: a chain of common tables and one SELECT per query."""

from __future__ import annotations

from .views import ALLOCATIONS, LEDGER, OVERRIDES, RULES, SNAPSHOTS, TX_EVENTS

INCOME = "('income', 'family_support')"
EXPENSE = "('expense', 'business_expense', 'fee')"
REFUND = "('refund', 'tax_refund', 'deposit_refund')"
INTERNAL = "('self_transfer_unresolved', 'reversed_transfer')"
TOTAL = "contas_correntes_consolidadas"


def ratio(n: str, d: str) -> str:
    """n / d to four places, half up, in whole numbers; d must not be negative."""
    q = f"CAST((abs(CAST({n} AS HUGEINT)) * 20000 + ({d})) // (2 * ({d})) * CASE WHEN ({n}) < 0 THEN -1 ELSE 1 END AS BIGINT)"
    return f"CASE WHEN ({d}) <> 0 THEN CAST({q} * CAST(0.0001 AS DECIMAL(5, 4)) AS DECIMAL(18, 4)) END"


def half(twice: str) -> str:
    """Half of a whole number, half away from zero."""
    return f"CAST((abs({twice}) + 1) // 2 * CASE WHEN ({twice}) < 0 THEN -1 ELSE 1 END AS BIGINT)"


def median2(x: str) -> str:
    """Twice the median of whole numbers, exact."""
    return f"CAST(quantile_disc({x}, 0.5) + CASE WHEN count({x}) % 2 = 1 THEN quantile_disc({x}, 0.5) ELSE list_sort(list({x}))[count({x}) // 2 + 1] END AS BIGINT)"


def _on(year: str) -> str:
    return f"TRY_CAST(CAST({year} AS VARCHAR) || '-' || mm || '-' || dd AS DATE)"


DATED = rf"""
SELECT * EXCLUDE (dd, mm, hit), transaction_date AS posting_date, coalesce(hit, transaction_date) AS operation_date,
       CASE WHEN hit IS NULL THEN 'posting_date' WHEN layout = 'bb' THEN 'bb_memo_prefix' ELSE 'itau_memo_suffix' END AS operation_date_source,
       CAST(coalesce(hit, transaction_date) - transaction_date AS INTEGER) AS operation_posting_lag_days
FROM (SELECT *, CASE WHEN {_on('year(transaction_date)')} - transaction_date BETWEEN -4 AND 0 THEN {_on('year(transaction_date)')}
                     WHEN {_on('year(transaction_date) - 1')} - transaction_date BETWEEN -4 AND 0 THEN {_on('year(transaction_date) - 1')} END AS hit
      FROM (SELECT *, CASE layout WHEN 'bb' THEN regexp_extract(trim(memo_raw), '^(\d{{2}})/(\d{{2}})\s+\d{{2}}:\d{{2}}(?:\s+|$)', 1) WHEN 'itau' THEN regexp_extract(trim(memo_raw), '[A-Za-z](\d{{2}})\s+(\d{{2}})$', 1) ELSE '' END AS dd,
                   CASE layout WHEN 'bb' THEN regexp_extract(trim(memo_raw), '^(\d{{2}})/(\d{{2}})\s+\d{{2}}:\d{{2}}(?:\s+|$)', 2) WHEN 'itau' THEN regexp_extract(trim(memo_raw), '[A-Za-z](\d{{2}})\s+(\d{{2}})$', 2) ELSE '' END AS mm
            FROM ledger) a) b"""


def _flow_rows(source: str, day: str = "operation_date") -> str:
    c = lambda cond, v: f"sum(CASE WHEN {cond} THEN {v} ELSE 0 END)"
    a = "amount_cents"
    parts = {
        "bank_inflows_cents": c(f"{a} > 0", a),
        "bank_outflows_cents": c(f"{a} < 0", f"-{a}"),
        "net_bank_flow_cents": f"sum({a})",
        "external_income_cents": c(f"nature IN {INCOME} AND {a} > 0", a),
        "external_expense_cents": c(f"nature IN {EXPENSE} AND {a} < 0", f"-{a}"),
        "refund_cents": c(f"nature IN {REFUND}", a),
        "investment_return_cents": c("nature = 'investment_return'", a),
        "reserve_contribution_cents": c("nature = 'reserve_contribution'", f"abs({a})"),
        "deporte_cents": c("nature = 'deporte'", f"abs({a})"),
        "internal_transfer_net_cents": c(f"nature IN {INTERNAL}", a),
        "unclassified_inflow_cents": c(f"nature = 'inflow_unclassified' AND {a} > 0", a),
        "unclassified_outflow_cents": c(f"nature = 'outflow_unclassified' AND {a} < 0", f"-{a}"),
    }
    sums = ", ".join(f"{v} AS {k}" for k, v in parts.items())
    zeros = ", ".join(f"CAST(coalesce({k}, 0) AS BIGINT) AS {k}" for k in ["transaction_count", *parts])
    return f"""
    SELECT portfolio_id, account_id, date, institution, date BETWEEN f AND t AS coverage_complete, {zeros}
    FROM (SELECT portfolio_id, account_id, institution, f, t, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date
          FROM (SELECT portfolio_id, account_id, min(institution) AS institution, min({day}) AS a, max({day}) AS b, min({day}) AS f, max({day}) AS t FROM {source} GROUP BY ALL
                UNION ALL
                SELECT portfolio_id, '{TOTAL}', string_agg(DISTINCT i, ' + ' ORDER BY i), min(a), max(b), max(a), min(b)
                FROM (SELECT portfolio_id, account_id, min(institution) AS i, min({day}) AS a, max({day}) AS b FROM {source} GROUP BY ALL) GROUP BY portfolio_id) spans) spine
    LEFT JOIN (SELECT portfolio_id, {day} AS date, account_id, count(*) AS transaction_count, {sums} FROM {source} GROUP BY ALL
               UNION ALL SELECT portfolio_id, {day}, '{TOTAL}', count(*), {', '.join(parts.values())} FROM {source} GROUP BY ALL) facts
    USING (portfolio_id, account_id, date)"""


BALANCES = f"""
SELECT portfolio_id, account_id, date, institution, 'ledger_balance' AS balance_basis, ledger_balance_cents, liquidity_adjustment_cents,
       ledger_balance_cents + liquidity_adjustment_cents AS analysis_balance_cents, snapshot_balance_cents, snapshot_balance_cents - ledger_balance_cents AS snapshot_difference_cents, true AS coverage_complete
FROM (SELECT s.portfolio_id, s.account_id, s.date, s.institution, b.balance_cents AS snapshot_balance_cents,
             CAST(anchor - coalesce(sum(moved) OVER (PARTITION BY s.portfolio_id, s.account_id ORDER BY s.date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS ledger_balance_cents,
             CAST(-coalesce(sum(swept) OVER (PARTITION BY s.portfolio_id, s.account_id ORDER BY s.date ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS liquidity_adjustment_cents
      FROM (SELECT portfolio_id, account_id, l.institution, anchor, CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date
            FROM (SELECT portfolio_id, account_id, min(institution) AS institution, min(transaction_date) AS first FROM ledger GROUP BY ALL) l
            JOIN (SELECT portfolio_id, account_id, max(balance_date) AS last, arg_max(balance_cents, balance_date) AS anchor FROM snapshots GROUP BY ALL) x USING (portfolio_id, account_id)) s
      LEFT JOIN (SELECT portfolio_id, account_id, transaction_date AS date, sum(amount_cents) AS moved, sum(CASE WHEN channel = 'bb_rende_facil' OR name_raw = 'BB Rende Fácil' THEN amount_cents ELSE 0 END) AS swept FROM ledger GROUP BY ALL) m
        ON m.portfolio_id = s.portfolio_id AND m.account_id = s.account_id AND m.date = s.date
      LEFT JOIN snapshots b ON b.portfolio_id = s.portfolio_id AND b.account_id = s.account_id AND b.balance_date = s.date) q"""

ALL_BALANCES = f"""
SELECT * FROM own_balances UNION ALL
SELECT portfolio_id, '{TOTAL}', date, names, 'sum_available_analysis_balances', CAST(sum(ledger_balance_cents) AS BIGINT), CAST(sum(liquidity_adjustment_cents) AS BIGINT), CAST(sum(analysis_balance_cents) AS BIGINT), NULL, NULL, date >= any_value(started)
FROM own_balances JOIN (SELECT portfolio_id, max(s) AS started, string_agg(DISTINCT i, ' + ' ORDER BY i) AS names FROM (SELECT portfolio_id, account_id, min(date) AS s, min(institution) AS i FROM own_balances GROUP BY ALL) GROUP BY portfolio_id) USING (portfolio_id)
GROUP BY portfolio_id, date, names"""

RATES = """
SELECT d AS date, CAST((20000 + (date_diff('day', DATE '1990-01-01', d) * 37) % 30000) * CAST(0.000001 AS DECIMAL(7, 6)) AS DECIMAL(18, 6)) AS daily_rate_percent, '12' AS source_series
FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT date_trunc('month', min(o_orderdate)) AS a, CAST(max(o_orderdate) AS DATE)::TIMESTAMP AS b FROM orders)) WHERE isodow(d) < 6"""

RESERVE_EVENTS = """
SELECT portfolio_id, operation_date AS date, analytical_transaction_id, parent_transaction_id, CASE channel WHEN 'cofrinho_application' THEN 'contribution' ELSE 'deporte' END AS event_type, abs(amount_cents) AS amount_cents,
       abs(amount_cents) * CASE channel WHEN 'cofrinho_application' THEN 1 ELSE -1 END AS reserve_cashflow_cents, account_id, description_raw, source_file, source_position
FROM dated WHERE channel IN ('cofrinho_application', 'cofrinho_redemption')"""

_DIV = "CAST((abs(({n})::HUGEINT) * 2 + {d}) // (2 * {d}) * CASE WHEN {n} < 0 THEN -1 ELSE 1 END AS BIGINT)"
_BACK = _DIV.format(n="(({c}) * 100000000000000::HUGEINT)", d="(100000000000000::HUGEINT + {u})")
_FORTH = _DIV.format(n="(({c})::HUGEINT * {u})", d="100000000000000::HUGEINT")

RESERVE_DAYS = """
SELECT s.portfolio_id, CAST(s.d AS DATE) AS date, anchor, coalesce(CAST(r.daily_rate_percent * 1000000 AS BIGINT) * 1000000, 0) AS units, r.daily_rate_percent AS rate, coalesce(ci, 0) AS ci, coalesce(co, 0) AS co,
       row_number() OVER (PARTITION BY s.portfolio_id ORDER BY s.d) AS n
FROM (SELECT portfolio_id, anchor, unnest(generate_series(date_trunc('month', first), greatest(anchor, last), INTERVAL 1 DAY)) AS d
      FROM (SELECT portfolio_id, min(date) AS first, max(date)::TIMESTAMP AS last FROM reserve_events GROUP BY ALL)
      JOIN (SELECT portfolio_id, date_trunc('year', max(transaction_date))::TIMESTAMP AS anchor FROM ledger GROUP BY ALL) USING (portfolio_id)) s
LEFT JOIN rates r ON r.date = CAST(s.d AS DATE)
LEFT JOIN (SELECT portfolio_id, date, CAST(sum(CASE event_type WHEN 'contribution' THEN amount_cents ELSE 0 END) AS BIGINT) AS ci, CAST(sum(CASE event_type WHEN 'deporte' THEN amount_cents ELSE 0 END) AS BIGINT) AS co FROM reserve_events GROUP BY ALL) e
  ON e.portfolio_id = s.portfolio_id AND e.date = CAST(s.d AS DATE)"""

RESERVE_DAILY = """
SELECT d.portfolio_id, d.date, f.opening AS opening_balance_cents, CASE WHEN units <> 0 THEN CAST(rate AS DECIMAL(20, 12)) END AS cdi_daily_rate_percent, f.closing - f.opening - (ci - co) AS estimated_interest_cents,
       ci AS contribution_cents, co AS deporte_cents, ci - co AS net_cashflow_cents, f.closing AS closing_balance_cents, d.date = CAST(anchor AS DATE) AS is_anchor_date,
       CASE WHEN d.date <= CAST(anchor AS DATE) THEN 'backward_from_anchor' ELSE 'forward_from_anchor' END AS estimation_method
FROM reserve_days d JOIN fold f USING (portfolio_id, n)"""

RESERVE_MONTHLY = """
SELECT portfolio_id, strftime(date, '%Y-%m') AS month, arg_min(opening_balance_cents, date) AS opening_balance_cents, CAST(sum(contribution_cents) AS BIGINT) AS contribution_cents, CAST(sum(deporte_cents) AS BIGINT) AS deporte_cents,
       CAST(sum(net_cashflow_cents) AS BIGINT) AS net_contribution_cents, CAST(sum(estimated_interest_cents) AS BIGINT) AS estimated_interest_cents, arg_max(closing_balance_cents, date) AS closing_balance_cents,
       bool_or(is_anchor_date) AS is_anchor_month, last_day(max(date)) <= any_value(model_end) AS is_complete_month
FROM reserve_daily JOIN (SELECT portfolio_id, max(date) AS model_end FROM reserve_daily GROUP BY ALL) USING (portfolio_id) GROUP BY portfolio_id, strftime(date, '%Y-%m')"""


def _monthly(source: str = "dated", alone: bool = False) -> str:
    """``alone``: without balances and reserve."""
    none = " AND false" if alone else ""
    a = "amount_cents"
    c = lambda cond, v: f"CAST(sum(CASE WHEN {cond} THEN {v} ELSE 0 END) AS BIGINT)"
    spent = f"nature IN {EXPENSE} AND {a} < 0"
    parts = {
        "external_income_cents": c(f"nature IN {INCOME} AND {a} > 0", a),
        "gross_external_expense_cents": c(spent, f"-{a}"),
        "refund_cents": c(f"nature IN {REFUND}", a),
        "recurring_living_cost_cents": c(f"{spent} AND cost_treatment = 'recurring'", f"-{a}"),
        "atypical_expense_cents": c(f"{spent} AND cost_treatment = 'expanded'", f"-{a}"),
        "outside_living_cost_cents": c(f"{spent} AND cost_treatment = 'outside'", f"-{a}"),
        "unclassified_outflow_cents": c(f"nature = 'outflow_unclassified' AND {a} < 0", f"-{a}"),
        "unclassified_inflow_cents": c(f"nature = 'inflow_unclassified' AND {a} > 0", a),
        "investment_return_cents": c("nature = 'investment_return'", a),
        "reserve_contribution_cents": c("nature = 'reserve_contribution'", f"abs({a})"),
        "deporte_cents": c("nature = 'deporte'", f"abs({a})"),
    }
    sums = ", ".join(f"{v} AS {k}" for k, v in parts.items())
    zeros = ", ".join(f"coalesce({k}, 0) AS {k}" for k in parts)
    return f"""
    SELECT portfolio_id, month, is_complete_month, account_coverage, {", ".join(parts)}, gross_external_expense_cents - refund_cents AS net_external_expense_cents,
           external_income_cents - gross_external_expense_cents + refund_cents AS savings_cents, {ratio('external_income_cents - gross_external_expense_cents + refund_cents', 'external_income_cents')} AS savings_rate,
           recurring_living_cost_cents + atypical_expense_cents AS expanded_living_cost_cents, reserve_contribution_cents - deporte_cents AS net_reserve_contribution_cents,
           current_accounts_balance_cents, reserve_balance_cents, current_accounts_balance_cents + reserve_balance_cents AS tracked_financial_assets_cents,
           CASE WHEN is_complete_month AND reserve_balance_cents IS NOT NULL THEN {ratio('reserve_balance_cents', 'recurring_living_cost_cents')} END AS survival_index_months
    FROM (SELECT portfolio_id, month, last_day(m) <= last AS is_complete_month, CASE WHEN last_day(m) >= all_from THEN 'all_available_accounts' ELSE 'partial_accounts' END AS account_coverage, {zeros},
                 current_accounts_balance_cents, reserve_balance_cents
          FROM (SELECT portfolio_id, last, all_from, CAST(m AS DATE) AS m, strftime(m, '%Y-%m') AS month
                FROM (SELECT portfolio_id, max(l) AS last, max(f) AS all_from, unnest(generate_series(date_trunc('month', min(f)), date_trunc('month', max(l)), INTERVAL 1 MONTH)) AS m
                      FROM (SELECT portfolio_id, account_id, min(operation_date) AS f, max(operation_date) AS l FROM {source} GROUP BY ALL) GROUP BY portfolio_id)) spine
          LEFT JOIN (SELECT portfolio_id, strftime(operation_date, '%Y-%m') AS month, {sums} FROM {source} GROUP BY ALL) facts USING (portfolio_id, month)
          LEFT JOIN (SELECT portfolio_id, strftime(date, '%Y-%m') AS month, arg_max(analysis_balance_cents, date) AS current_accounts_balance_cents FROM balances WHERE account_id = '{TOTAL}'{none} GROUP BY ALL) b USING (portfolio_id, month)
          LEFT JOIN (SELECT portfolio_id, month, closing_balance_cents AS reserve_balance_cents FROM reserve_monthly WHERE true{none}) r USING (portfolio_id, month)) q"""


CATEGORIES = f"""
SELECT portfolio_id, strftime(operation_date, '%Y-%m') AS month, category, subcategory, count(*) AS transaction_count,
       CAST(sum(CASE WHEN nature IN {EXPENSE} THEN -amount_cents ELSE 0 END) AS BIGINT) AS known_expense_cents, CAST(sum(CASE WHEN nature NOT IN {EXPENSE} THEN -amount_cents ELSE 0 END) AS BIGINT) AS unclassified_outflow_cents,
       CAST(sum(-amount_cents) AS BIGINT) AS total_observed_outflow_cents,
       CAST(sum(CASE WHEN nature IN {EXPENSE} AND cost_treatment = 'recurring' THEN -amount_cents ELSE 0 END) AS BIGINT) AS recurring_cost_cents,
       CAST(sum(CASE WHEN nature IN {EXPENSE} AND cost_treatment = 'expanded' THEN -amount_cents ELSE 0 END) AS BIGINT) AS atypical_expense_cents,
       CAST(sum(CASE WHEN nature IN {EXPENSE} AND cost_treatment = 'outside' THEN -amount_cents ELSE 0 END) AS BIGINT) AS outside_living_cost_cents
FROM dated WHERE amount_cents < 0 AND (nature IN {EXPENSE} OR nature = 'outflow_unclassified') GROUP BY ALL"""

COMPARABLE = "SELECT * FROM monthly WHERE is_complete_month AND account_coverage = 'all_available_accounts'"

SUMMARY = f"""
SELECT e.portfolio_id, a AS analysis_start_month, b AS analysis_end_month, l.month AS last_complete_month, coalesce(n, 0) AS comparable_complete_months, mean AS average_recurring_living_cost_cents,
       {half('med2')} AS median_recurring_living_cost_cents, dev AS standard_deviation_living_cost_cents, {ratio('dev', 'mean')} AS coefficient_of_variation,
       l.recurring_living_cost_cents AS last_complete_recurring_living_cost_cents, l.reserve_balance_cents AS last_complete_reserve_balance_cents, l.survival_index_months AS last_complete_survival_index_months
FROM (SELECT portfolio_id, min(month) AS a, max(month) AS b FROM monthly GROUP BY ALL) e
LEFT JOIN (SELECT portfolio_id, count(*) AS n, CAST((2 * sum(recurring_living_cost_cents) + count(*)) // (2 * count(*)) AS BIGINT) AS mean, {median2('recurring_living_cost_cents')} AS med2 FROM comparable GROUP BY ALL) m USING (portfolio_id)
LEFT JOIN (SELECT portfolio_id, CAST(round(sqrt(avg(pow(CAST(recurring_living_cost_cents - mean AS DOUBLE), 2)))) AS BIGINT) AS dev FROM comparable JOIN
           (SELECT portfolio_id, CAST((2 * sum(recurring_living_cost_cents) + count(*)) // (2 * count(*)) AS BIGINT) AS mean FROM comparable GROUP BY ALL) USING (portfolio_id) GROUP BY portfolio_id) s USING (portfolio_id)
LEFT JOIN (SELECT * FROM monthly WHERE is_complete_month QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY month DESC) = 1) l USING (portfolio_id)"""

EPISODES = f"""
SELECT portfolio_id, episode_id, min(operation_date) AS start_date, max(operation_date) AS end_date, CASE WHEN event_id IS NOT NULL THEN 'linked_event' ELSE 'single_transaction' END AS episode_type,
       coalesce(nullif(any_value(event_label), ''), arg_min(counterparty_display, operation_date) FILTER (eligible)) AS label,
       CAST(sum(CASE WHEN relevant THEN -amount_cents ELSE 0 END) AS BIGINT) AS amount_cents,
       CASE WHEN count(DISTINCT category) FILTER (eligible) = 1 THEN min(category) FILTER (eligible) ELSE 'Múltiplas' END AS category,
       CASE WHEN count(DISTINCT subcategory) FILTER (eligible) = 1 THEN min(subcategory) FILTER (eligible) ELSE 'Múltiplas' END AS subcategory,
       CASE WHEN bool_or(eligible AND nature = 'outflow_unclassified') THEN 'unknown' ELSE 'known' END AS classification_status, count(DISTINCT parent_transaction_id) AS transaction_count
FROM (SELECT d.*, e.event_id, e.event_label, CASE WHEN e.event_id IS NULL THEN 'transaction:' || analytical_transaction_id ELSE 'event:' || e.event_id END AS episode_id,
             peak_eligible = 'true' AND recurrence IN ('non_recurring', 'not_applicable') AND amount_cents < 0 AS eligible, nature IN {EXPENSE} OR nature IN {REFUND} OR nature = 'outflow_unclassified' AS relevant
      FROM dated d LEFT JOIN tx_events e ON e.portfolio_id = d.portfolio_id AND e.transaction_id = d.parent_transaction_id) x
GROUP BY portfolio_id, episode_id, event_id HAVING bool_or(eligible) AND sum(CASE WHEN relevant THEN -amount_cents ELSE 0 END) > 0"""

CANDIDATES = f"""
SELECT * EXCLUDE (off2, mad4, med2), {half('med2')} AS population_median_cents, CAST((mad4 + 2) // 4 AS BIGINT) AS population_mad_cents,
       CASE WHEN mad4 > 0 THEN CAST(CASE WHEN (abs(off2)::HUGEINT * 13490 * 2) % (2 * mad4) = mad4 AND ((abs(off2)::HUGEINT * 13490) // mad4) % 2 = 0 THEN (abs(off2)::HUGEINT * 13490) // mad4
            ELSE (abs(off2)::HUGEINT * 26980 + mad4) // (2 * mad4) END * CASE WHEN off2 < 0 THEN -1 ELSE 1 END * CAST(0.0001 AS DECIMAL(5, 4)) AS DECIMAL(18, 4)) WHEN off2 = 0 THEN CAST(0 AS DECIMAL(18, 4)) END AS modified_z_score,
       CAST(3.5 AS DECIMAL(3, 1)) AS threshold, mad4 > 0 AND off2::HUGEINT * 13490 > mad4::HUGEINT * 35000 AS is_peak
FROM (SELECT o.*, mad4 FROM (SELECT e.*, med2, 2 * amount_cents - med2 AS off2 FROM episodes e JOIN (SELECT portfolio_id, {median2('amount_cents')} AS med2 FROM episodes GROUP BY ALL) USING (portfolio_id)) o
      JOIN (SELECT portfolio_id, {median2('abs(2 * amount_cents - med2)')} AS mad4 FROM episodes JOIN (SELECT portfolio_id, {median2('amount_cents')} AS med2 FROM episodes GROUP BY ALL) USING (portfolio_id) GROUP BY portfolio_id) USING (portfolio_id)) q"""

PEAKS_MONTHLY = f"""
SELECT portfolio_id, month, is_complete_month, account_coverage, coalesce(n, 0) AS peak_count, coalesce(t, 0) AS peak_total_cents, coalesce(mean, 0) AS average_peak_cents, coalesce({half('med2')}, 0) AS median_peak_cents, coalesce(hi, 0) AS largest_peak_cents,
       {ratio('coalesce(t, 0)', 'gross_external_expense_cents')} AS peak_share_of_gross_expense
FROM monthly LEFT JOIN (SELECT portfolio_id, strftime(start_date, '%Y-%m') AS month, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS t, CAST((2 * sum(amount_cents) + count(*)) // (2 * count(*)) AS BIGINT) AS mean,
                               {median2('amount_cents')} AS med2, max(amount_cents) AS hi FROM candidates WHERE is_peak GROUP BY ALL) p USING (portfolio_id, month)"""

PEAKS_SUMMARY = f"""
SELECT portfolio_id, 'upper_modified_z_score_on_non_recurring_amounts' AS method, CAST(3.5 AS DECIMAL(3, 1)) AS threshold, coalesce(c, 0) AS candidate_count, coalesce(n, 0) AS peak_count, coalesce(kn, 0) AS known_peak_count,
       coalesce(un, 0) AS unknown_peak_count, months AS complete_month_count, {ratio('coalesce(n, 0)', 'months')} AS peaks_per_complete_month, full_months AS full_coverage_complete_month_count, coalesce(fn, 0) AS full_coverage_peak_count,
       {ratio('coalesce(fn, 0)', 'full_months')} AS peaks_per_full_coverage_month, coalesce(t, 0) AS peak_total_cents, mean AS average_peak_cents, {half('med2')} AS median_peak_cents, hi AS largest_peak_cents, lo AS smallest_peak_cents
FROM (SELECT portfolio_id, count(*) FILTER (is_complete_month) AS months, count(*) FILTER (is_complete_month AND account_coverage = 'all_available_accounts') AS full_months FROM monthly GROUP BY ALL) m
LEFT JOIN (SELECT portfolio_id, count(*) AS c FROM candidates GROUP BY ALL) a USING (portfolio_id)
LEFT JOIN (SELECT p.portfolio_id, count(*) AS n, count(*) FILTER (classification_status = 'known') AS kn, count(*) FILTER (classification_status = 'unknown') AS un, count(x.month) AS fn, CAST(sum(amount_cents) AS BIGINT) AS t,
                  CAST((2 * sum(amount_cents) + count(*)) // (2 * count(*)) AS BIGINT) AS mean, {median2('amount_cents')} AS med2, max(amount_cents) AS hi, min(amount_cents) AS lo
           FROM candidates p LEFT JOIN comparable x ON x.portfolio_id = p.portfolio_id AND x.month = strftime(p.start_date, '%Y-%m') WHERE is_peak GROUP BY p.portfolio_id) s USING (portfolio_id)"""

IDENTIFIED = r"""
SELECT * EXCLUDE (party), regexp_replace(upper(trim(regexp_replace(strip_accents(party), '[^A-Za-z0-9]+', ' ', 'g'))), ' +', ' ', 'g') AS counterparty_key, party AS counterparty_display,
       substr(sha256(channel || chr(0) || trim(regexp_replace(upper(strip_accents(party)), '[^A-Z0-9]+', ' ', 'g'))), 1, 20) AS group_id
FROM (SELECT portfolio_id, account_id, transaction_id, transaction_date, amount_cents, description_raw, layout, memo_raw,
       CASE WHEN layout = 'bb' THEN CASE name_raw WHEN 'Pix - Recebido' THEN 'pix_received' WHEN 'Compra com Cartão' THEN 'debit_card_purchase' WHEN 'Pagamento de Boleto' THEN 'bill_payment' WHEN 'Cobrança de I.O.F.' THEN 'bank_iof'
                 WHEN 'BB Rende Fácil' THEN 'bb_rende_facil' WHEN 'Pix - Enviado' THEN 'pix_sent' ELSE 'bb_other' END
            WHEN memo_raw = 'APLICACAO COFRINHOS' THEN 'cofrinho_application' WHEN memo_raw = 'RESGATE CDB COFRINHOS' THEN 'cofrinho_redemption' WHEN memo_raw LIKE 'PIX QRS %' THEN 'pix_qr_sent'
            WHEN memo_raw LIKE 'PIX TRANSF %' THEN 'pix_transfer' WHEN memo_raw LIKE 'PAG BOLETO %' THEN 'bill_payment' ELSE 'itau_other' END AS channel,
       CASE WHEN layout = 'bb' THEN CASE name_raw WHEN 'BB Rende Fácil' THEN name_raw WHEN 'Cobrança de I.O.F.' THEN memo_raw ELSE regexp_replace(memo_raw, '^\d{2}/\d{2}\s+\d{2}:\d{2}\s+', '') END
            ELSE trim(regexp_replace(regexp_replace(memo_raw, '([A-Za-z])\d{2}\s+\d{2}$', '\1'), '^(PIX QRS|PIX TRANSF|PAG BOLETO) ', '')) END AS party
      FROM ledger) a"""

_DIMS = ("nature", "category", "subcategory", "recurrence", "flexibility", "cost_treatment", "peak_eligible")
_LAST = ", ".join(f"arg_max(r.{d}, (coalesce(r.priority, 0), r.load_order)) FILTER (r.{d} <> '') AS {d}" for d in _DIMS)
CLASSIFIED = f"""
SELECT i.*, {", ".join(f"coalesce(nullif(o.{d}, ''), c.{d}) AS {d}" for d in _DIMS)}, coalesce(c.ids, '') || CASE WHEN o.transaction_id IS NULL THEN '' ELSE CASE WHEN c.ids IS NULL THEN '' ELSE ';' END || 'override:' || o.transaction_id END AS classification_provenance
FROM identified i
LEFT JOIN (SELECT x.transaction_id, {_LAST}, string_agg(r.rule_id, ';' ORDER BY coalesce(r.priority, 0), r.load_order) AS ids
           FROM identified x JOIN rules r ON CASE r.match_type WHEN 'channel' THEN x.channel WHEN 'group_id' THEN x.group_id ELSE x.counterparty_key END = r.match_value
                AND (r.valid_from IS NULL OR x.transaction_date >= r.valid_from) AND (r.valid_to IS NULL OR x.transaction_date <= r.valid_to)
                AND (r.min_amount_cents IS NULL OR x.amount_cents >= r.min_amount_cents) AND (r.max_amount_cents IS NULL OR x.amount_cents <= r.max_amount_cents)
           GROUP BY x.transaction_id) c USING (transaction_id)
LEFT JOIN overrides o ON o.transaction_id = i.transaction_id"""

EXPANDED = f"""
SELECT c.* EXCLUDE (amount_cents, classification_provenance, {", ".join(_DIMS)}), coalesce(a.amount_cents, c.amount_cents) AS amount_cents, c.amount_cents AS original_amount_cents, coalesce(a.allocation_id, c.transaction_id) AS analytical_transaction_id,
       c.transaction_id AS parent_transaction_id, a.allocation_id IS NOT NULL AS is_allocation, {", ".join(f"coalesce(nullif(a.{d}, ''), c.{d}) AS {d}" for d in _DIMS)},
       concat_ws(';', nullif(c.classification_provenance, ''), 'allocation:' || a.allocation_id) AS classification_provenance
FROM classified c LEFT JOIN allocations a USING (transaction_id)"""

_MISSING = ", ".join(f"CASE WHEN bool_or(coalesce({d}, '') = '') THEN '{d}' END" for d in sorted(_DIMS))
GROUPS = f"""
SELECT g.*, coalesce(missing_fields, '') AS missing_fields, sample_descriptions
FROM (SELECT portfolio_id, group_id, arg_min(channel, (transaction_date, account_id, transaction_id)) AS channel, arg_min(counterparty_key, (transaction_date, account_id, transaction_id)) AS counterparty_key,
             arg_min(counterparty_display, (transaction_date, account_id, transaction_id)) AS counterparty_display, count(*) AS transaction_count, count(*) FILTER (amount_cents > 0) AS inflow_count, count(*) FILTER (amount_cents < 0) AS outflow_count,
             min(transaction_date) AS first_date, max(transaction_date) AS last_date, count(DISTINCT strftime(transaction_date, '%Y-%m')) AS active_months, min(abs(amount_cents)) AS minimum_abs_cents,
             quantile_disc(abs(amount_cents), 0.5) AS median_abs_cents, max(abs(amount_cents)) AS maximum_abs_cents, CAST(sum(abs(amount_cents)) AS BIGINT) AS total_abs_cents FROM identified GROUP BY portfolio_id, group_id) g
JOIN (SELECT portfolio_id, group_id, concat_ws(';', {_MISSING}) AS missing_fields FROM expanded GROUP BY portfolio_id, group_id) m USING (portfolio_id, group_id)
JOIN (SELECT portfolio_id, group_id, string_agg(description_raw, ' || ' ORDER BY r) AS sample_descriptions FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id, group_id ORDER BY o) AS r
      FROM (SELECT portfolio_id, group_id, description_raw, min((transaction_date, account_id, transaction_id)) AS o FROM identified GROUP BY ALL)) WHERE r <= 3 GROUP BY portfolio_id, group_id) s USING (portfolio_id, group_id)"""

_DESC = "CASE WHEN name_raw <> '' AND memo_raw <> '' THEN name_raw || ' | ' || memo_raw ELSE name_raw || memo_raw END"
# the n-th repeat of a movement without a bank id counts inside a file; months and quarters agree on it
CANONICAL = f"""
SELECT sha256(CASE WHEN layout <> 'itau' THEN concat_ws(chr(0), 'bank-id', fp, transaction_id, CAST(transaction_date AS VARCHAR), CAST(amount_cents AS VARCHAR), dsc)
                   ELSE concat_ws(chr(0), 'fallback', fp, CAST(transaction_date AS VARCHAR), CAST(amount_cents AS VARCHAR), dsc, CAST(n AS VARCHAR)) END) AS transaction_id,
       portfolio_id, account_id, institution, fp AS account_fingerprint, transaction_date, amount_cents, 'OTHER' AS transaction_type, CASE WHEN layout <> 'itau' THEN transaction_id ELSE '' END AS bank_transaction_id, dsc AS description_raw, trim(name_raw) AS name_raw, memo_raw
FROM (SELECT *, sha256('bank-' || account_id || chr(0) || account_id) AS fp, {_DESC} AS dsc, row_number() OVER (PARTITION BY account_id, transaction_date, amount_cents, {_DESC} ORDER BY CAST(transaction_id AS BIGINT)) AS n FROM ledger) x"""

CHAIN = {
    "ledger": LEDGER,
    "snapshots": SNAPSHOTS,
    "tx_events": TX_EVENTS,
    "allocations": ALLOCATIONS,
    "overrides": OVERRIDES,
    "rules": RULES,
    "dated": DATED,
    "own_balances": BALANCES,
    "balances": ALL_BALANCES,
    "rates": RATES,
    "reserve_events": RESERVE_EVENTS,
    "reserve_days": RESERVE_DAYS,
    "reserve_daily": RESERVE_DAILY,
    "reserve_monthly": RESERVE_MONTHLY,
    "monthly": _monthly(),
    "categories": CATEGORIES,
    "comparable": COMPARABLE,
    "episodes": EPISODES,
    "candidates": CANDIDATES,
    "identified": IDENTIFIED,
    "classified": CLASSIFIED,
    "expanded": EXPANDED,
    "groups": GROUPS,
    "derived": DATED.replace("FROM ledger)", "FROM expanded)"),
    "flows": _flow_rows("dated"),
    "web": "SELECT 'web' AS portfolio_id, CAST(user_id AS VARCHAR) AS account_id, 'events' AS institution, CAST(ts AS DATE) AS operation_date, CAST(round(value * 100) AS BIGINT) * CASE event_type WHEN 'purchase' THEN 1 ELSE -1 END AS amount_cents, CASE event_type WHEN 'purchase' THEN 'income' ELSE 'expense' END AS nature FROM events",
}
# the backward and the forward half of the fold, each a recursion of its own
CHAIN["back"] = f"""
SELECT portfolio_id, n, {_BACK.format(c='1000000000 - (ci - co)', u='units')} AS opening, 1000000000::BIGINT AS closing FROM reserve_days WHERE date = CAST(anchor AS DATE)
UNION ALL SELECT d.portfolio_id, d.n, {_BACK.format(c='b.opening - (ci - co)', u='units')}, b.opening FROM back b JOIN reserve_days d ON d.portfolio_id = b.portfolio_id AND d.n = b.n - 1"""
CHAIN["forth"] = f"""
SELECT portfolio_id, n, 1000000000::BIGINT AS opening, 1000000000::BIGINT AS closing FROM reserve_days WHERE date = CAST(anchor AS DATE)
UNION ALL SELECT d.portfolio_id, d.n, b.closing, b.closing + {_FORTH.format(c='b.closing', u='units')} + ci - co FROM forth b JOIN reserve_days d ON d.portfolio_id = b.portfolio_id AND d.n = b.n + 1"""
CHAIN["fold"] = "SELECT * FROM back UNION ALL SELECT f.* FROM forth f JOIN reserve_days d USING (portfolio_id, n) WHERE d.date > CAST(d.anchor AS DATE)"
ORDER = [k for k in CHAIN if k not in ("back", "forth", "fold")]
ORDER[ORDER.index("reserve_days") + 1 : ORDER.index("reserve_days") + 1] = ["back", "forth", "fold"]
PREFIX = "WITH RECURSIVE " + ",\n".join(f"{k} AS ({CHAIN[k]})" for k in ORDER)

_ACCOUNTS = "SELECT DISTINCT portfolio_id, account_id, institution FROM ledger"
_SAFE = lambda c: f"replace(replace({c}, '&', '&amp;'), '<', '&lt;')"
_MONEY = lambda c: f"CAST(CAST({c} * CAST(0.01 AS DECIMAL(3, 2)) AS DECIMAL(20, 2)) AS VARCHAR)"
_NL = "chr(10)"
_TX = f"""concat('<STMTTRN><TRNTYPE>other', {_NL}, '<DTPOSTED>', strftime(transaction_date, '%Y%m%d'), '120000[-03:EST]', {_NL}, '<TRNAMT>', {_MONEY("amount_cents")},
        CASE WHEN layout <> 'itau' THEN {_NL} || '<FITID>' || transaction_id ELSE '' END, {_NL}, '<NAME>', {_SAFE("name_raw")}, {_NL}, '<MEMO>', {_SAFE("memo_raw")}, {_NL}, '</STMTTRN>', {_NL})"""
_TEXT = f"""concat('OFXHEADER:100', {_NL}, 'ENCODING:UTF-8', {_NL}, {_NL}, '<OFX><BANKACCTFROM><BANKID>bank-', account_id, {_NL}, '<ACCTID>', account_id, {_NL}, '</BANKACCTFROM><BANKTRANLIST>', {_NL}, txs,
        '<STMTTRN><TRNTYPE>OTHER', {_NL}, '<DTPOSTED>', strftime(b, '%Y%m%d'), {_NL}, '<TRNAMT>0.00', {_NL}, '<FITID>', {_NL}, '<NAME>Saldo do dia', {_NL}, '<MEMO>', {_NL}, '</STMTTRN>', {_NL}, '</BANKTRANLIST>',
        CASE WHEN balance_cents IS NOT NULL THEN concat('<LEDGERBAL><BALAMT>', {_MONEY("balance_cents")}, {_NL}, '<DTASOF>', strftime(b, '%Y%m%d'), {_NL}, '</LEDGERBAL>') ELSE '' END, '</OFX>', {_NL})"""
INVENTORY = f"""
SELECT portfolio_id, source_file, sha256(text) AS source_sha256, strlen(text) AS file_size_bytes, institution, account_id, 'ofx' AS format, true AS supported, duplicate_of, 'parsed' AS status, sha256('bank-' || account_id || chr(0) || account_id) AS account_fingerprint,
       a AS coverage_start, b AS coverage_end, balance_date, balance_cents, n + 1 AS ofx_rows, CAST(1 AS BIGINT) AS ignored_balance_markers, n AS transaction_rows
FROM (WITH periods AS (SELECT portfolio_id, account_id, institution, period, count(*) AS n, count(DISTINCT strftime(d, '%Y-%m')) AS months, min(d) AS a, max(d) AS b, string_agg(tx, '' ORDER BY d, k) AS txs
                       FROM (SELECT portfolio_id, account_id, institution, transaction_date AS d, CAST(transaction_id AS BIGINT) AS k, {_TX} AS tx,
                                    unnest(['m' || strftime(transaction_date, '%Y-%m'), 'q' || CAST(year(transaction_date) AS VARCHAR) || '-' || CAST(quarter(transaction_date) AS VARCHAR)]) AS period FROM ledger) GROUP BY ALL),
           full_periods AS (SELECT *, {_TEXT} AS text FROM (SELECT p.*, s.balance_date, s.balance_cents FROM periods p LEFT JOIN snapshots s ON p.period LIKE 'q%' AND s.account_id = p.account_id AND s.balance_date = p.b))
      SELECT *, account_id || '/' || period || '.ofx' AS source_file, CASE WHEN period LIKE 'q%' AND months = 1 AND balance_date IS NULL THEN account_id || '/m' || strftime(a, '%Y-%m') || '.ofx' END AS duplicate_of FROM full_periods
      UNION ALL SELECT *, account_id || '/z/' || period || '.ofx', account_id || '/' || period || '.ofx' FROM full_periods WHERE period LIKE 'm%-01') f"""

STATEMENT_FILES = f"""
SELECT portfolio_id, 'account_id=' || account_id AS folder, sha256(text) AS source_sha256, strlen(text) AS file_size_bytes, 'ofx' AS format, 'parsed' AS status, sha256('bank-' || account_id || chr(0) || account_id) AS account_fingerprint,
       a AS coverage_start, b AS coverage_end, n AS transaction_rows
FROM (SELECT *, concat('OFXHEADER:100', {_NL}, 'ENCODING:UTF-8', {_NL}, '<OFX><BANKACCTFROM><BANKID>bank-', account_id, {_NL}, '<ACCTID>', account_id, {_NL}, '</BANKACCTFROM><BANKTRANLIST>', {_NL}, txs, '</BANKTRANLIST></OFX>', {_NL}) AS text
      FROM (SELECT portfolio_id, account_id, count(*) AS n, min(transaction_date) AS a, max(transaction_date) AS b, string_agg({_TX}, '' ORDER BY transaction_date, CAST(transaction_id AS BIGINT)) AS txs FROM ledger GROUP BY ALL))"""

_FAULTS = (
    ("unknown_account", "'none-' || account_id || '/a.ofx'"), ("ambiguous_account", "'twice-' || account_id || '/a.ofx'"), ("undecodable", "account_id || '/broken/bytes.ofx'"), ("unexpected_bank", "account_id || '/broken/bank.ofx'"),
    ("missing_account_id", "account_id || '/broken/bank.ofx'"), ("missing_account_id", "account_id || '/broken/number.ofx'"), ("no_transactions", "account_id || '/broken/empty.ofx'"), ("bad_balance", "account_id || '/broken/balance.ofx'"),
    ("several_fingerprints", "account_id"), ("bad_date_or_amount", "account_id || '/broken/row.ofx#1'"), ("conflicting_balance", "account_id || '@1990-01-01'"),
    ("conflicting_transaction", "sha256(concat_ws(chr(0), 'bank-id', sha256('bank-' || account_id || chr(0) || account_id || '-shared'), 'x8', '1990-01-02', '100', 'n | ' || account_id))"),
)
SOURCE_CHECKS = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {key} AS key FROM ({_ACCOUNTS})" for kind, key in _FAULTS)

KNOWLEDGE = """
SELECT * FROM (WITH parts AS (SELECT * FROM allocations WHERE NOT allocation_id LIKE '%7-2'), g AS (SELECT DISTINCT group_id, channel FROM identified)
SELECT 'rule_without_id' AS kind, '' AS key UNION ALL SELECT 'duplicate_rule_id', 'r01' UNION ALL SELECT 'bad_match_type', 'r12' UNION ALL SELECT 'rule_group', 'no such group'
UNION ALL SELECT 'duplicate_allocation_id', allocation_id FROM parts WHERE allocation_id LIKE '%11-1' UNION ALL SELECT 'allocation_without_amount', allocation_id FROM parts WHERE allocation_id LIKE '%11-1'
UNION ALL SELECT 'allocation_sum', p.transaction_id FROM parts p JOIN ledger l USING (transaction_id) GROUP BY p.transaction_id, l.amount_cents HAVING sum(p.amount_cents) <> l.amount_cents
UNION ALL SELECT 'duplicate_investigation_id', 'i-' || group_id FROM g WHERE channel = 'pix_received' UNION ALL SELECT 'investigation_group', 'no-' || group_id FROM g WHERE channel = 'pix_received'
UNION ALL SELECT 'bad_status', 'i-' || group_id FROM g WHERE channel = 'pix_transfer'
UNION ALL SELECT 'transaction_in_several_events', transaction_id FROM tx_events WHERE transaction_id LIKE '%9' UNION ALL SELECT 'event_transaction', 'none-' || transaction_id FROM tx_events WHERE transaction_id LIKE '%1'
UNION ALL SELECT 'override_transaction', transaction_id FROM overrides WHERE transaction_id LIKE '%6' UNION ALL SELECT 'override_transaction', 'none-' || transaction_id FROM overrides WHERE transaction_id LIKE '%5' UNION ALL SELECT DISTINCT 'allocation_transaction', 'none-' || transaction_id FROM allocations WHERE transaction_id LIKE '%3') k"""

_DAYS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, day(CAST(o_orderdate AS DATE)) AS n FROM orders WHERE year(CAST(o_orderdate AS DATE)) < 1997)"
_ITEM = """concat('{"data":"', CASE n WHEN 7 THEN 'soon' ELSE strftime(d, '%d/%m/%Y') END, '","valor":"', CASE n WHEN 8 THEN '-0,05' WHEN 9 THEN 'none' ELSE '0,05' END, '"}')"""
RATE_CHECKS = f"""
SELECT 'bad_payload' AS kind, '[{{' || strftime(d, '%Y%m%d') AS key FROM {_DAYS} WHERE n = 1 UNION ALL SELECT 'not_a_list', {_ITEM} FROM {_DAYS} WHERE n = 2 UNION ALL SELECT 'duplicate_date', CAST(d AS VARCHAR) FROM {_DAYS} WHERE n = 3
UNION ALL SELECT 'bad_item', '{{"data":"' || strftime(d, '%Y') || '"}}' FROM {_DAYS} WHERE n = 4 UNION ALL SELECT 'bad_item', {_ITEM} FROM {_DAYS} WHERE n IN (7, 9) UNION ALL SELECT 'negative_rate', CAST(d AS VARCHAR) FROM {_DAYS} WHERE n = 8"""

# a private rule after all base rules of its priority; the last file's override
FROM_FILES = f"""
SELECT * FROM (WITH all_rules AS (SELECT * FROM rules UNION ALL SELECT * REPLACE ('p01' AS rule_id, 'private' AS category, 100 AS load_order) FROM rules WHERE rule_id = 'r01'),
c AS (SELECT x.transaction_id, {_LAST}, string_agg(r.rule_id, ';' ORDER BY coalesce(r.priority, 0), r.load_order) AS ids
      FROM identified x JOIN all_rules r ON CASE r.match_type WHEN 'channel' THEN x.channel WHEN 'group_id' THEN x.group_id ELSE x.counterparty_key END = r.match_value
           AND (r.valid_from IS NULL OR x.transaction_date >= r.valid_from) AND (r.valid_to IS NULL OR x.transaction_date <= r.valid_to)
           AND (r.min_amount_cents IS NULL OR x.amount_cents >= r.min_amount_cents) AND (r.max_amount_cents IS NULL OR x.amount_cents <= r.max_amount_cents) GROUP BY x.transaction_id)
SELECT i.transaction_id, CASE WHEN o.transaction_id IS NULL THEN c.category WHEN o.transaction_id LIKE '%33' THEN 'third' ELSE 'second' END AS category,
       CASE WHEN o.transaction_id IS NULL OR o.transaction_id LIKE '%33' THEN c.subcategory ELSE repeat('s', 20) END AS subcategory, coalesce(o.recurrence, c.recurrence) AS recurrence,
       concat_ws(';', c.ids, 'override:' || o.transaction_id) AS classification_provenance
FROM identified i LEFT JOIN c USING (transaction_id) LEFT JOIN overrides o ON o.transaction_id = i.transaction_id) q"""

RESERVE_CHECKS = """
SELECT DISTINCT 'no_events' AS kind, portfolio_id AS key FROM reserve_events WHERE portfolio_id = 'p0' UNION ALL SELECT DISTINCT 'anchor_before_events', portfolio_id FROM reserve_events WHERE portfolio_id = 'p1'
UNION ALL SELECT 'missing_rates', portfolio_id FROM reserve_days WHERE portfolio_id NOT IN ('p0', 'p1') AND isodow(date) < 6 AND (rate IS NULL OR year(date) = 1995) GROUP BY portfolio_id HAVING count(*) > 25
UNION ALL SELECT 'reserve_sign', analytical_transaction_id FROM dated WHERE channel IN ('cofrinho_application', 'cofrinho_redemption') AND year(operation_date) = 1996"""

RESERVE_QUALITY = """
SELECT portfolio_id, unnest(['anchor_balance', 'daily_roll_forward', 'recorded_events', 'cdi_rates', 'unrecorded_post_anchor_contributions']) AS check_type,
       unnest([CASE WHEN at_anchor = 1000000000 THEN 'balanced' ELSE 'mismatch' END, CASE WHEN broken = 0 THEN 'balanced' ELSE 'mismatch' END, 'ok', 'ok', 'excluded']) AS status,
       unnest([at_anchor, broken, events, rates, 0]) AS observed_value, unnest([1000000000, 0, events, rates, 0]) AS expected_value,
       unnest([CAST(anchor AS VARCHAR), CAST(days AS VARCHAR) || ' days', CAST(ins AS VARCHAR) || ' contributions; ' || CAST(outs AS VARCHAR) || ' withdrawals', 'SGS 12; ' || CAST(r0 AS VARCHAR) || ' to ' || CAST(r1 AS VARCHAR), 'later contributions outside the statements are not estimated']) AS details
FROM (SELECT portfolio_id, max(closing_balance_cents) FILTER (is_anchor_date) AS at_anchor, max(date) FILTER (is_anchor_date) AS anchor, count(*) FILTER (opening_balance_cents + estimated_interest_cents + net_cashflow_cents <> closing_balance_cents) AS broken, count(*) AS days FROM reserve_daily GROUP BY portfolio_id) d
JOIN (SELECT portfolio_id, count(*) AS events, count(*) FILTER (event_type = 'contribution') AS ins, count(*) FILTER (event_type = 'deporte') AS outs FROM reserve_events GROUP BY portfolio_id) e USING (portfolio_id),
(SELECT count(*) AS rates, min(date) AS r0, max(date) AS r1 FROM rates) r"""


def _share(n: str, d: str) -> str:
    return f"CAST(coalesce({ratio(n, d)}, 0) AS DECIMAL(18, 4))"


REPORT = f"""
SELECT portfolio_id, s.analysis_start_month AS first_month, s.analysis_end_month AS last_month, s.last_complete_month, s.average_recurring_living_cost_cents AS average_living_cost_cents, s.median_recurring_living_cost_cents AS median_living_cost_cents,
       s.standard_deviation_living_cost_cents, s.coefficient_of_variation AS living_cost_cv, s.last_complete_recurring_living_cost_cents AS latest_living_cost_cents, s.last_complete_reserve_balance_cents AS latest_reserve_cents,
       s.last_complete_survival_index_months AS latest_survival_months, comparable_months, lo.cost AS minimum_living_cost_cents, lo.month AS minimum_living_cost_month, hi.cost AS maximum_living_cost_cents, hi.month AS maximum_living_cost_month,
       median_survival_months, {_share('s.last_complete_reserve_balance_cents', 'hi.cost')} AS conservative_survival_months, total_income_cents, total_gross_expense_cents, total_net_expense_cents, total_savings_cents, positive_savings_months,
       w.month AS worst_savings_month, w.savings_cents AS worst_savings_cents, w.gross_external_expense_cents AS worst_month_gross_expense_cents, w.atypical_expense_cents AS worst_month_atypical_expense_cents,
       total_savings_cents - w.savings_cents AS savings_without_worst_month_cents, reserve_opening_cents, reserve_closing_cents, reserve_interest_cents, m.reserve_contribution_cents, deportes_cents, m.net_reserve_contribution_cents,
       unknown_transactions, transaction_count, unknown_outflows, outflow_count, comparable_unknown_outflow_count, comparable_outflow_count, comparable_unknown_outflow_cents, comparable_observed_outflow_cents,
       peak_count, peak_total_cents, average_peak_cents, median_peak_cents, largest_peak_cents, smallest_peak_cents, unknown_peak_count, coalesce(comparable_peak_count, 0) AS comparable_peak_count,
       {_share('unknown_transactions', 'transaction_count')} AS unknown_transaction_share, {_share('comparable_unknown_outflow_cents', 'comparable_observed_outflow_cents')} AS unknown_outflow_share,
       {_share('first_two', 'comparable_observed_outflow_cents')} AS top_two_category_share, top_categories, top_peaks
FROM ({SUMMARY}) s
LEFT JOIN (SELECT portfolio_id, count(*) AS comparable_months, CAST(quantile_cont(CAST(survival_index_months AS DOUBLE), 0.5) AS DECIMAL(18, 5)) AS median_survival_months, CAST(sum(external_income_cents) AS BIGINT) AS total_income_cents,
                  CAST(sum(gross_external_expense_cents) AS BIGINT) AS total_gross_expense_cents, CAST(sum(net_external_expense_cents) AS BIGINT) AS total_net_expense_cents, CAST(sum(savings_cents) AS BIGINT) AS total_savings_cents,
                  count(*) FILTER (savings_cents > 0) AS positive_savings_months, CAST(sum(reserve_contribution_cents) AS BIGINT) AS reserve_contribution_cents, CAST(sum(deporte_cents) AS BIGINT) AS deportes_cents,
                  CAST(sum(net_reserve_contribution_cents) AS BIGINT) AS net_reserve_contribution_cents FROM comparable GROUP BY portfolio_id) m USING (portfolio_id)
LEFT JOIN (SELECT portfolio_id, month, savings_cents, gross_external_expense_cents, atypical_expense_cents FROM comparable QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY savings_cents, month) = 1) w USING (portfolio_id)
LEFT JOIN (SELECT portfolio_id, month, recurring_living_cost_cents AS cost FROM comparable QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY recurring_living_cost_cents, month) = 1) lo USING (portfolio_id)
LEFT JOIN (SELECT portfolio_id, month, recurring_living_cost_cents AS cost FROM comparable QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY recurring_living_cost_cents DESC, month) = 1) hi USING (portfolio_id)
LEFT JOIN (SELECT r.portfolio_id, arg_min(opening_balance_cents, month) AS reserve_opening_cents, arg_max(closing_balance_cents, month) AS reserve_closing_cents, CAST(sum(estimated_interest_cents) AS BIGINT) AS reserve_interest_cents
           FROM reserve_monthly r SEMI JOIN comparable USING (portfolio_id, month) WHERE is_complete_month GROUP BY r.portfolio_id) held USING (portfolio_id)
LEFT JOIN (SELECT d.portfolio_id, count(*) FILTER (nature IN ('inflow_unclassified', 'outflow_unclassified')) AS unknown_transactions, count(*) AS transaction_count, count(*) FILTER (amount_cents < 0 AND nature = 'outflow_unclassified') AS unknown_outflows,
                  count(*) FILTER (amount_cents < 0) AS outflow_count, count(*) FILTER (amount_cents < 0 AND nature = 'outflow_unclassified' AND c.month IS NOT NULL) AS comparable_unknown_outflow_count,
                  count(*) FILTER (amount_cents < 0 AND c.month IS NOT NULL) AS comparable_outflow_count
           FROM dated d LEFT JOIN comparable c ON c.portfolio_id = d.portfolio_id AND c.month = strftime(d.operation_date, '%Y-%m') GROUP BY d.portfolio_id) seen USING (portfolio_id)
LEFT JOIN (SELECT k.portfolio_id, CAST(sum(unclassified_outflow_cents) AS BIGINT) AS comparable_unknown_outflow_cents, CAST(sum(total_observed_outflow_cents) AS BIGINT) AS comparable_observed_outflow_cents
           FROM categories k SEMI JOIN comparable USING (portfolio_id, month) GROUP BY k.portfolio_id) shares USING (portfolio_id)
LEFT JOIN ({PEAKS_SUMMARY}) p USING (portfolio_id)
LEFT JOIN (SELECT c.portfolio_id, count(*) AS comparable_peak_count FROM candidates c JOIN comparable x ON x.portfolio_id = c.portfolio_id AND x.month = strftime(c.start_date, '%Y-%m') WHERE is_peak GROUP BY c.portfolio_id) near USING (portfolio_id)
LEFT JOIN (SELECT portfolio_id, string_agg(category || ':' || CAST(amount AS VARCHAR), ',' ORDER BY r) AS top_categories, CAST(sum(amount) FILTER (r <= 2) AS BIGINT) AS first_two
           FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY amount DESC, seen, category) AS r
                 FROM (SELECT k.portfolio_id, category, CAST(sum(total_observed_outflow_cents) AS BIGINT) AS amount, min(month) AS seen FROM categories k SEMI JOIN comparable USING (portfolio_id, month) GROUP BY k.portfolio_id, category))
           WHERE r <= 6 GROUP BY portfolio_id) tc USING (portfolio_id)
LEFT JOIN (SELECT portfolio_id, string_agg(concat_ws(':', CAST(start_date AS VARCHAR), label, category, CAST(amount_cents AS VARCHAR)), ',' ORDER BY r) AS top_peaks
           FROM (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY amount_cents DESC, episode_id) AS r FROM candidates WHERE is_peak) WHERE r <= 5 GROUP BY portfolio_id) tp USING (portfolio_id)"""

FINAL = {
    "source_inventory": INVENTORY,
    "statement_files": STATEMENT_FILES,
    "source_checks": SOURCE_CHECKS,
    "knowledge_checks": KNOWLEDGE,
    "reserve_quality": RESERVE_QUALITY,
    **{
        f"written_{name}": f"SELECT {', '.join(keys)}, min(n) AS first_position, count(*) AS rows, CAST(0 AS BIGINT) AS out_of_order FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM ({table}) t) u GROUP BY {', '.join(keys)}"
        for name, table, keys, order in (
            ("transactions", CANONICAL, ("transaction_date", "account_id", "transaction_id"), "transaction_date, account_id, transaction_id"),
            ("snapshots", "SELECT * FROM snapshots", ("balance_date", "account_id"), "balance_date, account_id"),
            ("groups", "SELECT * FROM groups", ("transaction_count", "counterparty_key"), "transaction_count DESC, counterparty_key NULLS FIRST"),
            ("review_queue", "SELECT * FROM groups WHERE missing_fields <> ''", ("maximum_abs_cents", "total_abs_cents", "counterparty_key"), "maximum_abs_cents DESC, total_abs_cents DESC, counterparty_key NULLS FIRST"),
        )
    },
    "rate_checks": RATE_CHECKS,
    "classified_from_files": FROM_FILES,
    "reserve_checks": RESERVE_CHECKS,
    "report_summary": REPORT,
    "classified_metrics": _monthly("derived", alone=True),
    "classified_categories": CATEGORIES.replace("FROM dated", "FROM derived"),
    "monthly_metrics": "SELECT * FROM monthly",
    "monthly_category_spending": "SELECT * FROM categories",
    "metrics_summary": SUMMARY,
    "metrics_quality": """SELECT portfolio_id, unnest(['category_expense_reconciliation', 'living_cost_partition', 'savings_identity']) AS check_type, CASE WHEN unnest([a, b, s]) = 0 THEN 'balanced' ELSE 'mismatch' END AS status, unnest([a, b, s]) AS observed_value,
        CAST(0 AS BIGINT) AS expected_value, unnest([CAST(months AS VARCHAR) || ' months', 'expanded = recurring + atypical', 'savings = income - net expense']) AS details
        FROM (SELECT portfolio_id, count(*) FILTER (coalesce(k, 0) <> gross_external_expense_cents) AS a, count(*) FILTER (recurring_living_cost_cents + atypical_expense_cents <> expanded_living_cost_cents) AS b,
                     count(*) FILTER (external_income_cents - net_external_expense_cents <> savings_cents) AS s, count(*) AS months
              FROM monthly LEFT JOIN (SELECT portfolio_id, month, sum(known_expense_cents) AS k FROM categories GROUP BY ALL) USING (portfolio_id, month) GROUP BY portfolio_id)""",
    "category_ranking": "SELECT portfolio_id, category, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("recurring_cost_cents", "atypical_expense_cents", "outside_living_cost_cents", "unclassified_outflow_cents"))
    + ", CAST(sum(recurring_cost_cents + atypical_expense_cents + outside_living_cost_cents + unclassified_outflow_cents) AS BIGINT) AS total_cents FROM categories SEMI JOIN comparable USING (portfolio_id, month) GROUP BY portfolio_id, category",
    "operation_dates": "SELECT transaction_id, posting_date, operation_date, operation_date_source, operation_posting_lag_days FROM dated",
    "daily_flows": "SELECT * FROM flows",
    "flow_feed": f"SELECT portfolio_id, date, CAST(external_income_cents * CAST(0.01 AS DECIMAL(3, 2)) AS DECIMAL(18, 2)) AS income, CAST(external_expense_cents * CAST(0.01 AS DECIMAL(3, 2)) AS DECIMAL(18, 2)) AS expense, CAST((external_income_cents - external_expense_cents) * CAST(0.01 AS DECIMAL(3, 2)) AS DECIMAL(18, 2)) AS net FROM flows WHERE account_id = '{TOTAL}'",
    "event_flows": _flow_rows("web"),
    "daily_balances": "SELECT * FROM balances",
    "data_quality": """SELECT portfolio_id, account_id, 'operation_dates' AS check_type, CAST(NULL AS DATE) AS reference_date, 'ok' AS status, count(*) FILTER (operation_date_source <> 'posting_date') AS observed_value, count(*) AS expected_value, CAST(NULL AS BIGINT) AS difference_cents,
          CAST(count(*) FILTER (operation_posting_lag_days <> 0) AS VARCHAR) || ' shifted; most days: ' || CAST(max(-operation_posting_lag_days) AS VARCHAR) AS details FROM dated GROUP BY portfolio_id, account_id
        UNION ALL SELECT portfolio_id, account_id, 'balance_snapshot', date, CASE WHEN snapshot_difference_cents = 0 THEN 'balanced' ELSE 'mismatch' END, ledger_balance_cents, snapshot_balance_cents, snapshot_difference_cents, 'rebuilt against stated balance' FROM balances WHERE snapshot_balance_cents IS NOT NULL""",
    "anchor_checks": """SELECT CASE WHEN anchor IS NULL THEN 'no_anchor' ELSE 'transactions_after_anchor' END AS kind, account_id AS key FROM (SELECT portfolio_id, account_id, max(transaction_date) AS last FROM ledger GROUP BY ALL)
        LEFT JOIN (SELECT portfolio_id, account_id, max(balance_date) AS anchor FROM snapshots WHERE year(balance_date) < 2000 GROUP BY ALL) USING (portfolio_id, account_id) WHERE anchor IS NULL OR last > anchor""",
    "canonical_transactions": CANONICAL,
    "coverage_summary": """SELECT portfolio_id, account_id, institution, a AS coverage_start, b AS coverage_end, n AS transaction_count, f AS source_file_count, coalesce(s, 0) AS snapshot_count,
          coalesce((SELECT string_agg(m, ';' ORDER BY m) FROM (SELECT strftime(unnest(generate_series(date_trunc('month', a), date_trunc('month', b), INTERVAL 1 MONTH)), '%Y-%m') AS m) WHERE NOT list_contains(ms, m)), '') AS months_without_transactions
        FROM (SELECT portfolio_id, account_id, min(institution) AS institution, min(transaction_date) AS a, max(transaction_date) AS b, count(*) AS n, count(DISTINCT source_file) AS f, list(DISTINCT strftime(transaction_date, '%Y-%m')) AS ms FROM ledger GROUP BY ALL)
        LEFT JOIN (SELECT portfolio_id, account_id, count(*) AS s FROM snapshots GROUP BY ALL) USING (portfolio_id, account_id)""",
    "reconciliation": """SELECT portfolio_id, account_id, opening_date, opening_balance_cents, closing_date, closing_balance_cents, CAST(movement AS BIGINT) AS movement_cents, CAST(closing_balance_cents - opening_balance_cents - movement AS BIGINT) AS difference_cents,
          CASE WHEN closing_balance_cents - opening_balance_cents - movement = 0 THEN 'balanced' ELSE 'mismatch' END AS status
        FROM (SELECT s.*, (SELECT coalesce(sum(l.amount_cents), 0) FROM ledger l WHERE l.portfolio_id = s.portfolio_id AND l.account_id = s.account_id AND l.transaction_date > opening_date AND l.transaction_date <= closing_date) AS movement
              FROM (SELECT portfolio_id, account_id, balance_date AS opening_date, balance_cents AS opening_balance_cents, lead(balance_date) OVER w AS closing_date, lead(balance_cents) OVER w AS closing_balance_cents
                    FROM snapshots WINDOW w AS (PARTITION BY portfolio_id, account_id ORDER BY balance_date)) s WHERE closing_date IS NOT NULL)""",
    "transactions_classified": "SELECT analytical_transaction_id, parent_transaction_id, amount_cents, original_amount_cents, is_allocation, group_id, channel, counterparty_key, counterparty_display, " + ", ".join(_DIMS) + ", classification_provenance FROM expanded",
    "classification_groups": "SELECT * FROM groups",
    "review_queue": "SELECT portfolio_id, CAST(row_number() OVER (PARTITION BY portfolio_id ORDER BY maximum_abs_cents DESC, total_abs_cents DESC, counterparty_key, group_id) AS INTEGER) AS rank, group_id, maximum_abs_cents, total_abs_cents, missing_fields FROM groups WHERE missing_fields <> ''",
    "unclassified_rows": "SELECT analytical_transaction_id, amount_cents, " + ", ".join(_DIMS) + " FROM expanded WHERE " + " OR ".join(f"coalesce({d}, '') = ''" for d in _DIMS),
    "channel_of_canonical": "SELECT transaction_id, channel FROM identified",
    "normalized_text": "SELECT doc_id, trim(regexp_replace(upper(regexp_replace(strip_accents(text), '[^A-Za-z0-9]+', ' ', 'g')), ' +', ' ', 'g')) AS normalized FROM documents",
    "daily_rates": "SELECT * FROM rates",
    "reserve_events": "SELECT * FROM reserve_events",
    "reserve_daily": "SELECT * FROM reserve_daily",
    "reserve_monthly": "SELECT * FROM reserve_monthly",
    "tracked_assets": f"SELECT portfolio_id, date, closing_balance_cents AS reserve_cents, analysis_balance_cents AS current_cents, closing_balance_cents + analysis_balance_cents AS total_cents FROM reserve_daily JOIN (SELECT portfolio_id, date, analysis_balance_cents FROM balances WHERE account_id = '{TOTAL}') USING (portfolio_id, date)",
    "peak_candidates": "SELECT * FROM candidates",
    "peaks_monthly": PEAKS_MONTHLY,
    "peaks_summary": PEAKS_SUMMARY,
    "statement_snapshots": """SELECT portfolio_id, account_id, balance_date, institution, balance_cents, account_id || '/q' || CAST(year(balance_date) AS VARCHAR) || '-' || CAST(quarter(balance_date) AS VARCHAR) || '.ofx' AS source_file FROM snapshots""",
}
SQL = {k: f"{PREFIX}\n{v}" for k, v in FINAL.items()}
