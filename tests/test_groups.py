"""Groups and the review queue: what is written for them, and what moves rows."""

import random
import re
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerjobs.functions import exprs as X
from ledgerjobs.operators import classify as C
from ledgerjobs.operators import ranks
from ledgerjobs.plans.queries import QUERIES
from ledgerjobs.sources.tables import Staging

RAW = ("portfolio_id", "layout", "name_raw", "memo_raw", "subcategory", "transaction_date", "account_id", "transaction_id", "amount_cents", "description_raw")
SMALL = "/root/testdata/sf0.001"


def raw_rows(spark, path):
    """Written rows as the ledger's, with texts in and beyond ASCII."""
    memos = ["PIX QRS Loja X05 01", "pix transf Ana X", "TED 001 0001 Fulano", "Aplicacao Cofrinhos", "03/01 18:30 Padaria São João ½", "INT  DARF 1", "PIX", ""]
    names = ["", "Compra com Cartão", "Pix - Recebido", "BB Rende Fácil", "other"]
    rows = [("p", lay, n, m, "s", date(2026, 1, 5), "a", f"t{i}", -5, "d") for i, (lay, n, m) in enumerate((lay, n, m) for lay in ("bb", "itau", "other") for n in names for m in memos)]
    spark.createDataFrame(rows, ", ".join(f"{c} {'date' if c == 'transaction_date' else 'long' if c == 'amount_cents' else 'string'}" for c in RAW)).write.parquet(path)
    return spark.read.parquet(path)


def test_identity_moves_no_rows_and_is_compiled(spark, tmp_path):
    df = C.identify(raw_rows(spark, f"{tmp_path}/rows"))
    keep = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = spark._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", keep)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)]
    # the virtual machine interprets methods of over 8000 bytes
    assert "Exchange" not in plan and sizes and max(sizes) < 8000


def test_channels_and_parties_as_listed(spark, tmp_path):
    prefixes, exact, names = dict(X.ITAU_PREFIXES), dict(X.ITAU_EXACT), dict(X.BB_CHANNELS)
    for r in C.identify(raw_rows(spark, f"{tmp_path}/rows")).collect():
        memo = r["memo_raw"].upper()
        of_memo = exact.get(memo) or next((v for k, v in prefixes.items() if memo.startswith(k)), "itau_other")
        assert r["channel"] == (names.get(r["name_raw"], "bb_other") if r["layout"] == "bb" else of_memo)
    by = {(r["layout"], r["name_raw"], r["memo_raw"]): (r["counterparty_display"], r["counterparty_key"]) for r in C.identify(spark.read.parquet(f"{tmp_path}/rows")).collect()}
    assert by["other", "", "PIX QRS Loja X05 01"] == ("Loja X", "LOJA X") and by["itau", "", "pix transf Ana X"] == ("Ana X", "ANA X") and by["itau", "", "TED 001 0001 Fulano"] == ("Fulano", "FULANO")
    assert by["bb", "other", "03/01 18:30 Padaria São João ½"] == ("Padaria São João ½", "PADARIA SAO JOAO 1 2") and by["bb", "BB Rende Fácil", "PIX"][1] == "BB RENDE FACIL"


@pytest.mark.parametrize("portfolios", [False, True])
def test_few_rules_are_attached_as_many(spark, portfolios):
    rows = spark.createDataFrame(
        [(p, g, f"c{g[1]}" if g else None, f"k{g}", f"t{p}{g}{i}", date(2026, 1, 10), i) for p in ("p", "q", None) for i in range(4) for g in ("g1", "g2", "g3", None)],
        "portfolio_id string, group_id string, channel string, counterparty_key string, transaction_id string, transaction_date date, amount_cents long",
    )
    schema = "portfolio_id string, rule_id string, priority int, match_type string, match_value string, valid_from date, valid_to date, min_amount_cents long, max_amount_cents long, load_order int, " + ", ".join(f"{d} string" for d in C.DIMENSIONS)
    rules = spark.createDataFrame(
        [
            (None, "r1", 2, "channel", "c1", None, None, None, None, 1, *"abcdefg"), ("q", "r2", 2, "group_id", "g1", None, None, 2, None, 2, "h", "", *"jklmn"), ("p", "r3", 1, "counterparty_key", "kg1", None, None, None, 1, 3, *"opqrst", ""),
            (None, "r4", None, "counterparty_key", "kg2", None, None, None, None, 4, "u", *[None] * 6), (None, "r5", 2, "channel", "c1", None, None, None, None, 0, *[""] * 7), (None, "r6", 1, "channel", None, None, None, None, None, 5, *"abcdefg"),
        ], schema,
    )
    rules = rules if portfolios else rules.drop("portfolio_id")

    def never(df, name):
        raise AssertionError(name)

    few, many = C.classify(rows, rules, staged=never), C.classify(rows, rules, few=0)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.select(few.columns).collect())) and few.count() == 48
    got = {r["transaction_id"]: r for r in few.collect()}
    assert got["tqg13"]["classification_provenance"] == "r5;r1;r2" and (got["tqg13"]["nature"], got["tqg13"]["category"]) == ("h", "b")
    assert got["tpg10"]["classification_provenance"] == "r3;r5;r1" and got["tNoneg10"]["classification_provenance"] == ""


def test_medians_of_counts(spark):
    r = random.Random(7)
    values = {k: [r.choice([0, 1, 7, r.randint(0, 300), r.randint(0, 10**13)]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 500), ("d", 301), ("e", 4))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("f", None)], "k string, v long")
    got = {x["k"]: (x["low"], x["high"]) for x in ranks.middles(df, ["k"], "v").collect()}
    assert got == {k: (statistics.median_low(vs), statistics.median_high(vs)) for k, vs in values.items()}


@pytest.mark.parametrize("name", ["review_queue", "written_groups", "written_review_queue", "classification_groups"])
def test_groups_write_only_what_they_read(spark, name, monkeypatch):
    written, table = {}, Staging.table
    monkeypatch.setattr(Staging, "table", lambda self, df, name: written.update({name: df.columns}) or table(self, df, name))
    assert QUERIES[name](spark, SMALL).count() > 0
    assert set(written) <= {"ledger", "identified", "groups", "queue"}
    assert set(written["ledger"]) == set(RAW) and set(written["identified"]) == set(C.GROUPED)


def test_groups_of_null_amounts_and_ties(spark):
    rows = spark.createDataFrame(
        [("p", "g", "c", "k", "K", date(2026, m, 1), "a", f"t{i}", v, d) for i, (m, v, d) in enumerate([(2, -5, "x"), (1, 5, "y"), (1, None, None), (3, 9, "x"), (3, 0, "z"), (4, 7, "w")])],
        "portfolio_id string, group_id string, channel string, counterparty_key string, counterparty_display string, transaction_date date, account_id string, transaction_id string, amount_cents long, description_raw string",
    )
    flags = rows.withColumns({f: F.lit("v" if f != "flexibility" else "") for f in C.DIMENSIONS})
    (g,) = C.group_statistics(rows, flags).collect()
    assert tuple(g)[2:] == ("c", "k", "K", 6, 3, 1, date(2026, 1, 1), date(2026, 4, 1), 4, 0, 5, 9, 26, "y ||  || x", "flexibility")
