"""Golden cases of the ledger operators, on hand-built rows."""

import hashlib
import re
import statistics
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerjobs.functions import exprs as X
from ledgerjobs.functions.helpers import decode_statement, normalize, unescape
from ledgerjobs.operators import classify as C
from ledgerjobs.operators import coverage, daily, dates, joins, metrics, peaks, reserve
from ledgerjobs.sources import rates as R
from ledgerjobs.sources import statements as S
from ledgerjobs.sources import tables

D = date.fromisoformat
BB, ITAU = X.BB_ACCOUNT, X.ITAU_ACCOUNT
TX = (
    "portfolio_id string, account_id string, institution string, transaction_id string, transaction_date date, operation_date date, amount_cents long, name_raw string, memo_raw string, "
    "description_raw string, nature string, category string, subcategory string, recurrence string, cost_treatment string, peak_eligible string, channel string, counterparty_display string, "
    "analytical_transaction_id string, parent_transaction_id string, source_file string, source_position int"
)


def tx(spark, *rows):
    base = dict(portfolio_id="p", account_id=BB, amount_cents=1, institution="Banco do Brasil", name_raw="", memo_raw="", description_raw="d", nature="expense", category="c", subcategory="s",
                recurrence="non_recurring", cost_treatment="recurring", peak_eligible="true", channel="x", counterparty_display="shop", source_file="f", source_position=1)
    names = [c.split()[0] for c in TX.split(", ")]
    out = []
    for i, r in enumerate(rows):
        r = {**base, "transaction_id": f"t{i}", **r}
        day = D(r.pop("date", "2026-01-10"))
        r = {"transaction_date": day, "operation_date": day, "analytical_transaction_id": r["transaction_id"], "parent_transaction_id": r["transaction_id"], **r}
        out.append(tuple(r[n] for n in names))
    return spark.createDataFrame(out, TX)


STATEMENT = """OFXHEADER:100
ENCODING:{enc}

<OFX><BANKACCTFROM><BANKID>1234
<ACCTID>99-1
</BANKACCTFROM><BANKTRANLIST><DTSTART>20260101<DTEND>20260131
<STMTTRN><TRNTYPE>debit
<DTPOSTED>20260105120000[-03:EST]
<TRNAMT>-12.34
<FITID>{fitid}
<NAME>Café &amp; Pão
<MEMO>compra
</STMTTRN><STMTTRN><TRNTYPE>CREDIT<DTPOSTED>20260106<TRNAMT>100,00<FITID>B2<NAME>Receita ficticia<MEMO>RECEITA FICTICIA
<STMTTRN><TRNTYPE>OTHER<DTPOSTED>20260131<TRNAMT>0.00<FITID><NAME>Saldo do dia<MEMO></STMTTRN>
</BANKTRANLIST><LEDGERBAL><BALAMT>87.66<DTASOF>20260131</LEDGERBAL></OFX>"""


def read(spark, files, bank="1234"):
    accounts = spark.createDataFrame([("p", "acc", "bank", "acc", bank)], "portfolio_id string, account_id string, institution string, path_prefix string, expected_bank_id string")
    return parsed_files(spark.createDataFrame(files, "source_file string, content binary"), accounts)


def parsed_files(files, accounts):
    f = S.with_account(S.identified(S.digested(files)), accounts)
    parsed = S.parse(S.records_of(files))
    heads = S.statements(f, parsed)
    return f, heads, S.transactions(parsed, heads)


def test_statement_parses_in_both_encodings(spark):
    for enc, codec in (("UTF-8", "utf-8"), ("USASCII", "cp1252")):
        _, parsed, rows = read(spark, [("acc/a.ofx", STATEMENT.format(enc=enc, fitid="A1").encode(codec))])
        got = rows.orderBy("source_position").collect()
        assert [(r["amount_cents"], r["description_raw"], r["transaction_type"], r["is_marker"]) for r in got] == [
            (-1234, "Café & Pão | compra", "DEBIT", False), (10000, "Receita ficticia", "CREDIT", False), (0, "Saldo do dia", "OTHER", True),
        ]
        assert parsed.select("balance_date", "balance_cents", "bank_id").first() == (D("2026-01-31"), 8766, "1234")


def test_same_bytes_and_overlaps_count_once(spark):
    a = STATEMENT.format(enc="UTF-8", fitid="A1").encode()
    b = STATEMENT.format(enc="UTF-8", fitid="A1").replace("ENCODING", "X:1\nENCODING").encode()
    files, parsed, rows = read(spark, [("acc/a-b/1.ofx", a), ("acc/a/2.OFX", a), ("acc/c.ofx", b), ("acc/readme.txt", b"x")])
    assert S.canonical(rows).count() == 2 and S.snapshots(parsed).count() == 1
    inv = {r["source_file"]: r for r in S.inventory(files, parsed, rows).collect()}
    assert inv["acc/a-b/1.ofx"]["duplicate_of"] == "acc/a/2.OFX" and inv["acc/a/2.OFX"]["duplicate_of"] is None
    assert (inv["acc/c.ofx"]["ofx_rows"], inv["acc/c.ofx"]["ignored_balance_markers"], inv["acc/readme.txt"]["status"]) == (3, 1, "not_parsed")
    assert S.violations(files, parsed, rows).count() == 0
    assert {r["kind"] for r in S.violations(*read(spark, [("acc/a.ofx", a), ("zzz/a.ofx", a)], bank="9999")).collect()} == {"unexpected_bank", "unknown_account"}


def broken(text=STATEMENT.format(enc="UTF-8", fitid="A1"), **changes):
    for old, new in changes.values():
        assert old in text
        text = text.replace(old, new)
    return text.encode()


def kinds(spark, files, accounts=None):
    accounts = accounts or [("p", "acc", "bank", "acc", "1234")]
    known = spark.createDataFrame(accounts, "portfolio_id string, account_id string, institution string, path_prefix string, expected_bank_id string")
    f, parsed, rows = parsed_files(spark.createDataFrame(files, "source_file string, content binary"), known)
    return sorted(tuple(r) for r in S.violations(f, parsed, rows).collect()), {r["source_file"]: r["status"] for r in S.inventory(f, parsed, rows).collect()}


def test_every_kind_of_unfit_source_is_named(spark):
    good = ("acc/a.ofx", broken())
    cases = {
        "undecodable": ("acc/b.ofx", b"ENCODING:UTF-8\n<STMTTRN>\x81\xff"),
        "unexpected_bank": ("acc/b.ofx", broken(a=("<BANKID>1234", "<BANKID>77"))),
        "missing_account_id": ("acc/b.ofx", broken(a=("<ACCTID>99-1", "<ACCTID>"))),
        "no_transactions": ("acc/b.ofx", broken(a=("STMTTRN", "OTHER"))),
        "bad_balance": ("acc/b.ofx", broken(a=("87.66", "12.345"))),
        "bad_date_or_amount": ("acc/b.ofx", broken(a=("20260106", "2026-01-06"))),
        "conflicting_balance": ("acc/b.ofx", broken(a=("87.66", "87.67"))),
        "unknown_account": ("zzz/b.ofx", broken(a=("A1", "A2"))),
    }
    for kind, file in cases.items():
        found, status = kinds(spark, [good, file])
        extra = {"missing_account_id": {"several_fingerprints"}, "unexpected_bank": {"several_fingerprints"}}.get(kind, set())
        assert {k for k, _ in found} == {kind} | extra, kind
        assert status[file[0]] == (kind if kind in ("undecodable", "no_transactions") else "parsed")
    bad_day = broken(a=("<DTASOF>20260131", "<DTASOF>soon"))
    assert kinds(spark, [("acc/b.ofx", bad_day)])[0] == [("bad_balance", "acc/b.ofx")]
    two = [("p", x, "bank", "acc", "1234") for x in ("acc", "acd")]
    found, status = kinds(spark, [good], two)
    assert found == [("ambiguous_account", "acc/a.ofx")] and len(status) == 1
    shared = [("p", x, "bank", x, "1234") for x in ("acc", "acd")]
    found, _ = kinds(spark, [good, ("acd/a.ofx", broken(a=("87.66", "87.67")))], shared)
    assert [k for k, _ in found] == ["conflicting_transaction"] * 2


def test_blocks_end_as_the_format_allows(spark):
    text = "<stmttrn>a</stmttrn>x<X:STMTTRN k=1>b<STMTTRN>c</BANKTRANLIST>d<STMTTRN>cut off"
    for x in "abcd":
        text = text.replace(f">{x}<", f"><NAME>{x}<")
    _, heads, rows = read(spark, [("acc/a.ofx", text.encode()), ("acc/b.ofx", b"none"), ("acc/c.ofx", b"")])
    assert [r["name_raw"] for r in rows.orderBy("source_position").collect()] == ["a", "b", "c"]
    assert {r["source_file"]: (r["blocks"], r["decoded"]) for r in heads.collect()} == {"acc/a.ofx": (3, True), "acc/b.ofx": (0, True), "acc/c.ofx": (0, True)}
    field = lambda t, n: spark.range(1).select(F.coalesce(X.field_of(X.without_prefixes(F.lit(t)), X.ascii_upper(X.without_prefixes(F.lit(t))), F.lit(n)), F.lit("")).alias("f")).first()["f"]
    assert (field("<ofx:name>\n  A b \r\n<MEMO>m", "NAME"), field("<NAME><MEMO>m", "NAME"), field("<MEMO>m", "NAME"), field("<NAMES>x<NAME>y", "NAME")) == ("A b", "", "", "y")


def test_a_late_tag_is_found_in_text_of_many_bytes(spark):
    """Bytes that are UTF-8 but not declared so are read as Windows-1252, in which the same text has more characters."""
    text = STATEMENT.format(enc="USASCII", fitid="A1").replace("</STMTTRN>", "<CHECKNUM></STMTTRN>", 1)
    text = text.replace("<STMTTRN>", "<STMTTRN><TRNTYPE>x<DTPOSTED>20260102<TRNAMT>1<NAME>" + "é" * 40 + "<MEMO>m<FITID>late</STMTTRN><STMTTRN>", 1)
    _, heads, rows = read(spark, [("acc/a.ofx", text.encode())])
    assert heads.first()["encoding"] == "w"
    first = rows.orderBy("source_position").first()
    assert (first["name_raw"], first["memo_raw"], first["bank_transaction_id"]) == ("Ã©" * 40, "m", "late")


@pytest.mark.parametrize("name", ["TRNAMT", "NAME"])
def test_values_of_tags_are_those_of_fields(spark, name):
    texts = ["<name>\n A b \r\n<MEMO>m", "<NAME><MEMO>m", "<MEMO>m", "<NAMES>x<nAmE>y", "x<NAME> \t\x0b\x0c\u00a0é\u2003 \nz", "<NAME", "<NAME>a<NAME>b", "<trnamt>1,5\r\n<NAME>\u0131 <x", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(X.tag_value(F.col("t"), name).alias("a"), F.coalesce(X.field_of(F.col("t"), X.ascii_upper(F.col("t")), F.lit(name)), F.lit("")).alias("b")).collect()
    assert [r["a"] for r in got] == [r["b"] for r in got] and any(r["a"] for r in got)


@pytest.mark.parametrize("name", ["TRNAMT", "NAME"])
def test_usual_tags_are_searched_for_as_spelled(spark, name):
    usual = ["<NAME>\n A b \r\n<MEMO>m", "<NAME><MEMO>m", "<NAME>\r\n<MEMO>m", "<NAMES>x<NAME>y\t", "x<NAME> \t\x0b\x0c\u00a0é\u2003 \nz", "<NAME>a<NAME>b", "<TRNAMT>1,5 \r\n<NAME>a b  c", "<NAME> \t </X.Y>", "<NAME>", ""]
    others = ["<nAmE>y", "<NAME", "<x:NAME>y", "<NAME a=1>y", "<NAME>a < b", "<TRNAMT>1</ NAME>"]
    df = spark.createDataFrame([(t,) for t in usual + others], "t string")
    got = df.select("t", F.col("t").rlike(X.UNUSUAL).alias("other"), X.strip(X.usual_value(F.col("t"), name)).alias("a"), X.tag_value(F.col("t"), name).alias("b")).collect()
    assert {r["t"] for r in got if r["other"]} == set(others)
    assert all(r["a"] == r["b"] for r in got if not r["other"]) and any(r["a"] for r in got)


def test_usual_and_other_spellings_are_read_alike(spark):
    """The same records, as usual and with a tag in small letters behind, which takes them the long way."""
    one = "<STMTTRN><TRNTYPE>debit\n<DTPOSTED>20260105\n<TRNAMT> -12,34 \n<FITID>%s\n<NAME>Caf\u00e9 &amp; P\u00e3o\t\n<MEMO>\n m &lt;\n</STMTTRN>\n<NAME>late\n"
    text = "ENCODING:%s\n<BANKID>1234<ACCTID>9<BANKTRANLIST>" + one % "A" + one % "B" + "</BANKTRANLIST><LEDGERBAL><BALAMT>1.00<DTASOF>20260131</LEDGERBAL>"
    for enc, codec in (("UTF-8", "utf-8"), ("USASCII", "cp1252"), ("USASCII", "utf-8")):
        rows = []
        for t in (text % enc, (text % enc).replace("<NAME>late", "<Name>late")):
            _, heads, got = read(spark, [("acc/a.ofx", t.encode(codec))])
            rows.append([tuple(r) for r in heads.select("encoding", "blocks", "bank_id", "balance_cents").collect()] + [tuple(r) for r in got.orderBy("source_position").select("transaction_type", "bank_transaction_id", "amount_cents", "name_raw", "memo_raw").collect()])
        assert rows[0] == rows[1] and len(rows[0]) == 3 and rows[0][1][4] == "m <" and rows[0][1][3].endswith("o")


def test_snapshots_write_no_fields(spark):
    """Statements' headers and balances come from every record, but fields of transactions are not read for them."""
    from ledgerjobs.plans.queries import Jobs

    folder = "/root/testdata/sf0.001"
    heads, whole = Jobs(spark, folder), Jobs(spark, folder)
    a, b = heads.read_heads().get("read_snapshots"), whole.read().get("read_snapshots")
    assert "parsed" not in heads._kept and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) != []


@pytest.fixture
def split(spark):
    """Parts of files as small as they get."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_statements_read_in_records_are_those_read_whole(spark, tmp_path, split):
    text = STATEMENT.format(enc="UTF-8", fitid="A1")
    many = text.replace("<STMTTRN>", "<STMTTRN><TRNTYPE>x<DTPOSTED>20260102<TRNAMT>1<NAME>n<MEMO>ç</STMTTRN>\n" * 9 + "<STMTTRN>", 1)
    files = {
        "acc/a.ofx": text.encode(), "acc/b b+c%20.OFX": many.encode(), "acc/w.ofx": many.replace("UTF-8", "USASCII").encode("cp1252"), "acc/bom.ofx": b"\xef\xbb\xbf" + text.encode(), "acc/tags.ofx": text.replace("STMTTRN", "x:stmtTrn").encode(),
        "acc/mixed.ofx": text.replace("<STMTTRN>", "<stmttrn a=1>", 1).encode(), "acc/cut.ofx": (text[: text.index("</BANKTRANLIST>")] + "<STMTTRN><NAME>gone").encode(), "acc/end.ofx": (text + "<STMTTRN>").encode(), "acc/bytes.ofx": b"ENCODING:UTF-8\n<STMTTRN>\x81\xff", "acc/tail.txt": b"a<b<", "acc/bom.txt": b"\xef\xbb\xbfx<",
    }
    (tmp_path / "in/acc").mkdir(parents=True)
    for name, content in files.items():
        (tmp_path / "in" / name).write_bytes(content)
    folder = str(tmp_path / "in")
    known = spark.createDataFrame([("p", "acc", "bank", "acc", "1234")], "portfolio_id string, account_id string, institution string, path_prefix string, expected_bank_id string")
    whole = S.read_files(spark, folder)
    digests = sorted(map(tuple, S.digested(whole).collect()))
    assert digests == sorted((n, hashlib.sha256(c).hexdigest(), len(c)) for n, c in files.items())
    assert sorted(map(tuple, S.read_digests(spark, folder).collect())) == sorted(map(tuple, S.read_digests(spark, folder, most=0).collect())) == digests
    found = S.with_account(S.identified(S.digested(whole)), known)

    def read(records):
        parsed = S.parse(records)
        heads = S.statements(found, parsed)
        columns = ["source_file", "encoding", "blocks", "bank_id", "acct", "balance_date", "balance_cents"]
        return sorted(map(str, heads.select(*columns).collect())), sorted(map(str, S.transactions(parsed, heads).collect()))

    records = S.read_records(spark, folder)
    assert records.rdd.getNumPartitions() > 20
    a, b = read(records), read(S.records_of(whole))
    assert a == b and len(a[0]) == 9 and len(a[1]) == 6 * 3 + 2 * 12


def test_files_in_pieces_are_those_read_whole(spark):
    """Digests, headers and transactions of files that come as a head, a transaction each and an end are those of the files as rows."""
    text = STATEMENT.format(enc="UTF-8", fitid="A1")
    texts = {"acc/a.ofx": text.encode(), "acc/b.ofx": text.replace("<STMTTRN>", "<STMTTRN><TRNTYPE>x<DTPOSTED>20260102<TRNAMT>1<NAME>n<MEMO>ç</STMTTRN>\n" * 9 + "<STMTTRN>", 1).encode(), "acc/c.ofx": b"<STMTTRN><NAME>first", "acc/d.txt": b"x"}
    pieces = []
    for name, content in texts.items():
        at = [0, *[m.start() for m in re.finditer(b"<STMTTRN>", content) if m.start()], len(content)]
        pieces += [(name, a, content[a:b]) for a, b in zip(at, at[1:], strict=False)]
    schema = "source_file string, offset long, content binary"
    whole, cut = spark.createDataFrame(list(texts.items()), "source_file string, content binary"), spark.createDataFrame(pieces, schema).coalesce(1)
    digests = sorted((n, hashlib.sha256(c).hexdigest(), len(c)) for n, c in texts.items())
    assert sorted(map(tuple, S.digested_pieces(cut).collect())) == digests == sorted(map(tuple, S.digested(whole).collect()))
    assert S.digested_pieces(cut.limit(0)).collect() == []
    known = spark.createDataFrame([("p", "acc", "bank", "acc", "1234")], "portfolio_id string, account_id string, institution string, path_prefix string, expected_bank_id string")
    found = S.with_account(S.identified(S.digested(whole)), known)

    def read(files):
        parsed = S.parse(S.records_of(files))
        heads = S.statements(found, parsed)
        return [sorted(map(str, df.collect())) for df in (heads.select("source_file", "encoding", "blocks", "bank_id", "balance_cents"), S.transactions(parsed, heads))]

    assert read(cut) == read(whole) and len(read(cut)[1]) == 3 + 12
    swapped = spark.createDataFrame([pieces[1], pieces[0], *pieces[2:]], schema).coalesce(1)
    with pytest.raises(Exception, match="pieces are not in order"):
        S.digested_pieces(swapped).collect()
    with pytest.raises(Exception, match="does not begin with a transaction"):
        S.records_of(spark.createDataFrame([("acc/a.ofx", 0, b"<STM"), ("acc/a.ofx", 4, b"TTRN>")], schema)).collect()


def test_no_row_holds_a_file(spark):
    """Statements are made, written and digested in pieces, whatever their size, and by more tasks where there are more rows."""
    from ledgerjobs.plans.queries import Jobs
    from ledgerjobs.plans.statements import files

    jobs = Jobs(spark, "/root/testdata/sf0.001")
    contents = jobs.kept("contents").get("contents")
    sizes = {r["source_file"]: r for r in contents.groupBy("source_file").agg(F.max(F.length("content")).alias("most"), F.sum(F.length("content")).alias("size")).collect()}
    assert max(r["most"] for r in sizes.values()) < 400 < 1200 < max(r["size"] for r in sizes.values())
    made = files(jobs.v, rows_a_part=100)
    assert made.rdd.getNumPartitions() == jobs.v.ledger.count() // 100 > spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, contents.collect()))
    assert {r["source_file"]: r["file_size_bytes"] for r in jobs.get("files").collect()} == {n: r["size"] for n, r in sizes.items()}
    twice = jobs.get("files").where("source_file LIKE '%/z/%'").select("source_file", "duplicate_of").collect()
    assert twice and all(r["source_file"] == r["duplicate_of"].replace("/", "/z/") and r["duplicate_of"].endswith("-01.ofx") for r in twice)


def test_no_content_is_shuffled(spark):
    files = spark.createDataFrame([("acc/a.ofx", b"x")], "source_file string, content binary")
    known = spark.createDataFrame([("p", "acc", "bank", "acc", "1234")], "portfolio_id string, account_id string, institution string, path_prefix string, expected_bank_id string")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        _, heads, rows = parsed_files(files, known)
        for df in (S.inventory(_, heads, rows), S.canonical(rows), S.snapshots(heads), S.violations(_, heads, rows)):
            plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            moved = re.findall(r"\) (?:Broadcast)?Exchange[^\n]*\nInput \[\d+\]: \[([^\n]*)\]", plan)
            assert len(moved) > 1 and not any(re.search(r"\b(content|record|piece|u_own|w_own)#", columns) for columns in moved), moved
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_decoding_entities_and_normal_form(spark):
    import html
    import unicodedata

    rows = [b"ENCODING:UTF-8\n\xc3\xa9", b"CHARSET: utf-8\r\n\xe9", b"X:1\n\x80\x9f\xe9", b"X:1\n\x81", b"ENCODING:USASCII\nCHARSET:UTF-8\n\xc3\xa9", b"\xc3\x81", b"", None]
    want = ["ENCODING:UTF-8\né", "CHARSET: utf-8\r\né", "X:1\n€Ÿé", None, "ENCODING:USASCII\nCHARSET:UTF-8\nÃ©", "Á", "", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(rows)], "i int, b binary")
    assert [r["t"] for r in df.select("i", decode_statement("b").alias("t")).orderBy("i").collect()] == want
    texts = ["a &amp; b", "plain", "&eacute;&#65;&lt", None, "", "Psicólogo: João! ", "ﬁn–Ⅷ ａ²ß", "ไทย 12", "A--b__C"]

    def plain(s):
        out = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in out).upper().split())

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", unescape(F.col("t")).alias("u"), normalize("t").alias("n")).orderBy("i").collect()
    assert [r["u"] for r in got] == [t and html.unescape(t) for t in texts] and [r["n"] for r in got] == [t if t is None else plain(t) for t in texts]


def test_money_with_many_decimals(spark):
    r = spark.range(1).select(X.money_to_cents(F.lit("1.100000000000000")).alias("a"), X.money_to_cents(F.lit("1.100000000000001")).alias("b"), X.money_to_cents(F.lit("x")).alias("c"), X.description(F.lit("straße"), F.lit("STRASSE")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (110, None, None, "straße")


def test_ids_with_and_without_bank_id(spark):
    ident = lambda bank, n, cents=5: X.transaction_id(F.lit("fp"), F.lit(bank), F.lit("2026-01-01").cast("date"), F.lit(cents).cast("long"), F.lit("d"), F.lit(n))
    r = spark.range(1).select(ident("A", 1).alias("a"), ident("A", 99).alias("b"), ident("A", 1, 6).alias("c"), ident("", 1).alias("d"), ident("", 2).alias("e")).first()
    assert r.a == r.b and r.a != r.c and r.d != r.e


def test_money_dates_ratio_text(spark):
    r = spark.range(1).select(
        X.money_to_cents(F.lit("1.001")).alias("bad"), X.money_to_cents(F.lit(" -1,5 ")).alias("ok"), X.statement_date(F.lit("20260230")).alias("no_day"),
        X.ratio(F.lit(1), F.lit(3)).alias("third"), X.ratio(F.lit(1), F.lit(0)).alias("none"), X.ratio_or_zero(F.lit(1), F.lit(0)).alias("zero"), normalize(F.lit("  Psicólogo: João! ")).alias("n"),
        decode_statement(F.lit("ENCODING:UTF-8\né").cast("binary")).alias("text"),
    ).first()
    assert r.bad is None and r.ok == -150 and r.no_day is None and r.third == Decimal("0.3333") and r.none is None and r.zero == 0
    assert r.n == "PSICOLOGO JOAO" and r.text.endswith("é")


def test_identity(spark):
    rows = tx(
        spark, dict(name_raw="Compra com Cartão", memo_raw="03/01 18:30 MERCADO"), dict(name_raw="Compra com Cartão", memo_raw="05/01 09:00 MERCADO"), dict(name_raw="Pix - Recebido", memo_raw="01/01 10:00 00012345678901 ANA"),
        dict(name_raw="Pix - Recebido", memo_raw="01/01 10:00 00012345678902 ANA"), dict(account_id=ITAU, memo_raw="RESGATE CDB Cofrinhos"), dict(account_id=ITAU, memo_raw="TED 001 0001 FULANO"),
    )
    got = [r for r in C.identify(rows.drop("channel", "counterparty_display")).orderBy("transaction_id").collect()]
    assert got[0]["group_id"] == got[1]["group_id"] and got[2]["group_id"] != got[3]["group_id"] and got[2]["counterparty_key"].startswith("ID ")
    assert got[4]["channel"] == "cofrinho_redemption" and (got[5]["channel"], got[5]["counterparty_display"]) == ("ted_transfer", "FULANO")


RULE = "rule_id string, priority int, match_type string, match_value string, valid_from date, valid_to date, min_amount_cents long, max_amount_cents long, " + ", ".join(f"{f} string" for f in C.DIMENSIONS) + ", load_order int"


def rule(i, prio, kind, value, nature=None, category=None, lo=None, hi=None, **o):
    return (f"r{i}", prio, kind, value, o.get("start"), None, lo, hi, nature, category, None, None, None, None, None, i)


def test_rules_overrides_allocations(spark):
    rows = C.identify(tx(spark, dict(name_raw="Pix - Enviado", memo_raw="LOJA", amount_cents=-91000), dict(name_raw="Pix - Enviado", memo_raw="LOJA", amount_cents=-5)).drop("channel", "counterparty_display", "nature", "category", "subcategory", "recurrence", "cost_treatment", "peak_eligible"))
    rules = spark.createDataFrame([rule(1, 10, "channel", "pix_sent", "expense", "a"), rule(2, 5, "counterparty_key", "LOJA", "fee", "b"), rule(3, 20, "channel", "pix_sent", None, "big", hi=-100), rule(4, 30, "channel", "pix_sent", "income", start=D("2027-01-01"))], RULE)
    over = spark.createDataFrame([("t1", "refund", "", None, None, None, None, None)], "transaction_id string, " + ", ".join(f"{f} string" for f in C.DIMENSIONS))
    got = C.classify(rows, rules, over)
    by = {r["transaction_id"]: r for r in got.collect()}
    assert (by["t0"]["nature"], by["t0"]["category"], by["t0"]["classification_provenance"]) == ("expense", "big", "r2;r1;r3")
    assert (by["t1"]["nature"], by["t1"]["category"], by["t1"]["classification_provenance"]) == ("refund", "a", "r2;r1;override:t1")
    alloc = spark.createDataFrame([("a1", "t0", -70000, *[None] * 7), ("a2", "t0", -21000, None, "gift", *[None] * 5)], "allocation_id string, transaction_id string, amount_cents long, " + ", ".join(f"{f} string" for f in C.DIMENSIONS))
    parts = {r["analytical_transaction_id"]: r for r in C.expand_allocations(got, alloc).collect()}
    assert set(parts) == {"a1", "a2", "t1"} and parts["a2"]["category"] == "gift" and parts["a1"]["category"] == "big"
    assert parts["a1"]["original_amount_cents"] == -91000 and parts["a2"]["classification_provenance"] == "r2;r1;r3;allocation:a2"
    bad = alloc.where("allocation_id = 'a1'")
    inv = spark.createDataFrame([("i", "nope", "open")], "investigation_id string, group_id string, status string")
    ev = spark.createDataFrame([("e", "t0"), ("f", "t0"), ("g", "zz")], "event_id string, transaction_id string")
    kinds = {r["kind"] for r in C.knowledge_violations(rows, rules, over, bad, inv, ev).collect()}
    assert kinds == {"allocation_sum", "bad_status", "investigation_group", "transaction_in_several_events", "event_transaction"}
    groups = C.group_statistics(rows, C.expand_allocations(got, alloc)).collect()
    assert len(groups) == 1 and groups[0]["median_abs_cents"] == 5 and groups[0]["transaction_count"] == 2 and "flexibility" in groups[0]["missing_fields"]


def test_private_rules_come_after_base_rules_of_equal_priority(spark):
    rows = C.identify(tx(spark, dict(name_raw="Pix - Enviado", memo_raw="LOJA", amount_cents=-10)).drop("channel", "counterparty_display", "nature", "category", "subcategory", "recurrence", "cost_treatment", "peak_eligible"))
    no_order = RULE.replace(", load_order int", "")
    of = lambda *rs: spark.createDataFrame([r[:-1] for r in rs], no_order).coalesce(1)
    base, private = of(rule(1, 5, "channel", "pix_sent", "expense", "first"), rule(2, 5, "channel", "pix_sent", None, "second")), of(rule(3, 5, "channel", "pix_sent", None, "private"), rule(4, 1, "channel", "pix_sent", "fee", "low"))
    over = spark.createDataFrame([("t0", "refund", None, None, None, None, None, None), ("t0", "tax_refund", None, None, None, None, None, None), (None, "fee", *[None] * 6)], "transaction_id string, " + ", ".join(f"{f} string" for f in C.DIMENSIONS)).coalesce(1)
    got = C.classify(rows, C.load_rules(base, private), over).collect()
    assert [(r["nature"], r["category"], r["classification_provenance"]) for r in got] == [("tax_refund", "private", "r4;r1;r2;r3;override:t0")]
    assert C.classify(rows, C.load_rules(base)).first()["category"] == "second"


def test_running_ranks_and_medians(spark):
    import random
    import statistics

    from ledgerjobs.operators import ranks

    r = random.Random(3)
    values = {k: [r.choice([0, 5, r.randint(0, 9), r.randint(0, 10**12)]) for _ in range(n)] for k, n in (("a", 1), ("b", 2), ("c", 301), ("d", 200))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs] + [("e", None)], "k string, v long")
    assert {x["k"]: x["m"] for x in ranks.twice_median(df, ["k"], "v", "m").collect()} == {k: round(2 * statistics.median(vs)) for k, vs in values.items()}
    groups = spark.createDataFrame([("p", f"g{i}", f"k{i % 7}", v, v // 3, "x" if i % 9 else "") for i, v in enumerate(values["c"])], "portfolio_id string, group_id string, counterparty_key string, maximum_abs_cents long, total_abs_cents long, missing_fields string")
    got = [x["group_id"] for x in C.review_queue(groups).orderBy("rank").collect()]
    kept = sorted((x for x in groups.collect() if x["missing_fields"]), key=lambda x: (-x["maximum_abs_cents"], -x["total_abs_cents"], x["counterparty_key"], x["group_id"]))
    assert got == [x["group_id"] for x in kept] and [x["rank"] for x in C.review_queue(groups).orderBy("rank").collect()] == list(range(1, len(kept) + 1))


def test_tables_are_written_in_their_orders(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, f"k{i % 5}", i) for i in range(40)], "transaction_count int, counterparty_key string, n int").repartition(4)
    tables.write_table(df, f"{tmp_path}/groups", order=tables.ORDERS["groups"])
    files = sorted((tmp_path / "groups").glob("part-*"))
    rows = [tuple(x) for f in files for x in spark.read.parquet(str(f)).select("transaction_count", "counterparty_key").collect()]
    assert rows == sorted(rows, key=lambda x: (-x[0], x[1])) and len(rows) == 40
    assert [x["kind"] for x in R.violations(spark.createDataFrame([], "date date, daily_rate_percent decimal(18,6), source_series string")).collect()] == ["no_rates"]


@pytest.mark.parametrize("name", sorted(tables.ORDERS))
def test_orders_of_all_tables(spark, name):
    import random

    order, r = tables.ORDERS[name], random.Random(5)
    names = [c.lstrip("-") for c in order]
    df = spark.createDataFrame([tuple(r.randrange(4) for _ in names) for _ in range(60)], ", ".join(f"{c} int" for c in names))
    got = [tuple(x) for x in tables.ordered(df, order, 3).collect()]
    assert got == sorted(got, key=lambda x: tuple(-v if c.startswith("-") else v for c, v in zip(order, x))) and len(got) == 60


@pytest.mark.parametrize(
    "account, posted, memo, want",
    [
        (BB, "2026-01-05", "03/01 18:30 LOJA", "2026-01-03"), (BB, "2026-01-02", "31/12 18:30 LOJA", "2025-12-31"), (ITAU, "2026-02-02", "PIX Instit31 01", "2026-01-31"),
        (BB, "2026-01-20", "03/01 18:30 LOJA", "2026-01-20"), (BB, "2026-03-02", "30/02 18:30 LOJA", "2026-03-02"), (BB, "2026-01-05", None, "2026-01-05"),
    ],
)
def test_operation_dates(spark, account, posted, memo, want):
    got = dates.add_operation_dates(tx(spark, dict(account_id=account, date=posted, memo_raw=memo, amount_cents=1))).first()
    assert got["operation_date"] == D(want) and got["operation_posting_lag_days"] == (D(want) - D(posted)).days


def snaps(spark, *rows):
    return spark.createDataFrame([("p", a, "i", D(d), c) for a, d, c in rows], "portfolio_id string, account_id string, institution string, balance_date date, balance_cents long")


def test_balances_and_reconciliation(spark):
    rows = tx(spark, dict(date="2026-01-01", amount_cents=10000), dict(date="2026-01-02", amount_cents=-2500))
    s = snaps(spark, (BB, "2026-01-02", 7500))
    assert [r["ledger_balance_cents"] for r in daily.ledger_balances(rows, s).orderBy("date").collect()] == [10000, 7500]
    sweep = tx(spark, dict(date="2026-01-01", amount_cents=-64000, name_raw=X.SWEEP_NAME))
    r = daily.ledger_balances(sweep, snaps(spark, (BB, "2026-01-01", 0))).first()
    assert (r["liquidity_adjustment_cents"], r["analysis_balance_cents"]) == (64000, 64000)
    two = tx(spark, dict(date="2026-01-01", amount_cents=-200000), dict(date="2026-01-01", account_id=ITAU, amount_cents=200000))
    both = daily.daily_balances(two, snaps(spark, (BB, "2026-01-01", 0), (ITAU, "2026-01-01", 200000)))
    assert both.where(F.col("account_id") == X.CONSOLIDATED_ACCOUNT).first()["analysis_balance_cents"] == 200000
    rec = coverage.reconciliation(rows, snaps(spark, (BB, "2026-01-01", 10000), (BB, "2026-01-02", 7500))).first()
    assert (rec["movement_cents"], rec["status"]) == (-2500, "balanced")


def test_flows_do_not_invent_history(spark):
    rows = tx(spark, dict(date="2026-01-01", nature="income", amount_cents=600000), dict(date="2026-01-03", amount_cents=-350000), dict(date="2026-01-03", account_id=ITAU, nature="reserve_contribution", amount_cents=-200000))
    got = daily.daily_flows(rows)
    total = got.where(F.col("account_id") == X.CONSOLIDATED_ACCOUNT).orderBy("date").collect()
    assert [r["coverage_complete"] for r in total] == [False, False, True] and total[1]["transaction_count"] == 0
    assert (total[2]["external_expense_cents"], total[2]["reserve_contribution_cents"], total[0]["external_income_cents"]) == (350000, 200000, 600000)
    assert got.where(F.col("account_id") == ITAU).count() == 1


def test_monthly_metrics_and_identities(spark):
    rows = tx(
        spark, dict(date="2026-01-01", nature="income", amount_cents=600000), dict(date="2026-01-10", amount_cents=-350000), dict(date="2026-01-11", cost_treatment="expanded", amount_cents=-50000),
        dict(date="2026-01-12", nature="refund", amount_cents=1000), dict(date="2026-03-31", nature="fee", amount_cents=-1),
    )
    res = spark.createDataFrame([("p", "2026-01", 1_000_000)], "portfolio_id string, month string, closing_balance_cents long")
    m = metrics.monthly_metrics(rows, None, res)
    jan, feb, mar = m.orderBy("month").collect()
    assert (jan["gross_external_expense_cents"], jan["recurring_living_cost_cents"], jan["atypical_expense_cents"], jan["savings_cents"]) == (400000, 350000, 50000, 201000)
    assert jan["savings_rate"] == Decimal("0.3350") and jan["survival_index_months"] == Decimal("2.8571") and feb["savings_rate"] is None and mar["is_complete_month"]
    assert {r["status"] for r in metrics.metrics_quality(m, metrics.monthly_category_spending(rows)).collect()} == {"balanced"}
    s = metrics.metrics_summary(m).first()
    assert s["comparable_complete_months"] == 3 and s["average_recurring_living_cost_cents"] == 116667 and s["median_recurring_living_cost_cents"] == 1


def test_peaks(spark):
    small = [dict(amount_cents=-(1000 + i * 10), transaction_id=f"s{i}") for i in range(20)]
    rows = tx(spark, *small, dict(amount_cents=-900000, recurrence="fixed_contractual", transaction_id="rent"), dict(amount_cents=-100000, transaction_id="deposit"), dict(amount_cents=-70000, transaction_id="buy"), dict(amount_cents=70000, nature="refund", transaction_id="back"))
    ev = spark.createDataFrame([("p", "e", "buy", "label"), ("p", "e", "back", "label")], "portfolio_id string, event_id string, transaction_id string, event_label string")
    got = {r["episode_id"]: r for r in peaks.peak_candidates(rows, ev).collect()}
    assert {k for k, r in got.items() if r["is_peak"]} == {"transaction:deposit"} and "event:e" not in got and "transaction:rent" not in got
    same = peaks.peak_candidates(tx(spark, dict(amount_cents=-5), dict(amount_cents=-5), dict(amount_cents=-5), dict(amount_cents=-9)), ev).collect()
    assert {(r["amount_cents"], r["modified_z_score"], r["is_peak"]) for r in same} == {(5, Decimal("0.0000"), False), (9, None, False)}


def test_reserve(spark):
    rows = tx(spark, dict(date="2026-01-05", channel="cofrinho_application", amount_cents=-100000), dict(date="2026-02-01", channel="cofrinho_redemption", amount_cents=40000))
    events = reserve.reserve_events(rows)
    assert sorted(r["reserve_cashflow_cents"] for r in events.collect()) == [-40000, 100000]
    rates = R.parse_payload(spark.createDataFrame([('[{"data":"02/01/2026","valor":"0,041270"},{"data":"06/01/2026","valor":"0.05"}]',)], "value string"))
    assert rates.orderBy("date").first()["daily_rate_percent"] == Decimal("0.041270")
    assert [r["kind"] for r in R.violations(rates.union(rates.limit(1))).collect()] == ["duplicate_date"]
    a = spark.createDataFrame([("p", D("2026-01-31"), 1_000_000, Decimal("100"))], "portfolio_id string, anchor_date date, anchor_balance_cents long, yield_percentage decimal(9,4)")
    days = reserve.reserve_daily(events, rates, a).orderBy("date").collect()
    assert len(days) == 32 and days[30]["closing_balance_cents"] == 1_000_000 and days[31]["closing_balance_cents"] == 960_000
    assert all(r["opening_balance_cents"] + r["estimated_interest_cents"] + r["net_cashflow_cents"] == r["closing_balance_cents"] for r in days)
    for m in reserve.reserve_monthly(reserve.reserve_daily(events, rates, a)).collect():
        assert m["opening_balance_cents"] + m["estimated_interest_cents"] + m["net_contribution_cents"] == m["closing_balance_cents"]
    assert {r["status"] for r in reserve.reserve_quality(reserve.reserve_daily(events, rates, a), events, rates, a).collect()} == {"balanced", "ok", "excluded"}
    assert reserve.sign_violations(rows.withColumn("amount_cents", -F.col("amount_cents"))).count() == 2


def test_tables_at_the_edges(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "n int, tags array<string>")
    tables.write_table(df, f"{tmp_path}/out", ("n", "tags"), "csv")
    back = tables.read_table(spark, f"{tmp_path}/out", "n int, tags string", ("n",)).first()
    assert tuple(back) == (1, "a;b")
    assert tables.read_table(spark, f"{tmp_path}/out", "n int, tags string", exact=True, filled=True).count() == 1
    (tmp_path / "none.csv").write_text("n,tags\n")
    for broken in (lambda: tables.read_table(spark, f"{tmp_path}/out", "n int", exact=True), lambda: tables.read_table(spark, f"{tmp_path}/none.csv", "n int, tags string", filled=True), lambda: tables.write_table(df.limit(0), f"{tmp_path}/no"), lambda: tables.write_table(df, f"{tmp_path}/no", ("n",)), lambda: tables.read_table(spark, f"{tmp_path}/out", "n int, tags string", ("x",)), lambda: tables.require_empty(df)):
        with pytest.raises(tables.Unfit):
            broken()


def test_rows_stand_as_their_files_have_them(spark, tmp_path, split):
    head = "transaction_id," + ",".join(C.DIMENSIONS)
    line = lambda t, v: f"{t},,{v}" + "," * (len(C.DIMENSIONS) - 2)
    texts = {"a.csv": [line("t1", "first"), line("t2", "only")], "b/1.csv": [line("t1", "middle")] + [line(f"x{i}", "padding" * 9) for i in range(40)] + [line("t1", "second")], "b/2.csv": [line("x3", "later")]}
    (tmp_path / "in/b").mkdir(parents=True)
    for name, rows in texts.items():
        (tmp_path / "in" / name).write_text("\n".join([head, *rows]) + "\n")
    schema = "transaction_id string, " + ", ".join(f"{f} string" for f in C.DIMENSIONS)
    read = tables.read_table(spark, str(tmp_path / "in"), schema, placed=True)
    assert read.rdd.getNumPartitions() > 10
    got = {r["o_id"]: r["o_category"] for r in C.last_overrides(read).collect()}
    assert (got["t1"], got["t2"], got["x3"], len(got)) == ("second", "only", "later", 42)
    order = [r["transaction_id"] for r in read.orderBy("load_order").collect()]
    assert order == [r.split(",")[0] for rows in texts.values() for r in rows]
    rules = read.select(F.col("transaction_id").alias("rule_id"), "category", "load_order")
    numbered = spark.createDataFrame([("n2", "c", 2), ("n1", "c", 1)], "rule_id string, category string, load_order int")
    assert [r["rule_id"] for r in C.load_rules(rules, numbered).orderBy("load_order").collect()] == [*order, "n1", "n2"]


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path, old = f"{tmp_path}/out/table", spark.range(3)
    tables.write_table(old, path)
    broken = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    for bad in (broken, old.limit(0)):
        with pytest.raises(Exception):
            tables.write_table(bad, path)
        assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2]
    tables.write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in (tmp_path / "out").iterdir()] == ["table"]


def test_refused_rows_are_counted_while_writing(spark, tmp_path):
    path = f"{tmp_path}/table"
    sound = spark.createDataFrame([(1, *"abcdefg")], "id int, " + ", ".join(f"{d} string" for d in C.DIMENSIONS))
    tables.write_table(sound, path, refuse={"unclassified": C.any_blank()})
    with pytest.raises(tables.Unfit, match="unclassified.: 2"):
        tables.write_table(sound.union(sound.withColumn("nature", F.lit(""))).union(sound.withColumn("nature", F.lit(None))), path, refuse={"unclassified": C.any_blank()})
    assert spark.read.parquet(path).count() == 1


def test_order_of_written_files_is_proved(spark, tmp_path):
    df = spark.range(200).select((F.col("id") * 37 % 50).alias("amount_cents"), F.col("id").cast("string").alias("episode_id")).repartition(5)
    order = tables.ORDERS["peaks"]
    tables.write_table(df, f"{tmp_path}/sorted", order=order)
    tables.write_table(df, f"{tmp_path}/not")
    good, bad = (tables.read_ordered(spark, f"{tmp_path}/{n}") for n in ("sorted", "not"))
    assert tables.order_violations(good, order).count() == 0 and tables.order_violations(bad, order).count() > 20
    assert [r["position"] for r in good.orderBy("position").collect()] == list(range(1, 201))
    want = sorted((-(i * 37 % 50), str(i)) for i in range(200))
    assert [(-r["amount_cents"], r["episode_id"]) for r in good.orderBy("position").collect()] == want


def test_frequent_keys_are_not_dealt_to_one_task(spark):
    rows = [((0 if i % 3 == 0 else i % 400) if i % 50 else None, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(8).select(F.struct("k").alias("k"), "v")
    table = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    want = sorted(map(str, df.join(table.drop("n").withColumnRenamed("k", "l"), F.col("k").eqNullSafe(F.col("l"))).drop("l").collect()))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    keep = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for most in (20, 1000):  # beside and below the number of keys
            out = joins.attach(df, table, ["k"], "n", most=most)
            assert sorted(map(str, out.collect())) == want
            tasks = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
            assert tasks[-1] <= 2 * statistics.median(tasks)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("most", [2, 10_000])
def test_rules_are_attached_as_joined(spark, tmp_path, most, monkeypatch):
    monkeypatch.setattr(C, "attach", lambda *a: joins.attach(*a, most=most))
    rows = spark.createDataFrame([(p, g, f"c{g[1]}", g, f"t{p}{i}", D("2026-01-10"), i) for p in ("p", "q", None) for i in range(9) for g in ("g1", "g2", "g3")], "portfolio_id string, group_id string, channel string, counterparty_key string, transaction_id string, transaction_date date, amount_cents long")
    schema = "rule_id string, priority int, match_type string, match_value string, valid_from date, valid_to date, min_amount_cents long, max_amount_cents long, load_order int, " + ", ".join(f"{d} string" for d in C.DIMENSIONS)
    rules = spark.createDataFrame([("r1", 1, "channel", "c1", None, None, None, None, 1, *"abcdefg"), ("r2", 2, "group_id", "g2", None, None, 4, None, 2, *"hijklmn")], schema)
    numbers = iter(range(9))

    def staged(df, name):
        df.write.parquet(f"{tmp_path}/{name}{(n := next(numbers))}")
        return spark.read.parquet(f"{tmp_path}/{name}{n}")

    a, b = (sorted(map(str, C.classify(rows.where("portfolio_id IS NOT NULL"), rules, staged=s).collect())) for s in (None, staged))
    assert a == b and len(a) == 54
    assert C.classify(rows, rules, staged=staged).count() == 81


def test_faulty_payloads_are_rows(spark):
    texts = ["[{", '{"data":"02/01/2026","valor":"1"}', "7", "[]", '["x", null, {"data":"02/01/2026"}, {"data":"02/01/2026","valor":0.05}, {"data":"03/01/2026","valor":"-1,5","more":1}]', "", None]
    rates = R.parse_payload(spark.createDataFrame([(t,) for t in texts], "value string"))
    sound = [tuple(r) for r in rates.where("fault IS NULL").orderBy("date").collect()]
    assert sound == [(D("2026-01-02"), Decimal("0.050000"), "12", None, None), (D("2026-01-03"), Decimal("-1.500000"), "12", None, None)]
    found = sorted(tuple(r) for r in R.violations(rates).collect())
    assert found == sorted([("bad_payload", "[{"), ("bad_payload", ""), ("bad_payload", ""), ("not_a_list", texts[1]), ("not_a_list", "7"), ("bad_item", '"x"'), ("bad_item", "null"), ("bad_item", '{"data":"02/01/2026"}'), ("negative_rate", "2026-01-03")])


def test_references_stay_in_their_portfolio(spark):
    rows = spark.createDataFrame([("p", "t1", "g1", 5), ("q", "t2", "g2", 7)], "portfolio_id string, transaction_id string, group_id string, amount_cents long")
    rules = spark.createDataFrame([("p", "r1", "group_id", "g2"), ("p", "r2", "group_id", "g1"), (None, "r3", "group_id", "g2"), (None, "r4", "group_id", "g3")], "portfolio_id string, rule_id string, match_type string, match_value string")
    overrides = spark.createDataFrame([("q", "t1"), ("p", "t1")], "portfolio_id string, transaction_id string")
    none = spark.createDataFrame([], "portfolio_id string, allocation_id string, investigation_id string, event_id string, transaction_id string, group_id string, status string, amount_cents long")
    found = {tuple(r) for r in C.knowledge_violations(rows, rules, overrides, none, none, none).collect()}
    assert found == {("rule_group", "g2"), ("rule_group", "g3"), ("override_transaction", "t1")}


def test_files_are_found_below_a_folder(spark, tmp_path):
    (tmp_path / "in/acc").mkdir(parents=True)
    (tmp_path / "in/acc/a.ofx").write_bytes(STATEMENT.format(enc="UTF-8", fitid="A1").encode())
    assert [r["source_file"] for r in S.read_files(spark, str(tmp_path / "in")).collect()] == ["acc/a.ofx"]


def test_entry_has_queries_and_sql():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "monthly_metrics" in e.queries()
