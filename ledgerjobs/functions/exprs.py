"""Column expressions of the ledger: fields, money, dates, identities, channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Account ids, names and memos that the two statement layouts use.
BB_ACCOUNT = "banco_do_brasil_conta_corrente"
ITAU_ACCOUNT = "itau_conta_corrente"
CONSOLIDATED_ACCOUNT = "contas_correntes_consolidadas"
SWEEP_NAME = "BB Rende Fácil"
NO_COUNTERPARTY = "Sem contraparte"
BALANCE_MARKERS = ("saldo anterior", "saldo do dia")
BB_CHANNELS = (
    ("Compra com Cartão", "debit_card_purchase"),
    ("Pix - Enviado", "pix_sent"),
    ("Pix - Recebido", "pix_received"),
    ("Pix-Envio devolvido", "pix_sent_refund"),
    ("Pix-Recebimento devolvido", "pix_received_reversal"),
    ("BB Rende Fácil", "bb_rende_facil"),
    ("Pagamento de Boleto", "bill_payment"),
    ("Movimento do Dia", "scheduled_debit"),
    ("Cobrança de I.O.F.", "bank_iof"),
    ("Cobrança de Juros", "bank_interest"),
    ("Pagto cartão crédito", "credit_card_payment"),
    ("Compra DBT", "debit_card_adjustment"),
    ("Pagamento de Impostos", "tax_payment"),
)
ITAU_EXACT = (
    ("APLICACAO COFRINHOS", "cofrinho_application"),
    ("RESGATE CDB COFRINHOS", "cofrinho_redemption"),
    ("COF RESGATE CDB", "cofrinho_redemption"),
    ("RESGATE COFRINHOS", "cofrinho_redemption"),
    ("REND PAGO APLIC AUT MAIS", "investment_yield"),
    ("SEGURO CARTAO", "card_insurance"),
)
ITAU_PREFIXES = (
    ("PIX QRS ", "pix_qr_sent"),
    ("PIX TRANSF ", "pix_transfer"),
    ("DEV PIX ", "pix_refund"),
    ("PAG BOLETO ", "bill_payment"),
    ("TED ", "ted_transfer"),
    ("INT  DARF", "tax_payment"),
)
MEMO_AS_PARTY = ("Cobrança de I.O.F.", "Cobrança de Juros", "Movimento do Dia", "Pagamento de Impostos", "Pagto cartão crédito")
PARTY_PREFIXES = ("PIX QRS ", "PIX TRANSF ", "DEV PIX ", "PAG BOLETO ")

INCOME = ("income", "family_support")
EXPENSE = ("expense", "business_expense", "fee")
REFUND = ("refund", "tax_refund", "deposit_refund")
INTERNAL = ("self_transfer_unresolved", "reversed_transfer")


def layout_of(account_id: Column) -> Column:
    """Statement layout of an account: ``bb``, ``itau`` or ``other`` (read like itau, without memo dates)."""
    return F.when(account_id == BB_ACCOUNT, "bb").when(account_id == ITAU_ACCOUNT, "itau").otherwise("other")


#: What Unicode counts as white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def without_prefixes(text: Column) -> Column:
    """The text with tags bare of namespace prefixes."""
    prefixed = r"(</?)[^<>/:\s]*:"
    return F.when(text.rlike(prefixed), F.regexp_replace(text, prefixed, "$1")).otherwise(text)


def ascii_upper(text: Column) -> Column:
    """ASCII letters in upper case; nothing else changes, so places stay the same."""
    low = "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(text) != F.char_length(text), F.translate(text, low, low.upper())).otherwise(F.upper(text))


def field_of(text: Column, upper: Column, name: Column) -> Column:
    """Value of the first tag of that name (``upper`` is the text in upper case), null without one: it begins after the tag and blanks, and goes to the next tag or the line's end."""
    tag = F.concat(F.lit("<"), name, F.lit(">"))
    value = F.ltrim(F.substr(text, F.nullif(F.position(tag, upper), F.lit(0)) + F.length(tag)), F.lit(" \t\r\n\x0b\x0c"))
    for end in ("<", "\n", "\r"):
        value = F.substring_index(value, end, 1)
    return strip(value)


def fields_of(text: Column, upper: Column, wanted: tuple[str, ...]) -> Column:
    """Values of the first tags of those names, in their order; one expression for all, which keeps the generated code small."""
    return F.transform(F.array(*map(F.lit, wanted)), lambda n: field_of(text, upper, n))


def tag_value(text: Column, name: str) -> Column:
    """Value of the first tag of that name, as ``field_of`` reads it, empty without one: a search in generated code, for what each transaction has."""
    return strip(F.regexp_extract(text, rf"(?i)<{name}>[ \t\r\n\x0B\f]*([^<\n\r]*)", 1))


#: An angle bracket that opens no tag of capitals alone: what other spellings, prefixes and attributes have.
UNUSUAL = r"<(?!/?[A-Z0-9.]++>)"


def usual_value(text: Column, name: str) -> Column:
    """``tag_value`` of a text without ``UNUSUAL`` brackets, whose tags have one spelling that is searched for as it is; without outer ASCII blanks only."""
    return F.regexp_extract(text, rf"<{name}>[ \t\r\n\x0B\f]*+((?:[^<\n\r]*[^< \t\n\x0B\f\r])?)", 1)


def statement_date(value: Column) -> Column:
    """The first eight digits as a date; null if they are none."""
    return F.try_to_date(F.regexp_extract(value, r"^\s*(\d{8})", 1), "yyyyMMdd")


def money_to_cents(value: Column) -> Column:
    """Decimal text, dot or comma, as whole cents; null if it is no number or has parts of a cent."""
    text = F.replace(strip(value), F.lit(","), F.lit("."))
    number = text.try_cast("decimal(30,10)") * F.lit(100).cast("decimal(3,0)")
    # digits beyond the tenth place would be rounded away before they are looked at
    tiny = text.rlike(r"\.[0-9]{10}0*[1-9]")
    return F.when((number == F.round(number, 0)) & ~tiny, F.round(number, 0).cast("long"))


def fingerprint(bank_id: Column, account: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(bank_id, F.lit("")), F.lit("\0"), F.coalesce(account, F.lit(""))), 256)


def description(name: Column, memo: Column) -> Column:
    """name | memo, without blanks; a memo that repeats the name in any case is left out."""
    return F.when((F.lower(F.upper(name)) == F.lower(F.upper(memo))) & (name != ""), name).otherwise(F.concat_ws(" | ", blank_to_null(name), blank_to_null(memo)))


def transaction_id(owner: Column, bank_tx: Column, date: Column, cents: Column, text: Column, occurrence: Column) -> Column:
    """Stable id: by the bank's id with date, amount and text, else by those and the occurrence in the file."""
    zero = F.lit("\0")
    day, amount, words = F.date_format(date, "yyyy-MM-dd"), cents.cast("string"), F.coalesce(text, F.lit(""))
    by_bank = F.concat(F.lit("bank-id"), zero, owner, zero, bank_tx, zero, day, zero, amount, zero, words)
    by_place = F.concat(F.lit("fallback"), zero, owner, zero, day, zero, amount, zero, words, zero, occurrence.cast("string"))
    return F.sha2(F.when(F.coalesce(bank_tx, F.lit("")) != "", by_bank).otherwise(by_place), 256)


def month_key(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_end(month: Column) -> Column:
    return F.last_day(F.to_date(F.concat(month, F.lit("-01"))))


def ratio(n: Column, d: Column) -> Column:
    """n / d with four places, half up; null where d is 0."""
    return F.round(n.cast("decimal(20,0)") / F.nullif(d, F.lit(0)).cast("decimal(20,0)"), 4).cast("decimal(18,4)")


def ratio_or_zero(n: Column, d: Column) -> Column:
    return F.coalesce(ratio(n, d), F.lit(0).cast("decimal(18,4)"))


def half_up(value: Column) -> Column:
    """Whole cents, halves away from zero."""
    return F.round(value.cast("decimal(30,10)"), 0).cast("long")


def code_of(text: Column, codes: tuple[tuple[str, str], ...]) -> Column:
    """The code that stands beside the text, null without one: one search of a constant map, which keeps the generated code small."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in codes for x in pair]), text)


def prefix_of(memo: Column) -> Column:
    """Which of ``ITAU_PREFIXES`` the memo begins with in any case, in capitals; empty without one."""
    return F.regexp_extract(F.upper(memo), "^(?:" + "|".join(p for p, _ in ITAU_PREFIXES) + ")", 0)


def channel(layout: Column, name: Column, memo: Column, prefix: Column | None = None) -> Column:
    """The payment channel: by exact name in layout bb, by memo in the others; both without outer blanks and not null. ``prefix`` is ``prefix_of`` the memo."""
    prefix = prefix_of(memo) if prefix is None else prefix
    of_memo = F.coalesce(code_of(F.upper(memo), ITAU_EXACT), code_of(prefix, ITAU_PREFIXES), F.lit("itau_other"))
    return F.when(layout == "bb", F.coalesce(code_of(name, BB_CHANNELS), F.lit("bb_other"))).otherwise(of_memo)


def shape(c: Column) -> Column:
    """Digits all become 9."""
    return F.translate(c, "0123456789", "9" * 10)


def word(words: Column, n: int) -> Column:
    """The n-th of the words, counted from the end if negative; empty without one."""
    return F.coalesce(F.try_element_at(words, F.lit(n)), F.lit(""))


def without_first(c: Column, n: int) -> Column:
    """The text after its first ``n`` words; as it is if nothing follows them."""
    return F.regexp_replace(c, r"^" + r"\S+\s+" * n + r"(?=\S)", "")


def begins_with_time(words: Column) -> Column:
    """Layout bb: a day and month, then hours and minutes."""
    return (shape(word(words, 1)) == "99/99") & (shape(word(words, 2)) == "99:99")


def ends_with_day(words: Column) -> Column:
    """Layout itau: the last two words are one that ends in a letter and a day, and a month."""
    return (shape(word(words, -1)) == "99") & (F.size(words) > 1) & word(words, -2).rlike("[A-Za-z][0-9][0-9]$")


def memo_columns(rows: DataFrame, memo: str = "memo_raw") -> DataFrame:
    """Adds memo_text, without outer blanks and never null, and memo_words: what texts of memos are read from."""
    return rows.withColumn("memo_text", strip(F.coalesce(memo, F.lit("")))).withColumn("memo_words", F.split("memo_text", r"\s+"))


def with_counterparty(rows: DataFrame, layout: Column) -> DataFrame:
    """Adds channel and party, struct(display, id_hash): how the money moved, and who it went to or came from.

    id_hash is for received transfers that begin with a number only. Steps are columns of their
    own, so that the generated code does not repeat the ones before.
    """
    c = F.col
    words, memo, name = c("memo_words"), c("memo_text"), c("name_text")
    read = memo_columns(rows).withColumn("name_text", strip(F.coalesce("name_raw", F.lit(""))))
    read = read.withColumns({"of_layout": layout, "timed": begins_with_time(words), "dayed": ends_with_day(words), "second": word(words, 2), "third": word(words, 3), "prefix": prefix_of(memo)})
    read = read.withColumns(
        {
            "channel": channel(c("of_layout"), name, memo, c("prefix")),
            "body": F.when(c("timed"), without_first(memo, 2)).otherwise(memo),
            "number": F.when(c("timed"), c("third")).otherwise(word(words, 1)),
            "value": F.when(c("dayed"), strip(F.regexp_replace(memo, r"[0-9]{2}\s+[0-9]{2}$", ""))).otherwise(memo),
        }
    )
    only_digits = (F.translate("number", "0123456789", "") == "") & F.length("number").between(11, 14)
    numbered = (name == "Pix - Recebido") & only_digits & (F.size(words) > F.when(c("timed"), 3).otherwise(1))
    read = read.withColumns({"candidate": F.coalesce(blank_to_null(c("body")), name), "numbered": numbered})
    bare = F.coalesce(blank_to_null(F.ltrim(c("number"), F.lit("0"))), F.lit("0"))
    id_hash = F.when((c("of_layout") == "bb") & c("numbered"), F.substring(F.sha2(bare, 256), 1, 12)).otherwise("")
    read = read.withColumns({"named": F.when(c("numbered"), without_first(c("candidate"), 1)).otherwise(c("candidate")), "id_hash": id_hash})
    bb = (
        F.when(name == SWEEP_NAME, SWEEP_NAME)
        .when(name.isin(*MEMO_AS_PARTY), F.coalesce(blank_to_null(memo), name))
        .otherwise(F.coalesce(blank_to_null(c("named")), blank_to_null(name), F.lit(NO_COUNTERPARTY)))
    )
    # layout itau: what the bank puts before the party goes
    banks = F.translate(F.concat("second", "third"), "0123456789", "") == ""
    other = F.when(c("prefix") == "TED ", F.when(banks, without_first(c("value"), 3)).otherwise(c("value")))
    other = other.when(c("prefix").isin(*PARTY_PREFIXES), strip(F.substr(c("value"), F.length("prefix") + 1)))
    other = other.otherwise(F.coalesce(blank_to_null(c("value")), F.lit(NO_COUNTERPARTY)))
    read = read.withColumn("party", F.struct(F.when(c("of_layout") == "bb", bb).otherwise(other).alias("display"), c("id_hash")))
    return read.drop("memo_text", "memo_words", "name_text", "of_layout", "timed", "dayed", "second", "third", "prefix", "body", "number", "value", "candidate", "numbered", "named", "id_hash")


def group_id(chan: Column, key: Column) -> Column:
    return F.substring(F.sha2(F.concat(chan, F.lit("\0"), key), 256), 1, 20)


def memo_day(layout: Column, words: Column) -> Column:
    """struct(day, month) that a memo names, two digits each, null without them: at its beginning in layout bb, at its end in layout itau."""
    of_bb, of_itau = (layout == "bb") & begins_with_time(words), (layout == "itau") & ends_with_day(words)
    first = word(words, 1)
    day = F.when(of_bb, F.left(first, F.lit(2))).when(of_itau, F.right(word(words, -2), F.lit(2)))
    return F.struct(day.alias("day"), F.when(of_bb, F.right(first, F.lit(2))).when(of_itau, word(words, -1)).alias("month"))


def to_units(cents: Column) -> Column:
    return (cents.cast("decimal(20,0)") / 100).cast("decimal(18,2)")
