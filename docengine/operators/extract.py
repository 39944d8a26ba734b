"""Fields of a document by ordered rules. Each builder maps (text, doc_type, folded text) to a packed raw value and
confidence; the folded text tells by words which patterns can't match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import UNIT, any_of, apart, beginning, collapse, confidence_of, evidence, first_match, folded, let, lines, pack, raw_of, strip, where_words

CI = "(?iUd)"


def with_digit(packed: Column) -> Column:
    """``packed`` where its raw value has a digit, else null."""
    return F.when(raw_of(packed).rlike("(?U)\\d"), packed)


# -- invoice number --------------------------------------------------------------------------------------------------


def number_after_label(text: Column, low: Column) -> Column:
    """The first code-like line among the ten that follow an invoice label, the rest of its own line included."""
    rest = F.regexp_extract(text, f"{CI}{P.INVOICE_LABEL}((?s:.*))", 1)
    good = lambda x: x.rlike(CI + P.CODE_LINE) & x.rlike("(?U)\\d") & ~x.rlike(CI + P.DATE_LINE)
    found = F.get(F.filter(F.transform(F.slice(lines(rest), 1, 10), strip), good), F.lit(0))
    return F.when(low.contains("invoice") & text.rlike(CI + P.INVOICE_LABEL), pack(found, P.CODE_LINE_CONFIDENCE))


def invoice_number(text: Column, doc_type: Column, low: Column) -> Column:
    own = first_match(text, P.INVOICE_NUMBER, None, low, P.INVOICE_NUMBER_WORDS)
    by_receipt = F.when(doc_type.isin("receipt", "proof_of_payment"), first_match(text, P.RECEIPT_NUMBER, None, low, P.RECEIPT_NUMBER_WORDS))
    return F.when(doc_type != "statement", F.coalesce(own, by_receipt))


def checked_number(packed: Column, text: Column, doc_type: Column, low: Column) -> Column:
    return F.when(doc_type != "statement", F.coalesce(with_digit(packed), number_after_label(text, low)))


# -- organization ----------------------------------------------------------------------------------------------------


def bad_organization(raw: Column) -> Column:
    """Whether a capture looks like a label, an address or a sentence."""
    return any_of([*[raw.contains(x) for x in ("@", "<", ">", "No.:", "no.:")], raw.rlike(CI + P.NOT_AN_ORGANIZATION), F.size(F.split(collapse(raw), " ")) > 6])


def organization_line(line: Column) -> Column:
    """Whether a stripped line may be the name of an organization."""
    odd = F.length(F.regexp_replace(line, "[\\p{L}\\p{N} &,.'()\\-/]+", ""))
    begins = line.rlike("(?U)^\\p{Lu}\\p{L}*[.,;:]*(?!\\S)")  # its first word has letters only, punctuation at its end aside
    excluded = "|".join(f"(?:{p})" for p in (P.EMAIL_HEADER, P.CONTACT_LINE, P.CALENDAR_LINE, P.ADDRESS_LINE, P.PHONE_LINE))
    return F.length(line).between(3, 80) & begins & ~line.rlike(CI + excluded) & ~bad_organization(line) & (odd <= F.length(line) * 0.35)


def organization(text: Column, doc_type: Column, low: Column, top: list[Column]) -> Column:
    """``top`` are the first three lines, stripped, of a column of their own as they are used often."""
    first = F.coalesce(*[F.when(organization_line(x), F.concat(x, F.lit(f"{UNIT}0.72"))) for x in top])
    labelled = []
    for (label, value, tail, confidence), words in zip(P.ORGANIZATION, P.ORGANIZATION_WORDS, strict=True):
        raw = F.regexp_replace(strip(F.regexp_extract(text, f"{CI}(?:{label})({value})(?:{tail})", 1)), "[.,;]+$", "")
        good = let(raw, lambda r: F.when((F.length(r) >= 3) & r.rlike("^\\p{Lu}") & ~bad_organization(r), r))
        # A name is tried at every place in up to 60 lengths, so what has to follow it is looked for first.
        labelled.append(where_words(low, words, F.when(text.rlike(f"{CI}(?:{tail})"), pack(good, confidence)) if tail else pack(good, confidence)))
    anywhere = F.get(F.filter(F.transform(lines(text), strip), organization_line), F.lit(0))
    return F.coalesce(first, *labelled, pack(anywhere, 0.65))


def checked_recipient(packed: Column) -> Column:
    return F.when(raw_of(packed).rlike("^\\p{Lu}") & ~raw_of(packed).rlike(CI + P.NOT_A_RECIPIENT), packed)


# -- amounts and currencies ------------------------------------------------------------------------------------------


def largest_amount(text: Column) -> Column:
    """The money token with the largest number, its separators left out; of equal ones the first."""
    found = F.regexp_extract_all(text, F.lit(beginning(P.MONEY_FIRST) + CI + P.MONEY), F.lit(0))
    # A code of three letters follows an amount; a symbol or an R stands before one.
    amount = lambda t: strip(F.when(t.rlike("(?U)^\\d"), F.substr(t, F.lit(1), F.length(t) - 3)).otherwise(F.substr(t, F.lit(2))))
    ranked = F.transform(F.transform(found, amount), lambda t, i: F.struct(F.regexp_replace(t, "(?U)[\\s,.]", "").try_cast("double").alias("n"), (-i).alias("i"), t.alias("raw")))
    return pack(F.array_max(F.filter(ranked, lambda r: r["n"].isNotNull()))["raw"], P.LARGEST_AMOUNT)


def total_amount(text: Column, doc_type: Column, low: Column, whole: bool = False) -> Column:
    """``whole`` reads amounts without separators whole; by default they are cut to three digits, as they always were."""
    unlabelled = F.when(text.rlike(f"[{P.MONEY_HOLDS}]"), F.coalesce(first_match(text, P.BARE_RAND, {0: "(?Ud)"}), largest_amount(text)))
    return F.coalesce(first_match(text, P.total_labelled(whole), None, low, P.TOTAL_WORDS, P.TOTAL_FIRST), unlabelled)


def invoice_date(text: Column, doc_type: Column, low: Column) -> Column:
    """Every pattern of dates has a digit."""
    return F.when(text.rlike("(?U)\\d"), first_match(text, P.INVOICE_DATE, P.INVOICE_DATE_FLAGS, low, P.INVOICE_DATE_WORDS, P.INVOICE_DATE_FIRST))


def currency(text: Column, doc_type: Column, low: Column) -> Column:
    iso = F.when(text.rlike(CI + P.ISO_IN_TEXT), F.concat(F.upper(F.regexp_extract(text, CI + P.ISO_IN_TEXT, 1)), F.lit(f"{UNIT}0.95")))
    counts = [F.struct(F.regexp_count(text, F.lit("\\" + s if s == "$" else s)).alias("n"), (-F.locate(s, text)).alias("place"), F.lit(s).alias("symbol")) for s in P.SYMBOLS]
    code = lambda s: F.element_at(F.create_map(*[F.lit(x) for pair in P.SYMBOLS.items() for x in pair]), s)
    symbol = let(F.array_max(F.array(*counts))["symbol"], lambda s: F.when(s == "$", pack(code(s), 0.50)).otherwise(pack(code(s), 0.95)))
    rand = where_words(low, ["rand", "zar", "(r)"], F.when(text.rlike(CI + P.RAND_CONTEXT), F.lit(f"ZAR{UNIT}0.95")))
    return F.coalesce(rand, iso, F.when(text.rlike("(?Ud)R(?<=\\bR)\\s*\\d"), F.lit(f"ZAR{UNIT}0.88")), F.when(any_of([text.contains(s) for s in P.SYMBOLS]), symbol))


# -- the rest --------------------------------------------------------------------------------------------------------

BUILDERS: dict[str, Callable[..., Column]] = {
    "invoice_number": invoice_number,
    "organization_name": organization,
    "invoice_date": invoice_date,
    "total_amount": total_amount,
    "currency": currency,
    "purchase_order_number": lambda text, _, low: first_match(text, P.PO_NUMBER, None, low, P.PO_NUMBER_WORDS),
    "due_date": lambda text, _, low: first_match(text, P.DUE_DATE, None, low, P.DUE_DATE_WORDS),
    "vat_number": lambda text, _, low: first_match(text, P.VAT_NUMBER, P.VAT_FLAGS, low, P.VAT_NUMBER_WORDS),
    "recipient_organization": lambda text, _, low: first_match(text, P.RECIPIENT, None, low, P.RECIPIENT_WORDS),
}
#: What is asked of a packed value after that, which then is a column of its own and not evaluated at each use.
CHECKS: dict[str, Callable[[Column, Column, Column, Column], Column]] = {
    "invoice_number": checked_number,
    "purchase_order_number": lambda packed, *_: with_digit(packed),
    "recipient_organization": lambda packed, *_: checked_recipient(packed),
}


def _where(text: Column, table: list, flags: dict[int, str] | None, low: Column, words: list, good: Callable[[Column], Column] | None = None) -> Column:
    """The evidence of a table's first match, null if its stripped value isn't ``good``."""
    if good is None:
        return evidence(text, table, flags, low, words)
    value = lambda e: strip(F.substring(text, e["start"] + 1, e["end"] - e["start"]))
    return let(evidence(text, table, flags, low, words), lambda e: F.when(good(value(e)), e))


def _digit(raw: Column) -> Column:
    return raw.rlike("(?U)\\d")


def _number_evidence(text: Column, doc_type: Column, low: Column) -> Column:
    own, by_receipt = first_match(text, P.INVOICE_NUMBER, None, low, P.INVOICE_NUMBER_WORDS), doc_type.isin("receipt", "proof_of_payment")
    return F.when(doc_type != "statement", F.when(own.isNotNull(), _where(text, P.INVOICE_NUMBER, None, low, P.INVOICE_NUMBER_WORDS, _digit)).when(by_receipt, _where(text, P.RECEIPT_NUMBER, None, low, P.RECEIPT_NUMBER_WORDS, _digit)))


def _organization_evidence(text: Column, doc_type: Column, low: Column) -> Column:
    top = F.filter(F.slice(F.transform(lines(text), strip), 1, 3), organization_line)
    trimmed = lambda raw: F.regexp_replace(raw, "[.,;]+$", "")
    good = lambda raw: (F.length(trimmed(raw)) >= 3) & trimmed(raw).rlike("^\\p{Lu}") & ~bad_organization(trimmed(raw))
    return F.when(F.size(top) == 0, F.coalesce(*[_where(text, [row], None, low, [words], good) for row, words in zip(P.ORGANIZATION, P.ORGANIZATION_WORDS, strict=True)]))


def _amount_evidence(text: Column, doc_type: Column, low: Column, whole: bool = False) -> Column:
    return F.coalesce(*[_where(text, [row], None, low, [words], _digit) for row, words in zip(P.total_labelled(whole), P.TOTAL_WORDS, strict=True)], _where(text, P.BARE_RAND, {0: "(?Ud)"}, low, [None], _digit))


def _recipient_evidence(text: Column, doc_type: Column, low: Column) -> Column:
    return _where(text, P.RECIPIENT, None, low, P.RECIPIENT_WORDS, lambda raw: raw.rlike("^\\p{Lu}") & ~raw.rlike(CI + P.NOT_A_RECIPIENT))


#: Each field's evidence: that of the pattern which wins in BUILDERS, null where a scan of lines, amounts or symbols does.
EVIDENCE: dict[str, Callable[[Column, Column, Column], Column]] = {
    "invoice_number": _number_evidence,
    "organization_name": _organization_evidence,
    "invoice_date": lambda text, _, low: _where(text, P.INVOICE_DATE, P.INVOICE_DATE_FLAGS, low, P.INVOICE_DATE_WORDS),
    "total_amount": _amount_evidence,
    "currency": lambda text, _, low: _where(text, [("", P.RAND_CONTEXT, "", 0.95), ("", P.ISO_IN_TEXT, "", 0.95), ("", "\\bR\\s*\\d", "", 0.88)], {2: "(?Ud)"}, low, [["rand", "zar", "(r)"], None, None]),
    "purchase_order_number": lambda text, _, low: _where(text, P.PO_NUMBER, None, low, P.PO_NUMBER_WORDS, _digit),
    "due_date": lambda text, _, low: _where(text, P.DUE_DATE, None, low, P.DUE_DATE_WORDS),
    "vat_number": lambda text, _, low: _where(text, P.VAT_NUMBER, P.VAT_FLAGS, low, P.VAT_NUMBER_WORDS),
    "recipient_organization": _recipient_evidence,
}


def extract(df: DataFrame, fields: list[str], text: str = "text", whole_amounts: bool = False) -> DataFrame:
    """``df`` (text, doc_type) with raw_<field> and conf_<field>; null where a field isn't found or has no rule.

    All fields are packed in one projection, so that rows are copied once and not once a field, and no pattern runs twice. Spark generates it in
    small methods (``apart``). Few lambdas are left in it, as Spark evaluates those without generated code."""
    body, packed = F.coalesce(F.col(text), F.lit("")), {}
    for f in fields:
        build = BUILDERS.get(f)
        if build is total_amount:
            packed[f"_{f}"] = total_amount(body, F.col("doc_type"), F.col("_low"), whole_amounts)
        elif build is organization:
            packed[f"_{f}"] = organization(body, F.col("doc_type"), F.col("_low"), [F.get("_top", F.lit(i)) for i in range(3)])
        else:
            packed[f"_{f}"] = build(body, F.col("doc_type"), F.col("_low")) if build else F.lit(None).cast("string")
    df = df.withColumns({"_low": apart(folded(body)), "_top": F.transform(F.slice(lines(body), 1, 3), strip)})
    df = df.withColumns(packed)
    checks = {f"_{f}": CHECKS[f](F.col(f"_{f}"), body, F.col("doc_type"), F.col("_low")) for f in fields if f in CHECKS}
    df = df.withColumns(checks).drop("_low", "_top")
    return df.withColumns({f"{p}_{f}": of(F.col(f"_{f}")) for f in fields for p, of in (("raw", raw_of), ("conf", lambda c: apart(confidence_of(c))))}).drop(*packed)


def with_evidence(df: DataFrame, fields: list[str], text: str = "text", whole_amounts: bool = False) -> DataFrame:
    """``df`` (text, and doc_type for invoice_number) with ev_<field>: struct<text, start, end> of the match of the pattern that
    gave extract() its value (page is always 1); null if there is none."""
    body, found = F.coalesce(F.col(text), F.lit("")), {}
    for f in fields:
        if f == "total_amount":
            found[f"ev_{f}"] = _amount_evidence(body, F.col("doc_type"), F.col("_low"), whole_amounts)
        else:
            found[f"ev_{f}"] = EVIDENCE[f](body, F.col("doc_type"), F.col("_low"))
    return df.withColumn("_low", folded(body)).withColumns({n: apart(c) for n, c in found.items()}).drop("_low")


# -- plug-ins --------------------------------------------------------------------------------------------------------

_EXTRACTORS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {"rules-v1": extract}


def register_extractor(name: str, transform: Callable[[DataFrame, list[str]], DataFrame]) -> None:
    """Add an extractor: a function from (text, doc_type) rows and field ids to the columns that extract() gives."""
    _EXTRACTORS[name] = transform


def extractor(name: str) -> Callable[[DataFrame, list[str]], DataFrame]:
    if name not in _EXTRACTORS:
        raise KeyError(f"no extractor {name!r}; there are {sorted(_EXTRACTORS)}")
    return _EXTRACTORS[name]
