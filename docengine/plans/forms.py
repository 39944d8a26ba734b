"""Short documents, one for each way in which a rule can find a value, with the value that was written into it.

Where ``render`` has six whole documents, this has a form for every pattern that can win, for values that are found but invalid, and for dates
in the wrong order; another set has a document for each keyword. Lines begin in lower case where no organization is meant. Texts and
truth are the same SQL for Spark and DuckDB. Not here: ``on`` before a long date, whose date an earlier pattern always takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import patterns as P
from . import render

_SHORT, _LONG = "dn || ' ' || substr(mon, 1, 3) || ' ' || yy", "dn || ' ' || mon || ' ' || yy"
_SLASHES, _ISO, _SIX, _NINE = "dd || '/' || mm || '/' || yy", "yy || '-' || mm || '-' || dd", "lpad(k, 6, '0')", "lpad(k, 9, '0')"
_INVOICE, _TICKET, _SLIP = ("invoice", 0.90), ("receipt", 0.80), ("receipt", 0.88)
#: A first place for the pattern of company suffixes ("receipt sa..."), which is no name, so that later patterns get their turn.
_NO_NAME = "'receipt' || nl || 'sale' || nl || '- ' || org || "

#: name -> (text, (document type, its confidence), field -> (raw value, confidence)); other fields aren't found.
FORMS: dict[str, tuple[str, tuple[str, float], dict[str, tuple[str, float]]]] = {
    "bill_number": ("'tax invoice' || nl || 'bill no: B-' || k", _INVOICE, {"invoice_number": ("'B-' || k", 0.80)}),
    "pro_forma": ("'pro forma invoice: PF-' || k", _INVOICE, {"invoice_number": ("'PF-' || k", 0.85)}),
    "code_below_label": ("'invoice number' || nl || 'details' || nl || 'AB-' || k", ("invoice", 0.93), {"invoice_number": ("'AB-' || k", 0.70)}),
    "sale": ("'receipt' || nl || 'sale # S-' || k || nl || 'thank you for coming'", _SLIP, {"invoice_number": ("'S-' || k", 0.85)}),
    "booking": ("'e-ticket' || nl || 'booking ref: BK-' || k", _TICKET, {"invoice_number": ("'BK-' || k", 0.82)}),
    "order": (f"'e-ticket' || nl || 'order no. ' || {_SIX}", _TICKET, {"invoice_number": (_SIX, 0.80)}),
    "transaction": (f"'e-ticket' || nl || 'transaction ref: TX' || {_SIX}", _TICKET, {"invoice_number": (f"'TX' || {_SIX}", 0.78)}),
    "till": (f"'e-ticket' || nl || 'tran # ' || {_SIX}", _TICKET, {"invoice_number": (_SIX, 0.75)}),
    "trace": (f"'trace no. - T' || {_SIX}", ("proof_of_payment", 0.87), {"invoice_number": (f"'T' || {_SIX}", 0.75)}),
    "reference": (f"'proof of payment' || nl || 'reference: RF' || {_SIX}", ("proof_of_payment", 0.87), {"invoice_number": (f"'RF' || {_SIX}", 0.70)}),
    "statement_number": ("'opening balance' || nl || 'invoice no: INV-' || k || nl || 'end date' || nl || 'start date' || nl || 'balance b/f' || nl || 'closing balance'", ("statement", 0.88), {}),
    "suffix": ("'invoice' || nl || '- ' || org || ' Ltd.'", _INVOICE, {"organization_name": ("org", 0.88)}),
    "proprietary": (_NO_NAME + "' (Pty) Ltd'", _SLIP, {"organization_name": ("org", 0.90)}),
    "close_corporation": (_NO_NAME + "' CC'", _SLIP, {"organization_name": ("org", 0.88)}),
    "incorporated": (_NO_NAME + "' Inc'", _SLIP, {"organization_name": ("org", 0.85)}),
    "trading_as": ("'invoice' || nl || '- t/a ' || org", _INVOICE, {"organization_name": ("org", 0.85)}),
    "labelled_date": (f"'invoice' || nl || 'date: ' || {_SHORT}", _INVOICE, {"invoice_date": (_SHORT, 0.90)}),
    "weekday_date": ("'invoice' || nl || 'mon, ' || mon || ' ' || dn || ', ' || yy", _INVOICE, {"invoice_date": ("mon || ' ' || dn || ', ' || yy", 0.82)}),
    "line_date": (f"'invoice' || nl || {_SLASHES}", _INVOICE, {"invoice_date": (_SLASHES, 0.70)}),
    "pay_by": (f"'invoice' || nl || 'pay by: ' || {_SLASHES}", _INVOICE, {"due_date": (_SLASHES, 0.90)}),
    "due_in_words": (f"'invoice' || nl || 'payment due: ' || {_LONG}", _INVOICE, {"invoice_date": (_LONG, 0.88), "due_date": (_LONG, 0.88)}),
    "due_iso": (f"'invoice' || nl || 'payment due: ' || {_ISO}", _INVOICE, {"invoice_date": (_ISO, 0.80), "due_date": (_ISO, 0.85)}),
    "order_reference": ("'invoice' || nl || 'order ref: OR-' || k", _INVOICE, {"purchase_order_number": ("'OR-' || k", 0.80)}),
    "customer_order": ("'invoice' || nl || 'customer order no: CO-' || k", _INVOICE, {"purchase_order_number": ("'CO-' || k", 0.82)}),
    "vat_letters": (f"'invoice' || nl || 'vat no: GB' || {_NINE}", _INVOICE, {"vat_number": (f"'GB' || {_NINE}", 0.85)}),
    "vat_bare_letters": (f"'invoice' || nl || '- DE' || {_NINE}", _INVOICE, {"vat_number": (f"'DE' || {_NINE}", 0.80)}),
    "vat_bare": (f"'invoice' || nl || '- 4' || {_NINE}", _INVOICE, {"vat_number": (f"'4' || {_NINE}", 0.65)}),
    "attention": ("'invoice' || nl || 'attn: ' || cust", _INVOICE, {"recipient_organization": ("cust", 0.72)}),
    "amount_in_rand": ("'invoice' || nl || 'amount of goods: R ' || grouped", _INVOICE, {"total_amount": ("grouped", 0.88), "currency": ("'ZAR'", 0.88)}),
    "balance_due": ("'invoice' || nl || 'balance due: €' || grouped", _INVOICE, {"total_amount": ("grouped", 0.85), "currency": ("'EUR'", 0.95)}),
    "bare_rand": ("'invoice' || nl || '- R ' || grouped", _INVOICE, {"total_amount": ("grouped", 0.60), "currency": ("'ZAR'", 0.88)}),
    "largest": ("'invoice' || nl || '- $ 1.25' || nl || '- ' || grouped || ' USD'", _INVOICE, {"total_amount": ("grouped", 0.55), "currency": ("'USD'", 0.95)}),
    "rand": ("'invoice' || nl || 'in rand'", _INVOICE, {"currency": ("'ZAR'", 0.95)}),
    "iso": ("'invoice' || nl || 'in nzd'", _INVOICE, {"currency": ("'NZD'", 0.95)}),
    "pounds": ("'invoice' || nl || 'in £'", _INVOICE, {"currency": ("'GBP'", 0.95)}),
    "yen": ("'invoice' || nl || '€ or ¥ or ¥'", _INVOICE, {"currency": ("'JPY'", 0.95)}),
    "rupees": ("'invoice' || nl || 'in ₹'", _INVOICE, {"currency": ("'INR'", 0.95)}),
    "no_such_day": ("'invoice' || nl || 'date: 31/02/' || yy", _INVOICE, {"invoice_date": ("'31/02/' || yy", 0.92)}),
    "no_number": ("'invoice' || nl || 'amount of R 1 , 2.00'", _INVOICE, {"total_amount": ("'1 , 2.00'", 0.88), "currency": ("'ZAR'", 0.88)}),
    "due_before": (f"'invoice' || nl || 'date: ' || {_SLASHES} || nl || 'due date: 01/01/1990'", _INVOICE, {"invoice_date": (_SLASHES, 0.92), "due_date": ("'01/01/1990'", 0.90)}),
}
#: Forms whose value is found but invalid.
INVALID = {"no_such_day": "invoice_date", "no_number": "total_amount"}

#: (keyword, document type, confidence) of a document that has the keyword, a line end and a number.
KEYWORDS = [
    *[(w, "credit_note", 0.95) for w in P.CREDIT_NOTE], *[(w, "invoice", 0.93 if w in P.INVOICE_STRONG else 0.90) for w in P.INVOICE], *[(w, "receipt", 0.88) for w in P.RECEIPT],
    *[(w, "receipt", 0.88 if "RECEIPT" in w else 0.80) for w in P.RECEIPT_POS], *[(w, "purchase_order", 0.85) for w in P.PURCHASE_ORDER], *[(w, "statement", 0.88) for w in P.STATEMENT],
    *[(w, "proof_of_payment", 0.87) for w in P.PROOF_OF_PAYMENT],
]


def _case(what: str, rows: list[tuple[int, str]], kind: str = "STRING") -> str:
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in rows)
    return f"CAST(CASE {what} {whens} END AS {kind})" if rows else f"CAST(NULL AS {kind})"


#: Each order is a form and a keyword, by its number.
DOCS = f"""
SELECT *, {_case("form_no", [(i, f"'{name}'") for i, name in enumerate(FORMS)])} AS form, {_case("form_no", [(i, text) for i, (text, _, _) in enumerate(FORMS.values())])} AS text,
  {_case("keyword_no", [(i, f"'{w}'") for i, (w, _, _) in enumerate(KEYWORDS)])} || nl || k AS keyword_text
FROM (SELECT *, CAST(doc_key % {len(FORMS)} AS INT) AS form_no, CAST(doc_key % {len(KEYWORDS)} AS INT) AS keyword_no FROM ({render.PIECES}) p) f"""


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_key, form, text, keyword_text): the forms, dealt out as ``render.rendered`` does."""
    return spark.sql(DOCS, **render.frames(spark, sf_dir)).select("doc_key", "form", "text", "keyword_text")


def truth_sql(fields: list[str]) -> str:
    """DuckDB SQL: doc_type, doc_confidence, raw_ and conf_ of ``fields`` as written into each form, and the keyword's type."""
    docs = DOCS.format(**{t: t for t in render.TABLES})
    columns = [_case("form_no", [(i, f"'{t}'") for i, (_, (t, _), _) in enumerate(FORMS.values())]) + " AS doc_type", _case("form_no", [(i, str(c)) for i, (_, (_, c), _) in enumerate(FORMS.values())], "DOUBLE") + " AS doc_confidence"]
    for f in fields:
        known = [(i, found[f]) for i, (_, _, found) in enumerate(FORMS.values()) if f in found]
        columns += [_case("form_no", [(i, raw) for i, (raw, _) in known]) + f" AS raw_{f}", _case("form_no", [(i, str(c)) for i, (_, c) in known], "DOUBLE") + f" AS conf_{f}"]
    columns += [_case("keyword_no", [(i, f"'{t}'") for i, (_, t, _) in enumerate(KEYWORDS)]) + " AS keyword_type", _case("keyword_no", [(i, str(c)) for i, (_, _, c) in enumerate(KEYWORDS)], "DOUBLE") + " AS keyword_confidence"]
    return f"SELECT doc_key, form, d, m, {', '.join(columns)} FROM ({docs}) r"
