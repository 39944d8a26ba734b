"""The keywords, patterns, confidences and tables that results depend on.

Patterns are (label, value, tail, confidence), tried in this order. They hold what must equal the known behaviour.
"""

# --- fixed values: keywords of document types -----------------------------------------------------------------------
CREDIT_NOTE = ["CREDIT NOTE", "CREDIT MEMO", "GUTSCHRIFT", "AVERE", "NOTA DE CRÉDITO", "NOTA DE CREDITO"]
INVOICE = ["TAX INVOICE", "INVOICE #", "INVOICE NO", "INVOICE NUMBER", "FACTURE", "RECHNUNG", "FATTURA", "FACTURA", "INVOICE"]
INVOICE_STRONG = ["INVOICE NO", "INVOICE NUMBER", "INVOICE #", "INV NO", "INV NUMBER"]
RECEIPT = ["RECEIPT", "REÇU", "RECU", "QUITTUNG"]
RECEIPT_POS = [
    "AMOUNT DUE", "AMOUNT CHARGED", "PAYMENT RECEIVED", "THANKS FOR RIDING", "THANK YOU FOR", "AMOUNT PAID", "PAID IN CASH", "PAID BY CARD",
    "TABLE NO", "TABLE NUMBER", "SALE #", "SALE NO", "RECEIPT NO", "BOOKING CONFIRMED", "E-TICKET", "TRIP FARE", "YOCO RECEIPTS",
]
STATEMENT = [
    "TRANSACTION STATEMENT", "STATEMENT OF ACCOUNT", "ACCOUNT STATEMENT", "BALANCE STATEMENT", "CLOSING BALANCE", "OPENING BALANCE", "BALANCE B/F",
    "BALANCE BF", "START DATE", "END DATE",
]
PROOF_OF_PAYMENT = [
    "PROOF OF PAYMENT", "EFT CONFIRMATION", "PAYMENT CONFIRMATION", "PROOF OF TRANSFER", "ELECTRONIC FUNDS TRANSFER", "AUTHORISED", "TRACE NO",
    "AUTHORISATION CODE", "AUTHORISATION NO",
]
PURCHASE_ORDER = ["PURCHASE ORDER", "ORDER CONFIRMATION", "P.O. NUMBER", "PO NUMBER"]
INVOICE_HINT = r"(?:INV[-\s]|INVOICE\s*(?:#|NO\.?|NUMBER)\s*[:\-]?\s*\S)"

# --- fixed values: parts of patterns --------------------------------------------------------------------------------
_SEP = r"\s*[:\-]?\s*"
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
_FULL_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_NUMERIC_DATE = r"\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}"
_AMOUNT = r"\d{1,3}(?:[\s,]\d{3})*(?:[.,]\d{1,2})?|\d+[.,]\d{1,2}|\d+"
#: The same with whole numbers tried first, for readers who don't want amounts without separators cut to three digits.
_AMOUNT_WHOLE = r"\d{1,3}(?:[\s,]\d{3})+(?!\d)(?:[.,]\d{1,2})?|\d+[.,]\d{1,2}|\d+"
_NAME = r"[A-Z][a-zA-Z &,.'()-]"


def _code(least: int) -> str:
    return r"[A-Z0-9][\w\-./]{%d,30}" % least


# --- fixed values: ordered patterns of the fields -------------------------------------------------------------------
INVOICE_NUMBER = [
    (r"invoice\s*(?:#|no\.?|number|num\.?)" + _SEP, _code(1), "", 0.92),
    (r"\binv\b\.?\s*(?:no\.?|#)?" + _SEP, _code(1), "", 0.85),
    (r"bill\s*(?:no\.?|number)" + _SEP, _code(1), "", 0.80),
    (r"pro[-\s]?forma\s+invoice\s*[:\-#]?\s*", _code(1), "", 0.85),
]
RECEIPT_NUMBER = [
    (r"sale\s*[:#]?\s*", _code(2), "", 0.85),
    (r"receipt\s*(?:no\.?|#|number)?" + _SEP, _code(2), "", 0.85),
    (r"booking\s*(?:(?:no\.?|number|#|ref(?:erence)?)\s*[:\-]?\s*|[:\-#]\s*)", _code(2), "", 0.82),
    (r"order\s*(?:no\.?|#|number)?" + _SEP, r"\d{2,20}", "", 0.80),
    (r"transaction\s*(?:no\.?|#|ref(?:erence)?)?" + _SEP, _code(4), "", 0.78),
    (r"tran\s*#\s*", r"\d{3,20}", "", 0.75),
    (r"trace\s*no\.?\s*[-:\s]*", r"[A-Z0-9]{3,20}", "", 0.75),
    (r"ref(?:erence)?" + _SEP, _code(3), "", 0.70),
]
ORGANIZATION = [
    (r"(?:from|issued\s+by|supplier|vendor|billed?\s+by)\s*[:\-]?\s*\n?\s*", r"[A-Z][^\n]{3,60}", "", 0.85),
    ("", _NAME + "{5,60}", r"\s*(?:Ltd\.?|Limited|Inc\.?|LLC|GmbH|B\.?V\.?|SAS|S\.?A\.?|AG|PLC|Corp\.?|CC|Pty\.?\s*Ltd\.?)", 0.88),
    ("", _NAME + "{3,60}", r"\s*\(\s*Pty\s*\)\s*Ltd", 0.90),
    ("", _NAME + "{3,60}", r"\s+CC\b", 0.88),
    ("", _NAME + "{3,60}", r"\s+Inc\b", 0.85),
    (r"T/A\s+", r"[A-Z][^\n]{3,60}", "", 0.85),
]
INVOICE_DATE = [
    (r"(?:invoice\s+)?date" + _SEP, _NUMERIC_DATE, "", 0.92),
    (r"date" + _SEP, r"\d{1,2}\s+" + _MONTH + r"\.?\s+\d{4}", "", 0.90),
    ("", r"\d{1,2}\s+" + _FULL_MONTH + r"\s+\d{4}", "", 0.88),
    ("", r"\d{4}-\d{2}-\d{2}", "", 0.80),
    ("", r"\d{1,2}[-/]" + _MONTH + r"[-/]\d{2,4}", "", 0.85),
    (r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+", _MONTH + r"\.?\s+\d{1,2},?\s+\d{4}", "", 0.82),
    (r"\bon\s+", r"\d{1,2}\s+" + _FULL_MONTH + r"\s+\d{4}", "", 0.86),
    ("^", r"\d{1,2}/\d{1,2}/\d{4}", "", 0.70),
]
#: The eighth date pattern begins at any line and minds case.
INVOICE_DATE_FLAGS = {3: "(?Ud)", 7: "(?Udm)"}
DUE_DATE = [
    (r"(?:due\s+date|payment\s+due|pay\s+by)" + _SEP, _NUMERIC_DATE, "", 0.90),
    (r"(?:due\s+date|payment\s+due)" + _SEP, r"\d{1,2}\s+" + _MONTH + r"\.?\s+\d{4}", "", 0.88),
    (r"(?:due\s+date|payment\s+due)" + _SEP, r"\d{4}-\d{2}-\d{2}", "", 0.85),
]
PO_NUMBER = [
    (r"(?:purchase\s+order|p\.?o\.?)(?!\s*[Bb]ox)\s*(?:#|no\.?|number)?" + _SEP, _code(1), "", 0.88),
    (r"order\s+ref(?:erence)?" + _SEP, _code(1), "", 0.80),
    (r"(?:client\s+order\s+no\.?|customer\s+order\s+no\.?)" + _SEP, _code(1), "", 0.82),
]
VAT_NUMBER = [
    (r"(?:vat|tax)\s*(?:reg(?:istration)?\s*)?(?:no\.?|number|#)?" + _SEP, r"4\d{9}", r"\b", 0.92),
    (r"(?:vat|tax)\s*(?:no\.?|number|reg\.?|registration)" + _SEP, r"[A-Z]{0,2}[\d\s]{5,20}", "", 0.85),
    (r"\b", r"[A-Z]{2}\d{9,12}", r"\b", 0.80),
    (r"\b", r"4\d{9}", r"\b", 0.65),
]
#: The last two VAT patterns mind case.
VAT_FLAGS = {2: "(?Ud)", 3: "(?Ud)"}
RECIPIENT = [
    (r"(?:bill(?:ed)?\s+to|sold\s+to|invoice(?:d)?\s+to|client\s+name|customer\s+name|recipient)\s*[:\-]?\s*\n?\s*", r"[A-Z][^\n]{3,60}", "", 0.80),
    (r"(?:for\s+attention|attn)" + _SEP, r"[A-Z][^\n]{3,60}", "", 0.72),
]

#: Words of which a text in small letters (text.folded) holds one if the pattern in that place matches; null: not told by words.
INVOICE_NUMBER_WORDS = [["invoice"], ["inv"], ["bill"], ["forma"]]
RECEIPT_NUMBER_WORDS = [["sale"], ["receipt"], ["booking"], ["order"], ["transaction"], ["tran"], ["trace"], ["ref"]]
ORGANIZATION_WORDS = [
    ["from", "issued", "supplier", "vendor", "bill"], ["ltd", "limited", "inc", "llc", "gmbh", "bv", "b.v", "sa", "s.a", "ag", "plc", "corp", "cc"], ["pty"], ["cc"], ["inc"],
    ["t/a"],
]
INVOICE_DATE_WORDS = [["date"], ["date"], None, None, None, ["mon", "tue", "wed", "thu", "fri", "sat", "sun"], None, None]
DUE_DATE_WORDS = [["due", "pay"], ["due"], ["due"]]
PO_NUMBER_WORDS = [["purchase", "po", "p.o"], ["order"], ["order"]]
VAT_NUMBER_WORDS = [["vat", "tax"], ["vat", "tax"], None, None]
RECIPIENT_WORDS = [["bill", "sold", "invoice", "client", "customer", "recipient"], ["attention", "attn"]]
TOTAL_WORDS = [["total", "amount"], ["total", "amount"], ["total", "amount"], ["balance", "total"]]

#: Characters that a match of the pattern in that place begins with, those that (?iU) takes for ASCII letters included; null: not told by one. A look
#: at them spares most places of a text the alternatives that the pattern begins with.
INVOICE_DATE_FIRST = ["IiDd\u0130\u0131", None, None, None, None, "MmTtWwFfSs\u017f", None, None]
TOTAL_FIRST = ["TtAaGg", "TtSsAa\u017f", "TtAaGg", "BbNn"]
#: One of these characters is in every match of BARE_RAND and MONEY; one of MONEY begins with one of them or an R.
MONEY_HOLDS = "£€$¥₹\\p{Nd}"
MONEY_FIRST = MONEY_HOLDS + "Rr"


def total_labelled(whole: bool = False) -> list[tuple[str, str, str, float]]:
    """Labelled totals: in rand first, then in any currency."""
    amount = _AMOUNT_WHOLE if whole else _AMOUNT
    return [
        (
            r"(?:total\s+(?:amount\s+)?(?:due|payable|incl\.?\s*(?:vat|tax)?)|amount\s+(?:due|charged|paid)|grand\s+total|(?<!sub\s)(?<!SUB\s)total)"
            + _SEP + r"R?\s*", amount, "", 0.93,
        ),
        (r"(?:total|subtotal|amount)\b[^\n]*?R\s*", r"[\d\s,]+\.\d{2}", r"\b", 0.88),
        (r"(?:total\s+(?:amount\s+)?due|amount\s+due|total\s+payable|grand\s+total|total)" + _SEP + r"[£€$¥₹]?\s*R?\s*", amount, "", 0.90),
        (r"(?:balance\s+due|net\s+total)" + _SEP + r"[£€$¥₹]?\s*R?\s*", amount, "", 0.85),
    ]


BARE_RAND = [(r"\bR\s*", r"\d{1,3}(?:[\s,]\d{3})*(?:[.,]\d{1,2})?", r"\b", 0.60)]
MONEY = (
    r"[£€$¥₹]\s*([\d,\s]+\.?\d*)|(\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?)\s*(?:EUR|USD|GBP|JPY|CHF|AUD|CAD|ZAR)\b"
    r"|\bR\s*(\d{1,3}(?:[\s,]\d{3})*(?:[.,]\d{1,2})?)\b"
)
LARGEST_AMOUNT = 0.55
INVOICE_LABEL, CODE_LINE, DATE_LINE, CODE_LINE_CONFIDENCE = (
    r"(?:invoice|tax\s+invoice)\s*(?:no\.?|number|#)", r"^[A-Z0-9][\w\-./]{2,30}$", r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}$|^\d{4}-\d{2}-\d{2}$", 0.70,
)

# --- fixed values: currencies ---------------------------------------------------------------------------------------
RAND_CONTEXT = r"\b(?:rand|ZAR|South\s*African\s*Rand)\b|\(R\)"
ISO_IN_TEXT = (
    r"\b(?=\w{3}\b)(EUR|USD|GBP|JPY|CHF|AUD|CAD|CNY|INR|SEK|NOK|DKK|PLN|CZK|HUF|RON|MXN|BRL|SGD|HKD|NZD|ZAR|TRY|RUB|TWD|KRW|THB|MYR|IDR|PHP|VND)\b"
)
SYMBOLS = {"£": "GBP", "€": "EUR", "$": "USD", "¥": "JPY", "₹": "INR"}
KNOWN_CURRENCIES = [
    "AED", "AUD", "BGN", "BRL", "CAD", "CHF", "CNY", "CZK", "DKK", "EUR", "GBP", "HKD", "HRK", "HUF", "IDR", "ILS", "INR", "ISK",
    "JPY", "KRW", "MXN", "MYR", "NOK", "NZD", "PHP", "PLN", "RON", "RUB", "SEK", "SGD", "THB", "TRY", "TWD", "USD", "VND", "ZAR",
]

# --- fixed values: names of organizations ---------------------------------------------------------------------------
COMPANY_SUFFIXES = ["ltd", "llc", "inc", "plc", "ag", "bv", "sa", "sas", "gmbh", "nv", "oy", "ab", "aps", "as", "kk", "pte"]
NOT_AN_ORGANIZATION = (
    r"^(?:No\.?|Reg\.?|Order|Vendor|Client|For|The|Visit|Please|Thanks?|We\b|Hi\b|Dear|Your|Our|Amount|Total|Sub|Invoice|Receipt|Date|Payment"
    r"|Balance|Printed|Page|Tax|Allocation|Remarks|Exclusive|Property|Unit|Item|Description|Quantity|Deposit|Statement|Charge|Fee|Rate|Reference"
    r"|Period)\b"
)
EMAIL_HEADER = r"^(?:from|to|cc|bcc|sent|subject|date|reply-to)\s*:"
CONTACT_LINE = r"^(?:https?://|www\.|tel|fax|vat|reg|p\.o\.|po box|\d{1,2}[/\-])"
CALENDAR_LINE = (
    r"^(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday|Mon|Tue|Wed|Thu|Fri|Sat|Sun|January|February|March|April|May|June|July|August"
    r"|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b"
)
ADDRESS_LINE = r"\d{1,5}\s+\w+\s+(?:street|road|avenue|ave|drive|lane|rd|st|blvd|way|close|circle)"
PHONE_LINE = r"^(?:tel|fax|phone)\s*[:\-]?\s*[\+\d]"
NOT_A_RECIPIENT = r"^(?:Reg|Order|No\.?|Vendor|Client\s+order)"

# --- fixed values: file names ---------------------------------------------------------------------------------------
EXTENSIONS = r"(?:\.\w{2,5})+$"
FILENAME = r"^(\d{8})\s*-\s*(.+?)\s+-\s+(.+?)\s+-\s+(R\s*[\d\s,]+(?:[.,]\d{1,2})?)(?:\s+-\s+(.+?))?$"
FILENAME_TYPES = [
    (r"\bRec\b", "receipt"), (r"^POP\b", "proof_of_payment"), (r"^Statement\b", "statement"), (r"^Inv\b", "invoice"), (r"^Ref\b", "invoice"),
    (r"^Booking\b", "receipt"), (r"^Order\b", "receipt"),
]
FILENAME_REFERENCES = [
    r"^Inv\s+([A-Z0-9][\w.\-]+)", r"^Rec\s+([A-Z0-9][\w.\-]+)", r"Booking\s+(?:Ref\s+)?([A-Z0-9][\w.\-]+)", r"Order\s+(\d+)", r"^Ref\s+([A-Z0-9][\w.\-/]+)",
]
FILENAME_CONFIDENCE = 0.97
TRANSLITERATED = ("àáâãäåæçèéêëìíîïðñòóôõöùúûüýþß", "aaaaaaaceeeeiiiidnooooouuuuyts")
