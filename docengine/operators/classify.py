"""Document types by keywords. Adds doc_type and doc_confidence to rows with a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import count_true

#: Types in the order in which ties are settled, with their priority.
PRIORITY = {"credit_note": 6, "invoice": 5, "receipt": 4, "purchase_order": 2, "statement": 3, "proof_of_payment": 4}


def hits(upper: Column, keywords: list[str]) -> Column:
    """How many different keywords a text in capitals contains, anywhere in its words."""
    return count_true([upper.contains(k) for k in keywords])


def classify(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with doc_type and doc_confidence (unknown and 0 where no keyword is found or text is null)."""
    body = F.coalesce(F.col(text), F.lit(""))
    groups = {"credit": P.CREDIT_NOTE, "invoice": P.INVOICE, "strong": P.INVOICE_STRONG, "receipt": P.RECEIPT, "pos": P.RECEIPT_POS, "order": P.PURCHASE_ORDER, "statement": P.STATEMENT, "payment": P.PROOF_OF_PAYMENT}
    upper = df.withColumn("_upper", F.upper(body))
    counted = upper.withColumn("_hits", F.struct(*[hits(F.col("_upper"), k).alias(n) for n, k in groups.items()], body.rlike("(?iUd)" + P.INVOICE_HINT).alias("hint"))).drop("_upper")
    h = lambda n: F.col(f"_hits.{n}")
    till_slip = (h("invoice") >= 1) & (h("strong") == 0) & (h("pos") >= 2)
    receipts = h("receipt") + h("pos")

    def candidate(name: str, found: Column, confidence: Column, n: Column) -> Column:
        place = -list(PRIORITY).index(name)
        return F.when(found, F.struct((n * PRIORITY[name]).alias("score"), confidence.alias("confidence"), F.lit(place).alias("place"), F.lit(name).alias("type")))

    best = F.array_max(F.array(
        candidate("credit_note", h("credit") > 0, F.lit(0.95), h("credit")),
        candidate("invoice", (h("invoice") > 0) & ~till_slip, F.lit(0.90) + F.when(h("hint"), 0.03).otherwise(0.0), h("invoice")),
        candidate("receipt", (receipts > 0) | till_slip, F.when(h("receipt") > 0, 0.88).otherwise(0.80), F.greatest(receipts, F.lit(1))),
        candidate("purchase_order", h("order") > 0, F.lit(0.85), h("order")),
        candidate("statement", h("statement") > 0, F.lit(0.88), h("statement")),
        candidate("proof_of_payment", h("payment") > 0, F.lit(0.87), h("payment")),
    ))
    found = counted.withColumn("_best", best)
    return found.withColumns({"doc_type": F.coalesce("_best.type", F.lit("unknown")), "doc_confidence": F.coalesce("_best.confidence", F.lit(0.0))}).drop("_hits", "_best")
