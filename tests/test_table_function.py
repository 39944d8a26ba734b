"""Extractors by name in SQL."""

import pytest
from pyspark.errors import PySparkException

from docengine.operators import extract, table_function

TEXTS = [
    "Tax invoice\nInvoice date: 15/01/2024\nDue Date: 30 January 2024\nVAT No: 4123456789\nPurchase Order: PO-9", "Date: 3 Mar 2024\nPay by: 01-02-2024\nGB123456789", "P.O. Box 12\norder reference: AB/77",
    "2024-05-06", "Payment due: 2024-05-06 and tax number GB 12 34 56 78", "January 15, 2024", "PO number: none", "", None,
]


def test_same_as_rules(spark):
    table_function.register(spark)
    docs = spark.createDataFrame([(i, t, "invoice") for i, t in enumerate(TEXTS)], "i int, text string, doc_type string")
    fields = list(table_function.LABELS)
    got = spark.sql(f"SELECT * FROM extract_fields(TABLE({{docs}}), 'labels-v1', '{','.join(fields)}')", docs=docs)
    want = extract.extract(docs, fields)
    assert got.columns == ["i", "text", "doc_type", *[f"{p}_{f}" for f in fields for p in ("raw", "conf")]]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))
    assert all(got.where(f"raw_{f} is not null").count() for f in fields)


def test_own_extractor_and_errors(spark):
    table_function.register(spark, {"shout": lambda text, doc_type: {"title": (text.upper()[:4], 0.5)} if doc_type else {}})
    docs = spark.createDataFrame([(1, "abcdef", "x", 7), (2, None, "x", None), (3, "abc", None, 1)], "i int, text string, doc_type string, raw_other int")
    rows = spark.sql("SELECT * FROM extract_fields(TABLE({docs}), 'shout', 'title, nothing') ORDER BY i", docs=docs).collect()
    assert [tuple(r)[3:] for r in rows] == [(7, "ABCD", 0.5, None, None), (None, "", 0.5, None, None), (1, None, None, None, None)]
    for bad in ("SELECT * FROM extract_fields(TABLE({docs}), 'nobody', 'title')", "SELECT * FROM extract_fields(TABLE(SELECT 1 AS i), 'shout', 'title')"):
        with pytest.raises(PySparkException, match="no extractor|takes a table"):
            spark.sql(bad, docs=docs).collect()
