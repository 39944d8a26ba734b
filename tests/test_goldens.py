"""Known values of normalizers, names, classification and policies."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docengine.functions import naming, normalize
from docengine.operators.classify import classify
from docengine.operators.validate import validate
from docengine.plans.policy import DEFAULT, RESERVED, ConfigError, Naming, load


def values(spark, raws, build):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return [r[0] for r in df.select("i", build(F.col("raw")).alias("x")).orderBy("i").select("x").collect()]


def test_dates(spark):
    day = dt.date(2024, 1, 15)
    raws = ["2024-01-15", "15/01/2024", "15.01.2024", "15 January 2024", "15 Jan 2024", "January 15, 2024", "12/14/2018", "31/02/2024", "2024-15-01", "not-a-date", "", None]
    assert values(spark, raws, normalize.date) == [day] * 6 + [dt.date(2018, 12, 14)] + [None] * 5


def test_decimals(spark):
    raws = ["1234.56", "1,234.56", "1.234,56", "£1,234.56", "€ 1.234,56", "$1234.56", "1000", "1.234.567", "not-a-number", "", None]
    assert [None if x is None else float(x) for x in values(spark, raws, normalize.decimal)] == [1234.56] * 6 + [1000.0] + [None] * 4


def test_currencies(spark):
    assert values(spark, ["£", "€", "$", "eur", "USD", "GBP", "XYZ", "", None], normalize.currency) == ["GBP", "EUR", "USD", "EUR", "USD", "GBP", None, None, None]


def test_strings_and_organizations(spark):
    assert values(spark, ["  hello   world  ", "hello\t\nworld", "hello world", ""], normalize.string) == ["hello world"] * 3 + [""]
    assert values(spark, ["  Acme Ltd  ", "Acme Corp."], normalize.organization) == ["Acme LTD", "Acme Corp"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=40), min_size=20, max_size=60))
def test_strings_against_python(spark, raws):
    # Python and Java disagree on a few separators, so only these are compared.
    raws = ["".join(c if c.isprintable() or c in " \t\n" else "x" for c in r) for r in raws]
    assert values(spark, raws, normalize.string) == [" ".join(r.split()) for r in raws]


def name(spark, org="Acme Ltd", number="INV-001", extension=".pdf", policy=Naming(), date="2024-01-15"):  # noqa: B008
    fields = {"invoice_date": F.lit(date), "organization_name": F.lit(org), "document_type": F.lit("invoice"), "invoice_number": F.lit(number)}
    return spark.range(1).select(naming.file_name(policy, fields, F.lit(extension))).first()[0]


def test_names(spark):
    assert name(spark) == "2024-01-15_acme_ltd_invoice_inv-001.pdf"
    assert name(spark, extension=".PDF").endswith(".PDF")
    assert not set('<>:"/\\|?*') & set(name(spark, org='Acme<Corp>:"Ltd'))
    assert name(spark, org="Société Générale").isascii()
    assert name(spark, number="CON", policy=Naming(template="{invoice_number}.{extension}", reserved_names=RESERVED)).startswith("_")
    short = name(spark, org="x" * 90, policy=Naming(max_length=30))
    assert len(short) <= 34 and short.endswith(".pdf")


def test_classification(spark):
    texts = ["TAX INVOICE\nInvoice No: INV-1", "Credit note for returned goods", "hello", None, ""]
    got = classify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").select("doc_type").collect()
    assert [r[0] for r in got] == ["invoice", "credit_note", "unknown", "unknown", "unknown"]


BASE = {"invoice_number": ("INV-001", 0.97), "organization_name": ("Acme Ltd", 0.96), "invoice_date": ("2024-01-15", 0.97), "total_amount": ("1234.56", 0.96), "currency": ("GBP", 0.97)}


def judged(spark, **changes):
    fields = {f.id: (None, None) for f in DEFAULT.fields} | BASE | changes
    df = spark.createDataFrame([("invoice", *(x for v in fields.values() for x in v))], "doc_type string, " + ", ".join(f"raw_{f} string, conf_{f} double" for f in fields))
    return validate(df, DEFAULT).first()


def test_validation(spark):
    assert judged(spark).validation_status == "accepted" and judged(spark).overall >= 0.94
    assert judged(spark, **{f: (raw, 0.8) for f, (raw, _) in BASE.items()}).validation_status == "review"
    missing = judged(spark, invoice_number=(None, None))
    assert missing.validation_status == "rejected" and "missing_required_field" in missing.reason_codes
    assert "invalid_date" in judged(spark, invoice_date=("not-a-date", 0.97)).reason_codes
    assert "cross_field_inconsistency" in judged(spark, due_date=("2024-01-10", 0.9)).reason_codes
    assert judged(spark, currency=("USD", 0.5)).status_currency == "low_confidence"


def test_policies(tmp_path):
    (tmp_path / "schemas").mkdir()
    (tmp_path / "policies").mkdir()
    (tmp_path / "schemas/s1.yaml").write_text("document_type: invoice\nfields:\n- {id: a, type: date, required: true}\n")
    good = tmp_path / "policies/p.yaml"
    good.write_text("policy_version: p1\nschema_version: s1\nthresholds: {auto_apply: 0.9}\n")
    assert load(str(good)).required == ("a",) and load(str(good)).thresholds.auto_apply == 0.9
    for bad in ("schema_version: s1\n", "policy_version: p1\n", "- a\n", "a: [\n"):
        good.write_text(bad)
        with pytest.raises(ConfigError):
            load(str(good))
    with pytest.raises(ConfigError):
        load(str(tmp_path / "none.yaml"))
