"""Every query of the document engine against its SQL, and plans without Python."""

import pytest
from oracle import same, tables

from pyspark.sql import functions as F

from docengine import queries
from docengine.functions import text
from docengine.operators import extract
from docengine.operators.classify import classify


@pytest.fixture(scope="module")
def con(sf_dir):
    return tables(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf_dir, con, name):
    same(queries.queries()[name](spark, sf_dir), con, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["q00_auto_apply_by_type", "e20_extract_all", "v01_v06_validate"])
def test_no_python_in_plans(spark, sf_dir, name):
    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_evidence_of_all_fields(spark):
    texts = [
        "TAX INVOICE\nInvoice No: INV-77\nDate: 15/01/2024\nDue Date: 30/01/2024\nVAT No: 4123456789\nPurchase Order: PO-9\nBill To: Blue Ridge\nTotal Due: R 1,234.56",
        "receipt\nReceipt No: 88123\nthank you for your payment\npaid in ZAR 20.00\nTotal: R 20.00", "tax invoice\nsupplier: Acme Trading\nR 45.00",
    ]
    docs = classify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    rows = extract.with_evidence(extract.extract(docs, queries.FIELDS), queries.FIELDS).orderBy("i").collect()
    for r in rows:
        for f in queries.FIELDS:
            ev = r[f"ev_{f}"]
            if ev and f != "currency":
                assert r.text[ev.start : ev.end].strip().rstrip(".,;" if f == "organization_name" else "") == r[f"raw_{f}"], f
            assert r[f"raw_{f}"] is not None or ev is None, f
    for f in ("invoice_number", "invoice_date", "total_amount", "currency", "due_date", "vat_number", "purchase_order_number", "recipient_organization"):
        assert rows[0][f"ev_{f}"], f
    assert rows[1].raw_invoice_number is None or rows[1].ev_invoice_number


def test_values_may_hold_any_character(spark):
    """Also the one that stands between a value and its confidence while rules are tried."""
    docs = classify(spark.createDataFrame([("tax invoice\nSupplier: Acme\x1fTrading House\nInvoice No: INV-7",)], "text string"))
    row = extract.extract(docs, queries.FIELDS).first()
    assert row.raw_organization_name.endswith("Acme\x1fTrading House") and row.conf_organization_name > 0.5 and row.raw_invoice_number == "INV-7"
    packed = text.pack(F.col("text"), 0.85)
    assert tuple(docs.select(text.raw_of(packed), text.confidence_of(packed)).first()) == (docs.first()["text"], 0.85)


def test_coverage_plans_no_analysis(spark, sf_dir):
    """x02_coverage_at_threshold joins stored results: its plan held two analyses, 20 times this size, and broke the driver's memory."""
    plan = queries.queries()["x02_coverage_at_threshold"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan and len(plan) < 20_000


def test_patterns_run_once(spark):
    """F3 to F22: each pattern stands once in the plan (before, twice: to be compared with '' and to be read), rows are copied by few projections."""
    from docengine.functions import patterns as P
    from docengine.operators.validate import validate
    from docengine.plans.policy import DEFAULT

    rows = extract.extract(classify(spark.range(1).selectExpr("string(id) as text")), queries.FIELDS)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    for table in (P.INVOICE_NUMBER, P.RECEIPT_NUMBER, P.ORGANIZATION, P.DUE_DATE, P.PO_NUMBER, P.VAT_NUMBER[:2], P.RECIPIENT, P.total_labelled()):
        for label, value, tail, _ in table:
            assert plan.count(f"(?:{label})({value})(?:{tail}),") == 1, label
    assert plan.count("Project") <= 8
    raw = spark.createDataFrame([], ", ".join(f"raw_{f} string, conf_{f} double" for f in queries.FIELDS))
    assert validate(raw, DEFAULT)._jdf.queryExecution().optimizedPlan().toString().count("Project") <= 8


def test_typed_values_are_made_once(spark, sf_dir):
    """the filter on amounts was moved into the join of the tables that texts are made of, with patterns and texts written out for each use (a plan of 831,603 characters)."""
    from docengine.functions import patterns as P

    plan = queries.queries()["n02_n03_typed_values"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    for label, value, tail, _ in P.total_labelled() + P.BARE_RAND + P.INVOICE_DATE:
        assert plan.count(f"(?:{label})({value})(?:{tail}),") == 1, label
    assert plan.count("Tax Invoice") == 1 and len(plan) < 40_000


def test_first_characters_spare_no_match(spark):
    """a look at a pattern's first characters, digits or symbols changes no match, also of letters that (?iU) takes for ASCII ones."""
    import random

    from docengine.functions import patterns as P

    rng = random.Random(5)
    parts = "total subtotal amount due paid payable grand balance net invoice date mon sat sun thu march mar jan R r $ € £ ZAR usd jpy 12/03/2024 3 1,234.56 12 45.6 7,890 ٤٥ - : , . on".split()
    parts += ["date: 3 march 2024", "12 March 2024", "on 3 May 2024", "2024-01-02", "3-mar-24", "mon, mar 3, 2024", "amount: R 12.50", "net total: 5", "\n1/2/2024"]
    odd = {"i": "ıİ", "s": "ſ", "k": "\u212a"}
    texts = []
    for _ in range(4000):
        t = rng.choice(["", " ", " ", "\n"]).join(rng.choice([str.title, str.upper, str])(rng.choice(parts)) for _ in range(rng.randrange(1, 9)))
        texts.append("".join(rng.choice(odd[c.lower()]) if c.lower() in odd and rng.random() < 0.1 else c for c in t))
    t, columns = F.col("t"), []
    for name, table, flags, first in (("date", P.INVOICE_DATE, P.INVOICE_DATE_FLAGS, P.INVOICE_DATE_FIRST), ("total", P.total_labelled(), {}, P.TOTAL_FIRST), ("whole", P.total_labelled(True), {}, P.TOTAL_FIRST)):
        assert len(table) == len(first)
        for i, row in enumerate(table):
            f = {0: flags.get(i, "(?iUd)")}
            columns.append((f"{name}{i}", text.first_match(t, [row], f), text.first_match(t, [row], f, None, None, [first[i]])))
    columns.append(("dates", text.first_match(t, P.INVOICE_DATE, P.INVOICE_DATE_FLAGS), extract.invoice_date(t, None, text.folded(t))))
    groups = [F.regexp_extract_all(t, F.lit("(?iUd)" + P.MONEY), F.lit(i)) for i in (1, 2, 3)]
    tokens = F.transform(F.arrays_zip(*[g.alias(f"g{i}") for i, g in enumerate(groups)]), lambda z: text.strip(F.concat(z["g0"], z["g1"], z["g2"])))
    ranked = F.transform(tokens, lambda z, i: F.struct(F.regexp_replace(z, "(?U)[\\s,.]", "").try_cast("double").alias("n"), (-i).alias("i"), z.alias("raw")))
    columns.append(("largest", text.pack(F.array_max(F.filter(ranked, lambda r: r["n"].isNotNull()))["raw"], P.LARGEST_AMOUNT), extract.largest_amount(t)))
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(*[(~a.eqNullSafe(b)).cast("int").alias(f"d_{n}") for n, a, b in columns], *[a.isNotNull().cast("int").alias(f"n_{n}") for n, a, _ in columns])
    got = rows.groupBy().sum().first().asDict()
    assert all(got[f"sum(d_{n})"] == 0 for n, _, _ in columns) and all(got[f"sum(n_{n})"] > 0 for n, _, _ in columns), got


def test_plain_dates_and_amounts_as_others(spark):
    """dates of numbers and amounts without letters take a path in generated code, with the values of the general one."""
    from docengine.functions import normalize

    raws = [f"{a:0{w}d}{c}{b}{c}{y}" for a in range(40) for b in range(40) for w, c in ((1, "/"), (2, "-")) for y in ("2024", "2023", "0000", "0999", "24", "999")]
    raws += [f"{y}.{a}.{b:02d}" for a in range(15) for b in range(35) for y in ("2024", "2023", "0000")]
    raw = F.col("raw")
    rows = spark.createDataFrame([(r,) for r in raws], "raw string").select(normalize.date(raw).alias("a"), normalize._date_of(raw, normalize.PIVOT_YEAR).alias("b"))
    assert rows.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0 and rows.where("a is not null").count() > 3000
    amounts = [(r,) for r in ("1,234.56", "1.234,56", "12,5", "12,345", "1,2,3", "..", ",", "5.", ".5", "1.2.3", "007", "", None)]
    rows = spark.createDataFrame(amounts, "raw string").select(normalize.decimal_text(raw).alias("a"), normalize.decimal_text(F.concat(F.lit("R "), raw)).alias("b"))
    assert rows.where(~F.col("a").eqNullSafe(F.col("b"))).count() == 0 and rows.where("a is not null").count() == 8


def test_only_keeps_what_where_keeps(spark):
    rows = spark.createDataFrame([(i, None if i % 3 else i * 1.5, None if i % 2 else f"t{i}") for i in range(20)], "i long, x double, t string")
    for condition in (F.col("x").isNotNull(), F.col("x") > 5, F.col("t") == "t6", F.lit(False), F.lit(None).cast("boolean")):
        kept = text.only(rows, condition)
        assert kept.dtypes == rows.dtypes and kept.orderBy("i").collect() == rows.where(condition).orderBy("i").collect()


def test_words_spare_no_match(spark):
    """A pattern that a text's words rule out doesn't match it: with and without words the same, also in letters that (?iU) takes for ASCII ones."""
    import random

    from docengine.functions import patterns as P

    rng = random.Random(4)
    parts = [w for n in dir(P) if n.endswith("_WORDS") for ws in getattr(P, n) for w in ws or []]
    parts += ["by", "no", "no.", "number", "#", ":", " ", "\n", "4123456789", "INV-77", "Acme Trading Co", "Ltd", "(Pty) Ltd", "Inc", "CC", "S.A.", "B.V.", "1,234.56", "R", "12/03/2024", "3 March 2024", "March 3, 2024", "2024-01-02", "date", "ordered", "reference", "payable", "to", "name"]
    odd = {"i": "ıİ", "s": "ſ", "k": "K"}
    texts = []
    for _ in range(3000):
        t = rng.choice(["", " ", "\n"]).join(rng.choice([str.title, str.upper, str.lower])(rng.choice(parts)) for _ in range(rng.randrange(1, 9)))
        texts.append("".join(rng.choice(odd[c.lower()]) if c.lower() in odd and rng.random() < 0.1 else c for c in t))
    low = text.folded(F.col("t"))
    tables = [("INVOICE_NUMBER", {}), ("RECEIPT_NUMBER", {}), ("ORGANIZATION", {}), ("INVOICE_DATE", P.INVOICE_DATE_FLAGS), ("DUE_DATE", {}), ("PO_NUMBER", {}), ("VAT_NUMBER", P.VAT_FLAGS), ("RECIPIENT", {}), ("TOTAL", {})]
    columns = []
    for name, flags in tables:
        table, words = (P.total_labelled() if name == "TOTAL" else getattr(P, name)), getattr(P, f"{name}_WORDS")
        assert len(table) == len(words)
        for i, row in enumerate(table):
            if words[i]:
                f = {0: flags.get(i, "(?iUd)")}
                columns.append((f"{name}_{i}", text.first_match(F.col("t"), [row], f), text.first_match(F.col("t"), [row], f, low, [words[i]])))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*[(~plain.eqNullSafe(spared)).cast("int").alias(f"d_{n}") for n, plain, spared in columns], *[plain.isNotNull().cast("int").alias(f"n_{n}") for n, plain, _ in columns])
    got = rows.groupBy().sum().first().asDict()
    assert all(got[f"sum(d_{n})"] == 0 for n, _, _ in columns), got
    assert sum(got[f"sum(n_{n})"] > 0 for n, _, _ in columns) > 25, got


def test_folded_letters_and_stripped_spaces(spark):
    chars = spark.createDataFrame([(i, chr(i)) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000], "id int, c string").cache()
    low = text.folded(F.col("c"))
    missed = chars.select(*[(F.col("c").rlike("(?iUd)" + a) & ~low.contains(a)).cast("int").alias(a) for a in "abcdefghijklmnopqrstuvwxyz"]).groupBy().sum().first()
    assert set(missed) == {0}
    both = F.concat("c", "c", F.lit("a"), "c", F.lit("b"), "c")
    assert not chars.where(text.strip(both) != F.regexp_replace(both, "(?U)^\\s+|\\s+$", "")).count()
    ends = F.concat(F.lit("x"), "c", F.lit("y\r\nz\n"), "c")
    split = F.split(ends, text.LINE_END)
    assert not chars.where(text.lines(ends) != F.when(F.element_at(split, -1) == "", F.slice(split, 1, F.size(split) - 1)).otherwise(split)).count()


def test_analysis_is_generated_in_small_methods(spark):
    """The JVM interprets methods of more than 8000 bytes; validation's was 10,732 bytes long, and its patterns were lambdas, which Spark evaluates without generated code."""
    from docengine.functions import patterns
    from docengine.operators.validate import validate
    from docengine.plans.store import stored

    docs = stored(spark.createDataFrame([(1, "Tax Invoice\nInvoice No: INV-1\nDate: 03/04/2020\nTotal Due: R 12.50")], "doc_key long, text string"))
    found = stored(extract.extract(classify(docs), queries.FIELDS))
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    parts = debug.codegenStringSeq(validate(found, queries.DEFAULT)._jdf.queryExecution().executedPlan())
    assert all(parts.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(parts.length()))
    packed = docs.select(text.first_match(F.col("text"), patterns.INVOICE_NUMBER), text.first_match(F.col("text"), patterns.VAT_NUMBER))
    assert "lambda" not in packed._jdf.queryExecution().toString()
