"""Financial documents rendered from the sales tables, with the fields that are known to be in them.

The SQL is the same text for Spark and DuckDB, so that a test can compare what is extracted with what was written. Six kinds of
documents (o_orderkey modulo 6) exercise different rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MONTH = "CASE m WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END"

#: (doc_key, variant, what documents are made of); {orders}, {supplier} and {customer} stand for the tables.
PIECES = f"""
SELECT *, {_MONTH} AS mon, lpad(CAST(d AS STRING), 2, '0') AS dd, CAST(d AS STRING) AS dn, lpad(CAST(m AS STRING), 2, '0') AS mm, CAST(y AS STRING) AS yy,
  CAST(amount AS STRING) AS plain, CAST(100 + doc_key % 900 AS STRING) AS cents,
  CASE WHEN length(whole) > 3 THEN substr(whole, 1, length(whole) - 3) || ',' || substr(whole, length(whole) - 2, 3) ELSE whole END || substr(CAST(amount AS STRING), length(whole) + 1, 3) AS grouped
FROM (
  SELECT *, CAST(doc_key AS STRING) AS k, substr(CAST(amount AS STRING), 1, length(CAST(amount AS STRING)) - 3) AS whole, chr(10) AS nl FROM (
    SELECT o_orderkey AS doc_key, CAST(o_orderkey % 6 AS INT) AS variant, o_orderdate, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d,
      CAST(o_totalprice AS DECIMAL(18, 2)) AS amount, c_name AS cust,
      CASE s_suppkey % 5 WHEN 0 THEN 'Acme Trading' WHEN 1 THEN 'Blue River Foods' WHEN 2 THEN 'Northwind Supply' WHEN 3 THEN 'Delta Paper Works' ELSE 'Harbour Tools' END AS org
    FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{supplier}} ON s_suppkey = o_orderkey % 7 + 1
  ) a
) b
"""

#: The same with text and filename.
DOCS = f"""
SELECT *,
  CASE variant
    WHEN 0 THEN 'Tax Invoice' || nl || 'Invoice No: INV-' || k || nl || 'Date: ' || dd || '/' || mm || '/' || yy || nl || 'Supplier: ' || org || nl || 'Customer Name: ' || cust || nl || 'Total Due: R ' || grouped
    WHEN 1 THEN org || nl || 'Receipt No: RC' || k || nl || 'Thank you for shopping' || nl || 'Paid on ' || dn || ' ' || mon || ' ' || yy || nl || 'Amount Paid: R' || plain
    WHEN 2 THEN 'Statement of Account' || nl || 'Period ending ' || yy || '-' || mm || '-' || dd || nl || 'Payment reference none' || nl || 'Closing Balance: ' || plain || ' EUR'
    WHEN 3 THEN 'CREDIT NOTE' || nl || 'Inv CN-' || k || nl || 'Date: ' || dd || '-' || substr(mon, 1, 3) || '-' || yy || nl || 'Net Total: $' || grouped
    WHEN 4 THEN 'PURCHASE ORDER: PX-' || k || nl || 'Due Date: ' || dd || '/' || mm || '/' || yy || nl || 'Grand Total: ' || cents || nl || 'VAT No: 4' || lpad(k, 9, '0')
    ELSE 'Memo to all staff' || nl || 'Nothing to report'
  END AS text,
  CASE WHEN variant = 5 THEN 'memo ' || k || '.txt'
    ELSE yy || mm || dd || ' - ' || org || ' - ' || CASE variant WHEN 0 THEN 'Inv MNT' || k WHEN 1 THEN 'Rec 2019.' || k WHEN 2 THEN 'Statement ' || yy WHEN 3 THEN 'POP' ELSE 'Order ' || k END || ' - R' || grouped || ' - Enterprise.pdf' END AS filename
FROM ({PIECES}) c
"""

#: What the rules find in each kind of document: raw values and confidences.
TRUTH = """
SELECT doc_key, variant, y, m, d, amount, whole, yy, mm, dd, mon, grouped,
  CASE variant WHEN 0 THEN 'invoice' WHEN 1 THEN 'receipt' WHEN 2 THEN 'statement' WHEN 3 THEN 'credit_note' WHEN 4 THEN 'purchase_order' ELSE 'unknown' END AS doc_type,
  CAST(CASE variant WHEN 0 THEN 0.93 WHEN 1 THEN 0.88 WHEN 2 THEN 0.88 WHEN 3 THEN 0.95 WHEN 4 THEN 0.85 ELSE 0.0 END AS DOUBLE) AS doc_confidence,
  CASE variant WHEN 0 THEN 'INV-' || k WHEN 1 THEN 'RC' || k WHEN 3 THEN 'CN-' || k END AS raw_invoice_number,
  CAST(CASE variant WHEN 0 THEN 0.92 WHEN 1 THEN 0.85 WHEN 3 THEN 0.85 END AS DOUBLE) AS conf_invoice_number,
  CASE variant WHEN 0 THEN org WHEN 1 THEN org WHEN 2 THEN 'Closing Balance: ' || plain || ' EUR' WHEN 3 THEN 'CREDIT NOTE' WHEN 4 THEN 'PURCHASE ORDER: PX-' || k ELSE 'Memo to all staff' END AS raw_organization_name,
  CAST(CASE variant WHEN 0 THEN 0.85 WHEN 2 THEN 0.65 ELSE 0.72 END AS DOUBLE) AS conf_organization_name,
  CASE variant WHEN 0 THEN dd || '/' || mm || '/' || yy WHEN 1 THEN dn || ' ' || mon || ' ' || yy WHEN 2 THEN yy || '-' || mm || '-' || dd WHEN 3 THEN dd || '-' || substr(mon, 1, 3) || '-' || yy WHEN 4 THEN dd || '/' || mm || '/' || yy END AS raw_invoice_date,
  CAST(CASE variant WHEN 0 THEN 0.92 WHEN 1 THEN 0.88 WHEN 2 THEN 0.80 WHEN 3 THEN 0.85 WHEN 4 THEN 0.92 END AS DOUBLE) AS conf_invoice_date,
  CASE variant WHEN 0 THEN grouped WHEN 1 THEN CASE WHEN length(whole) > 3 THEN substr(whole, 1, 3) ELSE plain END
    WHEN 2 THEN CASE WHEN length(whole) > 3 THEN substr(whole, length(whole) - 2, 3) ELSE whole END || substr(plain, length(whole) + 1, 3) WHEN 3 THEN grouped WHEN 4 THEN cents END AS raw_total_amount,
  CAST(CASE variant WHEN 0 THEN 0.93 WHEN 1 THEN 0.93 WHEN 2 THEN 0.55 WHEN 3 THEN 0.90 WHEN 4 THEN 0.93 END AS DOUBLE) AS conf_total_amount,
  CASE variant WHEN 0 THEN 'ZAR' WHEN 1 THEN 'ZAR' WHEN 2 THEN 'EUR' WHEN 3 THEN 'USD' END AS raw_currency,
  CAST(CASE variant WHEN 0 THEN 0.88 WHEN 1 THEN 0.88 WHEN 2 THEN 0.95 WHEN 3 THEN 0.50 END AS DOUBLE) AS conf_currency,
  CASE variant WHEN 4 THEN 'PX-' || k END AS raw_purchase_order_number,
  CAST(CASE variant WHEN 4 THEN 0.88 END AS DOUBLE) AS conf_purchase_order_number,
  CASE variant WHEN 4 THEN dd || '/' || mm || '/' || yy END AS raw_due_date,
  CAST(CASE variant WHEN 4 THEN 0.90 END AS DOUBLE) AS conf_due_date,
  CASE variant WHEN 4 THEN '4' || lpad(k, 9, '0') END AS raw_vat_number,
  CAST(CASE variant WHEN 4 THEN 0.92 END AS DOUBLE) AS conf_vat_number,
  CASE variant WHEN 0 THEN cust END AS raw_recipient_organization,
  CAST(CASE variant WHEN 0 THEN 0.80 END AS DOUBLE) AS conf_recipient_organization
FROM ({docs}) r
"""

TABLES = ["orders", "supplier", "customer"]


def frames(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """TABLES by name. Orders are a few bytes a row but stand for texts whose rules take milliseconds, so they're dealt out by number, not bytes."""
    out = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    out["orders"] = out["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    return out


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents: text, filename and the pieces that they're made of."""
    return spark.sql(DOCS, **frames(spark, sf_dir))


def docs_sql() -> str:
    """DOCS for DuckDB, whose views are named like the tables."""
    return DOCS.format(**{t: t for t in TABLES})


def truth_sql() -> str:
    return TRUTH.format(docs=docs_sql())


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A history from the events table: each user is an item, each hour a batch, each event a version of the run of that item and
    batch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    status = F.element_at(F.array(*[F.lit(s) for s in ("planned", "applied", "quarantined", "failed", "skipped")]), (F.col("event_id") % 5 + 1).cast("int"))
    batch = F.concat(F.lit("b"), (F.dayofyear("ts") % 10).cast("string"))
    return e.select(
        F.concat_ws("-", batch, F.col("user_id").cast("string")).alias("run_id"), F.col("event_id").alias("seq"), batch.alias("batch_id"), F.col("user_id").cast("string").alias("item_id"),
        F.sha2(F.col("user_id").cast("string"), 256).alias("content_hash"), F.lit("default-v1").alias("policy_version"), status.alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"),
    )


#: The same for DuckDB.
RUNS_SQL = """SELECT 'b' || (dayofyear(ts) % 10)::VARCHAR || '-' || user_id::VARCHAR AS run_id, event_id AS seq, 'b' || (dayofyear(ts) % 10)::VARCHAR AS batch_id, user_id::VARCHAR AS item_id,
 sha256(user_id::VARCHAR) AS content_hash, 'default-v1' AS policy_version, (['planned', 'applied', 'quarantined', 'failed', 'skipped'])[event_id % 5 + 1] AS status, ts AS created_at, ts AS updated_at FROM events"""
