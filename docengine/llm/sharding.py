"""Operator 5, sharding by extendible hashing. DataFrame functions only.

A row's address is a string of bits: 48 of the md5 of its id, 48 of its text, and 48 of its place in the input, which only
rows equal in both need. A shard is a prefix of addresses. The directory starts with the empty prefix; a bucket whose
bytes exceed the limit splits on one more bit, all others stay, until every shard fits. A single row larger than the limit
keeps a shard of its own once the bits are used up, and is marked oversize.

The splits of many levels are found at once: bytes are summed by the prefixes of some depth, those sums are rolled up to
every shallower prefix, and a prefix of the directory is the shallowest one that fits. Buckets that are too large even at
that depth go on by themselves, STEP bits deeper. Only (prefix, bytes) is shuffled, and summed before that.

Defined results: null ids and texts are addressed as empty texts, a null text has 0 bytes; repeated rows are spread by
their place; an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shelf

BITS, STEP, SPARE = 48, 8, 4
MAX_BYTES = 256 << 20


def _bits(value: Column) -> Column:
    return F.lpad(F.conv(F.substring(F.md5(value.cast("binary")), 1, BITS // 4), 16, 2), BITS, "0")


def assign(docs: DataFrame, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, depth, oversize) of every row; shard is the bits of its prefix, '' if one shard is enough."""
    return _assigned(docs, max_bytes, id_col, text_col, [], Shelf(docs.sparkSession))


def _assigned(docs: DataFrame, max_bytes: int, id_col: str, text_col: str, keys: list[str], shelf: Shelf) -> DataFrame:
    """The rows of assign() with the columns ``keys`` of ``docs`` after them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    address = F.concat(_bits(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), _bits(text), _bits(F.monotonically_increasing_id().cast("string")))
    left = shelf.put(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), address.alias("address"), *keys))
    total = left.agg(F.sum("n_bytes")).first()[0] or 0
    depth = max(-(-total // max_bytes) - 1, 0).bit_length() + (SPARE if total > max_bytes else 0)
    # The empty prefix holds all rows, whose bytes are known: where they don't fit, nothing is summed up for it.
    shallow, done = min(depth, 1), []
    while True:
        depth = min(depth, 3 * BITS)
        last = depth == 3 * BITS
        addressed = left.withColumn("prefix", F.substring("address", 1, depth))
        sums = addressed.groupBy("prefix").agg(F.sum("n_bytes").alias("n"), F.count("*").alias("rows"))
        levels = sums.select("prefix", "n", F.explode(F.sequence(F.lit(shallow), F.lit(depth))).alias("depth")).groupBy(F.substring(F.col("prefix"), F.lit(1), F.col("depth")).alias("at"), "depth").agg(F.sum("n").alias("n"))
        fits = levels.where(F.col("n") <= max_bytes).select("at", "depth")
        paths = sums.select("prefix", F.explode(F.sequence(F.lit(shallow), F.lit(depth))).alias("depth")).withColumn("at", F.substring(F.col("prefix"), F.lit(1), F.col("depth")))
        directory = paths.join(fits, ["at", "depth"]).groupBy("prefix").agg(F.min("depth").alias("depth"))
        # A row alone in its prefix and too large goes to the end of its bits at once.
        directory = directory.unionByName(sums.where((F.col("rows") == 1) & (F.col("n") > max_bytes)).select("prefix", F.lit(3 * BITS).alias("depth")))
        found = addressed.join(directory, "prefix", "left")
        found = found.select("doc_id", "n_bytes", "address", *keys, F.when(F.col("depth").isNull() & F.lit(last), depth).otherwise(F.col("depth")).alias("depth"))
        found = shelf.put(found)
        done.append(found.where("depth is not null"))
        if last or found.where("depth is null").isEmpty():
            break
        left, shallow, depth = found.where("depth is null").drop("depth"), depth + 1, depth + STEP
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "n_bytes", F.substring(F.col("address"), F.lit(1), F.col("depth")).alias("shard"), F.col("depth").cast("long").alias("depth"), (F.col("n_bytes") > max_bytes).alias("oversize"), *keys)


def write(docs: DataFrame, path: str, max_bytes: int = MAX_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the rows of ``docs`` to one folder per shard, and return the assignment.

    Rows are numbered in a stored copy and go by their number, so ids may be null or repeated."""
    shelf, row = Shelf(docs.sparkSession), "_".join(["row", *docs.columns])
    numbered = shelf.put(docs.withColumn(row, F.monotonically_increasing_id()))
    shards = shelf.put(_assigned(numbered, max_bytes, id_col, text_col, [row], shelf))
    numbered.join(shards.select(row, "shard"), row).drop(row).repartition("shard").write.partitionBy("shard").parquet(path)
    return shards.drop(row)


def sql(max_bytes: int) -> str:
    """DuckDB SQL for tables whose ids are unique and whose shards are at most 24 deep."""
    return f"""
WITH a AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes, lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::UBIGINT), 48, '0') AS address FROM documents),
p AS (SELECT doc_id, n_bytes, depth, substr(address, 1, depth) AS shard FROM a, (SELECT unnest(range(0, 25)) AS depth)),
s AS (SELECT depth, shard, sum(n_bytes) AS n FROM p GROUP BY ALL)
SELECT doc_id, n_bytes, shard, depth::BIGINT AS depth, n_bytes > {max_bytes} AS oversize FROM p JOIN s USING (depth, shard) WHERE n <= {max_bytes}
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1
"""
