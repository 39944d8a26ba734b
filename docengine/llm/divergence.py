"""Operator 11, source divergence audit: two-dimensional group-block tiling.

A group is the documents of one (lang, source). Each lang keeps the terms (lower-cased runs of letters) in at least MIN_DOCS of its documents. A
group's share of a term is p = 1 + floor(1e9 * (count + 1) / (N + V)), smoothed over the V kept terms, N the sum of its counts; the
divergence of two shares is f = floor((p - q)**2 / q). ``pair`` rows sum f over all kept terms for each ordered pair of groups of a lang, ``term`` rows
list the terms by which a group exceeds its lang most.

Workers count words in parts, Spark adds them up. Kept terms are numbered within chunks of about CHUNK terms, dealt by hash, and a
group's counts of a chunk are packed into one row, a sparse vector. The groups of a lang are dealt into blocks of about BLOCK. A
vector is replicated to the tiles (pairs of blocks) that its block takes part in. A task has one tile over SPAN chunks: it reads them one after
another, spreads each over the terms that its groups have, and adds to the submatrix of the tile's pairs. Spark adds up the
spans. A term that neither group of a pair has adds the same to it, so those are counted, not listed.

A task holds one chunk of two blocks at once. All arithmetic is exact: integers, products below 2**63, and long division in
three steps of 1000 (exact for N + V below 9e15).

Defined results: null text, lang and source are empty strings; groups without kept terms have p = 1 + floor(1e9 / V); a lang
without kept terms has pairs of value 0 and no term rows; a lang of one source has no pairs; repeated rows count each; no rows, no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Shelf, small_batches

MIN_DOCS, SCALE, TOP = 3, 1_000_000_000, 200
#: Terms of a chunk, chunks of a task, groups of a block.
CHUNK, SPAN, BLOCK = 1024, 64, 32
#: Terms, and bytes of terms (taken as long as the longest of their text), that a worker holds before it hands its counts on.
HELD_TERMS, HELD_BYTES = 400_000, 64 << 20
#: Bytes to letters in lower case, and everything that isn't part of a term to spaces. Bytes above 127 are parts of letters.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of documents (lang, source, text): occurrences and documents, added up in part."""
    small_batches(docs.sparkSession)
    schema = "lang string, source string, term string, n long, docs long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        docs: dict[tuple, Counter] = {}
        terms = held = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.encode().translate(FOLD).split()
                if not words:
                    continue
                key, once = (lang, source), set(words)
                if key not in n:
                    n[key], docs[key] = Counter(), Counter()
                before = len(n[key])
                n[key].update(words)
                docs[key].update(once)
                new = len(n[key]) - before
                terms, held = terms + new, held + new * max(map(len, once))
                if terms >= HELD_TERMS or held >= HELD_BYTES:
                    yield from handed_on(n, docs)
                    n, docs, terms, held = {}, {}, 0, 0
        yield from handed_on(n, docs)

    def handed_on(n: dict[tuple, Counter], docs: dict[tuple, Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in n.items():
            seen = docs[lang, source]
            terms = pa.array(list(found), pa.binary()).cast(pa.string())
            columns = [pa.repeat(pa.scalar(x, pa.string()), len(found)) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(list(found.values()), pa.int64()), pa.array([seen[t] for t in found], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    text = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return text.mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


class Vocabulary:
    """Stored tables: ``counts`` (lang, source, term, n, all_n, chunk, at) of kept terms, and ``groups`` (lang, source, total, terms, all_total, block, blocks)."""

    def __init__(self, docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, chunk: int = CHUNK, block: int = BLOCK) -> None:
        shelf = Shelf(docs.sparkSession)
        docs = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
        counts = shelf.put(count_terms(docs))
        kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= min_docs)
        kept = shelf.put(kept.drop("docs"))
        langs = shelf.put(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_total")))
        chunks = F.ceil(F.col("terms") / chunk)
        numbered = kept.join(sent(langs, "lang"), "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), chunks))
        numbered = numbered.select("lang", "term", "all_n", "chunk", (F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).alias("at"))
        self.counts = shelf.put(counts.drop("docs").join(numbered, ["lang", "term"]))
        for x in (counts, kept):
            shelf.drop(x)
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
        sources = groups.groupBy("lang").agg(F.ceil(F.count("*") / block).alias("blocks"))
        groups = groups.join(totals, ["lang", "source"], "left").join(sources, "lang").join(langs, "lang", "left")
        zero = F.lit(0)
        self.groups = shelf.put(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "all_total")], F.pmod(F.xxhash64("source"), "blocks").alias("block"), "blocks"))
        self.chunk = chunk


def sent(df: DataFrame, *names: str) -> DataFrame:
    """A stored table, marked for broadcast if its strings and numbers have at most BROADCAST_BYTES."""
    held = df.agg(F.sum(sum((F.octet_length(c) for c in names), F.lit(64)))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def _share(count: str, total: str) -> str:
    """SQL of a group's share of a term, in decimals."""
    return f"1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 1 as decimal(20,0))) div cast({total} + terms as decimal(20,0))"


def term_rows(found: Vocabulary, top: int = TOP) -> DataFrame:
    """The terms by which each group exceeds its lang, at most ``top`` (which Spark cuts to before the shuffle)."""
    shares = found.counts.join(sent(found.groups, "lang", "source"), ["lang", "source"]).withColumns({"p": F.expr(_share("n", "total")), "q": F.expr(_share("all_n", "all_total"))})
    worth = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    return _ranked(worth).where(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def pair_rows(found: Vocabulary) -> DataFrame:
    """The divergence of each group from each other group of its lang."""
    tiles = _tiles(found)
    sums = _submatrices(tiles).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("listed").alias("listed"), F.max("terms").alias("terms"), F.max("neither").alias("neither"))
    value = F.col("value") + (F.col("terms") - F.col("listed")) * F.col("neither")
    return _ranked(sums.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")))


def _tiles(found: Vocabulary) -> DataFrame:
    """(lang, i, j, span, chunk, block, source, total, terms, packed): every group as a row of chunk -1 in each task of its tiles, and its packed chunks."""
    packed = found.counts.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct(F.col("at").cast("int").alias("at"), "n")).alias("packed"))
    groups = sent(found.groups, "lang", "source")
    packed = packed.join(groups, ["lang", "source"]).withColumn("span", F.expr(f"chunk div {SPAN}"))
    spans = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("terms") / found.chunk) / SPAN))
    heads = found.groups.withColumn("span", F.explode(F.sequence(F.lit(0).cast("long"), spans - 1)))
    heads = heads.withColumns({"chunk": F.lit(-1).cast("long"), "packed": F.lit(None).cast(packed.schema["packed"].dataType)})
    names = ["lang", "source", "total", "terms", "block", "blocks", "span", "chunk", "packed"]
    rows = heads.select(names).union(packed.select(names)).withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rows.select("lang", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "span", "chunk", "block", "source", "total", "terms", "packed")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(1e9 * (count + 1) / total) by long division in three steps of 1000."""
    rest, out = count + 1, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        digit = rest // total
        out, rest = out * 1000 + digit, rest - digit * total
    return out + 1


class Tile:
    """The groups of two blocks of a lang, and the sums of their pairs so far."""

    def __init__(self, heads: list[tuple], one: bool) -> None:
        """``heads``: (block, source, total, terms) of each group; ``one``: a block with itself."""
        self.sources = [h[1] for h in heads]
        self.number = {s: k for k, s in enumerate(self.sources)}
        block = np.array([h[0] for h in heads])
        self.terms = heads[0][3]
        self.total = np.array([h[2] for h in heads]) + self.terms
        self.none = share(np.zeros(len(heads), np.int64), np.maximum(self.total, 1)) if self.terms else np.ones(len(heads), np.int64)
        #: Groups that each one is compared with: those of the other block, in a tile of one block all others.
        self.others = [np.flatnonzero(block != block[a]) if not one else np.delete(np.arange(len(heads)), a) for a in range(len(heads))]
        self.sums, self.listed = np.zeros((len(heads), len(heads)), np.int64), 0

    def add(self, packed: list[tuple[str, np.ndarray, np.ndarray]]) -> None:
        """One chunk: (source, at, n) of the groups that have terms of it."""
        at = np.unique(np.concatenate([a for _, a, _ in packed]))
        shares = np.repeat(self.none[:, None], len(at), axis=1)
        for source, own, n in packed:
            g = self.number[source]
            shares[g, np.searchsorted(at, own)] = share(n, self.total[g])
        for a, others in enumerate(self.others):
            apart = shares[others] - shares[a]
            self.sums[others, a] += (apart * apart // shares[a]).sum(1)
        self.listed += len(at)

    def rows(self) -> tuple[list, list, list, list]:
        """Sources, items, sums, and what a term that neither of the two has adds."""
        pairs = [(int(g), a) for a, others in enumerate(self.others) for g in others]
        apart = [int(self.none[g]) - int(self.none[a]) for g, a in pairs]
        return [self.sources[g] for g, _ in pairs], [self.sources[a] for _, a in pairs], [int(self.sums[g, a]) for g, a in pairs], [d * d // int(self.none[a]) for d, (_, a) in zip(apart, pairs, strict=True)]


def _submatrices(tiles: DataFrame) -> DataFrame:
    """(lang, source, item, value, listed, terms, neither): partial sums of each task's pairs."""
    small_batches(tiles.sparkSession)
    schema = "lang string, source string, item string, value long, listed long, terms long, neither long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, i, j, _), rows in groupby(unpacked(batches), key=lambda r: r[:4]):
            tile = None
            for chunk, own in groupby(rows, key=lambda r: r[4]):
                if chunk < 0:
                    tile = Tile([r[5:9] for r in own], i == j)
                else:
                    tile.add([(r[6], *r[9]) for r in own])
            source, item, value, neither = tile.rows()
            if source:
                same = [pa.repeat(pa.scalar(x, pa.int64()), len(source)) for x in (tile.listed, tile.terms)]
                columns = [pa.repeat(pa.scalar(lang, pa.string()), len(source)), pa.array(source), pa.array(item), pa.array(value, pa.int64()), *same, pa.array(neither, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "item", "value", "listed", "terms", "neither"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            packed = batch.column(9)
            for k, row in enumerate(zip(*(c.to_pylist() for c in batch.columns[:9]), strict=True)):
                both = packed[k].values
                yield (*row, None if both is None else (both.field("at").to_numpy(), both.field("n").to_numpy()))

    order = ["lang", "i", "j", "span"]
    return tiles.repartition(*order).sortWithinPartitions(*order, "chunk", "source").mapInArrow(run, schema)


def audit(docs: DataFrame, top: int = TOP, min_docs: int = MIN_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups: pairs with every other source, and the ``top`` terms."""
    found = Vocabulary(docs, lang_col, source_col, text_col, min_docs)
    return pair_rows(found).unionByName(term_rows(found, top))


SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
  w AS (SELECT r, lang, source, translate(unnest(words), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
  k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
  v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS terms, CAST(sum(n) AS HUGEINT) AS total FROM k GROUP BY lang),
  c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
  g AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
  p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE} * (coalesce(c.n, 0) + 1)) // (g.total + v.terms) AS p, 1 + ({SCALE} * (k.n + 1)) // (v.total + v.terms) AS q
    FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
  pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  worth AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source
      LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
    UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM worth QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= {TOP}"""
