"""Operator 2, quality rules with risk-controlled thresholds. DataFrame functions only.

Every text gets measures of its words (runs without ASCII white space), symbols, repeated lines and repeated 3-word
windows. A text of fewer than 50 words, or of which more than half the words lie in repeated windows, fails the base
rule. Beyond that, each rule compares a share with a cutoff from a fixed grid, chosen per stratum on labelled holdouts:

* for every (stratum, rule, cutoff), k of the stratum's n good holdouts lie beyond the cutoff. The cutoff is certified if
  the exact binomial probability of at most k of n, at the largest allowed rate, is at most DELTA divided by the number
  of such triples (Bonferroni). That is the same as an exact Clopper-Pearson upper bound below that rate.
* the allowed rate of a rule is RISK divided by the number of rules, so that all rules together reject at most RISK of a
  stratum's good texts, with probability 1 - DELTA over all strata.
* of the certified cutoffs the one with the best balance of rejected bad and good holdouts is used, the largest of equals,
  and none if no balance is positive. A stratum with too few holdouts certifies nothing and only has the base rule.

Defined results: null text has no words and fails the base rule; a null stratum is one of its own; labels that are null
or without a document count for nothing, a label repeated for a document counts once; repeated documents are judged each;
without labels only the base rule holds. Measures of a text of any length are exact but for collisions of 64-bit hashes
of windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Shelf

MIN_WORDS, MAX_REPEATED = 50, 50
RISK, DELTA, GOOD_WEIGHT = 0.02, 0.05, 20
SPACES = " \t\n\x0b\x0c\r"
#: rule -> (numerator, denominator, cutoffs): a text is rejected if numerator > cutoff * denominator.
RULES = {
    "symbols": ("n_symbols", "n_words", (0.05, 0.1, 0.2, 0.4, 0.7, 1.0)),
    "dup_lines": ("n_dup_lines", "n_lines", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "repeats": ("n_repeat_words", "n_words", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4)),
    "capitals": ("n_caps", "word_chars", (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)),
    "word_length": ("word_chars", "n_words", (8.0, 10.0, 12.0, 15.0, 20.0, 30.0)),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps"]


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows found twice or more: windows as (hash, place), sorted, so that equal ones are
    neighbours; then the places that the repeated windows cover."""
    n = F.size(words) - 2
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))
    return F.when(n >= 2, windows)


def _covered(windows: Column) -> Column:
    n = F.size(windows)
    at = lambda k: F.get(windows, k)
    twice = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.coalesce(at(k)["h"] == at(k - 1)["h"], F.lit(False)) | F.coalesce(at(k)["h"] == at(k + 1)["h"], F.lit(False)))
    places = F.flatten(F.transform(twice, lambda k: F.array(at(k)["i"], at(k)["i"] + 1, at(k)["i"] + 2)))
    return F.when(windows.isNull(), 0).otherwise(F.size(F.array_distinct(places)))


def measure(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the measures (long) as further columns, named with ``prefix``; a narrow pass."""
    p = prefix
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    trimmed = F.btrim(text, F.lit(SPACES))
    df = docs.withColumns({f"{p}w": F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")), f"{p}l": lines})
    df = df.withColumn(f"{p}r", _repeated(F.col(f"{p}w")))
    df = df.withColumns({
        f"{p}n_words": F.size(f"{p}w"),
        f"{p}word_chars": F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")),
        f"{p}n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")),
        f"{p}n_dup_lines": F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l")),
        f"{p}n_repeat_words": _covered(F.col(f"{p}r")),
        f"{p}n_lines": F.size(f"{p}l"),
        f"{p}n_caps": F.length(F.regexp_replace(text, "[^A-Z]+", "")),
    })
    return df.drop(f"{p}w", f"{p}l", f"{p}r").withColumns({p + m: F.col(p + m).cast("long") for m in MEASURES})


def base_failed(prefix: str = "") -> Column:
    n, repeated = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)


def _beyond(rule: str, cutoff: Column, prefix: str = "") -> Column:
    numerator, denominator, _ = RULES[rule]
    return F.col(prefix + numerator) > cutoff * F.col(prefix + denominator)


def at_most(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of a binomial X of n trials, summed term by term in logarithms; 1 where k is at least the mean."""
    first = n * F.log1p(F.lit(-rate))
    odds = F.log(F.lit(rate / (1 - rate)))
    state = lambda t, s: F.struct(t.alias("t"), s.alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + odds
        return state(t, acc["s"] + F.exp(t))

    tail = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), state(first, F.exp(first)), step, lambda acc: acc["s"])
    return F.when(k >= n * rate, 1.0).otherwise(tail)


def thresholds(measured: DataFrame, labels: DataFrame, stratum: str, id_col: str = "doc_id", prefix: str = "") -> DataFrame:
    """(stratum, rule -> cutoff as columns) of the strata with a certified cutoff; a null cutoff never rejects.

    The binomial sums and the choice run on one row per stratum and cutoff, whatever the size of the corpus."""
    p = prefix
    marks = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").alias("label_quality")).where("label_id is not null and label_quality is not null")
    marks = marks.groupBy("label_id").agg(F.min("label_quality").alias("label_quality"))
    held = measured.where(~base_failed(p)).select(F.col(id_col).alias("held_id"), F.col(stratum).alias("stratum"), *[p + m for m in MEASURES]).join(marks, F.col("held_id") == F.col("label_id"))
    good = F.col("label_quality") == 1
    grid = [(r, c) for r, (_, _, cutoffs) in RULES.items() for c in cutoffs]
    sums = [F.sum(F.when(_beyond(r, F.lit(c), p) & g, 1).otherwise(0)).alias(f"{kind}{i}") for i, (r, c) in enumerate(grid) for kind, g in (("k", good), ("b", ~good))]
    per = held.groupBy("stratum").agg(F.sum(F.when(good, 1).otherwise(0)).alias("n"), *sums).withColumn("strata", F.count("*").over(Window.partitionBy()))
    rows = per.select("stratum", "n", "strata", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"k{i}").alias("k"), F.col(f"b{i}").alias("b")) for i, (r, c) in enumerate(grid)])).alias("t")).select("stratum", "n", "strata", "t.*")
    certified = rows.where(F.col("n") > 0).where(at_most(F.col("k"), F.col("n"), RISK / len(RULES)) <= DELTA / (F.col("strata") * len(grid)))
    worth = certified.withColumn("worth", F.col("b") - GOOD_WEIGHT * F.col("k")).where("worth > 0")
    best = worth.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("worth", "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def judge(measured: DataFrame, labels: DataFrame, stratum: str = "lang", id_col: str = "doc_id", prefix: str = "") -> DataFrame:
    """``measured`` with base_failed and kept (named with ``prefix``). ``measured`` is read twice, so it should be stored."""
    p = prefix
    cuts = thresholds(measured, labels, stratum, id_col, p)
    cuts = cuts.select(F.col("stratum").alias(f"{p}cut_stratum"), *[F.col(f"cut_{r}").alias(f"{p}cut_{r}") for r in RULES])
    joined = measured.join(cuts, F.col(stratum).eqNullSafe(F.col(f"{p}cut_stratum")), "left")
    rejected = reduce(lambda a, b: a | b, [F.coalesce(_beyond(r, F.col(f"{p}cut_{r}"), p), F.lit(False)) for r in RULES])
    out = joined.withColumn(f"{p}base_failed", base_failed(p)).withColumn(f"{p}kept", ~base_failed(p) & ~rejected)
    return out.drop(f"{p}cut_stratum", *[f"{p}cut_{r}" for r in RULES])


def verdicts(docs: DataFrame, labels: DataFrame, stratum: str = "lang", shelf: Shelf | None = None) -> DataFrame:
    """(doc_id, measures, base_failed, kept) of every document. Measures are taken once and stored as numbers."""
    shelf = shelf or Shelf(docs.sparkSession)
    measured = shelf.put(measure(docs.select("doc_id", "text", F.col(stratum).alias("stratum"))).drop("text"))
    return judge(measured, labels, "stratum").drop("stratum")


def keep(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that pass, with all their columns. Documents are stored with their measures, so texts are measured once."""
    prefix = "_".join(["q", *docs.columns, ""])
    shelf = Shelf(docs.sparkSession)
    measured = shelf.put(measure(docs, prefix=prefix))
    return judge(measured, labels, stratum, prefix=prefix).where(F.col(f"{prefix}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
WITH docs AS (SELECT doc_id, lang AS stratum, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
flat AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM flat) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
m AS (SELECT d.doc_id, d.stratum, len(w)::BIGINT AS n_words, length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(d.text, '[^#*$%%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines, length(regexp_replace(d.text, '[^A-Z]+', '', 'g'))::BIGINT AS n_caps
  FROM docs d JOIN words USING (doc_id) JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
grid AS (%(grid)s),
marks AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT f.*, quality FROM f JOIN marks USING (doc_id) WHERE NOT base_failed),
strata AS (SELECT count(DISTINCT coalesce(stratum, '?')) AS strata FROM held),
cells AS (SELECT stratum, rule, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND beyond) AS k, count(*) FILTER (quality <> 1 AND beyond) AS b
  FROM (SELECT held.stratum, quality, rule, cutoff, CASE rule %(case)s END AS beyond FROM held, grid) GROUP BY ALL),
tested AS (SELECT *, CASE WHEN k >= n * %(rate)r THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(%(rate)r) + (n - i) * ln(1 - %(rate)r)))) END AS p FROM cells WHERE n > 0),
worth AS (SELECT stratum, rule, cutoff, b - %(weight)d * k AS worth FROM tested, strata WHERE p <= %(delta)r / (strata * %(cells)d) AND b - %(weight)d * k > 0),
cuts AS (SELECT stratum, rule, cutoff FROM worth QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY worth DESC, cutoff DESC) = 1),
bad AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, CASE rule %(case)s END AS beyond FROM f JOIN cuts ON f.stratum IS NOT DISTINCT FROM cuts.stratum) WHERE beyond)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept
FROM f LEFT JOIN bad ON f.doc_id = bad.doc_id
""" % {
    "grid": " UNION ALL ".join(f"SELECT '{r}' AS rule, {c}::DOUBLE AS cutoff" for r, (_, _, cutoffs) in RULES.items() for c in cutoffs),
    "case": " ".join(f"WHEN '{r}' THEN {a} > cutoff * {b}" for r, (a, b, _) in RULES.items()),
    "rate": RISK / len(RULES), "weight": GOOD_WEIGHT, "delta": DELTA, "cells": sum(len(c) for _, _, c in RULES.values()),
}
