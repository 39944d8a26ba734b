"""Source divergence audit against SQL and a plain version in Python integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import same, tables

from docengine.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, lang string, source string, term string, n int, block int"


def brute(docs, top=200):
    """Rows (lang, source, part, item, value, rank) of (text, lang, source)."""
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]
        groups[lang].add(source)
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]
        every = Counter({t: sum(counts[lang, s][t] for s in sources) for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(every)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sources if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs, key=lambda r: (r[0], r[1].encode()))), ("term", sorted(terms, key=lambda r: (r[0], r[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, item) in enumerate(rows)]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_matches_sql(spark, sf_dir):
    same(queries.op11_source_divergence(spark, sf_dir), tables(sf_dir), divergence.SQL)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    words = ["the", "The", "rate", "über", "漢字", "É", "é", "naïve", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]]
    rows = [(" 7,".join(rng.choices(words, k=rng.randrange(1, 60))), rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", *[f"s{k}" for k in range(9)], None])) for _ in range(400)]
    rows += [(None, "en", "no text"), ("", "en", "empty"), ("12 34", "en", "no words"), ("rare once", "xx", "a"), (None, "xx", "b"), (None, None, None), ("alone alone", "one", "source"), ("tail " * 50_000, "de", "hot")]
    return rows + rows[:3]


@pytest.mark.parametrize("chunk, span, block, held", [(1024, 64, 32, 400_000), (7, 2, 2, 50), (1, 1, 1, 1)])
def test_by_definition(spark, docs, chunk, span, block, held, monkeypatch):
    """Whatever the sizes of chunks, tasks and blocks, and however often workers hand counts on."""
    monkeypatch.setattr(divergence, "SPAN", span)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    df = spark.createDataFrame([(k, *r, "x", 1, 2) for k, r in enumerate(docs)], DOCS).repartition(3)
    found = divergence.Vocabulary(df, chunk=chunk, block=block)
    assert rows_of(divergence.pair_rows(found).unionByName(divergence.term_rows(found))) == brute(docs)


def test_top_terms_are_cut(spark, docs):
    df = spark.createDataFrame([(k, *r, "x", 1, 2) for k, r in enumerate(docs)], DOCS)
    assert rows_of(divergence.audit(df, top=2)) == brute(docs, top=2)


def test_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []


def test_shares_of_large_counts():
    rng = random.Random(2)
    for _ in range(300):
        total = rng.randrange(1, 9 * 10**15)
        count = rng.randrange(0, total)
        assert divergence.share(np.array([count]), np.int64(total))[0] == 1 + 10**9 * (count + 1) // total
