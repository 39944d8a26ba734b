"""Best-fit packing against the tokenizer, a plain best fit and the lower bound."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from docengine.llm import packing, queries
from docengine.llm.common import table


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(queries.BYTE_BPE)


def check(rows, want, capacity=1024):
    """Every document's tokens are there once, in sequences without gaps; returns the number of sequences."""
    got, places = defaultdict(list), defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    for ps in places.values():
        ends = np.cumsum([n for _, n in sorted(ps)])
        assert [o for o, _ in sorted(ps)] == [0, *ends[:-1].tolist()] and ends[-1] <= capacity
    assert sorted(got, key=str) == sorted(want, key=str)
    for doc, copies in want.items():
        made = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got[doc])
        parts = []
        for ids in copies:
            n = len(ids)
            at = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n, capacity), n]
            parts += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(at, at[1:]))]
        assert made == sorted(parts), doc
    return len(places)


def test_packed_documents(spark, sf_dir, exact):
    docs = {r.doc_id: [[*exact.encode(r.text or "", add_special_tokens=False).ids, 2]] for r in table(spark, sf_dir, "documents").collect()}
    n = check(queries.op13_best_fit_packing(spark, sf_dir).collect(), docs)
    least = -(-sum(len(x[0]) for x in docs.values()) // 1024)
    whole = sum((len(x[0]) - 1) // 1024 for x in docs.values())
    parts = sorted((len(x[0]) - 1) % 1024 + 1 for x in docs.values())
    # No better packing puts two pieces longer than half a sequence together.
    assert least <= n <= max(least, whole + sum(p > 512 for p in parts)) * 1.02 + 1


def test_odd_documents(spark, exact):
    texts = [(1, None), (2, ""), (None, "no id"), (5, "same"), (5, "same"), (6, "word " * 5000), (7, "a<|endoftext|>b"), (8, " " * 3_000_000), (9, "漢字 😀\x00\r\n"), (10, "a" * 40_000)]
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in texts], "doc_id long, text string, packing string, length string")
    want = defaultdict(list)
    for i, t in texts:
        want[i].append([*exact.encode(t or "", add_special_tokens=False).ids, 2])
    packed = packing.pack(packing.pieces(docs, queries.BYTE_BPE))
    check(packed.collect(), want)
    whole = {tuple(r.ids) for r in packing.sequences(packed).collect()}
    assert sorted(len(x) for x in whole)[-1] <= 1024 and any(tuple(want[2][0]) == x[k : k + 1] for x in whole for k in range(len(x)))
    assert sum(len(x) for r in want.values() for x in r) == sum(len(r.ids) for r in packing.sequences(packed).collect())


def test_text_ids_and_nothing(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y z")], "name string, body string")
    rows = packing.pack(packing.pieces(docs, queries.BYTE_BPE, id_col="name", text_col="body")).collect()
    assert {(r.doc_id, r.length) for r in rows} == {("a", 2), ("b", 3)} and len({r.sequence_id for r in rows}) == 1
    assert packing.pack(packing.pieces(docs.limit(0), queries.BYTE_BPE, id_col="name", text_col="body")).count() == 0


def test_ids_are_the_tokenizers(exact):
    rng, encode = random.Random(1), packing.encoder(queries.BYTE_BPE)
    for _ in range(4000):
        kind = rng.choice(["ab", "aeinst 'sl", "01234 .,", "abcdefghijklmnopqrstuvwxyz      \n\t", "".join(map(chr, range(1, 1200))), "!?<|endoftext|>é漢😀  \u0085　"])
        text = "".join(rng.choice(kind) for _ in range(rng.randrange(1, 80)))
        assert encode(text) == exact.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_bins_by_definition(most):
    rng, bins, plain = random.Random(most), packing.Bins(64, most), {}
    for item in range(3000):
        size = rng.randrange(0, 65)
        fits = [b for b, left in plain.items() if left >= size]
        into, offset = bins.put(item, size)
        if fits:
            assert plain[into] == min(plain[b] for b in fits) and offset == 64 - plain[into]
            plain[into] -= size
        else:
            assert (into, offset) == (item, 0)
            if len(plain) == most and size < 64:
                fullest, gone = min(plain.values()), [b for b in plain if b not in bins.open()]
                assert len(gone) == 1 and plain.pop(gone[0]) == fullest
            plain[item] = 64 - size
        plain = {b: left for b, left in plain.items() if left}
        assert bins.open() == {b: 64 - left for b, left in plain.items()} and len(plain) <= most


def test_many_rounds(spark):
    rng = random.Random(3)
    sizes = [rng.randrange(1, 1025) for _ in range(6000)] + [1024] * 20 + [0, 1, 1]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "doc_id long, length long").repartition(5)
    for group, most, waste in ((64, 16, 1.12), (500, 250, 1.05), (100_000, 8192, 1.03)):
        got = packing.pack(rows, group=group, most=most).collect()
        places = defaultdict(list)
        for r in got:
            places[r.sequence_id].append((r.offset, r.length))
        assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(sizes))
        for ps in places.values():
            ends = np.cumsum([n for _, n in sorted(ps)]).tolist()
            assert [o for o, _ in sorted(ps)] == [0, *ends[:-1]] and ends[-1] <= 1024
        assert len(places) <= waste * sum(sizes) / 1024


def test_too_long_a_piece(spark):
    with pytest.raises(Exception, match="capacity"):
        packing.pack(spark.createDataFrame([(1, 1025)], "doc_id long, length long")).collect()
