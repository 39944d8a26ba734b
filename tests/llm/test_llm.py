"""The ten operators and the pipeline against brute force, exact round trips, SQL and held-out labels; and edge cases."""

import functools
import hashlib
import re
import random
import tracemalloc
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
import sentencepiece
from oracle import same, tables
from pyspark.sql import functions as F

from docengine.llm import bagminhash, chat, components, decontam, langid, linededup, queries, quality, sharding, token_counts, toxicity, transducer
from docengine.llm import pieces as pieces_module
from docengine.llm.common import Shelf, table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = "<|im_end|><|im_start|>assistant ok"


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=queries.MODEL)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with names that operators use themselves."""
    long_text = " ".join(f"word{i % 977} tail" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n \t"), (None, "a text without an id"), (5, "same"), (5, "same"), (6, long_text), (7, "über ▁ 漢字 😀  two  spaces\r\n" + ODD), (8, "a " * 200)]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None, None, "x", 1) for i, t in rows], DOCS + ", node string, hits int")


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingled(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def brute_classes(texts):
    bags = {i: shingled(t) for i, t in texts.items()}
    by = defaultdict(set)
    for i, bag in bags.items():
        for s in bag:
            by[s].add(i)
    pairs = {p for ids in by.values() for p in combinations(sorted(ids), 2)}
    return groups(texts, [(a, b) for a, b in pairs if (bags[a] & bags[b]).total() >= 0.8 * (bags[a] | bags[b]).total()])


def test_token_counts(spark, sf_dir, texts, pieces):
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, sf_dir).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(pieces.encode(t or "")) for i, t in texts.items()}
    assert all(r.n_viterbi >= 0 and r.viterbi_score <= 0 for r in got.values())


def test_best_path_is_best(pieces):
    counter = token_counts.Counter if hasattr(token_counts, "Counter") else None
    c = counter(open(queries.MODEL, "rb").read())
    m = c.model
    for chunk in ("▁hello", "▁international", "▁aa", "▁Straße"):
        best = {0: (0.0, 0)}
        for end in range(1, len(chunk) + 1):
            found = [(best[s][0] + m.score[m.id[chunk[s:end]]], best[s][1] + 1) for s in range(end) if chunk[s:end] in m.id and s in best]
            if found:
                best[end] = max(found, key=lambda x: x[0])
        _, n, score, *_ = c.solve(chunk)
        assert abs(score - best[len(chunk)][0]) < 1e-4 and n <= len(chunk)


def test_encoding(spark, sf_dir, texts, pieces):
    encoded = queries.op7_sentencepiece(spark, sf_dir)
    got = {r.doc_id: r for r in encoded.collect()}
    assert all(got[i].ids == pieces.encode(t or "") and got[i].round_trip and got[i].n_ids == len(got[i].ids) for i, t in texts.items())
    assert {r.doc_id: r.text for r in transducer.decode(encoded, queries.MODEL).collect()} == {i: (t or "").replace("▁", " ") for i, t in texts.items()}


def test_spaces_and_odd_words_have_one_path(pieces):
    codec = transducer.Codec(open(queries.MODEL, "rb").read())
    for n in range(40):
        for word in ("", "hello", "def", "Straße", "日本", "\n", "é", "//", "\U0001f600", "▁"):
            for text in (" " * n + word, "a" + " " * n + word + " b"):
                assert codec.encode(text).tolist() == pieces.encode(text)
    assert codec.merged_chunks == 0


def test_spaces_are_counted_on_paths(pieces):
    c, pick = pieces_module.Counter(open(queries.MODEL, "rb").read()), random.Random(1)
    words = ["", "hello", "Straße", "日本", "\n", "//", "\U0001f600", "▁", "x" * 50, " " * 9]
    texts = [a + " " * n + w + " b" for n in (0, 1, 2, 3, 7, 31, 257, 3000) for w in words for a in ("", "a")]
    texts += ["".join(pick.choice([*words, " " * pick.randint(2, 70)]) for _ in range(pick.randint(1, 40))) for _ in range(400)]
    assert [c.count(t)[0] for t in texts] == [len(pieces.encode(t)) for t in texts] and c.merged_chunks == 0


def test_pairs_of_pieces_are_told_without_merging() -> None:
    codec, rng = transducer.Codec(open(queries.MODEL, "rb").read()), random.Random(5)
    m = codec.model
    whole = [i for i in m.id.values() if m.whole(i)]
    short = [i for i in whole if len(m.text[i]) <= 3]
    pairs = [tuple(rng.choices(short if k % 2 else whole, k=2)) for k in range(20_000)] + [(a, a) for a in short[:2000]]
    pairs += [(m.id[t[:c]], m.id[t[c:]]) for t in (m.text[i] for i in whole[::5]) for c in range(1, len(t)) if {t[:c], t[c:]} <= set(m.id) and m.whole(m.id[t[:c]]) and m.whole(m.id[t[c:]])]
    assert [m.apart(a, b) for a, b in pairs] == [m.merge(m.text[a] + m.text[b]) == [a, b] for a, b in pairs]
    words = [" " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(3000)]
    right, merged, merge = [m.merge(w.replace(" ", "\u2581")) for w in words], [], m.merge
    m.merge = lambda *a: merged.append(a) or merge(*a)  # counts what is merged for new words
    assert [codec.shortest(w, False) for w in words] == right
    assert len(merged) < len(words)


@pytest.mark.parametrize("kind, fallback, own", [(1, True, False), (1, False, False), (1, True, True), (1, False, True), (2, True, False), (2, False, False)])
def test_small_files(kind, fallback, own):
    """Unigram (1) and BPE (2) files with and without byte fallback, and a user-defined piece, against the tokenizer."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256) if fallback)]
    texts = ["▁a", "ab", "▁", "abc", "c", "b", "a", "bca", "▁ab", "cab"] if kind == 1 else ["ab", "▁a", "▁ab", "bc", "abc", "ca", "▁", "c", "b", "a"]
    rows += [(p, -float(k) - 1.25 / (k + 1) if kind == 1 else -float(k), 1) for k, p in enumerate(texts, 1)]
    rows += [("cc", 0.0, 4)] if own else []
    for piece, score, type_ in rows:
        proto.pieces.add(piece=piece, score=score, type=type_)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = kind, fallback
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces = True, False
    data = proto.SerializeToString()
    codec, counter, known = transducer.Codec(data), token_counts.Counter(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("aabbcc éx漢") for _ in range(rng.randint(0, 14)))
        want = known.encode(text)
        assert codec.encode(text).tolist() == want, text
        by_merge, best, *_ = counter.count(text)
        assert (best if kind == 1 else by_merge) == len(want), text
        assert not fallback or codec.decode(codec.encode(text).tolist()) == text


def test_quality_and_shards_match_sql(spark, sf_dir):
    con = tables(sf_dir)
    same(queries.op2_quality_rules(spark, sf_dir), con, quality.SQL)
    same(queries.op5_sharding(spark, sf_dir), con, sharding.sql(queries.SHARD_BYTES))


def test_shards_fit(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("text"))
    shards = sharding.assign(docs, 2000).collect()
    size = Counter()
    for r in shards:
        size[r.shard] += r.n_bytes
    assert max(size.values()) <= 2000 and len(shards) == 3000
    assert not any(a != b and b.startswith(a) for a in size for b in size)
    for s, n in size.items():
        assert sum(m for x, m in size.items() if x.startswith(s[:-1])) > 2000, "only oversized buckets split"
    large = spark.createDataFrame([(i, "x" * (5000 if i < 3 else 10)) for i in range(400)], "doc_id long, text string")
    got = {r.doc_id: r for r in sharding.assign(large, 1000).collect()}
    assert len(got) == 400 and all(got[i].oversize and got[i].depth == 144 and len(got[i].shard) == 144 for i in range(3)) and max(got[i].depth for i in range(3, 400)) < 48
    same_rows = spark.range(50).select(F.lit(1).alias("doc_id"), F.lit("y" * 100).alias("text"))
    assert max(Counter(r.shard for r in sharding.assign(same_rows, 1000).collect()).values()) <= 10


def test_written_shards_keep_all_rows(spark, tmp_path):
    rows = [(None, f"no id {i}", i) for i in range(30)] + [(7, "hot" * 10, i) for i in range(60)] + [(i, None if i == 100 else "x" * 40, i) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    shards = sharding.write(docs, str(tmp_path / "shards"), 500)
    got = spark.read.option("basePath", str(tmp_path / "shards")).schema("doc_id long, text string, extra int, shard string").parquet(str(tmp_path / "shards")).collect()
    assert Counter((r.doc_id, r.text, r.extra) for r in got) == Counter(rows) and shards.count() == len(rows)
    size = Counter()
    for r in got:
        size[r.shard] += len(r.text or "")
    assert max(size.values()) <= 500


def test_binomial_bound(spark):
    from math import comb

    df = spark.createDataFrame([(0, 100), (3, 200), (8, 400)], "k long, n long")
    for k, n, p in df.select("k", "n", quality.at_most(F.col("k"), F.col("n"), 0.05)).collect():
        assert p == pytest.approx(sum(comb(n, i) * 0.05**i * 0.95 ** (n - i) for i in range(k + 1)) if k < n * 0.05 else 1.0)


def test_near_duplicates(spark, sf_dir, texts):
    got = {r.doc_id: r.class_id for r in queries.op3_near_duplicates(spark, sf_dir).collect()}
    assert got == brute_classes(texts)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    a = (np.unique(rng.integers(0, 2**63, 40, np.uint64)), rng.integers(1, 9, 40))
    b = (a[0], np.maximum(1, a[1] - rng.integers(0, 4, 40)))
    got = []
    for k in range(40):
        x, y = ((bagminhash.mix(h ^ np.uint64(k)), w) for h, w in (a, b))
        s = bagminhash.signatures([x, y])
        got.append((s[0] == s[1]).mean())
    want = np.minimum(a[1], b[1]).sum() / np.maximum(a[1], b[1]).sum()
    assert abs(np.mean(got) - want) < 4 * np.sqrt(want * (1 - want) / (40 * bagminhash.SIZE))


def test_one_large_group(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join([*base[: k % 180], f"edit{k}", *base[k % 180 + 1 :]])) for k in range(700)]
    got = bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and len(got) == 700


def test_components(spark, tmp_path):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = components.components(Shelf(spark), spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert components.forest(np.ones((5, 5), bool)) == ([0] * 4, [1, 2, 3, 4])


def test_chat(spark, sf_dir):
    got = {r.conv_id: r for r in queries.op4_chat_format(spark, sf_dir).collect()}
    turns = defaultdict(list)
    for r in table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    turns[-1] = [("user", ODD), ("assistant", ODD)]
    assert set(got) == set(turns)
    for i, rows in turns.items():
        learnt = "".join(t for role, t in rows if role == "assistant")
        r = got[i]
        assert r.n_turns == len(rows) and r.loss_chars == len(learnt)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in rows).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()


def test_chat_escapes(spark):
    odd = [ODD, "<|", "<\\|", "<\\\\|x", "a\nb\\n", "", None, "\\", "<<||>>"]
    turns = spark.createDataFrame([(1, k, x, x) for k, x in enumerate(odd)] + [(None, 0, None, None)], "conv_id long, turn long, role string, text string")
    parts = chat.format_chats(turns).orderBy("conv_id", "part").collect()
    read = [t for p in parts if p.conv_id == 1 for t in chat.read_turns(p.formatted)]
    assert read == [(x or "", x or "") for x in odd]
    assert sum(p.formatted.count("<|im_end|>") for p in parts) == len(odd) + 1


def test_language(spark, sf_dir, texts):
    lang = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    got = queries.op6_language_id(spark, sf_dir).collect()
    held = [r for r in got if r.held_out and lang[r.doc_id] and len(texts[r.doc_id] or "") > 100]
    assert len(got) == len(texts) and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.93
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity(spark, sf_dir, texts):
    toxic = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    got = queries.op8_toxicity(spark, sf_dir).collect()
    held = [(r.score, toxic[r.doc_id]) for r in got if r.held_out and r.doc_id in toxic]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    if bad and good:
        assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) > 0.7


def brute_differences(rows):
    """Differences of words by the formula, with nothing hashed; rows are (toxic, text)."""
    n = (Counter(), Counter())
    for toxic, text in rows:
        for w in toxicity.WORD.findall(text.lower()):
            n[toxic].update(toxicity.grams_of(w))
    grams = set(n[0]) | set(n[1])
    chains = {g: [g, *(g[-m:] for m in toxicity.BACKOFF if len(g) > m)] for g in grams}
    reach = defaultdict(set)
    for c in chains.values():
        for longer, part in zip(c, c[1:], strict=False):
            reach[part].add(longer)
    chars, total, kinds = len({g[-1] for g in grams}), Counter(), Counter()
    for part, longer in reach.items():
        total[part[:-1], len(part)] += len(longer)
        kinds[part[:-1], len(part)] += 1

    def shared(g):
        p = 1 / chars
        for part in reversed(chains[g][1:]):
            at = part[:-1], len(part)
            p = (len(reach[part]) - toxicity.DISCOUNT + toxicity.DISCOUNT * kinds[at] * p) / total[at]
        return p

    d, after, types = [], (Counter(), Counter()), (Counter(), Counter())
    for k in (0, 1):
        once, twice = (sum(x == i for x in n[k].values()) for i in (1, 2))
        d.append(min(max(once / (once + 2 * twice or 1), 0.1), 0.95))
        for g, x in n[k].items():
            after[k][g[:-1]] += x
            types[k][g[:-1]] += 1

    def log_p(k, g):
        h, p = g[:-1], shared(g) if g in grams else 1.0
        return np.log((max(n[k][g] - d[k], 0) + d[k] * types[k][h] * p) / after[k][h] if after[k][h] else p)

    return functools.cache(lambda word: sum(log_p(1, g) - log_p(0, g) for g in toxicity.grams_of(word)))


@pytest.mark.parametrize("hot", [toxicity.HOT_WORDS if hasattr(toxicity, "HOT_WORDS") else None, 300, 0])
def test_toxicity_is_exact(spark, sf_dir, texts, hot, monkeypatch):
    monkeypatch.setattr(toxicity, "HOT_WORDS", hot)
    toxic = {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    docs, labels, shelf = table(spark, sf_dir, "documents").where("doc_id % 3 = 0"), table(spark, sf_dir, "labels"), Shelf(spark)
    word = brute_differences([(toxic[i], t) for i, t in texts.items() if i % 6 == 0 and t and toxic.get(i) is not None])
    model = toxicity.model(toxicity.gram_counts(docs, labels, F.col("doc_id") % 6 == 0), shelf)
    scores = toxicity.word_scores(docs, model, shelf)
    want = {w for i, t in texts.items() if i % 3 == 0 and t for w in toxicity.WORD.findall(t.lower())}
    got = {r.word: r.v for r in scores.collect()}
    assert set(got) == want and all(abs(got[w] - word(w)) < 1e-6 for w in want)
    found = {r.doc_id: r for r in toxicity.features(docs, scores, shelf).collect()}
    assert set(found) == {i for i in texts if i % 3 == 0}
    assert found == {r.doc_id: r for r in toxicity.known_features(docs, model, shelf).collect()}, "the two ways differ"
    for i, r in found.items():
        x = np.array([word(w) for w in toxicity.WORD.findall((texts[i] or "").lower())])
        assert (r["mean"], r.stretch, r.top) == pytest.approx(toxicity.features_of(x), abs=1e-4)


def brute_hits(text, windows):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, items = set(), set()
    for size in {len(w) for w in windows}:
        for i in range(len(words) - size + 1):
            if found := windows.get(tuple(words[i : i + size])):
                hit |= set(range(i, i + size))
                items |= found
    return len(words), hit, items


@pytest.mark.parametrize("max_bytes", [decontam.MAX_ITEM_BYTES, 4000])
def test_decontamination(spark, sf_dir, texts, max_bytes):
    windows = defaultdict(set)
    bench = table(spark, sf_dir, "benchmark")
    for r in bench.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[i : i + n])].add(r.item_id)
    for r in decontam.scan(table(spark, sf_dir, "documents"), bench, max_bytes).collect():
        n, hit, items = brute_hits(texts[r.doc_id], windows)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, len(hit), len(items), bool(hit) and 20 * len(hit) >= n)
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def test_windows_are_small_and_exact(monkeypatch):
    """A slice's set stays within its bound, and windows whose keys meet are told apart."""
    pick = random.Random(3)
    vocabulary = ["".join(pick.choices("abcdefghij", k=pick.randint(1, 9))) for _ in range(3000)]
    items = [(i, " ".join(pick.choices(vocabulary, k=200)).encode()) for i in range(500)] + [(900 + i, b"one two three") for i in range(300)]
    decontam.Windows(items[:1])  # what numpy loads when it is first used isn't counted
    tracemalloc.start()
    windows = decontam.Windows(items)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 32 * 500 * 200 + 150 * 3000 + 100_000
    n, hit, found = windows.scan(b"x one two three " + items[7][1][:400])
    assert n == 4 + len(decontam.words(items[7][1][:400])) and not hit[0] and hit[1:-1].all() and found.tolist() == [7, *range(900, 1200)]
    draw, drawn = np.random.default_rng, []

    class Ones:
        def integers(self, *args):
            return np.ones(args[2], np.uint64)

    monkeypatch.setattr(np.random, "default_rng", lambda seed: drawn.append(seed) or (Ones() if len(drawn) == 1 else draw(seed)))
    windows = decontam.Windows([(1, b"a b c"), (2, b"c a b")])
    assert len(drawn) == 2 and windows.scan(b"a b c")[2].tolist() == [1] and windows.scan(b"b c a b")[2].tolist() == [2] and not len(windows.scan(b"b a c")[2])


def brute_dropped(texts):
    lines = [(i, p, x.strip(linededup.SPACES)) for i, t in sorted(texts.items()) if t is not None for p, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= linededup.LEAST_CHARS]
    sets = {x: {x[i : i + 5] for i in range(max(len(x) - 4, 1))} for _, _, x in lines}
    by = defaultdict(list)
    for x in sets:
        by[len(x) // 8].append(x)
    links = []
    for k, some in by.items():
        near = [y for j in range(k, int(k * 1.35) + 2) for y in by.get(j, ())]
        links += [(x, y) for x in some for y in near if x != y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    root, first = groups(sets, links), {}
    out = defaultdict(list)
    for i, p, x in lines:
        if root[x] in first:
            out[i].append(p)
        else:
            first[root[x]] = (i, p)
    return out


def test_line_dedup(spark, sf_dir, texts):
    few = dict(sorted(texts.items())[:120])
    docs = table(spark, sf_dir, "documents").where(F.col("doc_id").isin(list(few)))
    got = {r.doc_id: list(r.dropped) for r in linededup.report(docs).collect()}
    want = brute_dropped(few)
    assert got == {i: want.get(i, []) for i in few}
    left = {r.doc_id: r.text for r in linededup.remove(docs).collect()}
    assert left == {i: t if i not in want else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in want[i]) for i, t in few.items()}


@pytest.mark.parametrize("length, edits", [(9, 1), (25, 1), (60, 1), (96, 2), (140, 3), (330, 7), (1000, 21)])
def test_similar_lines_meet(spark, length, edits):
    """Recall of the bands at the threshold, by length of lines."""
    rng = np.random.default_rng(length)
    pairs = []
    while len(pairs) < 300:
        a = rng.integers(97, 123, length)
        b = a.copy()
        for k in range(edits):
            b[(2 * k + 1) * length // (2 * edits)] = 48 + k % 10
        a, b = ("".join(map(chr, x)) for x in (a, b if length > 50 else [*a, *[46] * (length // 20 + 1)]))
        sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in (a, b)]
        assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.92
        pairs.append((a, b))
    lines = spark.createDataFrame([(f"{k} {i}", line) for k, pair in enumerate(pairs) for i, line in enumerate(pair)], "id string, line string").coalesce(4)
    met = Shelf(spark).put(linededup.signed(lines)).select(F.substring_index("id", " ", 1).alias("k"), F.explode("buckets").alias("bucket")).groupBy("k", "bucket").count().where("count > 1")
    assert met.select("k").distinct().count() >= 0.99 * len(pairs)


@pytest.mark.parametrize("letters", ["漢字中文語言學習資料庫引擎", "абвгдежзийклмнопрст", "0369", "0123456789", "xyz"])
def test_lines_of_mixed_scripts_meet(spark, letters):
    """Lines that differ in one inserted stretch of another script or of digits, 0.8 to 0.9 similar, 20 to 1000 characters."""
    rng, pairs = random.Random(letters), []
    for length in (20, 45, 100, 160, 200, 400, 1000):
        while len(pairs) % 100 or len(pairs) < 1 or pairs[-1][2] != length:
            a = "".join(rng.choices("etaoinshrdlu cmfwyp", k=length))
            at = rng.randrange(length)
            b = a[:at] + "".join(rng.choices(letters, k=max(1, length // 6 - 6))) + a[at:]
            sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in (a, b)]
            if 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.92 or length == 20:
                pairs.append((a, b, length))
    near = [p for p in pairs if len({p[0][i : i + 5] for i in range(len(p[0]) - 4)} & {p[1][i : i + 5] for i in range(len(p[1]) - 4)}) >= 0.8 * len({p[0][i : i + 5] for i in range(len(p[0]) - 4)} | {p[1][i : i + 5] for i in range(len(p[1]) - 4)})]
    lines = spark.createDataFrame([(f"{k} {i}", line) for k, pair in enumerate(near) for i, line in enumerate(pair[:2])], "id string, line string").coalesce(4)
    met = Shelf(spark).put(linededup.signed(lines)).select(F.substring_index("id", " ", 1).alias("k"), F.explode("buckets").alias("bucket")).groupBy("k", "bucket").count().where("count > 1")
    assert len(near) >= 500 and met.select("k").distinct().count() >= 0.99 * len(near)


def test_heads_of_chunks_are_composed_once(monkeypatch):
    """Chunks that begin alike share the states of their first characters, also when few are kept; ids are those of whole paths."""
    codec, rng = transducer.Codec(open(queries.MODEL, "rb").read()), random.Random(8)
    chunks = [" unde" + "".join(rng.choices("rstaéß漢😀0", k=rng.randrange(9))) for _ in range(300)] + ["".join(rng.choices(" abc漢", k=12)) for _ in range(300)]
    with monkeypatch.context() as whole:
        whole.setattr(transducer, "HEAD", 99)
        want = [codec.shortest(c, False) for c in chunks]
    for kept in (transducer.CACHE_HEADS, 3):
        monkeypatch.setattr(transducer, "CACHE_HEADS", kept)
        codec.begun.clear()
        assert [codec.shortest(c, False) for c in chunks] == want
    codec.begun.clear()
    read, reach = [], transducer.reach
    monkeypatch.setattr(transducer, "reach", lambda now, labels, *rest: read.extend(labels) or reach(now, labels, *rest))
    codec.shortest(" underst", False), codec.shortest(" underta", False)
    assert "".join(read) == " underst" + "rta"


def test_shingles_are_those_of_characters(spark):
    lines = ["", "a", "abcd", "abcde", "x😀yz漢字😀", "😀" * 7, "ab\ncdefg", "a" * 50]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = rows.select("i", F.array_distinct(linededup.shingles(F.col("line"))).alias("s")).orderBy("i").collect()
    assert [set(r.s) for r in got] == [{x[i : i + 5] for i in range(max(len(x) - 4, 1))} for x in lines]


def test_shingle_sets_of_any_script_without_a_pattern(spark, capsys):
    """Hashes of the different shingles, the same for a shingle in lines of any script; no regular expression cuts them."""
    lines = ["a", "abcd", "abcde", "abcde漢", "x😀yz漢字😀", "😀" * 7, "ab\ncdefg", "a" * 50, "é" + "a" * 50, "abcd漢"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").select("i", linededup.shingle_set(F.col("line")).alias("s"))
    shingles = [{x[i : i + 5] for i in range(max(len(x) - 4, 1))} for x in lines]
    got = [set(r.s) for r in rows.orderBy("i").collect()]
    assert all(len(got[a] & got[b]) == len(shingles[a] & shingles[b]) for a in range(len(lines)) for b in range(len(lines)))
    rows.explain()
    assert "regexp" not in capsys.readouterr().out


def test_links_between_many_leaders(spark):
    """A bucket of several groups, none of whose nodes resembles its first leader."""
    group = lambda n: n % 7
    members = Shelf(spark).put(spark.range(120).select(F.lit(1).alias("bucket"), F.col("id").alias("node")))
    got = components.linked(Shelf(spark), members, lambda pairs: pairs.where("a % 7 = b % 7 and abs(a - b) <= 14")).collect()
    assert {r.node: r.root for r in got} == {n: group(n) for n in range(120)}


def test_unlike_nodes_of_a_bucket_are_told_by_sketches(spark) -> None:
    """120 sets that share seven tenths with each other and 30 that have a partner at 0.8 to 0.95, all in one bucket: the links of
    brute force, and far fewer pairs to verify than the bucket has. Long sets, whose sketches are full, lose no link either."""
    rng = random.Random(11)
    new = lambda n: [rng.getrandbits(64) - 2**63 for _ in range(n)]
    common, long_ = new(150), new(9000)
    sets = {k: common + new(32) for k in range(120)}
    sets |= {120 + k: sets[k][: -(k % 4 * 5 + 1)] + new(k % 4 * 5 + 1) for k in range(30)}
    sets |= {150: long_, 151: long_[:8600] + new(300), 152: long_[:5000] + new(3000)}
    jaccard = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    links = [(a, b) for a, b in combinations(sets, 2) if jaccard(a, b) >= 0.8]
    rows = spark.createDataFrame(list(sets.items()), "node long, items array<long>").localCheckpoint()
    table_ = components.sketched(rows).localCheckpoint()
    both = table_.crossJoin(table_.select(*[F.col(c).alias(f"o_{c}") for c in table_.columns])).where("node < o_node").where(components.may_reach(0.8, "o_"))
    may = {(r.node, r.o_node) for r in both.collect()}
    assert set(links) <= may and len(may) < 2 * len(links)
    seen: list[int] = []

    def similar(pairs):
        found = [(r.a, r.b) for r in pairs.collect()]
        seen.append(len(found))
        return spark.createDataFrame([(a, b) for a, b in found if jaccard(a, b) >= 0.8], "a long, b long")

    members = spark.createDataFrame([(1, k) for k in sets], "bucket long, node long")
    got = components.linked(Shelf(spark), members, similar, lambda nodes: rows.join(nodes, "node"), 0.8).collect()
    root = {k: k for k in sets}
    for a, b in sorted(links) * len(sets):
        root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in got} == {k: root[k] for k in sets if any(k in x for x in links)}
    assert seen[0] == len(sets) - 1 and sum(seen[1:]) < 200


def test_certified_cutoffs_match_sql(spark, tmp_path):
    """Thousands of good holdouts in one stratum certify cutoffs, which reject bad texts; too few in another certify nothing."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    text = lambda i, extra: " ".join([*(words[(7 * i + 3 * k) % 600] for k in range(60)), *extra])
    rows = [(i, text(i, ["#"] * 25 if bad else ["A" * 40] if i % 997 == 0 else []), lang) for i, (bad, lang) in enumerate([(False, "en")] * 2600 + [(True, "en")] * 200 + [(False, None)] * 40 + [(True, None)] * 40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int("#" not in t), 0) for i, t, _ in rows] + [(5, None, 0), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    out = queries.op2_quality_rules(spark, str(tmp_path))
    same(out, con, quality.SQL)
    kept = {r.doc_id: (r.kept, r.base_failed) for r in out.collect()}
    assert not any(k or b for i, (k, b) in kept.items() if 2600 <= i < 2800), "bad texts of the large stratum go by a threshold"
    assert all(k for i, (k, _) in kept.items() if i < 2600 or i >= 2800), "good texts stay, and all of the small stratum"


def brute_language(text, profiles):
    """Out-of-place distance by its definition."""
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    if not words:
        return "und"
    grams = Counter()
    marked = "_" + "_".join(words) + "_"
    for n in (1, 2, 3):
        grams.update(g for i in range(len(marked) - n + 1) if "_" not in (g := marked[i : i + n])[1 : n - 1] and (n > 1 or g != "_"))
    own = [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], pack(x[0])))][: langid.PROFILE]
    far = {name: sum(abs(r - ranks[g]) if g in ranks else langid.PROFILE for r, g in enumerate(own)) for name, ranks in profiles.items()}
    return min(sorted(far), key=far.__getitem__)


def pack(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


@pytest.mark.parametrize("languages", [1000, 3])
def test_language_by_definition(spark, sf_dir, texts, languages):
    docs = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    found = langid.learn(docs, F.col("lang"))
    unpack = lambda g: "".join(chr(g >> s & 0x1FFFFF) for s in (42, 21, 0) if g >> s)
    profiles = {name: {unpack(g): r for r, g in enumerate(grams)} for name, grams in found}
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, found, languages=languages).collect()}
    assert got == {i: brute_language(t, profiles) for i, t in texts.items() if i % 2 == 0}


def test_ties_and_many_languages(spark):
    docs = spark.createDataFrame([(i, "abc abd", f"l{i:02}") for i in range(30)] + [(99, "xyz", "z")], "doc_id long, text string, lang string")
    found = langid.learn(docs, F.col("lang"))
    assert len(found) == 31
    for languages in (7, 1000):
        got = {r.doc_id: r.lang_pred for r in langid.predict(docs, found, languages=languages).collect()}
        assert got == {i: "l00" for i in range(30)} | {99: "z"}


def test_long_and_repeated_turns(spark):
    """A conversation over several batches, very long texts, repeated turns and columns with clashing names."""
    turns = [(1, k // 2, ("user", "assistant")[k % 2], f"turn {k} {ODD}") for k in range(700)] + [(2, 0, "assistant", "x" * 300_000), (2, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame([(*t, "p", 7) for t in turns], "conv_id long, turn long, role string, text string, part string, formatted int")
    parts = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    for i in (1, 2):
        rows = sorted((t for t in turns if t[0] == i), key=lambda t: t[1:])
        learnt = "".join(t[3] for t in rows if t[2] == "assistant")
        assert got[i].n_turns == len(rows) and got[i].loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest() and got[i].loss_chars == len(learnt)
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in rows).encode()).hexdigest()
        assert got[i].formatted_chars == sum(len(r.formatted) for r in parts.where(F.col("conv_id") == i).collect())
    assert parts.where("conv_id = 1").count() > 1


def test_toxicity_of_odd_rows(spark, odd):
    """Null, empty and very long texts through a fitted model."""
    rows = [(100 + i, "hello kind words here" if i % 2 else "awful nasty rubbish here") for i in range(60)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i, _ in rows] + [(None, 1, 1), (1, 1, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    third = F.coalesce(F.col("doc_id"), F.lit(0)) % 3
    got = toxicity.score(docs, labels, third != 0, third == 0).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == odd.count() + 60 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert min(by[100 + i] for i in range(0, 60, 2)) > max(by[101 + i] for i in range(0, 60, 2)) and by[1] == by[2] == by[3]


def test_repeated_items_in_slices(spark, odd):
    bench = spark.createDataFrame([(1, "same"), (1, "same"), (2, "without an id"), (3, "tail word1 tail"), (4, "word2 tail word3")], "item_id long, text string")
    whole = sorted((r.doc_id or 0, r.n_hit, r.n_items, r.items_sha256) for r in decontam.scan(odd, bench).collect())
    assert whole == sorted((r.doc_id or 0, r.n_hit, r.n_items, r.items_sha256) for r in decontam.scan(odd, bench, 10).collect())
    assert {r[0]: r[2] for r in whole}[6] == 2 and len(whole) == odd.count()


def test_odd_rows(spark, odd, pieces, tmp_path):
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "same"), (2, None), (None, "a text without an id"), (3, "")], "item_id long, text string")
    n = odd.count()
    counted = token_counts.count_tokens(odd, queries.MODEL).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counted) == sorted((r.doc_id or 0, len(pieces.encode(r.text or ""))) for r in odd.collect())
    assert all(r.round_trip for r in transducer.encode(odd, queries.MODEL).collect())
    assert quality.verdicts(odd, labels).count() == n
    assert quality.keep(odd, labels).columns == odd.columns
    assert sharding.assign(odd, 1000).count() == n
    classes = {(r.doc_id, r.class_id) for r in bagminhash.classes(odd).collect()}
    assert classes == {(i, i) for i in (1, 2, 3, None, 5, 6, 7, 8)}
    kept = bagminhash.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 5, 6, 7, 8]
    assert linededup.report(odd).count() == n and linededup.remove(odd).columns == odd.columns
    found = {r.doc_id: r for r in decontam.scan(odd, bench).collect()}
    assert found[5].contaminated and not found[1].contaminated and found[1].n_words == 0 and not found[None].contaminated
    assert decontam.remove(odd, bench).columns == odd.columns
    spoken = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, langid.learn(odd, F.col("lang"))).collect()}
    assert spoken[1] == spoken[2] == spoken[3] == ("und", 0.0) and spoken[5][0] == "en"
    fold = langid.fold("doc_id", 5)
    assert toxicity.score(odd, labels, fold != 0, fold == 99).count() == n


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    fold = langid.fold("doc_id", 5)
    for out in (
        token_counts.count_tokens(docs, queries.MODEL), quality.verdicts(docs, labels), bagminhash.classes(docs), bagminhash.deduplicate(docs), chat.digests(chat.format_chats(turns)),
        sharding.assign(docs), langid.predict(docs, langid.learn(docs, F.col("lang"))), transducer.encode(docs, queries.MODEL), toxicity.score(docs, labels, fold != 0, fold == 4),
        decontam.scan(docs, bench), linededup.report(docs), linededup.remove(docs),
    ):
        assert out.count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = table(spark, sf_dir, "documents")
    shelf, now, seen = Shelf(spark), docs, {}
    for name, stage in p.STAGES:
        before, now = now, shelf.put(stage(spark, now, sf_dir))
        seen[name] = (before, now)
    for name, (before, after) in list(seen.items())[:-1]:
        assert after.columns == docs.columns, name
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    judged = quality.verdicts(docs, table(spark, sf_dir, "labels"))
    assert ids(seen["quality_rules"][1]) == ids(judged.where("kept"))
    assert ids(seen["line_dedup"][1]) == ids(seen["line_dedup"][0])
    texts = {r.doc_id: r.text for r in seen["near_dedup"][0].collect()}
    assert ids(seen["near_dedup"][1]) == {i for i, c in brute_classes(texts).items() if i == c}
    marked = decontam.scan(seen["decontamination"][0], table(spark, sf_dir, "benchmark"))
    assert ids(seen["decontamination"][1]) == ids(marked.where("not contaminated"))
    assert all(r.round_trip for r in now.collect()) and ids(now) == ids(seen["decontamination"][1])


def test_pipeline_run_by_brute_force(spark, sf_dir, texts, pieces, tmp_path):
    """run() on a small table with nulls, empty and repeated rows and clashing columns, against all five stages by brute force."""
    import corpus_pipeline as p

    rows = [(i, t) for i, t in sorted(texts.items())[:50]]
    whole = next(t for _, t in rows if t and len(t.split()) > 120)
    rows += [(900, None), (901, ""), (902, whole + " more"), (None, whole), (903, whole), (903, whole)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", 1) for i, t in rows], DOCS + ", node string, hits int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, sf_dir, name).write.parquet(str(tmp_path / f"{name}.parquet"))

    def good(text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        times = Counter(zip(ws, ws[1:], ws[2:], strict=False))
        hit = {j for i in range(len(ws) - 2) if times[ws[i], ws[i + 1], ws[i + 2]] > 1 for j in (i, i + 1, i + 2)}
        return len(ws) >= 50 and 100 * len(hit) <= 50 * len(ws)

    left = sorted({(i is None, i or 0, t) for i, t in rows if good(t)})
    lost = brute_dropped({x: x[2] for x in left})
    left = [(*x[:2], "\n".join(y for k, y in enumerate(x[2].split("\n")) if k not in lost.get(x, ()))) for x in left]
    classes = brute_classes({x: x[2] for x in left})
    left = [x for x in left if classes[x] == x]
    windows = defaultdict(set)
    for r in table(spark, sf_dir, "benchmark").collect():
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        n = min(13, len(ws))
        for i in range(len(ws) - n + 1 if ws else 0):
            windows[tuple(ws[i : i + n])].add(r.item_id)
    hits = {x: brute_hits(x[2], windows) for x in left}
    left = [x for x in left if not (hits[x][1] and 20 * len(hits[x][1]) >= hits[x][0])]
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == sorted((x[1], pieces.encode(x[2])) for x in left)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline as p

    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
