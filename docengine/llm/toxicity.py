"""Operator 8, toxicity by class-conditional Kneser-Ney models of the characters of words.

Two models of order ORDER, one of toxic and one of ordinary text, give the characters of each lower-cased word (a mark on
each side) a probability. Their highest order counts per class; both fall back to the same lower orders, which are
Kneser-Ney continuation counts pooled over the classes, so an expression that neither class has seen often is judged by
what both share. For a character c after a history h:

    P_class(c | h) = (max(n_class(hc) - D_class, 0) + D_class * types_class(h) * P_shared(c | h')) / n_class(h)

and P_class = P_shared(c | h') if the class never saw h. D_class is n1 / (n1 + 2 n2) of its counts. Only the difference of
the two log-likelihoods decides, and in it P_shared cancels wherever neither class saw hc: then it is that of the classes'
backoff weights. So the model is a table of one number for each n-gram seen and one for each history, a Spark table by their exact
keys, whatever its size, in units of 1 / UNIT, so that no order of summing matters. A model of at most MODEL_KEYS keys, which is
checked, is sent to the workers, who score texts in one narrow pass. For a larger one the distinct words of the texts are broken up
and joined to the table; their most frequent ones, at most HOT_WORDS, are sent to workers, and the words of a text that aren't among
them are joined by Spark. Both ways give the same values.

A word's difference is the sum over its characters. A text's features are the mean over its words, the largest mean of a
window of WINDOW consecutive words, and the mean of its TOP_WORDS highest words, all normalised by length; a logistic curve turns them into the score. It is fitted on
one fold of the labelled rows, whose texts no count has seen, at most FIT_ROWS of them (those of the lowest hash); counts
come from every row of the other folds.

Defined results: null texts and texts without a letter get the score of a text of difference 0; labels that are null, or
have no text, teach nothing; of a document labelled twice the larger label counts; without labels of both classes every
score is 0.
"""

from __future__ import annotations

import gc
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bagminhash import mix
from .common import Shelf, broadcast_if_small, map_batches, small_batches

ORDER, WINDOW, TOP_WORDS, FIT_ROWS = 8, 8, 4, 200_000
#: Words that workers hold, none of HOT_CHARS characters or more; steps of their counts, a factor of 2 each; units of a difference.
HOT_WORDS, HOT_CHARS, HOT_STEPS, UNIT = 200_000, 64, 8, 1e9
#: Lengths of the shared levels below ORDER, and their discount.
BACKOFF, DISCOUNT = (5, 3, 1), 0.75
FLUSH_WORDS = 200_000
#: Keys of a model that is sent to workers whole, 16 bytes each; words that a worker keeps.
MODEL_KEYS, CACHE_WORDS = 8_000_000, 400_000
FEATURES = ["mean", "stretch", "top"]
WORD = re.compile(r"[^\W\d_]+")
PAD = "_"


def grams_of(word: str) -> list[str]:
    """For each character of a word and its end: up to ORDER - 1 characters of history and itself."""
    padded = PAD + word + PAD
    return [padded[max(0, i - ORDER + 1) : i + 1] for i in range(1, len(padded))]


def gram_counts(docs: DataFrame, labels: DataFrame, chosen: Column) -> DataFrame:
    """(gram, n0, n1) over all words of the chosen labelled rows: occurrences in ordinary and in toxic texts.

    Workers count words in bounded parts and break each different word up once; Spark adds up."""
    small_batches(docs.sparkSession)
    rows = labelled(docs.where(chosen), labels)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            grams: dict[str, list[int]] = {}
            for k in (0, 1):
                for word, n in seen[k].items():
                    for g in grams_of(word):
                        grams.setdefault(g, [0, 0])[k] += n
                seen[k].clear()
            if grams:
                n = list(grams.values())
                yield pa.RecordBatch.from_arrays([pa.array(list(grams), pa.string()), pa.array([x[0] for x in n], pa.int64()), pa.array([x[1] for x in n], pa.int64())], names=["gram", "n0", "n1"])

        for batch in batches:
            for toxic, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen[toxic].update(WORD.findall((text or "").lower()))
            if len(seen[0]) + len(seen[1]) > FLUSH_WORDS:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(count, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def marks(labels: DataFrame) -> DataFrame:
    """(label_id, toxic) of every labelled document."""
    rows = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).where("label_id is not null and toxic in (0, 1)")
    return rows.groupBy("label_id").agg(F.max("toxic").alias("toxic"))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, text) of the documents with a label. Texts aren't shuffled unless the labels are too many to be sent to them."""
    known = broadcast_if_small(Shelf(docs.sparkSession).put(marks(labels)), 16)
    return docs.select("doc_id", "text").join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "toxic", "text")


def _shared(grams: DataFrame, shelf: Shelf) -> DataFrame:
    """``grams`` with p = P_shared of a gram's last character after shorter histories.

    A gram falls back to its last BACKOFF[0] characters, those to BACKOFF[1], and so on. Counts of these are continuation
    counts: by how many different longer grams each is reached. Every level is made of the one above it and interpolates with the next
    shorter one, the last with a uniform distribution over the characters. A gram meets one level only, that of its own suffix. Levels
    are stored, as the next ones are made of them."""
    chars = grams.agg(F.count_distinct(F.expr("right(gram, 1)")).alias("chars")).first()["chars"]
    longer, parts = grams.select(F.col("gram").alias("longer")), []
    for n in BACKOFF:
        counts = longer.where(F.length("longer") > n).groupBy(F.expr(f"right(longer, {n})").alias("part")).agg(F.count("*").alias("n"))
        counts = shelf.put(counts.withColumn("history", F.expr("left(part, length(part) - 1)")))
        parts.append(counts)
        longer = longer.where(F.length("longer") <= n).unionByName(counts.select(F.col("part").alias("longer")))
    below, upper, out = None, None, None
    for n, counts in reversed(list(zip(BACKOFF, parts, strict=True))):
        sums = counts.groupBy("history").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        level = counts.join(sums, "history")
        # The level of single characters has one row for each character in use.
        level = level.withColumn("q", F.lit(1.0 / max(chars or 1, 1))) if below is None else level.join(below, F.expr(f"right(part, {upper})") == F.col("below"))
        level = shelf.put(level.select(F.col("part").alias("below"), ((F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * F.col("q")) / F.col("total")).alias("q")))
        mine = grams.where((F.length("gram") > n) & (F.length("gram") <= (BACKOFF[BACKOFF.index(n) - 1] if n != BACKOFF[0] else ORDER)))
        below, upper = F.broadcast(level) if n == 1 else level, n
        mine = mine.join(below, F.expr(f"right(gram, {n})") == F.col("below")).drop("below").withColumnRenamed("q", "p")
        out = mine if out is None else out.unionByName(mine)
    return out


def model(counts: DataFrame, shelf: Shelf) -> DataFrame:
    """(key, v) of every n-gram ("g" before it) and history ("h"), v in units of 1 / UNIT.

    A history's v is the classes' difference after it if neither saw what comes; an n-gram's is what seeing it adds to that. So a
    word's difference is the sum over all its keys that are here, as every n-gram's history is here too."""
    counts = shelf.put(counts)
    discounts = counts.agg(*[F.sum(F.when(F.col(f"n{k}") == i, 1).otherwise(0)).alias(f"d{k}{i}") for k in (0, 1) for i in (1, 2)]).first()
    d = [(discounts[f"d{k}1"] or 0) / ((discounts[f"d{k}1"] or 0) + 2 * (discounts[f"d{k}2"] or 0) or 1) for k in (0, 1)]
    d = [min(max(x, 0.1), 0.95) for x in d]
    history = F.substring(F.col("gram"), F.lit(1), F.length("gram") - 1)
    rows = shelf.put(_shared(counts, shelf).withColumn("history", history))
    sums = rows.groupBy("history").agg(*[x for k in (0, 1) for x in (F.sum(f"n{k}").alias(f"h{k}"), F.sum(F.when(F.col(f"n{k}") > 0, 1).otherwise(0)).alias(f"types{k}"))])

    def of(k: int) -> Column:
        seen = (F.greatest(F.col(f"n{k}") - d[k], F.lit(0.0)) + d[k] * F.col(f"types{k}") * F.col("p")) / F.col(f"h{k}")
        return F.when(F.col(f"h{k}") > 0, seen).otherwise(F.col("p"))

    def units(x: Column) -> Column:
        return F.round(x * UNIT).cast("long")

    back = [F.when(F.col(f"h{k}") > 0, d[k] * F.col(f"types{k}") / F.col(f"h{k}")).otherwise(1.0) for k in (0, 1)]
    after = units(F.log(back[1] / back[0]))
    grams = rows.join(sums, "history").select(F.concat(F.lit("g"), "gram").alias("key"), (units(F.log(of(1) / of(0))) - after).alias("v"))
    out = shelf.put(grams.unionByName(sums.select(F.concat(F.lit("h"), "history").alias("key"), after.alias("v"))))
    shelf.drop(counts)
    return out


def word_scores(docs: DataFrame, table: DataFrame, shelf: Shelf) -> DataFrame:
    """(word, n, v) of every distinct word of the texts: how often it occurs, and its difference."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(WORD.findall((text or "").lower()))
                if len(seen) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        found: list[str] = []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], names=["id", "key"])
            ids.clear()
            found.clear()
            return out

        for batch in batches:
            for i, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for g in grams_of(word):
                    found += ["g" + g] if g[:-1] == PAD else ["g" + g, "h" + g[:-1]]
                ids += [i] * (len(found) - len(ids))
                if len(ids) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    small_batches(docs.sparkSession)
    words = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = shelf.put(words.withColumn("id", F.monotonically_increasing_id()))
    # Every word begins with the same history, which is no key of a join.
    start = table.where(F.col("key") == "h" + PAD).first()
    sums = words.select("id", "word").mapInArrow(keys, "id long, key string").join(table, "key").groupBy("id").agg(F.sum("v").alias("v"))
    value = (F.coalesce("v", F.lit(0)) + F.lit(start["v"] if start else 0)) / UNIT
    return shelf.put(words.join(sums, "id", "left").select("word", "n", value.alias("v")))


def hot_words(scores: DataFrame) -> tuple[dict[str, float], bool]:
    """The most frequent words' differences, at most HOT_WORDS, and whether these are all words."""
    short = F.length("word") < HOT_CHARS
    steps = scores.groupBy(F.when(short, F.floor(F.log2("n") * HOT_STEPS)).alias("step")).agg(F.count("*").alias("words")).collect()
    total, least = 0, None
    for step, words in sorted(((r["step"], r["words"]) for r in steps if r["step"] is not None), reverse=True):
        total += words
        if total > HOT_WORDS:
            break
        least = step
    if least is None:
        return {}, not steps
    hot = scores.where(short & (F.floor(F.log2("n") * HOT_STEPS) >= least)).select("word", "v").toArrow()
    return dict(zip(hot.column(0).to_pylist(), hot.column(1).to_pylist(), strict=True)), hot.num_rows == sum(r["words"] for r in steps)


def _hashed(codes: np.ndarray, start: np.ndarray, last: np.ndarray, size: int, salt: int) -> np.ndarray:
    """64-bit hashes of the at most ``size`` characters that end at each of ``last`` and don't begin before ``start``."""
    out = np.full(len(last), salt, np.uint64)
    for k in range(size):
        at = last - k
        out = np.where(at >= start, mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[np.maximum(at, 0)]), out)
    return out.view(np.int64)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The characters of texts in one array, and where each begins and ends."""
    ends = np.cumsum([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return codes, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


class Known:
    """A model of at most MODEL_KEYS keys as two sorted arrays, with the differences of the words that a worker has met."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys, self.values, self.words = keys, values, {}

    def units(self, hashed: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(hashed), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
        return np.where(self.keys[at] == hashed, self.values[at], 0)

    def meet(self, words: set[str]) -> None:
        """Take up the words that aren't known, all at once."""
        new = [w for w in words if w not in self.words]
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words, new = {}, list(words)
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            codes, starts, ends = _codes([PAD + w + PAD for w in some])
            start, place = np.repeat(starts, ends - starts), np.arange(len(codes))
            inner = place > start
            start, place = start[inner], place[inner]
            units = self.units(_hashed(codes, start, place, ORDER, 1)) + self.units(_hashed(codes, start, place - 1, ORDER - 1, 2))
            per = np.concatenate([[0], np.cumsum(units)])[np.cumsum(ends - starts - 1)]
            self.words.update(zip(some, (np.diff(per, prepend=0) / UNIT).tolist(), strict=True))

    def of(self, words: list[str]) -> np.ndarray:
        """The differences of words that have been met, in order."""
        return np.fromiter(map(self.words.__getitem__, words), np.float64, len(words))


def _keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
    keys = batch.column(0).to_pylist()
    codes, starts, ends = _codes(keys)
    kind = codes[starts] == ord("g") if len(keys) else np.empty(0, bool)
    gram, history = _hashed(codes, starts + 1, ends - 1, ORDER, 1), _hashed(codes, starts + 1, ends - 1, ORDER - 1, 2)
    return pa.RecordBatch.from_arrays([pa.array(np.where(kind, gram, history)), batch.column(1)], names=["k", "v"])


_known: dict[str, Known] = {}


def known_features(docs: DataFrame, table: DataFrame, shelf: Shelf) -> DataFrame:
    """As :func:`features`, for a model that fits in a worker: one narrow pass over the texts, nothing is shuffled. Keys go by 64-bit
    hashes, which are checked to differ from each other."""
    hashed = shelf.put(map_batches(table, ["key", "v"], "k long, v long", _keyed).orderBy("k"))
    keys, values = (hashed.select(c).toArrow().column(0).to_numpy() for c in ("k", "v"))
    if not (keys[1:] > keys[:-1]).all():
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        if (keys[1:] == keys[:-1]).any():
            return features(docs, word_scores(docs, table, shelf), shelf)
    name, shared = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast((keys, values))
    del keys, values
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if name not in _known:
            _known.clear()
            _known[name] = Known(*shared.value)
        words = [WORD.findall(t.lower()) if t else [] for t in batch.column(1).to_pylist()]
        _known[name].meet(set().union(*words))
        out = [features_of(_known[name].of(w).astype(np.float32).astype(np.float64)) for w in words]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in out], pa.float64()) for i in range(3))], names=["doc_id", *FEATURES])

    return shelf.put(map_batches(docs, ["doc_id", "text"], f"doc_id {kind}, " + ", ".join(f"{f} double" for f in FEATURES), run))


def features_of(x: np.ndarray) -> tuple[float, float, float]:
    """FEATURES of a text by the differences of its words, in order."""
    if not len(x):
        return 0.0, 0.0, 0.0
    size = min(WINDOW, len(x))
    total = np.concatenate([[0.0], np.cumsum(x)])
    top = np.partition(x, -TOP_WORDS)[-TOP_WORDS:] if len(x) > TOP_WORDS else x
    return float(x.mean()), float((total[size:] - total[:-size]).max() / size), float(top.mean())


_hot: dict[str, dict[str, float]] = {}


def features(docs: DataFrame, scores: DataFrame, shelf: Shelf) -> DataFrame:
    """(doc_id, FEATURES) of each row's text.

    One narrow pass looks up the words that workers hold. A text that has others leaves the values it has and the words it lacks;
    those are joined to ``scores`` (no frequent word is among them) and come back to their row."""
    hot, whole = hot_words(scores)
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = ", ".join(f"{f} double" for f in FEATURES)

    def look_up(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _hot:
            _hot.clear()
            _hot[key] = shared.value
        held, got, values, slots, rare = _hot[key], [], [], [], []
        for text in batch.column(2).to_pylist():
            words = WORD.findall(text.lower()) if text else []
            x = [held.get(w) for w in words]
            lacks: dict[str, int] = {}
            at = [lacks.setdefault(w, len(lacks)) for w, v in zip(words, x, strict=True) if v is None]
            x = np.array(x, np.float64)
            got.append((None, None, None) if at else features_of(x.astype(np.float32).astype(np.float64)))
            values.append(x.astype(np.float32) if at else None)
            slots.append(at or None)
            rare.append(list(lacks) or None)
        columns = [pa.array([g[i] for g in got], pa.float64()) for i in range(3)]
        more = [pa.array(values, pa.list_(pa.float32())), pa.array(slots, pa.list_(pa.int32())), pa.array(rare, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *more], names=["row", "doc_id", *FEATURES, "given", "slots", "rare"])

    def fill(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = []
        for values, slots, found in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
            x = np.array(values, np.float64)
            x[np.isnan(x)] = np.array(found, np.float32)[slots]
            got.append(features_of(x))
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[i] for g in got], pa.float64()) for i in range(3))], names=["doc_id", *FEATURES])

    rows = docs.withColumn("row", F.monotonically_increasing_id())
    first = map_batches(rows, ["row", "doc_id", "text"], f"row long, doc_id {kind}, {named}, given array<float>, slots array<int>, rare array<string>", look_up)
    if whole:
        return shelf.put(first.select("doc_id", *FEATURES))
    first = shelf.put(first)
    lacking = first.where("rare is not null").select("row", F.posexplode("rare").alias("k", "word")).join(scores.select("word", "v"), "word")
    found = lacking.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("found"))
    filled = first.where("rare is not null").select("row", "doc_id", "given", "slots").join(found, "row")
    filled = map_batches(filled, ["doc_id", "given", "slots", "found"], f"doc_id {kind}, {named}", fill)
    return shelf.put(first.where("rare is null").select("doc_id", *FEATURES).unionByName(filled))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve over the features and 1, by Newton steps with a little shrinkage."""
    scale = np.abs(x).max(axis=0) + 1e-9
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


def score(docs: DataFrame, labels: DataFrame, counting: Column, fitting: Column) -> DataFrame:
    """(doc_id, score, predicted) of every document. ``counting`` and ``fitting`` choose, by id, the labelled rows that
    counts and the curve come from; they must not overlap."""
    docs, shelf = docs.select("doc_id", "text"), Shelf(docs.sparkSession)
    table = model(gram_counts(docs.where("doc_id is not null"), labels, counting), shelf)
    # Shuffles that nothing refers to any more leave the disks when the driver's garbage is collected.
    gc.collect()
    docs.sparkSession._jvm.System.gc()
    if table.count() <= MODEL_KEYS:
        found = known_features(docs, table, shelf)
    else:
        found = features(docs, word_scores(docs, table, shelf), shelf)
    rows = found.where("doc_id is not null").where(fitting).join(marks(labels), F.col("doc_id") == F.col("label_id"))
    known = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS).select("toxic", *FEATURES).toPandas()
    y = known["toxic"].to_numpy(float)
    ok = 0 < y.sum() < len(y)
    w = fit(known[FEATURES].to_numpy(), y) if ok else np.zeros(len(FEATURES) + 1)
    line = sum((F.lit(float(a)) * F.col(f) for a, f in zip(w, FEATURES, strict=False)), F.lit(float(w[-1])))
    value = 1 / (1 + F.exp(-line)) if ok else F.lit(0.0)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), value.alias("score"), F.when(value >= 0.5, 1).otherwise(0).alias("predicted"))
