"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, and language quantiles.

Training. Trusted rows are labelled quality 1 and not toxic. All of the half that a seeded hash sets aside for training train
the model; `max_train` may bound them to those with the smallest hashes.
The `max_words` most frequent tokens keep their own numbers; all others become one of a few classes by shape
(case, final or inner punctuation), so that odd spellings and odd symbols differ; a token of a shape is as likely as one
of the different tokens of that shape in training. A token equal to the one before is a class of its own and charged like
one unseen token out of all: runs of a word would else be the most likely text of all. The order is 2: counts of word
pairs, of contexts and of continuations are grouped and joined in Spark, with three discounts for either order, estimated
from counts of counts; each pair seen gets its full interpolated log-probability, each context its back-off weight.

Scoring. The numbers, the back-off weights and the continuation probabilities of at most max_words + SHAPES words are
broadcast: their size is bounded by that parameter. The pairs are not: they are sharded by hash, and so are the pairs of
all documents, packed and counted by chunk of rows; each shard joins the two, and partial sums of log-probabilities (fixed
point, so that their order doesn't matter) go back to the documents. perplexity = exp(-sum / tokens).

Thresholds. For each language the `quantile` of the perplexities of trusted rows that the model has not seen; for languages with fewer than `least` such rows (and null) the quantile of all. Rows above are rejected.

Toxic text has usual words but for a few, so its perplexity is usual. Rows labelled toxic and rows labelled not toxic (all of
the half set aside for training, or at most `max_train` of either) give each word a log ratio; a row's toxicity is the largest sum
of positive ratios in WORST consecutive tokens. Rows above the `worst` quantile of it, by language, are rejected as well.

Texts without tokens (null, empty, blank) have perplexity null and are rejected; a label of an unknown row counts for
nothing; without any trusted row nothing is rejected but empty texts. Repeated rows are scored alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, buckets_for, by_bucket, cut, keyed, mix, pack_gaps, pieces, release, slices, small_or_shuffled, table, unpack_gaps

_U = np.uint64
#: Classes for tokens beyond the vocabulary: case (lower, capital, all capitals, none) x last character x inside.
SHAPES = 4 * 4 * 2
#: The number of a token that equals the one before it.
REPEAT = 1 + SHAPES
#: Tokens of the window in which toxic words are summed.
WORST = 32
#: Fixed point of summed log-probabilities.
POINT = 1 << 20
_END = re.compile(rb"[.,;:!?]+$")
_ODD = re.compile(rb"[\x00-\x2B\x2F-\x40\x5B-\x60\x7B-\x7F]")


def shape(w: bytes) -> int:
    """A class from 0 to SHAPES - 1."""
    t = w.decode("utf-8", "replace")
    core = t.rstrip(".,;:!?")
    case = 0 if core.islower() else 2 if len(core) > 1 and core.isupper() else 1 if core[:1].isupper() else 3
    end = 0 if t == core else 1 if t[-1:] in ".,;:" and len(t) - len(core) == 1 else 2 if len(t) - len(core) == 1 else 3
    return (case * 4 + end) * 2 + bool(_ODD.search(core.encode()))


class Cached(dict):
    """numbers, and for other tokens 1 + shape, kept as long as there is room."""

    def __init__(self, numbers: dict[bytes, int]):
        super().__init__(numbers)
        self.room = 300_000

    def __missing__(self, w: bytes) -> int:
        n = 1 + shape(w)
        if self.room:
            self[w] = n
            self.room -= 1
        return n


class Vocabulary:
    """Token -> number: 0 begins a text, 1 to SHAPES are shapes, REPEAT repeats, the rest are words."""

    def __init__(self, words: list[bytes]):
        self.numbers = {w: 1 + REPEAT + i for i, w in enumerate(words)}
        self.size = 1 + REPEAT + len(words)

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens of all texts, and the number of tokens of each."""
        number, out, counts = Cached(self.numbers).__getitem__, [], []
        for t in texts:
            n, last = 0, b""
            for p in pieces(t):
                ws = p.split()
                x = np.fromiter(map(number, ws), dtype=np.int64, count=len(ws))
                x[np.fromiter(map(eq, ws, chain((last,), ws)), dtype=bool, count=len(ws))] = REPEAT
                out.append(x)
                n += len(ws)
                last = ws[-1] if ws else last
            counts.append(n)
        return np.concatenate(out) if out else np.empty(0, np.int64), np.array(counts, dtype=np.int64)


def pairs(numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context << 32 | word) of each token, and the row it belongs to; the first token's context is 0."""
    before = np.concatenate(([0], numbers[:-1])) if len(numbers) else numbers
    first = np.cumsum(counts) - counts
    before[first[counts > 0]] = 0
    return (before << 32) | numbers, np.repeat(np.arange(len(counts)), counts)


class Model:
    """pairs: (pair long, logp double), sharded; words: arrays by number of log back-off weight and log-probability."""

    def __init__(self, vocabulary: Vocabulary, pair_table: DataFrame, back_off: np.ndarray, unigram: np.ndarray):
        self.vocabulary, self.pairs, self.back_off, self.unigram = vocabulary, pair_table, back_off, unigram


def trusted(docs: DataFrame, labels: DataFrame, seed: int) -> DataFrame:
    """(doc_id, h): labelled quality 1, not toxic; h orders and splits them, the even for training."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).where("q = 1 and t = 0 and doc_id is not null")
    return good.select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("h"))


def discounts(times: dict[int, int]) -> list[float]:
    """What is taken from counts of 1, 2, and 3 or more, by how many things were counted 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (times.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    return [min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05) if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def train(docs: DataFrame, sample: DataFrame, max_words: int) -> Model:
    """sample: doc_id of the training rows, a checkpoint."""
    spark = docs.sparkSession
    rows = keyed(docs.join(small_or_shuffled(sample, 16), "doc_id", "left_semi"))
    one = pa.schema([("w", pa.binary()), ("n", pa.int64())])
    two = pa.schema([("p", pa.int64()), ("n", pa.int64())])

    def count_words(batches):
        for batch in batches:
            for part in slices(batch):
                seen: Counter = Counter()
                for t in as_bytes(part.column("text")):
                    for p in pieces(t):
                        seen.update(p.split())
                yield table(seen.items(), one)

    words = cut(rows.mapInArrow(count_words, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")))
    top = [bytes(r["w"]) for r in cut(words.where("n > 1").orderBy(F.desc("n"), "w").limit(max_words)).orderBy(F.desc("n"), "w").collect()]
    vocabulary = Vocabulary(top)
    shared = spark.sparkContext.broadcast(vocabulary)

    def count_shapes(batches):
        for batch in batches:
            k = [1 + shape(w) for w in batch.column("w").to_pylist() if w not in shared.value.numbers]
            yield table(enumerate(np.bincount(np.array(k, dtype=np.int64), minlength=1 + REPEAT).tolist()), two)

    emission = np.zeros(vocabulary.size)
    for r in words.mapInArrow(count_shapes, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).collect():
        emission[r["p"]] = -math.log(1 + r["n"])
    emission[REPEAT] = -math.log(1 + words.count())

    def count_pairs(batches):
        for batch in batches:
            for part in slices(batch):
                p, n = np.unique(pairs(*shared.value.of(as_bytes(part.column("text"))))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(n)], schema=two)

    counted = cut(rows.mapInArrow(count_pairs, "p long, n long").groupBy("p").agg(F.sum("n").alias("n")).withColumn("c", F.shiftright("p", 32)).withColumn("w", F.expr("p & 4294967295")))
    d = discounts({r["n"]: r["m"] for r in counted.where("n <= 4").groupBy("n").agg(F.count("*").alias("m")).collect()})
    # continuations: in how many contexts a word was seen; contexts: totals and how many pairs were seen once, twice, more
    after = counted.groupBy("w").agg(F.count("*").alias("m")).collect()
    contexts = counted.groupBy("c").agg(F.sum("n").alias("total"), *[F.sum((F.least("n", F.lit(3)) == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3)])
    contexts = contexts.withColumn("gamma", (F.col("n1") * d[0] + F.col("n2") * d[1] + F.col("n3") * d[2]) / F.col("total"))
    total = sum(r["m"] for r in after)
    # interpolated with the uniform distribution, so that a class never seen has a chance
    seen, bow = np.zeros(vocabulary.size, np.int64), np.ones(vocabulary.size)
    for r in after:
        seen[r["w"]] = r["m"]
    off = np.array([0.0, *discounts(dict(enumerate(np.bincount(seen[seen <= 4], minlength=5).tolist())))])[np.minimum(seen, 3)]
    p1 = (seen - off) / total + off.sum() / total / vocabulary.size if total else np.full(vocabulary.size, 1 / vocabulary.size)
    for r in contexts.select("c", "gamma").collect():
        bow[r["c"]] = r["gamma"]
    discount = F.element_at(F.array(*map(F.lit, d)), F.least("n", F.lit(3)).cast("int"))
    lower = spark.createDataFrame([(i, float(x), float(e)) for i, (x, e) in enumerate(zip(p1, emission, strict=True))], "w long, p1 double, e double")  # one row a word
    known = counted.join(contexts.select("c", "total", "gamma"), "c").join(lower, "w").select(F.col("p").alias("pair"), (F.log((F.col("n") - discount) / F.col("total") + F.col("gamma") * F.col("p1")) + F.col("e")).alias("logp"))
    return Model(vocabulary, cut(known), np.log(bow), np.log(p1) + emission)


_BLOCK = "shard int, chunk long, kind byte, keys binary, rows binary"
_PA_BLOCK = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int8()), ("keys", pa.binary()), ("rows", pa.binary())])
#: Kinds of blocks: the pairs of a chunk, the rows of a chunk, sums for rows of a chunk.
PAIRS, ROWS, SUMS = range(3)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, _qs_th, n_words, perplexity), one row for each distinct (doc_id, text)."""
    spark = docs.sparkSession
    release(spark, again=2)  # what the model was made from would lie beside the packed pairs of all documents
    n = buckets_for(docs, 16 << 20, 2.0)
    vocabulary = spark.sparkContext.broadcast(model.vocabulary)
    arrays = spark.sparkContext.broadcast((model.back_off, model.unigram))
    shard_of = lambda p: (mix(p.astype(_U)) % _U(n)).astype(np.int64)

    def emit(batches):
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").cast(pa.int64())
                null, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0), dtype=np.int64)
                texts = np.asarray(part.column("_qs_th"), dtype=np.int64)
                numbers, counts = vocabulary.value.of(as_bytes(part.column("text")))
                chunk = xxhash.xxh64_intdigest(b"".join((ids.tobytes(), null.tobytes(), texts.tobytes()))) >> 1
                out = [(chunk % n, chunk, ROWS, np.stack((ids, null.astype(np.int64), texts, counts)).tobytes(), b"")]
                p, row = pairs(numbers, counts)
                order = np.lexsort((row, p))
                p, row = p[order], row[order].astype("<u2" if len(counts) < 1 << 16 else "<u4")
                head = np.flatnonzero(np.concatenate((np.ones(min(1, len(p)), bool), p[1:] != p[:-1])))
                times = np.diff(np.concatenate((head, [len(p)])))
                own = p[head]
                for k, pick in by_bucket(shard_of(own), n):
                    t = times[pick]
                    where = np.repeat(head[pick], t) + np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
                    r = row[where]
                    # ascending pairs as gaps of 32 bits, where context and word fit, and their numbers of rows
                    keys = own[pick]
                    packed = pack_gaps((keys >> 32) << 16 | (keys & 0xFFFF)) if vocabulary.value.size <= 1 << 16 else keys.tobytes()
                    out.append((k, chunk, PAIRS, packed + np.minimum(t, 255).astype(np.uint8).tobytes() + t[t >= 255].astype("<u4").tobytes(), (b"\x02" if r.itemsize == 2 else b"\x04") + int(len(keys)).to_bytes(4, "little") + r.tobytes()))
                yield table(out, _PA_BLOCK)

    small = model.vocabulary.size <= 1 << 16

    def join(key, model_rows: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        mp = np.asarray(model_rows.column("pair"), dtype=np.int64)
        ml = np.asarray(model_rows.column("logp"), dtype=np.float64)
        order = np.argsort(mp)
        mp, ml = mp[order], ml[order]
        bow, p1 = arrays.value
        for shard, chunk, kind, keys, rows in zip(*(blocks.column(c).to_pylist() for c in ("shard", "chunk", "kind", "keys", "rows")), strict=True):
            if kind == ROWS:
                out.append((shard, chunk, ROWS, keys, b""))
                continue
            width, m = rows[0], int.from_bytes(rows[1:5], "little")
            r = np.frombuffer(rows, "<u2" if width == 2 else "<u4", offset=5).astype(np.int64)
            size = 4 if small else 8
            p = unpack_gaps(keys[: 4 * m]) if small else np.frombuffer(keys, "<i8", m)
            if small:
                p = (p >> 16) << 32 | (p & 0xFFFF)
            t = np.frombuffer(keys, np.uint8, m, offset=size * m).astype(np.int64)
            t[t == 255] = np.frombuffer(keys, "<u4", offset=(size + 1) * m)
            at = np.minimum(np.searchsorted(mp, p), max(0, len(mp) - 1))
            logp = bow[p >> 32] + p1[p & 0xFFFFFFFF]
            if len(mp):
                logp = np.where(mp[at] == p, ml[at], logp)
            value = np.repeat(np.rint(logp * POINT).astype(np.int64), t)
            which, inverse = np.unique(r, return_inverse=True)
            sums = np.zeros(len(which), np.int64)
            np.add.at(sums, inverse, value)
            out.append((shard, chunk, SUMS, which.astype("<u4").tobytes(), sums.astype("<i8").tobytes()))
        return pa.Table.from_batches([table(out, _PA_BLOCK)])

    final = pa.schema([("doc_id", pa.int64()), ("_qs_th", pa.int64()), ("n_words", pa.int64()), ("perplexity", pa.float64())])

    def gather(group: pa.Table) -> pa.Table:
        kinds, keys, rows = (group.column(c).to_pylist() for c in ("kind", "keys", "rows"))
        head = next((k for k, kind in zip(keys, kinds, strict=True) if kind == ROWS), b"")
        ids, null, texts, counts = np.frombuffer(head, "<i8").reshape(4, -1)
        total = np.zeros(len(ids), np.int64)
        for k, r, kind in zip(keys, rows, kinds, strict=True):
            if kind == SUMS:
                np.add.at(total, np.frombuffer(k, "<u4"), np.frombuffer(r, "<i8"))
        out = [(None if z else int(i), int(h), int(c), math.exp(min(700.0, -s / POINT / c)) if c else None) for i, z, h, c, s in zip(ids, null, texts, counts, total, strict=True)]
        return pa.Table.from_batches([table(out, final)])

    # every shard has a block of the model or of documents; a shard's part of either is a fixed size, as shards follow the input
    mine = model.pairs.mapInArrow(_shards(shard_of), "shard int, pair long, logp double")
    blocks = keyed(docs).mapInArrow(emit, _BLOCK)
    sums = mine.groupBy("shard").cogroup(blocks.groupBy("shard")).applyInArrow(join, _BLOCK)
    back = sums.groupBy("chunk").applyInArrow(gather, "doc_id long, _qs_th long, n_words long, perplexity double")
    return cut(back.dropDuplicates(["doc_id", "_qs_th"]))


def _shards(shard_of):
    def run(batches):
        for b in batches:
            p = np.asarray(b.column("pair"), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(p).astype(np.int32)), b.column("pair"), b.column("logp")], names=["shard", "pair", "logp"])

    return run


class Weights(dict):
    """The weights of words by their spellings in texts, kept as long as there is room."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights, self.room = weights, 300_000

    def __missing__(self, w: bytes) -> float:
        x = self.weights.get(plain(w), 0.0)
        if self.room:
            self[w] = x
            self.room -= 1
        return x


def plain(w: bytes) -> str:
    return w.decode("utf-8", "replace").lower().strip(".,;:!?\"'()")


def bounded(rows: DataFrame, most: int | None) -> DataFrame:
    """A checkpoint of rows (doc_id, h, ...): all, or at most so many of the smallest h."""
    return cut((rows if most is None else rows.orderBy("h", "doc_id").limit(most)).drop("h"))


def toxic_words(docs: DataFrame, labels: DataFrame, max_train: int | None, max_words: int, seed: int) -> dict[str, float]:
    """Log ratios of the shares of toxic and of other labelled rows that have a word, where positive; at most max_words."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("t")).withColumn("h", F.xxhash64("doc_id", F.lit(seed))).where("h % 2 = 0")
    sides = [bounded(marked.where(F.col("t") == t).select("doc_id", "h", F.lit(t).alias("t")), max_train) for t in (0, 1)]
    schema = pa.schema([("w", pa.string()), ("a", pa.int64()), ("b", pa.int64())])

    def count(batches):
        for batch in batches:
            for part in slices(batch):
                seen: dict[str, list[int]] = {}
                for t, x in zip(as_bytes(part.column("text")), part.column("t").to_pylist(), strict=True):
                    for w in {plain(w) for p in pieces(t) for w in set(p.split())} | {""}:  # "": the row itself
                        seen.setdefault(w, [0, 0])[x] += 1
                yield table([(w, n[1], n[0]) for w, n in seen.items()], schema)

    rows = docs.join(small_or_shuffled(sides[0].union(sides[1]), 16), "doc_id").select("text", "t")
    counts = cut(rows.mapInArrow(count, "w string, a long, b long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    every = counts.where("w = ''").first()
    if every is None or not every["a"]:
        return {}
    ratio = F.log((F.col("a") + 0.5) / (every["a"] + 1)) - F.log((F.col("b") + 0.5) / (every["b"] + 1))
    top = counts.where("w <> '' and a > 1").withColumn("x", ratio).where("x > 0").orderBy(F.desc("x"), "w").limit(max_words)
    return {r["w"]: r["x"] for r in top.collect()}


def toxicity(docs: DataFrame, words: dict[str, float]) -> DataFrame:
    """(doc_id, _qs_th, lang, toxicity): the largest sum of weights in WORST consecutive tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        weight = Weights(shared.value).__getitem__
        for batch in batches:
            for part in slices(batch):
                out = []
                for t in as_bytes(part.column("text")):
                    v = np.concatenate([np.fromiter(map(weight, ws), dtype=np.float64, count=len(ws)) for p in pieces(t) for ws in (p.split(),)])
                    c = np.concatenate((np.zeros(1), np.cumsum(v)))
                    out.append(float((c[WORST:] - c[:-WORST]).max()) if len(v) > WORST else float(c[-1]))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("_qs_th"), part.column("lang"), pa.array(out, pa.float64())], names=["doc_id", "_qs_th", "lang", "toxicity"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("_qs_th"), "lang").mapInArrow(run, "doc_id long, _qs_th long, lang string, toxicity double")


def classify(docs: DataFrame, labels: DataFrame, max_train: int | None = None, max_words: int = 20_000, quantile: float = 0.995, worst: float = 0.99, least: int = 30, seed: int = 11) -> DataFrame:
    """(doc_id, _qs_th, lang, n_words, perplexity, threshold, keep), one row for each distinct (doc_id, text)."""
    known = cut(trusted(docs, labels, seed))
    model = train(docs, bounded(known.where("h % 2 = 0"), max_train), max_words)
    scored = score(docs, model)
    del model
    marked = toxicity(docs, toxic_words(docs, labels, max_train, max_words, seed))
    lang = marked.groupBy("doc_id", "_qs_th").agg(F.min("lang").alias("lang"), F.round(F.max("toxicity"), 6).alias("toxicity"))
    scored = cut(scored.withColumnRenamed("doc_id", "_id").withColumnRenamed("_qs_th", "_th").join(lang, (F.col("_th") == F.col("_qs_th")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "_qs_th", "lang", "n_words", "perplexity", "toxicity"))
    held = scored.where("perplexity is not null").join(known.where("h % 2 <> 0").select("doc_id"), "doc_id", "left_semi")
    at = [F.percentile("perplexity", F.lit(quantile)).alias("own"), F.percentile("toxicity", F.lit(worst)).alias("most")]
    by_lang = held.where("lang is not null").groupBy("lang").agg(*at, F.count("*").alias("n")).where(F.col("n") >= least).select("lang", "own", "most")
    every, most = (math.inf if x is None else float(x) for x in held.agg(*at).first())
    out = scored.join(small_or_shuffled(cut(by_lang), 64), "lang", "left").withColumn("threshold", F.coalesce("own", F.lit(every)))
    fits = (F.col("perplexity") <= F.col("threshold")) & (F.col("toxicity") <= F.coalesce("most", F.lit(most)))
    return out.select("doc_id", "_qs_th", "lang", "n_words", "perplexity", "threshold", F.coalesce(fits, F.lit(False)).alias("keep"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, n_words, perplexity, threshold, keep."""
    found = classify(docs, labels)
    release(docs.sparkSession)
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"))
    return rows.join(found, (F.col("_th") == F.col("_qs_th")) & F.col("_id").eqNullSafe(F.col("doc_id"))).select("doc_id", "lang", "n_words", F.round("perplexity", 4).alias("perplexity"), F.round("threshold", 4).alias("threshold"), "keep")


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the rejected rows; the rejected ids are broadcast only if few."""
    bad = cut(classify(docs, labels, **options).where("not keep").select(F.col("doc_id").alias("_qs_id"), "_qs_th"))
    release(docs.sparkSession)
    return docs.join(small_or_shuffled(bad, 32), F.col("_qs_id").eqNullSafe(docs["doc_id"]) & (F.col("_qs_th") == F.xxhash64(docs["text"])), "left_anti")
