"""LM scoring by masked pseudo-likelihood.

A window network predicts a token from WINDOW tokens on either side of it, never from itself. The score of a document is
the sum over all its tokens of log p(token | both sides).

Vocabulary: the most frequent tokens of all documents, counted in Spark, and classes by shape for all others: GROUPS *
GROUPS numbers in all, so the network's size is a constant (about 1.3 MB), and so is what is broadcast. Network: one
embedding table for each place of the window, summed and put through tanh; then a softmax over GROUPS groups of numbers
and one over the GROUPS numbers of the group. It starts at the token frequencies.

A token beyond the vocabulary is scored as its class and, within the class, by its share of the class's occurrences in all
documents: log p(class | both sides) + log p(token | class), with exact counts of every token, so that the sum over all
tokens there are is 1. The counts grow with the input and are sharded, never broadcast.

Texts become numbers once. They are dealt to buckets by a hash of (doc_id, text), as many as the count of all tokens asks
for, so that neither the layout of files nor the number of partitions has a say in the model.

Training, in numpy on the executors: in each round every bucket masks a seeded share of the tokens of its documents (all
documents take part, so what is gathered grows with the input), descends on them by AdaGrad from the shared weights, and
hands its weights in; these are averaged, weighted by masked tokens, in two steps (by block and salt, then by block), in the
order of buckets, so that no task gathers the weights of all.

Texts without tokens (null, empty, blank) score 0 over 0 tokens; repeated rows score alike; words of equal counts are taken by
their bytes; an empty table gives an empty result; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, CHUNK_BYTES, buckets_for, cut, mix, slices, table, trim
from .quality import _ODD, POINT, SHAPES, shape

WINDOW, WIDTH, GROUPS = 2, 16, 64
SIZE = GROUPS * GROUPS
MASKED, ROUNDS, BATCH, RATE = 0.15, 2, 4096, 0.1
#: Weights are averaged in so many blocks.
BLOCKS = 64
#: Tokens of one group that are scored at once, so that their logits stay in a core's cache, and tokens that are sorted by group.
STEP, SORTED = 2048, 1 << 20
PLACES = [k for k in range(-WINDOW, WINDOW + 1) if k]


class Tokens:
    """Token -> number: 0 lies outside a text, 1 to SHAPES are shapes, the rest words by frequency."""

    def __init__(self, words: list[bytes]):
        self.numbers = {w: 1 + SHAPES + i for i, w in enumerate(words[: SIZE - SHAPES - 1])}
        self.words = pa.array(self.numbers, pa.binary())

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words, and which of them lie beyond the vocabulary."""
        found = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.words), -1))
        beyond, numbers = found < 0, found + np.int32(1 + SHAPES)
        numbers[beyond] = 1 + shapes(words.filter(pa.array(beyond)))
        return numbers, beyond


class Network:
    """embed (places, SIZE, WIDTH), bias (WIDTH); group (WIDTH + 1, GROUPS); inner (GROUPS, WIDTH + 1, GROUPS)."""

    SHAPES = ((len(PLACES), SIZE, WIDTH), (WIDTH,), (WIDTH + 1, GROUPS), (GROUPS, WIDTH + 1, GROUPS))

    def __init__(self, weights: list[np.ndarray]):
        self.w = weights

    @classmethod
    def start(cls, counts: np.ndarray, seed: int) -> Network:
        """Random embeddings; the output biases are the log frequencies of counts, by number."""
        r = np.random.default_rng(seed)
        p = ((counts + 0.5) / (counts.sum() + 0.5 * SIZE)).reshape(GROUPS, GROUPS)
        embed = r.normal(0, 0.1, cls.SHAPES[0])
        group, inner = r.normal(0, 0.05, cls.SHAPES[2]), r.normal(0, 0.05, cls.SHAPES[3])
        group[-1] = np.log(p.sum(axis=1))
        inner[:, -1] = np.log(p / p.sum(axis=1, keepdims=True))
        return cls([x.astype(np.float32) for x in (embed, np.zeros(WIDTH), group, inner)])

    @classmethod
    def of_flat(cls, flat: np.ndarray) -> Network:
        out, at = [], 0
        for s in cls.SHAPES:
            n = math.prod(s)
            out.append(flat[at : at + n].reshape(s).astype(np.float32))
            at += n
        return cls(out)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w])

    def hidden(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        embed, bias = self.w[:2]
        x = np.tile(bias, (len(at), 1))
        for k, place in enumerate(PLACES):
            x += embed[k].take(numbers[at + place], axis=0)
        h = np.ones((len(at), WIDTH + 1), x.dtype)
        h[:, :-1] = np.tanh(x, out=x)
        return h

    def log_p(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log p of the numbers at `at`, each from both its sides. Those of one group are taken together: both their softmaxes are one product."""
        out = np.empty(len(at), dtype=np.float64)
        both = [np.concatenate((self.w[2], w), axis=1) for w in self.w[3]]
        large = [_large(w) for w in both]
        room = np.empty((STEP, 2 * GROUPS), self.w[2].dtype)
        one = np.ones(GROUPS, room.dtype)
        for a in range(0, len(at), SORTED):
            own = at[a : a + SORTED]
            group, inner = np.divmod(numbers[own], GROUPS)
            order = np.argsort(group.astype(np.uint8), kind="stable")
            bound = np.searchsorted(group[order], np.arange(GROUPS + 1)).tolist()
            for g in range(GROUPS):
                for b in range(bound[g], bound[g + 1], STEP):
                    i = order[b : min(b + STEP, bound[g + 1])]
                    x = np.matmul(self.hidden(numbers, own[i]), both[g], out=room[: len(i)])
                    if large[g]:
                        for half in (x[:, :GROUPS], x[:, GROUPS:]):
                            half -= half.max(axis=1, keepdims=True)
                    lp = x[:, g].astype(np.float64), x[np.arange(len(i)), GROUPS + inner[i]]
                    np.exp(x, out=x)
                    out[a + i] = lp[0] - np.log(x[:, :GROUPS] @ one) + (lp[1] - np.log(x[:, GROUPS:] @ one))
        return out

    def gradients(self, numbers: np.ndarray, at: np.ndarray) -> list:
        """Of the mean negative log p; for the embeddings, of each place, the rows it touches and theirs."""
        n = len(at)
        at = at[np.argsort((numbers[at] // GROUPS).astype(np.uint8), kind="stable")]
        group, inner = np.divmod(numbers[at], GROUPS)
        bound = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        runs = [(g, slice(a, b)) for g, (a, b) in enumerate(zip(bound, bound[1:])) if a < b]  # noqa: B905
        h = self.hidden(numbers, at)
        g_inner, back = np.zeros_like(self.w[3]), np.ascontiguousarray(self.w[3].transpose(0, 2, 1))
        d = _off(h @ self.w[2], group, _large(self.w[2]))
        g_group = h.T @ d / n
        d_h = d @ self.w[2].T
        for g, i in runs:
            np.dot(h[i], self.w[3][g], out=d[i])
        d = _off(d, inner, _large(self.w[3]))
        for g, i in runs:
            np.dot(h[i].T, d[i], out=g_inner[g])
            d_h[i] += np.dot(d[i], back[g])
        g_inner /= n
        d_h *= 1 - h * h
        d_h /= n
        d_x = np.ascontiguousarray(d_h[:, :-1])
        g_embed = []
        for place in PLACES:
            x = numbers[at + place].astype(np.uint16)  # a sort by two bytes is a radix sort
            by = np.argsort(x, kind="stable")
            x = x[by]
            head = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            g_embed.append((x[head], np.add.reduceat(d_x.take(by, axis=0), head, axis=0)))
        return [g_embed, np.ones(n, d_x.dtype) @ d_x, g_group, g_inner]

    def descend(self, numbers: np.ndarray, at: np.ndarray, squares: list[np.ndarray], rate: float = RATE) -> None:
        for a in range(0, len(at), BATCH):
            touched, *dense = self.gradients(numbers, at[a : a + BATCH])
            for w, s, (rows, g) in zip(self.w[0], squares[0], touched, strict=True):
                own = s.take(rows, axis=0) + g * g
                s[rows] = own
                w[rows] = w.take(rows, axis=0) - rate * g / (np.sqrt(own) + 1e-8)
            for w, s, g in zip(self.w[1:], squares[1:], dense, strict=True):
                s += g * g
                w -= rate * g / (np.sqrt(s) + 1e-8)


def _large(w: np.ndarray) -> bool:
    """Whether a logit could be too large for an exponential: hidden values are at most 1."""
    return np.abs(w).sum(axis=-2).max() > 60


def _off(x: np.ndarray, which: np.ndarray, large: bool) -> np.ndarray:
    """Softmax of logits x minus the one that is right, in the place of x."""
    if large:
        x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= (x @ np.ones(GROUPS, x.dtype))[:, None]
    x[np.arange(len(x)), which] -= 1
    return x


def split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each token of all texts its place among the distinct tokens, the number of tokens of each text, and the distinct tokens."""
    data, bound = _ends(pc.fill_null(column.cast(pa.binary()), b""))
    a, words, starts = 0, [], []
    while a < len(data) or not words:
        b = a + CHUNK_BYTES
        if b < len(data):  # a long text is cut at white space
            m = _SPACE.search(data, b)
            b = m.start() if m else len(data)
        piece = data[a:b]
        solid = (piece != 32) & (piece - np.uint8(9) > 4)
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        begin = bound[np.searchsorted(bound, a) : np.searchsorted(bound, a + len(piece))] - a
        first[begin] = solid[begin]
        body = piece[solid]
        offsets = np.append(np.flatnonzero(first[solid]), len(body)).astype(np.int32)
        words.append(pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(body)]))
        starts.append(np.flatnonzero(first) + a)
        a += len(piece)
    sizes = np.diff(np.searchsorted(np.concatenate(starts), bound))
    coded = pa.chunked_array(words).dictionary_encode().unify_dictionaries()
    if not len(coded):
        return np.empty(0, np.int32), sizes, pa.array([], pa.binary())
    return np.concatenate([np.asarray(c.indices) for c in coded.chunks]), sizes, coded.chunk(0).dictionary


class Shapes(dict):
    """Tokens and their shapes, kept as long as there is room."""

    def __missing__(self, w: bytes) -> int:
        s = shape(w)
        if len(self) < 300_000:
            self[w] = s
        return s


_KEPT = Shapes()


def _ends(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all words, and where each begins and the last one ends."""
    bound = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset) if len(words) else np.zeros(1, np.int32)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8)[bound[0] : bound[-1]], bound.astype(np.int64) - bound[0]


def _listed(words: pa.Array) -> list[bytes]:
    """to_pylist(), which makes a scalar of each word on the way."""
    data, bound = _ends(words)
    data, bound = data.tobytes(), bound.tolist()
    return [data[a:b] for a, b in zip(bound, bound[1:])]  # noqa: B905


#: What a byte is: 1 a small letter, 2 a capital, 4 beyond ASCII, 8 odd, 16 ends a sentence or part of it.
_KIND = np.array([(97 <= b <= 122) + 2 * (65 <= b <= 90) + 4 * (b > 127) + 8 * bool(_ODD.match(bytes([b]))) + 16 * (b in b".,;:!?") for b in range(256)], np.uint8)


def shapes(words: pa.Array) -> np.ndarray:
    """shape() of each word; what is beyond ASCII or ends in many signs is left to it."""
    if not len(words):
        return np.empty(0, np.int32)
    data, bound = _ends(words)
    kind, start, end = _KIND[data], bound[:-1], bound[1:].copy()
    left = np.arange(len(end))
    for _ in range(4):
        left = left[end[left] > start[left]]
        left = left[kind[end[left] - 1] & 16 > 0]
        end[left] -= 1
        kind[end[left]] = 0
    every, off = np.bitwise_or.reduceat(kind, start), bound[1:] - end
    capital = (kind[start] & 2) > 0
    case = np.select([every & 3 == 1, (every & 3 == 2) & (end - start > 1), capital], [0, 2, 1], 3)
    last = data[bound[1:] - 1]
    ends = np.select([off == 0, off > 1, (last != 33) & (last != 63)], [0, 3, 1], 2)
    out = ((case * 4 + ends) * 2 + (every & 8 > 0)).astype(np.int32)
    by_hand = np.flatnonzero((every & 4 > 0) | (off == 4))
    out[by_hand] = [_KEPT[w] for w in _listed(words.take(pa.array(by_hand)))]
    return out


#: Distinct tokens that a task holds before it hands them on.
HELD = 1 << 19


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n) of a task: each token once, as long as there are no more than HELD."""

    def summed(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("w", use_threads=False).aggregate([("n", "sum")]).rename_columns(["w", "n"])

    held: list[pa.Table] = []
    for batch in batches:
        for part in slices(batch):
            codes, _, words = split(part.column("text"))
            held.append(pa.table([words, pa.array(np.bincount(codes, minlength=len(words)))], names=["w", "n"]))
            if sum(map(len, held)) > HELD:
                held = [summed(held)]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches(1 << 17)
    if held:
        yield from summed(held).to_batches(1 << 17)


def counted(docs: DataFrame) -> DataFrame:
    """(w, n): how often each token occurs in all documents."""
    return cut(docs.select("text").mapInArrow(tally, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")))


def most_frequent(words: DataFrame, k: int) -> list:
    """The k rows (w, n) of largest n, ties by w. Counts of counts say which rows can be among them; no task sorts the rest."""
    level = F.floor(F.log2("n") * 16).cast("int")
    least, many = 0, 0
    for r in sorted(words.groupBy(level.alias("b")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r["b"]):  # some hundred rows
        least, many = r["b"], many + r["m"]
        if many >= k:
            break
    return cut(words.where(level >= least)).orderBy(F.desc("n"), "w").limit(k).collect()


def vocabulary(docs: DataFrame, words: DataFrame | None = None) -> tuple[Tokens, np.ndarray]:
    """The tokens of all documents, and counts by number."""
    words = counted(docs) if words is None else words
    by_number = pa.schema([("k", pa.int64()), ("n", pa.int64())])
    top = [(bytes(r["w"]), r["n"]) for r in most_frequent(words, SIZE - SHAPES - 1)]
    tokens = Tokens([w for w, _ in top])
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def by_shape(batches):
        for batch in batches:
            numbers, beyond = shared.value.of(batch.column("w"))
            sums = np.zeros(1 + SHAPES, np.int64)
            np.add.at(sums, numbers[beyond], np.asarray(batch.column("n"))[beyond])
            yield table(enumerate(sums.tolist()), by_number)

    counts = np.zeros(SIZE, np.int64)
    counts[1 + SHAPES : 1 + SHAPES + len(top)] = [n for _, n in top]
    for r in words.mapInArrow(by_shape, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    return tokens, counts


#: Tokens of a bucket, about.
BUCKET = 4 << 20
_NUMBERS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("row", pa.int32()), ("key", pa.int64()), ("numbers", pa.binary())])
_PACKED = pa.schema([("bucket", pa.int32()), ("chunks", pa.binary()), ("rows", pa.binary()), ("sizes", pa.binary()), ("numbers", pa.binary())])
_PACKED_DDL = "bucket int, chunks binary, rows binary, sizes binary, numbers binary"


def packed(numbered: DataFrame) -> DataFrame:
    """One row for each bucket: its documents' places and numbers, in the order of keys. numbered: rows of _NUMBERS."""

    def pack(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*(group.column(c).to_pylist() for c in ("key", "numbers", "chunk", "row")), strict=True))  # equal keys are equal documents
        numbers = [r[1] for r in rows]
        sizes = np.array([len(x) // 2 for x in numbers], "<i8")
        return pa.Table.from_batches([table([(group.column("bucket")[0].as_py(), np.array([r[2] for r in rows], "<i8").tobytes(), np.array([r[3] for r in rows], "<i4").tobytes(), sizes.tobytes(), b"".join(numbers))], _PACKED)])

    return cut(numbered.select(*_NUMBERS.names).groupBy("bucket").applyInArrow(pack, _PACKED_DDL))


def spread(sizes: np.ndarray, numbers: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers with WINDOW zeros around each document, and the places of tokens in them."""
    at = np.arange(sizes.sum()) + WINDOW * (1 + np.repeat(np.arange(len(sizes)), sizes))
    out = np.zeros(sizes.sum() + WINDOW * (1 + len(sizes)), np.int32)
    out[at] = np.frombuffer(numbers, "<u2")
    return out, at


def numbers_of(docs: DataFrame, tokens: Tokens, counts: np.ndarray) -> DataFrame:
    """packed() of docs alone."""
    n, shared = max(1, int(counts.sum()) // BUCKET), docs.sparkSession.sparkContext.broadcast(tokens)

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                codes, sizes, words = split(part.column("text"))
                yield table(_number_rows(part, shared.value.of(words)[0][codes].astype("<u2"), sizes, chunk, n), _NUMBERS)
                chunk += 1

    return packed(_keyed(docs).mapInArrow(run, "bucket int, chunk long, row int, key long, numbers binary"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def _number_rows(part: pa.RecordBatch, numbers: np.ndarray, sizes: np.ndarray, chunk: int, n: int) -> list[tuple]:
    """Of each row: bucket, chunk, row, key, numbers."""
    keys, end = np.asarray(part.column("key"), dtype=np.int64), np.cumsum(sizes).tolist()
    buckets = (mix(keys.view(np.uint64)) % np.uint64(n)).tolist()
    return [(b, chunk, i, k, numbers[e - m : e].tobytes()) for i, (b, k, m, e) in enumerate(zip(buckets, keys.tolist(), sizes.tolist(), end, strict=True))]


def train(buckets: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, masked: float = MASKED, seed: int = 7) -> Network:
    """buckets: packed(). Every bucket starts from the shared weights in each round."""
    spark = buckets.sparkSession
    network = Network.start(counts, seed)
    salts = max(1, math.isqrt(int(counts.sum()) // BUCKET))
    schema = pa.schema([("block", pa.int32()), ("salt", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("sums", pa.binary())])
    ddl = "block int, salt int, part int, n long, sums binary"

    def add(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])  # in a fixed order, so that reruns agree
        sums = np.frombuffer(rows[0]["sums"], "<f8").copy()
        for r in rows[1:]:
            sums += np.frombuffer(r["sums"], "<f8")
        return pa.Table.from_batches([table([(rows[0]["block"], -1, min(r["part"] for r in rows), sum(r["n"] for r in rows), sums.tobytes())], schema)])

    for turn in range(rounds):
        weights = spark.sparkContext.broadcast(network.flat())

        def run(batches, weights=weights, turn=turn):
            for batch in batches:
                for b, sizes, packed_numbers in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sizes", "numbers")), strict=True):
                    own = Network.of_flat(weights.value)
                    squares = [np.zeros_like(x) for x in own.w]
                    numbers, at = spread(np.frombuffer(sizes, "<i8"), packed_numbers)
                    draw = mix(at.astype(np.uint64) + np.uint64((seed + turn) << 32)) >> np.uint64(11)
                    at = at[draw < np.uint64(int(masked * (1 << 53)))]
                    at = at[np.argsort(mix(at.astype(np.uint64) ^ np.uint64(seed)))]  # a fixed shuffle
                    own.descend(numbers, at, squares)
                    if len(at):
                        sums = own.flat().astype("<f8") * len(at)
                        yield table([(k, b % salts, b, len(at), x.tobytes()) for k, x in enumerate(np.array_split(sums, BLOCKS))], schema)
                    trim()

        handed = buckets.select("bucket", "sizes", "numbers").mapInArrow(run, ddl)
        averaged = handed.groupBy("block", "salt").applyInArrow(add, ddl).groupBy("block").applyInArrow(add, ddl)
        blocks = sorted(averaged.collect(), key=lambda r: r["block"])
        if blocks:
            network = Network.of_flat(np.concatenate([np.frombuffer(r["sums"], "<f8") / r["n"] for r in blocks]))
    return network


def score(docs: DataFrame, tokens: Tokens, network: Network) -> DataFrame:
    """doc_id, n_tokens, score: the sum of log p over all tokens of each row."""
    shared = docs.sparkSession.sparkContext.broadcast((tokens, network.flat()))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches):
        tokens, flat = shared.value
        own = Network.of_flat(flat)
        for batch in batches:
            for part in slices(batch):
                codes, counts, words = split(part.column("text"))
                numbers, at = spread(counts, tokens.of(words)[0][codes].astype("<u2").tobytes())
                total = np.concatenate(([0.0], np.cumsum(own.log_p(numbers, at))))
                end = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(total[end] - total[end - counts])], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, score double")


_BLOCK = "kind byte, shard int, chunk long, row int, key long, a binary, b binary"
_PA_BLOCK = pa.schema([("kind", pa.int8()), ("shard", pa.int32()), ("chunk", pa.int64()), ("row", pa.int32()), ("key", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
#: Kinds of blocks: a document's numbers (shard: its bucket), the rows of a chunk, the rare tokens of a chunk, and sums for
#: rows of a chunk, from the network and from rare tokens.
NUMBERS, ROWS, RARE, BASE, SUMS = range(5)


def encoded(docs: DataFrame, tokens: Tokens, counts: np.ndarray, n: int) -> DataFrame:
    """NUMBERS, ROWS and RARE blocks of all documents: the one pass in which texts become numbers. n: shards of rare tokens."""
    shared, buckets = docs.sparkSession.sparkContext.broadcast(tokens), max(1, int(counts.sum()) // BUCKET)

    def run(batches):
        tokens, chunk = shared.value, TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                codes, sizes, words = split(part.column("text"))
                numbers, beyond = tokens.of(words)
                ids = part.column("doc_id").cast(pa.int64())
                out = [(NUMBERS, b, c, i, k, x, b"") for b, c, i, k, x in _number_rows(part, numbers[codes].astype("<u2"), sizes, chunk, buckets)]
                rows = np.stack((np.asarray(ids.fill_null(0), np.int64), np.asarray(ids.is_null()).astype(np.int64), sizes))
                out.append((ROWS, chunk % n, chunk, 0, 0, rows.tobytes(), b""))
                h = _hashes(_listed(words.filter(pa.array(beyond))))
                shard = (mix(h) % np.uint64(n)).astype(np.int64)
                by_shard = np.argsort(shard, kind="stable")
                place = np.zeros(len(words), np.int64)  # of a word beyond, in the order of shards
                place[np.flatnonzero(beyond)[by_shard]] = np.arange(len(h))
                rare = beyond[codes]
                key, times = np.unique(place[codes[rare]] * len(sizes) + np.repeat(np.arange(len(sizes)), sizes)[rare], return_counts=True)
                word, row = np.divmod(key, max(1, len(sizes)))
                h, each = h[by_shard], np.bincount(word, minlength=len(h)).astype(np.uint64)
                row, times = row.astype("<u4"), times.astype("<u4")
                which, first = np.unique(shard[by_shard], return_index=True)
                cuts = [*first.tolist(), len(h)]
                pairs = np.searchsorted(word, cuts).tolist()
                for b, w, v, i, j in zip(which.tolist(), cuts, cuts[1:], pairs, pairs[1:], strict=False):
                    out.append((RARE, b, chunk, 0, 0, h[w:v].tobytes() + each[w:v].tobytes(), row[i:j].tobytes() + times[i:j].tobytes()))
                yield table(out, _PA_BLOCK)
                chunk += 1

    return cut(_keyed(docs).mapInArrow(run, _BLOCK))


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def whole_score(blocks: DataFrame, buckets: DataFrame, words: DataFrame, tokens: Tokens, counts: np.ndarray, network: Network, n: int) -> DataFrame:
    """doc_id, n_tokens, score: of the numbers, and for every token beyond the vocabulary log p(token | its class) besides.

    That is its share of its class in the counts of all documents, words. Counts and rare tokens of chunks of rows, both by
    64-bit hash, are sharded and joined; sums in fixed point go back to the chunk, so that their order doesn't matter.
    blocks: encoded(); buckets: packed() of its numbers.
    """
    sc = blocks.sparkSession.sparkContext
    shared, flat = sc.broadcast((tokens, counts[: 1 + SHAPES])), sc.broadcast(network.flat())

    def shares(batches):
        tokens, classes = shared.value
        for batch in batches:
            numbers, beyond = tokens.of(batch.column("w"))
            h = _hashes(_listed(batch.column("w").filter(pa.array(beyond))))
            value = np.log(np.asarray(batch.column("n"))[beyond].astype(float) / classes[numbers[beyond]])
            yield pa.RecordBatch.from_arrays([pa.array((mix(h) % np.uint64(n)).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(np.rint(value * POINT).astype(np.int64))], names=["shard", "h", "v"])

    def base(batches):
        own = Network.of_flat(flat.value)
        for batch in batches:
            for r in batch.to_pylist():
                sizes, chunks, rows = np.frombuffer(r["sizes"], "<i8"), np.frombuffer(r["chunks"], "<i8"), np.frombuffer(r["rows"], "<i4")
                numbers, at = spread(sizes, r["numbers"])
                total, end = np.concatenate(([0.0], np.cumsum(own.log_p(numbers, at)))), np.cumsum(sizes)
                sums = np.rint((total[end] - total[end - sizes]) * POINT).astype("<i8")
                order = np.argsort(chunks, kind="stable")
                cuts = np.flatnonzero(np.diff(chunks[order])) + 1
                yield table([(BASE, 0, int(chunks[i[0]]), 0, 0, rows[i].astype("<u4").tobytes(), sums[i].tobytes()) for i in np.split(order, cuts) if len(i)], _PA_BLOCK)
                trim()

    def join(key, known: pa.Table, blocks: pa.Table) -> pa.Table:
        h, v = np.asarray(known.column("h"), dtype=np.int64).view(np.uint64), np.asarray(known.column("v"), dtype=np.int64)
        order = np.argsort(h)
        h, v, out = h[order], v[order], []
        for chunk, keys, rows in zip(*(blocks.column(c).to_pylist() for c in ("chunk", "a", "b")), strict=True):
            own, each = np.frombuffer(keys, "<u8").reshape(2, -1)
            row, times = np.frombuffer(rows, "<u4").reshape(2, -1).astype(np.int64)
            which, sums = np.flatnonzero(np.bincount(row)), np.zeros(row.max() + 1, np.int64)
            np.add.at(sums, row, np.repeat(v[np.searchsorted(h, own)], each.astype(np.int64)) * times)
            out.append((SUMS, 0, chunk, 0, 0, which.astype("<u4").tobytes(), sums[which].tobytes()))
        return pa.Table.from_batches([table(out, _PA_BLOCK)])

    final = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def gather(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group.column(c).to_pylist() for c in ("kind", "a", "b")), strict=True))
        ids, null, sizes = np.frombuffer(next(a for kind, a, _ in rows if kind == ROWS), "<i8").reshape(3, -1)
        total = np.zeros(len(ids), np.int64)
        for kind, a, b in rows:
            if kind != ROWS:
                total[np.frombuffer(a, "<u4")] += np.frombuffer(b, "<i8")
        return pa.table([pa.array(ids, mask=null.astype(bool)), pa.array(sizes), pa.array(total / POINT)], schema=final)

    mine = words.mapInArrow(shares, "shard int, h long, v long")
    rare = mine.groupBy("shard").cogroup(blocks.where(F.col("kind") == RARE).groupBy("shard")).applyInArrow(join, _BLOCK)
    every = blocks.where(F.col("kind") == ROWS).unionByName(buckets.mapInArrow(base, _BLOCK)).unionByName(rare)
    return every.groupBy("chunk").applyInArrow(gather, "doc_id long, n_tokens long, score double")


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score."""
    words = counted(docs)
    tokens, counts = vocabulary(docs, words)
    n = buckets_for(docs, 16 << 20, 2.0)
    blocks = encoded(docs, tokens, counts, n)
    numbers = F.col("kind") == NUMBERS
    buckets = packed(blocks.where(numbers).select(F.col("shard").alias("bucket"), "chunk", "row", "key", F.col("a").alias("numbers")))
    return whole_score(blocks, buckets, words, tokens, counts, train(buckets, counts), n)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score, mean_score."""
    return scored(docs).select("doc_id", "n_tokens", F.round("score", 3).alias("score"), F.when(F.col("n_tokens") > 0, F.round(F.col("score") / F.col("n_tokens"), 5)).alias("mean_score"))
