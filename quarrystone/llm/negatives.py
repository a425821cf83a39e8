"""Hard negatives: for each anchor and positive, the best rows of other labels that are nearly as good as the positive.

Method. One pass sums the outer products of all vectors; the eigenvectors of that matrix, largest first, are an orthogonal
rotation, which keeps inner products and moves their weight to the leading components. A search multiplies a few leading
components of a block of anchors with a batch of rows at a time. By Cauchy-Schwarz what is left of a product is at most the
product of the norms of what is left of both vectors; with some slack for rounding this gives bounds, and rows that cannot
reach what an anchor already has (or lie beyond what it may have) are discarded before more components are added. For pairs
that survive all the components, or once few do, the integer products themselves decide, so rounding never shows in a result.

Two searches, both by this method: the positives (the best of the same label), then, for each anchor and positive, the best
of other labels within [least, most] percent of the positive's score. Each begins with a thin first pass over rows chosen by a
hash, whose k-th best scores are lower bounds to start from; the second pass is over all rows, so the bounds decide how much is
looked at and handed on, not what is found. Anchors are dealt to blocks of BLOCK_BYTES that are broadcast one after the other;
each block is a pass over all rows, and its lists (k rows a list from each task, at most) are written before the next begins.

Input rows (vec_id, embedding, label). Rows with a null vec_id or label, a null vector, or a null or non-finite component take
no part. Shorter vectors count as filled up with zeros, and an empty one is a zero vector. Repeated rows count as often as they
stand: every row with an anchor's vec_id and label (a repeated anchor, too) is an anchor of its own, and rows with the
anchor's vec_id are not candidates. Ties go to the smaller vec_id. An empty table, or one without anchors, gives no rows. Other
columns take no part. Components are integers after quantising; squared lengths must stay below 2**55, else ValueError.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import cut

#: Of anchors that are broadcast at once, counted as integers and rotated components.
BLOCK_BYTES = 16 << 20
#: Anchors and rows that are multiplied at once: what a task holds.
TILE = 512
#: One in so many rows is searched first, for bounds to begin with.
THIN = 64
#: Components in a step, of the leading ones first; each step is one matrix product of what survives.
STEPS = (8, 24, 64, 192, 512, 1536)
#: Pairs are looked at one by one as soon as at most this share of a tile survives.
FEW = 1 / 32
_NONE = np.int64(-(1 << 62))


class Space(NamedTuple):
    """dim, the rotation (dim x dim, leading directions first), the sum of squares of the longest vector."""

    dim: int
    rotation: np.ndarray
    longest: float


def eligible(vectors: DataFrame, flip_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, embedding) of rows that take part; the labels of ids divisible by flip_every are moved on by one."""
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity in Spark
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % flip_every == 0, (label + 1) % labels).otherwise(label)
    return vectors.where(F.col("vec_id").isNotNull() & label.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), e.alias("embedding"))


def _matrix(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of every vector, as integers, filled up with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() >= 2.0**31:
        raise ValueError("components are too large for exact products")
    flat = flat.astype(np.int64)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def fit(rows: DataFrame, scale: int = 256) -> Space:
    """The rotation, from all rows: one small matrix from each task, in as many rows as it has dimensions, summed in Spark."""
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    if not dim:
        return Space(0, np.zeros((0, 0)), 0.0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, longest = np.zeros((dim, dim)), 0.0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), dim, scale).astype(np.float64)
                total += x.T @ x
                longest = max(longest, float(np.einsum("ij,ij->i", x, x).max()))
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary()), pa.array([longest] * dim)], names=["i", "row", "longest"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, np.ndarray] = {}
        longest = 0.0
        for b in batches:
            for i, r, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows[i] = rows[i] + np.frombuffer(r) if i in rows else np.frombuffer(r)
                longest = max(longest, n)
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array([r.tobytes() for r in rows.values()], pa.binary()), pa.array([longest] * len(rows))], names=["i", "row", "longest"])

    kind = "i int, row binary, longest double"
    found = rows.select("embedding").mapInArrow(sums, kind).repartition("i").mapInArrow(add, kind).collect()
    gram, longest = np.zeros((dim, dim)), max(r["longest"] for r in found)
    for r in found:
        gram[r["i"]] = np.frombuffer(r["row"])
    if longest >= 2.0**55:
        raise ValueError("vectors are too long for exact products")
    _, directions = np.linalg.eigh((gram + gram.T) / 2)
    return Space(dim, np.ascontiguousarray(directions[:, ::-1]), longest)


def _steps(dim: int) -> list[int]:
    return [0, *(s for s in STEPS if s < dim), dim]


def _rests(rotated: np.ndarray, steps: list[int]) -> np.ndarray:
    """Norms of what is left of each vector after each step."""
    squares = np.cumsum((rotated * rotated)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate((squares, np.zeros((len(rotated), 1))), axis=1)[:, steps[1:]])


class Block(NamedTuple):
    """Anchors of a block, in the order of no, and their lists: list i belongs to anchor own[i] and takes scores in [low[i], high[i]]."""

    no: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    exact: np.ndarray
    rotated: np.ndarray
    own: np.ndarray
    key: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _best(have: tuple[np.ndarray, ...], more: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """The k best (list, score, id) of each list, of both."""
    at, score, ids = (np.concatenate(x) for x in zip(have, more, strict=True))
    order = np.lexsort((ids, -score, at))
    at, score, ids = at[order], score[order], ids[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(at)), bool), at[1:] != at[:-1])))
    rank = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    keep = rank < k
    return at[keep], score[keep], ids[keep]


def _survivors(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, steps: list[int], allowed: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, row) of a tile whose products may lie in their anchor's [low, high], by partial products and bounds."""
    slack = 1e-9 * np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)) + 1e-3
    rows, cols = np.arange(len(a)), np.arange(len(b))
    part = np.zeros((len(a), len(b)))
    for i, (s, e) in enumerate(zip(steps, steps[1:], strict=False)):
        part += a[rows, s:e] @ b[cols, s:e].T
        rest = np.outer(ra[rows, i], rb[cols, i]) + slack
        allowed &= (part + rest >= low[rows, None]) & (part - rest <= high[rows, None])
        if np.count_nonzero(allowed) <= FEW * allowed.size:
            break
        keep_r, keep_c = allowed.any(axis=1), allowed.any(axis=0)
        if keep_r.mean() < 0.75 or keep_c.mean() < 0.75:
            rows, cols = rows[keep_r], cols[keep_c]
            part, slack, allowed = (x[keep_r][:, keep_c] for x in (part, slack, allowed))
    i, j = np.nonzero(allowed)
    return rows[i], cols[j]


def _search(rows: DataFrame, block: Block, space: Space, k: int, same: bool, scale: int) -> DataFrame:
    """(no, key, id, score): for each list of the block, the k best of a task's rows of the same (or of other) labels."""
    shared = rows.sparkSession.sparkContext.broadcast((block, space))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, space = shared.value
        steps = _steps(space.dim)
        rests = _rests(block.rotated, steps)
        low = block.low.copy()  # of each list; rises to the k-th best score
        begin = np.searchsorted(block.own, np.arange(len(block.no) + 1))  # lists of an anchor stand together
        has = np.flatnonzero(np.diff(begin))
        top = np.full(len(block.no), _NONE)
        top[has] = np.maximum.reduceat(block.high, begin[has]) if len(has) else top[has]
        best = tuple(np.empty(0, np.int64) for _ in range(3))
        for b in batches:
            for at in range(0, b.num_rows, TILE):
                part = b.slice(at, TILE)
                ids, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                exact = _matrix(part.column(2), space.dim, scale)
                rotated = exact @ space.rotation
                rest = _rests(rotated, steps)
                bottom = np.full(len(block.no), -_NONE)
                bottom[has] = np.minimum.reduceat(low, begin[has]) if len(has) else bottom[has]
                found = []
                for f in range(0, len(block.no), TILE):
                    t = slice(f, f + TILE)
                    allowed = ((block.labels[t, None] == labels[None]) == same) & (block.ids[t, None] != ids[None])
                    i, j = _survivors(block.rotated[t], rotated, rests[t], rest, steps, allowed, bottom[t], top[t])
                    i = i + f
                    for p in range(0, len(i), 1 << 16):  # integer products of what survives
                        ii, jj = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
                        score = np.einsum("ij,ij->i", block.exact[ii], exact[jj])
                        n = begin[ii + 1] - begin[ii]  # of each pair, for every list of its anchor
                        lists = np.repeat(begin[ii] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        score, jj = np.repeat(score, n), np.repeat(jj, n)
                        fits = (score >= low[lists]) & (score <= block.high[lists])
                        found.append((lists[fits], score[fits], ids[jj[fits]]))
                if found:
                    best = _best(best, tuple(np.concatenate(x) for x in zip(*found, strict=True)), k)
                    last = np.flatnonzero(np.append(best[0][1:] != best[0][:-1], np.ones(min(1, len(best[0])), bool)))
                    full = last[(last >= k - 1) & (best[0][np.maximum(last - k + 1, 0)] == best[0][last])]
                    low[best[0][full]] = np.maximum(low[best[0][full]], best[1][full])
        at, score, ids = best
        yield pa.RecordBatch.from_arrays([pa.array(block.no[block.own[at]]), pa.array(block.key[at]), pa.array(ids), pa.array(score)], names=["no", "key", "id", "score"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(run, "no long, key long, id long, score long")


def _top(lists: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("no", "key").orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _found(rows: DataFrame, anchors: DataFrame, wanted: DataFrame | None, space: Space, k: int, scale: int) -> DataFrame:
    """(no, key, id, score, rank): the k best of each list.

    anchors: a checkpoint of (no, vec_id, label, embedding). wanted: a checkpoint of lists (no, key, low, high) of rows of other
    labels; None is one list an anchor, of rows of its own label.
    """
    n = anchors.count()
    blocks = max(1, -(-n * (space.dim + 1) * 16 // BLOCK_BYTES))
    mine = F.pmod(F.xxhash64("no"), F.lit(blocks))
    thin = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(12)), F.lit(THIN)) == 0)
    done = None
    for b in range(blocks):
        own = sorted(anchors.where(mine == b).collect(), key=lambda r: r["no"]) if n else []
        if not own:
            continue
        no = np.array([r["no"] for r in own])
        exact = _matrix(pa.array([r["embedding"] for r in own], pa.list_(pa.float64())), space.dim, scale)
        lists = sorted(tuple(r) for r in wanted.where(mine == b).select("no", "key", "low", "high").collect()) if wanted is not None else [(x, 0, int(_NONE), -int(_NONE)) for x in no.tolist()]
        if not lists:
            continue
        at, key, low, high = (np.array(x, dtype=np.int64) for x in zip(*lists, strict=True))
        block = Block(no, np.array([r["vec_id"] for r in own]), np.array([r["label"] for r in own]), exact, exact @ space.rotation, np.searchsorted(no, at), key, low, high)
        same = wanted is None
        seen = {(r["no"], r["key"]): r["score"] for r in _top(_search(thin, block, space, k, same, scale), k).where(F.col("rank") == k).collect()}
        low = np.array([max(x, seen.get(i, x)) for x, i in zip(low.tolist(), zip(at.tolist(), key.tolist(), strict=True), strict=True)], dtype=np.int64)
        one = cut(_top(_search(rows, block._replace(low=low), space, k, same, scale), k))
        done = one if done is None else done.unionByName(one)
    return done if done is not None else rows.sparkSession.createDataFrame([], "no long, key long, id long, score long, rank int")


def mine(vectors: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), from eligible rows (vec_id, label, embedding).

    least * positive_score <= 100 * negative_score <= most * positive_score, in integers.
    """
    space = fit(vectors, scale)
    anchors = cut(vectors.where(F.col("vec_id") % anchor_every == 0).withColumn("no", F.monotonically_increasing_id()))
    best = _found(vectors, anchors, None, space, positives, scale)
    pairs = best.join(anchors.select("no", F.col("vec_id").alias("anchor_id")), "no").select("no", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = cut(pairs)
    # whole numbers: ceil(least * p / 100) and floor(most * p / 100); equal scores of an anchor share a list
    low, high = (F.expr(f"-((-{x} * positive_score - pmod(-{x} * positive_score, 100L)) div 100)" if up else f"({x} * positive_score - pmod({x} * positive_score, 100L)) div 100") for x, up in ((least, True), (most, False)))
    wanted = pairs.select("no", F.col("positive_score").alias("key"), low.alias("low"), high.alias("high")).where("low <= high").distinct()
    found = _found(vectors, anchors, cut(wanted), space, negatives, scale)
    out = pairs.join(found.select("no", F.col("key").alias("positive_score"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank"), ["no", "positive_score"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def report(vectors: DataFrame) -> DataFrame:
    """The contract's rows, from a table (vec_id, embedding, label)."""
    return mine(eligible(vectors))
