"""An inverted file of vectors with product-quantised residuals, for cosine search that reads little.

fit() learns from at most max_train rows (those of least key hash; a documented bound): cell centres by k-means, and for the
rest (a vector less its cell's centre) one codebook for each group of dimensions. Each k-means is a task of its own in a Spark
job. place() puts every row of a table into its nearest cell: (cell, key, code, miss, vector), where code has a byte for each
codebook and miss is the length of what the code leaves out. write() stores that, a folder for each cell; a big cell has as
many files as ranges of keys it spans. Rows with a null or zero vector are left out, as cosine search leaves them out.

search() takes a stated set of queries, broadcast in blocks. Each query looks into its `probes` nearest cells; a scan of those
cells' codes alone scores rows by tables of inner products, keeps `refine` rows a query and task, and merges them. Then the
vectors of those candidates are read, and the exact cosine decides, ties by key. probes is chosen in fit() as the least number
that finds `recall` of the neighbours of unseen sample rows.

With exact=True all cells are read, and miss bounds the error of each score: |q.v - score| <= miss for a query of length 1.
Rows whose upper bound reaches the k-th best lower bound are candidates, so the result is that of a full search, still
reading a few bytes a row first and vectors only for candidates.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .retrieval import cosine, exact_cosine, unit_rows

#: Cells are folders of a table, so there are not too many of them.
MOST_CELLS = 4096
#: Entries of a codebook, at most: a code is one byte.
ENTRIES = 256
#: Rows of a cell and queries that are scored at once.
TILE = 1024


class Model(NamedTuple):
    """centres (cells x dim); books (groups x entries x width), the last group filled up with zeros; probes, the default of search."""

    centres: np.ndarray
    books: np.ndarray
    probes: int

    def cells(self, unit: np.ndarray) -> np.ndarray:
        return np.argmin(_apart(unit, self.centres), axis=1)

    def groups(self, x: np.ndarray) -> np.ndarray:
        """x as (groups, rows, width)."""
        n, _, width = self.books.shape
        wide = np.zeros((len(x), n * width), dtype=np.float32)
        wide[:, : x.shape[1]] = x
        return wide.reshape(len(x), n, width).transpose(1, 0, 2)

    def encode(self, unit: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the lengths of what they leave out."""
        parts = self.groups(unit - self.centres[cells])
        codes = np.stack([np.argmin(_apart(p, b), axis=1) for p, b in zip(parts, self.books, strict=True)], axis=1).astype(np.uint8)
        missed = sum(((p - b[codes[:, i]]) ** 2).sum(axis=1) for i, (p, b) in enumerate(zip(parts, self.books, strict=True)))
        return codes, np.sqrt(missed)


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, less the rows' own squares."""
    return (centres * centres).sum(axis=1)[None] - 2 * (x @ centres.T)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centres of x (repeated rows count once at the start, so that they aren't all centres); empty ones move to the farthest rows."""
    rng = np.random.default_rng(seed)
    different = np.unique(x, axis=0)
    k = min(k, len(different))
    centres = different[rng.permutation(len(different))[:k]].copy()
    for _ in range(rounds):
        apart = _apart(x, centres)
        at = apart.argmin(axis=1)
        n = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=c, minlength=k) for c in x.T], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        if (n == 0).any():
            own = apart[np.arange(len(x)), at] + (x * x).sum(axis=1)
            centres[n == 0] = x[np.argsort(-own)[: (n == 0).sum()]]
    return centres


def _fine(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(flat.reshape(len(column), -1)).astype(np.float32) if len(flat) else np.zeros((len(column), 0), np.float32)


def _run(spark: SparkSession, shared, jobs: list[int], task) -> dict[int, np.ndarray]:
    """task(shared, job) for each job, in a Spark task of its own."""
    value = spark.sparkContext.broadcast(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for job in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([job]), pa.array([pickle.dumps(task(value.value, job))], pa.binary())], names=["job", "made"])

    rows = spark.createDataFrame([(j,) for j in jobs], "job long").repartition(len(jobs)).mapInArrow(run, "job long, made binary").collect()
    return {r["job"]: pickle.loads(bytes(r["made"])) for r in rows}


def fit(nodes: DataFrame, key: str = "id", vector: str = "embedding", cells: int | None = None, width: int = 4, max_train: int = 20_000, recall: float = 0.95, k: int = 10) -> Model:
    """cells: by default the square root of the rows, at most MOST_CELLS. width: dimensions a codebook covers."""
    spark, rows = nodes.sparkSession, nodes.where(_fine(vector))
    n = rows.count()
    if not n:
        return Model(np.zeros((0, 0), np.float32), np.zeros((0, 1, width), np.float32), 0)
    at = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(3)), F.lit(1 << 30))
    thin = rows.select(at.alias("_at"), F.col(vector).alias("v")).where(F.col("_at") <= min(1.0, (1.2 * max_train + 100) / n) * (1 << 30))
    sample = unit_rows(np.array([r["v"] for r in thin.orderBy("_at", "v").limit(max_train).collect()], dtype=np.float64)).astype(np.float32)
    cells = min(cells or max(1, round(n**0.5)), MOST_CELLS, len(sample))
    centres = _run(spark, sample, [0], lambda x, _: kmeans(x, cells))[0]
    model = Model(centres, np.zeros((-(-sample.shape[1] // width), 1, width), np.float32), 1)
    rests = model.groups(sample - centres[model.cells(sample)])
    books = _run(spark, rests, list(range(len(rests))), lambda x, j: kmeans(x[j], ENTRIES, seed=j))
    most = max(map(len, books.values()))
    filled = np.stack([np.concatenate((books[j], np.repeat(books[j][:1], most - len(books[j]), axis=0))) for j in sorted(books)])
    model = model._replace(books=filled.astype(np.float32))
    return model._replace(probes=_run(spark, (sample, model, recall, k), [0], _probes)[0])


def _probes(shared, _: int) -> int:
    """The least number of cells that hold the share `recall` of the k nearest rows of some sample rows, among the sample."""
    sample, model, recall, k = shared
    queries = sample[:: max(1, len(sample) // 256)]
    near = np.argsort(-(queries @ sample.T), axis=1)[:, : k + 1]  # with the query itself
    rank = np.argsort(np.argsort(_apart(queries, model.centres), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, model.cells(sample)[near], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))])


def place(nodes: DataFrame, model: Model, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(cell, key, code, miss, vector) of every row with a vector. Nothing is shuffled."""
    shared = nodes.sparkSession.sparkContext.broadcast(model)
    rows = nodes.where(_fine(vector)).select(key, vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for at in range(0, b.num_rows, TILE):
                part = b.slice(at, TILE)
                unit = _units(part.column(1))
                cells = model.cells(unit)
                codes, miss = model.encode(unit, cells)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), part.column(0), packed, pa.array(miss.astype(np.float32) + np.float32(1e-5)), part.column(1)], names=["cell", key, "code", "miss", vector])

    schema = f"cell int, {key} {rows.schema[key].dataType.simpleString()}, code binary, miss float, {vector} {rows.schema[vector].dataType.simpleString()}"
    return rows.mapInArrow(run, schema)


def write(placed: DataFrame, path: str, key: str = "id") -> DataFrame:
    """The stored index: a folder for each cell, keys in order; big cells lie in many files. A search reads the cells it needs."""
    placed.repartitionByRange("cell", key).sortWithinPartitions("cell", key).write.mode("errorifexists").partitionBy("cell").parquet(path)
    return placed.sparkSession.read.schema(placed.schema).parquet(path)


def search(index: DataFrame, model: Model, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding", probes: int | None = None, refine: int | None = None, exact: bool = False, block_bytes: int = 16 << 20) -> DataFrame:
    """(query_id, key, score, rank) of the k best by cosine for each of queries (query_id, vector); a query_id is that of one row.

    index: what write() returned, or placed rows. probes: cells a query looks into, else what fit() chose. refine: candidates a
    query, 10 * k by default. exact: all cells, and bounds in place of refine.
    """
    wanted = queries.where(_fine("vector")).select("query_id", "vector")
    n, probes = wanted.count(), min(probes or model.probes, len(model.centres))
    width = model.centres.size // max(1, len(model.centres))
    each = 16 * width if exact else 4 * (model.books.shape[0] * model.books.shape[1] + width)
    blocks = max(1, -(-n * each // block_bytes))
    found = None
    for b in range(blocks):
        rows = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()
        if not rows or not len(model.centres):
            continue
        ids, vectors = [r["query_id"] for r in rows], np.array([r["vector"] for r in rows], dtype=np.float64)
        if exact:
            one = _bounded(index, model, ids, vectors, k, key, vector, queries)
        else:
            own = unit_rows(vectors).astype(np.float32)
            near = np.argsort(_apart(own, model.centres), axis=1)[:, :probes]
            some = index.where(F.col("cell").isin(sorted(set(near.ravel().tolist()))))
            one = _scored(some, model, ids, own, near, refine or 10 * k, key, queries)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = index.sparkSession.createDataFrame([], _kind(queries, index, key))
    if exact:
        scored = found.select("query_id", key, F.col("score").cast("double"))
    else:
        full = found.select("query_id", "cell", key).join(index.select("cell", key, vector), ["cell", key]).join(wanted.withColumnRenamed("vector", "_q"), "query_id")
        scored = full.select("query_id", key, cosine(vector, "_q").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _kind(queries: DataFrame, index: DataFrame, key: str) -> str:
    return f"query_id {queries.schema['query_id'].dataType.simpleString()}, cell int, {key} {index.schema[key].dataType.simpleString()}, score float, miss float"


def _scores(index: DataFrame, model: Model, own: np.ndarray, near: np.ndarray, keep, ids: list, key: str, queries: DataFrame) -> DataFrame:
    """Candidates of a block of queries: keep(scores) picks pairs (query, row) of a cell's part of a batch."""
    shared = index.sparkSession.sparkContext.broadcast((model, ids, own, near))
    id_type = to_arrow_type(queries.schema["query_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids, own, near = shared.value
        cells = near.ravel()
        order = np.argsort(cells, kind="stable")
        cuts = np.flatnonzero(np.diff(cells[order])) + 1
        looks = {int(cells[o[0]]): o // near.shape[1] for o in np.split(order, cuts)}  # cell -> queries that look into it
        groups = model.groups(own)
        tables = np.einsum("gqw,gew->gqe", groups, model.books)  # inner products of queries and entries
        centred = own @ model.centres.T
        for b in batches:
            cells = b.column(0).to_numpy()
            for cell in np.unique(cells).tolist():
                asked = looks.get(cell, ())
                at = np.flatnonzero(cells == cell)
                for rows in (at[i : i + TILE] for i in range(0, len(at) if len(asked) else 0, TILE)):
                    part = b.take(pa.array(rows))
                    codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(rows), -1)
                    miss = part.column(3).to_numpy()
                    for q in (asked[i : i + TILE] for i in range(0, len(asked), TILE)):
                        score = np.repeat(centred[q, cell][:, None], len(rows), axis=1)
                        for g in range(codes.shape[1]):
                            score += tables[g][q][:, codes[:, g]]
                        i, j = keep(score)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([ids[x] for x in q[i].tolist()], id_type), pa.array(np.full(len(i), cell, np.int32)), pc.take(part.column(1), pa.array(j)), pa.array(score[i, j].astype(np.float32)), pa.array(miss[j])],
                            names=["query_id", "cell", key, "score", "miss"],
                        )

    return index.select("cell", key, "code", "miss").mapInArrow(run, _kind(queries, index, key))


def _scored(index: DataFrame, model: Model, ids: list, own: np.ndarray, near: np.ndarray, refine: int, key: str, queries: DataFrame) -> DataFrame:
    """The `refine` rows of best score for each query."""

    def keep(score):
        m = min(refine, score.shape[1])
        i, j = np.nonzero(score >= np.partition(score, score.shape[1] - m, axis=1)[:, score.shape[1] - m][:, None])
        return i, j

    found = _scores(index, model, own, near, keep, ids, key, queries)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= refine).drop("_rank")


def _bounded(index: DataFrame, model: Model, ids: list, vectors: np.ndarray, k: int, key: str, vector: str, queries: DataFrame) -> DataFrame:
    """(query_id, key, score): the k best rows of each task for each query of a block, ties by key.

    Codes bound the scores of a tile; only what may reach the k-th best so far is scored by its vector. Which rows come first
    changes what is scored, not what is found.
    """
    shared = index.sparkSession.sparkContext.broadcast((model, ids, vectors))
    key_type, id_type = to_arrow_type(index.schema[key].dataType), to_arrow_type(queries.schema["query_id"].dataType)
    schema = pa.schema([("q", pa.int64()), ("score", pa.float64()), ("key", key_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, ids, vectors = shared.value
        own = unit_rows(vectors)
        near = own.astype(np.float32)
        best = np.full(len(own), -np.inf)  # no more than the k-th best of each query
        held, waiting = [schema.empty_table()], 0

        def pruned() -> pa.Table:
            rows = pa.concat_tables(held).sort_by([("q", "ascending"), ("score", "descending"), ("key", "ascending")])
            q, s = rows.column("q").to_numpy(), rows.column("score").to_numpy()
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(q)), bool), q[1:] != q[:-1])))
            n = np.diff(np.concatenate((first, [len(q)])))
            full = first[n >= k]
            best[q[full]] = s[full + k - 1]
            return rows.take(pa.array(np.flatnonzero(np.arange(len(q)) - np.repeat(first, n) < k))).combine_chunks()

        for b in batches:
            for part in (b.slice(x, TILE) for x in range(0, b.num_rows, TILE)):
                cell, miss = part.column(0).to_numpy(), part.column(3).to_numpy()
                codes = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                about = model.centres[cell] + np.concatenate([x[codes[:, g]] for g, x in enumerate(model.books)], axis=1)[:, : model.centres.shape[1]]
                v = part.column(4).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                unit = unit_rows(v)
                for at in range(0, len(own), TILE):
                    # sums in single precision are off by less than 1e-4
                    may = near[at : at + TILE] @ about.T + (miss[None] + np.float32(1e-4)) >= best[at : at + TILE, None]
                    asked, rows = at + np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
                    if not len(asked):
                        continue
                    score = own[asked] @ unit[rows].T
                    if len(rows) >= k:
                        best[asked] = np.maximum(best[asked], np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k])
                    i, j = np.nonzero(score >= best[asked, None] - 1e-9)
                    for x in range(0, len(i), 1 << 14):
                        q, r = asked[i[x : x + (1 << 14)]], rows[j[x : x + (1 << 14)]]
                        s = exact_cosine(vectors[q], v[r])
                        fine = ~np.isnan(s)
                        held.append(pa.table([pa.array(q[fine]), pa.array(s[fine]), part.column(1).take(pa.array(r[fine]))], schema=schema))
                        waiting += len(s)
                        if waiting > max(1 << 18, 2 * k * len(own)):
                            held, waiting = [pruned()], 0
        for x in pruned().to_batches(max_chunksize=1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in x.column(0).to_pylist()], id_type), x.column(2), x.column(1)], names=["query_id", key, "score"])

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {index.schema[key].dataType.simpleString()}, score double"
    return index.select("cell", key, "code", "miss", vector).mapInArrow(run, kinds)
