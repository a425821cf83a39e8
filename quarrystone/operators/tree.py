"""The summary tree: reduce, choose clusters, assign softly, summarise, embed, level by level.

A level's vectors are reduced by principal components, and mixtures with full covariances are fitted for every allowed
number of clusters; the lowest BIC wins, ties to the fewest. One algorithm at every size: seeded starts and expectation-
maximisation over blocks of rows, whose sums are added in the order of blocks. Up to LOCAL_ROWS nodes every number of
clusters is fitted by one task (a few floats a node), side by side; beyond, every round is a pass over all blocks on the
executors for all numbers of clusters at once. Both add the same numbers in the same order. A node belongs to each cluster
whose posterior reaches the threshold: usually one, sometimes none.

A summary's id is a hash of its level, its cluster and its text: summaries of different clusters may have one text.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as T
from ..functions.checkpoints import cut, stored
from .aggregate import cluster_inputs
from .providers import Embedder, TextProvider, complete, embed
from .retrieval import normalised

LOCAL_ROWS = 50_000
#: Rows of a block, about.
BLOCK = 8192
SUMMARY = "Summarise the following passages."


def bic(log_likelihood: float, n: int, k: int, d: int) -> float:
    return -2 * log_likelihood + (k * d * (d + 1) / 2 + k * d + k - 1) * math.log(n)


def squares(x: np.ndarray) -> np.ndarray:
    """Of each row the products of any two of its numbers, the numbers, and 1."""
    i, j = np.triu_indices(x.shape[1])
    return np.concatenate((x[:, i] * x[:, j], x, np.ones((len(x), 1))), axis=1)


class Mixtures:
    """Gaussian mixtures of several numbers of clusters, fitted to blocks of rows.

    statistics() of a block are arrays; add() them up in the order of blocks and give them to step(). Starts: one sequence of
    rows, each drawn with a chance that grows with its distance to those before, by seeded hashes, so that the draw is a
    maximum over all rows; k clusters start at the first k.
    """

    def __init__(self, numbers: Sequence[int], seed: int, rounds: int = 100, tol: float = 1e-3, ridge: float = 1e-6):
        self.seed, self.rounds, self.tol, self.ridge = seed, rounds, tol, ridge
        self.starts: list[np.ndarray] = []
        self.models: dict[int, tuple | None] = dict.fromkeys(numbers)
        self.likelihood: dict[int, float] = dict.fromkeys(numbers, -math.inf)
        self.open = set(numbers)
        self.turn = 0

    def draw(self, keys: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray] | None:
        """The best row of a block for the next start, with its rank."""
        if not len(x):
            return None
        u = (keys.astype(np.uint64) + np.uint64(self.seed * 1000 + len(self.starts))) * np.uint64(0x9E3779B97F4A7C15)
        u = ((u ^ (u >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(12)).astype(float) / (1 << 52)
        far = np.min([((x - c) ** 2).sum(axis=1) for c in self.starts], axis=0) if self.starts else np.ones(len(x))
        rank = far / np.maximum(-np.log(np.maximum(u, 1e-300)), 1e-300)
        best = int(np.argmax(rank))
        return float(rank[best]), x[best]

    def start(self, drawn: Sequence[tuple[float, np.ndarray]]) -> None:
        self.starts.append(max(drawn, key=lambda r: r[0])[1])

    def posteriors(self, k: int, x: np.ndarray) -> tuple[np.ndarray, float]:
        """Posteriors of a block's rows, and their log-likelihood."""
        return self._posteriors(k, x, None if self.models[k] is None else squares(x) @ self.forms(k))

    def forms(self, k: int) -> np.ndarray:
        """The log-densities of k clusters, times their shares, as weights of squares(): a column a cluster."""
        out = []
        for share, mean, chol in zip(*self.models[k], strict=True):
            d = len(mean)
            root = np.linalg.inv(chol)
            exact = root.T @ root  # the inverse of the covariance
            i, j = np.triu_indices(d)
            out.append(np.concatenate((-0.5 * exact[i, j] * np.where(i == j, 1, 2), exact @ mean, [math.log(share) - 0.5 * (d * math.log(2 * math.pi) + ((root @ mean) ** 2).sum()) - np.log(np.diag(chol)).sum()])))
        return np.stack(out, axis=1)

    def _posteriors(self, k: int, x: np.ndarray, log_p: np.ndarray | None) -> tuple[np.ndarray, float]:
        if log_p is None:
            post = np.zeros((len(x), k))
            post[np.arange(len(x)), np.argmin([((x - c) ** 2).sum(axis=1) for c in self.starts[:k]], axis=0)] = 1
            return post, -math.inf
        top = log_p.max(axis=1, keepdims=True)
        post = np.exp(log_p - top)
        total = post.sum(axis=1, keepdims=True)
        return post / total, float((top + np.log(total)).sum())

    def statistics(self, x: np.ndarray) -> dict[int, list[np.ndarray]]:
        """Of each open number of clusters: rows, log-likelihood, weights, weighted sums and squares.

        All clusters of all numbers are two matrix products with the rows' squares().
        """
        numbers, z, d = sorted(self.open), squares(x), x.shape[1]
        fitted = [k for k in numbers if self.models[k] is not None]
        log_p = dict(zip(fitted, np.split(z @ np.concatenate([self.forms(k) for k in fitted], axis=1), np.cumsum(fitted)[:-1], axis=1), strict=True)) if fitted else {}
        found = [self._posteriors(k, x, log_p.get(k)) for k in numbers]
        i, j = np.triu_indices(d)
        out = {}
        for k, (_, ll), sums in zip(numbers, found, np.split(np.concatenate([post for post, _ in found], axis=1).T @ z, np.cumsum(numbers)[:-1]), strict=True):
            second = np.empty((k, d, d))
            second[:, i, j] = second[:, j, i] = sums[:, : len(i)]
            out[k] = [np.array([len(x), ll]), sums[:, -1], sums[:, len(i) : -1], second]
        return out

    @staticmethod
    def add(a: dict | None, b: dict) -> dict:
        return b if a is None else {k: [x + y for x, y in zip(a[k], b[k], strict=True)] for k in b}

    def step(self, sums: dict[int, list[np.ndarray]]) -> None:
        """New models from statistics of all rows; numbers of clusters that are done or can't be fitted close."""
        self.turn += 1
        for k, ((n, ll), weight, first, second) in sums.items():
            if math.isfinite(self.likelihood[k]) and abs(ll - self.likelihood[k]) < self.tol * n or self.turn > self.rounds:
                self.likelihood[k] = ll
                self.open.discard(k)
                continue
            self.likelihood[k] = ll
            weight = weight + 1e-10
            mean = first / weight[:, None]
            cov = second / weight[:, None, None] - np.einsum("ki,kj->kij", mean, mean) + self.ridge * np.eye(mean.shape[1])
            try:
                self.models[k] = weight / n, mean, np.linalg.cholesky(cov)
            except np.linalg.LinAlgError:  # this number of clusters can't be fitted
                self.likelihood[k] = -math.inf
                self.open.discard(k)

    def score(self, k: int, n: int, d: int) -> float:
        return bic(self.likelihood[k], n, k, d) if math.isfinite(self.likelihood[k]) and self.models[k] else math.inf


def _fit_local(mixtures: Mixtures, blocks: list[tuple[np.ndarray, np.ndarray]], most: int) -> Mixtures:
    for _ in range(most):
        mixtures.start([r for r in (mixtures.draw(k, x) for k, x in blocks) if r])
    while mixtures.open:
        sums = None
        for _, x in blocks:
            sums = mixtures.add(sums, mixtures.statistics(x))
        mixtures.step(sums)
    return mixtures


def _fit_spread(mixtures: Mixtures, blocks: DataFrame, most: int) -> Mixtures:
    """The same over a checkpoint of blocks (block, keys, x); what comes back a round is a row of sums for each block's turn."""
    sc = blocks.sparkSession.sparkContext

    def over(f):
        shared = sc.broadcast(mixtures)

        def run(batches):
            for b in batches:
                out = [(r["block"], pickle.dumps(f(shared.value, *_unpacked(r)))) for r in b.to_pylist()]
                yield pa.RecordBatch.from_pylist([{"block": k, "v": v} for k, v in out], schema=pa.schema([("block", pa.int32()), ("v", pa.binary())]))

        # put in order here: a sort by ranges would make every row twice, once for its sample
        rows = sorted(blocks.mapInArrow(run, "block int, v binary").collect(), key=lambda r: r["block"])
        return (pickle.loads(r["v"]) for r in rows)

    for _ in range(most):
        mixtures.start([r for r in over(lambda m, k, x: m.draw(k, x)) if r])
    while mixtures.open:
        sums = None
        for s in over(lambda m, k, x: m.statistics(x)):
            sums = mixtures.add(sums, s)
        mixtures.step(sums)
    return mixtures


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(row["keys"], "<i8")
    return keys, np.frombuffer(row["x"], "<f8").reshape(len(keys), -1)


def _blocks(reduced: DataFrame, key: str, n: int) -> DataFrame:
    """(block, keys, x): rows by blocks of about BLOCK, by a hash of the key, each in the order of keys."""
    count = max(1, n // BLOCK)

    def pack(group: pa.Table) -> pa.Table:
        keys = np.asarray(group.column(key), dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        x = np.array(group.column("f").to_pylist(), dtype="<f8")[order]
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "keys": [keys[order].astype("<i8").tobytes()], "x": [x.tobytes()]})

    rows = reduced.select(F.col(key).cast("long").alias(key), vector_to_array("features").alias("f"), F.pmod(F.xxhash64(key), F.lit(count)).cast("int").alias("block"))
    return cut(rows.groupBy("block").applyInArrow(pack, "block int, keys binary, x binary"))


def reduce_dimensions(nodes: DataFrame, k: int, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(key, features): principal components of the unit vectors, k of them, or fewer for short vectors."""
    unit = cut(nodes.select(key, array_to_vector(normalised(vector).cast("array<double>")).alias("v")))  # read three times
    width = len(nodes.select(vector).first()[0])
    model = PCA(k=min(k, width), inputCol="v", outputCol="features").fit(unit)
    return model.transform(unit).select(key, "features")


def soft_clusters(nodes: DataFrame, components: int, max_clusters: int = 15, threshold: float = 0.5, key: str = "id", seed: int = 42) -> DataFrame:
    """(cluster_id, key, p): every membership that reaches the threshold. nodes should be materialised."""
    n = nodes.count()
    if n <= components + 1 or n <= 2:  # too few to reduce: one cluster of all
        return nodes.select(F.lit(0).alias("cluster_id"), key, F.lit(1.0).alias("p"))
    reduced = reduce_dimensions(nodes, components, key)
    most = min(max_clusters, n - 1)
    if most < 2:
        return nodes.select(F.lit(0).alias("cluster_id"), key, F.lit(1.0).alias("p"))
    blocks = _blocks(reduced, key, n)
    numbers, d = range(2, most + 1), len(reduced.first()["features"])
    out = pa.schema([("k", pa.int32()), ("bic", pa.float64()), (key, pa.int64()), ("cluster_id", pa.int32()), ("p", pa.float64())])

    def members(mixtures: Mixtures, k: int, keys: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        post, _ = mixtures.posteriors(k, x)
        at, cluster = np.nonzero(post >= threshold)
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip((np.full(len(at), k), np.full(len(at), mixtures.score(k, n, d)), keys[at], cluster, post[at, cluster]), out, strict=True)], schema=out)

    ddl = f"k int, bic double, {key} long, cluster_id int, p double"
    if n <= LOCAL_ROWS:

        def fit(group: pa.Table) -> pa.Table:
            rows = sorted(group.to_pylist(), key=lambda r: r["block"])
            parts, k = [_unpacked(r) for r in rows], rows[0]["k"]
            fitted = _fit_local(Mixtures([k], seed), parts, k)
            return pa.Table.from_batches([members(fitted, k, *p) for p in parts] if math.isfinite(fitted.score(k, n, d)) else [], schema=out)

        fits = cut(blocks.withColumn("k", F.explode(F.array(*[F.lit(k) for k in numbers]))).groupBy("k").applyInArrow(fit, ddl))
        best = fits.agg(F.min_by("k", F.struct("bic", "k")).alias("k")).first()["k"]
        found = fits.where(F.col("k") == best) if best is not None else None
    else:
        fitted = _fit_spread(Mixtures(numbers, seed), blocks, most)
        best = min((k for k in numbers if math.isfinite(fitted.score(k, n, d))), key=lambda k: (fitted.score(k, n, d), k), default=None)
        shared = blocks.sparkSession.sparkContext.broadcast(fitted)

        def assign(batches):
            for b in batches:
                for r in b.to_pylist():
                    yield members(shared.value, best, *_unpacked(r))

        found = blocks.mapInArrow(assign, ddl) if best is not None else None
    if found is None:
        return nodes.select(F.lit(0).alias("cluster_id"), key, F.lit(1.0).alias("p"))
    return found.select("cluster_id", F.col(key).cast(nodes.schema[key].dataType).alias(key), "p")


def over_threshold(posteriors: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The memberships (p) that reach the threshold."""
    return posteriors.where(F.col("p") >= threshold)


def summaries(members: DataFrame, level: int, summariser: TextProvider, embedder: Embedder, config: EngineConfig) -> DataFrame:
    """Nodes of the next level from members of clusters; clusters whose summary is empty give none."""
    inputs = cluster_inputs(members, config.summary_input_chars).withColumn("text", T.truncate("text", config.summary_input_chars))
    made = complete(inputs, summariser, SUMMARY, "text", "summary").where("summary <> ''")
    out = made.select(
        "cluster_id", T.unit_id(F.concat_ws("\x1f", F.lit(level), "cluster_id", "summary")).alias("id"), F.col("summary").alias("text"), F.col("summary").alias("original_text"), "document_id", "source",
        T.level_title(F.lit(level)).alias("title"), F.size(F.split(F.trim("summary"), r"\s+")).alias("n_tokens"), F.lit(level).alias("level"), "children_ids",
    )
    return embed(out, embedder, batch=config.embedding_batch_size)


def build(leaves: DataFrame, summariser: TextProvider, embedder: Embedder, config: EngineConfig | None = None, kept: bool = False) -> DataFrame:
    """All nodes: leaves and up to max_tree_levels levels of summaries, with parent links.

    leaves: NODE columns with level 0 and embeddings, plus seq, the order of nodes. Equal texts stay separate leaves. kept: leaves
    are read from a stored table, and no copy is made of them.
    """
    config = config or EngineConfig()
    leaves = leaves.withColumn("seq", F.col("seq").cast("long"))
    done, current = [], leaves if kept else stored(leaves)
    for level in range(1, config.max_tree_levels + 1):
        if current.count() < config.min_cluster_size:
            break
        assigned = cut(soft_clusters(current.select("seq", "embedding"), config.components(level), config.max_clusters, config.cluster_threshold, "seq"))
        members = assigned.join(current, "seq").withColumnRenamed("seq", "pos")
        made = cut(summaries(members, level, summariser, embedder, config))
        if not made.head(1):
            break
        # the last cluster that holds a node is its parent
        parents = assigned.join(made.select("cluster_id", F.col("id").alias("_parent")), "cluster_id").groupBy("seq").agg(F.max_by("_parent", "cluster_id").alias("_parent"))
        done.append(current.join(parents, "seq", "left").withColumn("parent_id", F.coalesce("_parent", "parent_id")).drop("_parent"))
        seq = F.row_number().over(Window.orderBy("cluster_id")).cast("long") - 1  # at most max_clusters rows
        nxt = made.withColumn("seq", seq).drop("cluster_id").withColumn("parent_id", F.lit(None).cast("string"))
        for c in leaves.columns:
            if c not in nxt.columns:
                nxt = nxt.withColumn(c, F.lit(None).cast(leaves.schema[c].dataType))
        current = cut(nxt.select(*leaves.columns))
    out = current
    for d in done:
        out = out.unionByName(d)
    return out
