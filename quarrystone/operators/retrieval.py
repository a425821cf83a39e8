"""Dense and lexical top-k, rank fusion, packing to a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.tokens import count_tokens, lexical_tokens, like, stem_counts

# Saturation, length weight and mean length of the lexical weights.
K1, B, MEAN_LENGTH = 1.2, 0.75, 256.0


def dot(a: Column | str, b: Column | str) -> Column:
    wide = lambda c: T._c(c).cast("array<double>")
    return F.aggregate(F.zip_with(wide(a), wide(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column | str) -> Column:
    """A vector over its length; a null or zero vector stays as it is. Done once, when a node is written."""
    # the length is a lambda's variable: within the inner lambda it would be summed again for each number
    over = lambda n: F.when(n > 0, F.transform(T._c(v), lambda x: (x / n).cast("float"))).otherwise(T._c(v))
    return F.transform(F.array(F.sqrt(dot(v, v))), over)[0]


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null where either vector is null or zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def dense_topk(nodes: DataFrame, query: Sequence[float], k: int, key: str = "id", vector: str = "embedding", unit: bool = False) -> DataFrame:
    """(key, score) of the k nodes of highest cosine, ties by key; a zero vector has no cosine, so a zero query finds nothing.

    unit: both sides have length 1 already.
    The query is a literal, so this is one scan of two columns and a top-k in every task; nothing is shuffled but k rows.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    score = dot(vector, q) if unit else cosine(vector, q)
    return nodes.select(key, score.alias("score")).where("score is not null and not isnan(score)").orderBy(F.desc("score"), key).limit(k)


def dense_topk_many(nodes: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "embedding", block_bytes: int = 32 << 20) -> DataFrame:
    """(query_id, key, score, rank): for a stated set of queries (query_id, vector), the rows of dense_topk for each.

    Queries are broadcast in blocks of this size, each a pass over the nodes. Partial top-k lists of every batch meet by query,
    which keeps k rows. A matrix product picks the nodes of a batch that may be among the k; their scores are then summed in
    the order of dense_topk, so both agree to the last bit and ties go by key. Null and zero vectors find nothing.
    """
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    blocks = max(1, -(-n * width * 8 // block_bytes))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, {key} {nodes.schema[key].dataType.simpleString()}, score double"
    partial = nodes.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        rows = queries.where(block == b).select("query_id", "vector").collect()
        if rows:
            partial = partial.unionByName(_partial_topk(nodes, rows, k, key, vector, schema))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_cosine(a, b):
    """Cosines of the rows of two arrays, summed from the left like cosine(); NaN for zero vectors."""
    import numpy as np

    total = lambda x, y: np.cumsum(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))
    with np.errstate(invalid="ignore", divide="ignore"):
        return total(a, b) / np.sqrt(total(a, a) * total(b, b))


def unit_rows(a):
    """Rows over their lengths; zero rows stay zero."""
    import numpy as np

    n = np.linalg.norm(a, axis=1, keepdims=True)
    return a / np.where(n > 0, n, 1)


def _partial_topk(nodes: DataFrame, rows: list, k: int, key: str, vector: str, schema: str) -> DataFrame:
    """(query_id, key, score): the k best nodes of each batch for each query of a block."""
    import numpy as np
    import pandas as pd

    rows = [r for r in rows if r[1] is not None and None not in r[1] and np.any(r[1])]
    ids, matrix = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64)
    shared = nodes.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(frames):
        ids, matrix = shared.value
        for f in frames:
            if not len(f) or not len(ids):
                continue
            v = np.array(f[vector].tolist(), dtype=np.float64)
            unit = unit_rows(v)
            for at in range(0, len(ids), 256):
                s = unit_rows(matrix[at : at + 256]) @ unit.T
                m = min(k, s.shape[1])
                least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                q, t = np.nonzero(s >= least[:, None] - 1e-9)
                found = pd.DataFrame({"query_id": q + at, key: f[key].to_numpy()[t], "score": exact_cosine(matrix[q + at], v[t])}).dropna(subset="score")
                found = found.sort_values(["query_id", "score", key], ascending=[True, False, True]).groupby("query_id").head(k)
                yield found.assign(query_id=[ids[i] for i in found["query_id"]])

    fine = F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    return nodes.where(fine).select(key, vector).mapInPandas(run, schema)


def weight(tf: Column, length: Column) -> Column:
    """Term frequency, saturated, and set against the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / MEAN_LENGTH))


def postings(docs: DataFrame, key: str = "id", text: str = "text", only: Sequence[str] | None = None) -> DataFrame:
    """(key, token, tf, weight); a token is a string, so nothing collides. Terms are counted within rows: nothing is shuffled.

    only: other tokens are left out before rows are made of them, most before they leave the JVM.
    """
    words = docs.select(key, lexical_tokens(text).alias("_w"))
    kept = F.col("_w") if only is None else F.filter("_w", like(only))
    each = stem_counts(words.select(key, kept.alias("_w"), F.size("_w").alias("_n")), key, "_w", "_n", only)
    return each.select(key, "token", "tf", weight(F.col("tf").cast("double"), F.col("_n").cast("double")).alias("weight"))


def query_terms(spark, query: str) -> DataFrame:
    """(token, query_weight), by the documents' encoder; as few rows as the query has words."""
    return postings(spark.createDataFrame([(0, query)], "id int, text string")).select("token", F.col("weight").alias("query_weight"))


def lexical_topk(index: DataFrame, query: str, k: int, key: str = "id", idf: bool = False, n_docs: int | None = None) -> DataFrame:
    """(key, score) of the k best by the dot product of weights over shared tokens, ties by key.

    index: stored postings, or texts (key, text), of which only the query's terms become rows. idf: weights each token by its
    rarity among n_docs documents (rows of texts with any token) as well. The query's tokens are joined as a broadcast.
    """
    terms = query_terms(index.sparkSession, query).collect()
    words = [r["token"] for r in terms]
    stored = "token" in index.columns
    hits = index.where(F.col("token").isin(words)) if stored else postings(index, key, only=words)
    weights = index.sparkSession.createDataFrame([tuple(r) for r in terms], "token string, query_weight double")  # one row a word
    hits = hits.join(F.broadcast(weights), "token")
    part = F.col("weight") * F.col("query_weight")
    if idf:
        n = n_docs if n_docs is not None else index.select(key).distinct().count() if stored else index.where(F.size(lexical_tokens("text")) > 0).count()
        df = hits.groupBy("token").agg(F.count_distinct(key).alias("_df"))
        hits = hits.join(F.broadcast(df), "token")
        part = part * F.log(1 + (n - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    return hits.groupBy(key).agg(F.sum(part).alias("score")).orderBy(F.desc("score"), key).limit(k)


def rank_fusion(lists: Sequence[DataFrame], k: int = 60, key: str = "id") -> DataFrame:
    """(key, score): the sum over lists of 1 / (k + rank), ranks from 1 by descending score. Lists are top-k lists: short."""
    every = None
    for x in lists:
        ranked = x.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("r"))
        every = ranked if every is None else every.unionByName(ranked)
    return every.groupBy(key).agg(F.sum(1.0 / (F.col("r") + k)).alias("score"))


def with_passages(hits: DataFrame, passage: Column) -> DataFrame:
    """hits with `passage`, the block that is shown, and passage_tokens, counted on all of it: what a budget is spent on."""
    return hits.withColumn("passage", passage).withColumn("passage_tokens", count_tokens("passage"))


def hybrid_topk(nodes: DataFrame, index: DataFrame, vector: Sequence[float], query: str, top_k: int = 10, rrf_k: int = 60, key: str = "id", where: Column | None = None) -> DataFrame:
    """(key, score): both lists of 2 * top_k fused; top_k 0 means 10. where: a filter on nodes, pushed into the scan."""
    top_k = top_k or 10
    if where is not None:
        nodes = nodes.where(where)
        index = index.where(where) if "token" not in index.columns else index.join(nodes.select(key), key, "left_semi")
    fused = rank_fusion([dense_topk(nodes, vector, 2 * top_k, key), lexical_topk(index, query, 2 * top_k, key)], rrf_k, key)
    return fused.orderBy(F.desc("score"), key).limit(top_k)


def pack(hits: DataFrame, budget: int = 1650, tokens: str = "passage_tokens", rank: str = "rank") -> DataFrame:
    """The longest prefix by rank whose tokens fit the budget; stops at the first that doesn't. hits: a top-k list."""
    run = F.sum(tokens).over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("_run", run).where(F.col("_run") <= budget).drop("_run")


def assemble(packed: DataFrame, passage: str = "passage", rank: str = "rank") -> DataFrame:
    """One row: passages_text, total_tokens, num_passages, levels_used."""
    from .aggregate import ordered_concat

    return packed.agg(
        ordered_concat(passage, rank, T.PASSAGE_JOIN).alias("passages_text"), F.coalesce(F.sum("passage_tokens"), F.lit(0)).cast("long").alias("total_tokens"),
        F.count("*").alias("num_passages"), F.array_sort(F.collect_set("raptor_tree_node_level")).alias("levels_used"),
    )
