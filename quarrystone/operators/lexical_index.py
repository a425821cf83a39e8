"""A lexical index in blocks, for top-k that stops early.

Documents are ordered by length, so that those of a block have weights alike, and dealt to blocks of `size`. The index has a row
for each block and token: the greatest weight, and the documents with their weights. A query first reads only tokens, blocks and
greatest weights of its own tokens; their weighted sum bounds the score of every document of a block. The blocks of greatest
bounds are scored first; the k-th best score there is a threshold, and of the other blocks only those whose bound reaches it
are read. Every document lies in one block, so the result is that of scoring all of them.

A text without terms is in no block. Keys have to be unique, as a collection's are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.batches import parts
from ..functions.checkpoints import cut, stored
from ..functions.tokens import lexical_tokens, stem_lists
from .retrieval import query_terms, weight


def blocks(docs: DataFrame, key: str = "id", text: str = "text", size: int = 8) -> DataFrame:
    """(token, block, top, keys, weights) of docs; a task's rows are ordered by token, so that a reader skips most of a file.

    Write it, or cut it: a query reads it three times. A document's terms stay one row until its block is built. One shuffle
    deals these rows to ranges of length; a block is built within a task, from `size` documents, and moves no more.
    """
    words = docs.select(key, lexical_tokens(text).alias("_w"))
    each = stem_lists(words.select(key, "_w", F.size("_w").alias("_n")), key, "_w", "_n")
    each = stored(each)  # ranges are found by a pass over the rows, which shall not stem all texts again
    each = each.repartitionByRange("_n", key).sortWithinPartitions("_n", key)
    kind = to_arrow_type(each.schema[key].dataType)

    def made(rows: pa.Table, first: int) -> pa.RecordBatch:
        """The blocks of rows, the first of which begins block `first`."""
        tokens, tfs = (pa.concat_arrays([c.flatten() for c in rows.column(x).chunks]) for x in ("tokens", "tfs"))
        tokens = tokens.dictionary_encode()
        count = np.concatenate([pc.list_value_length(c).to_numpy() for c in rows.column("tokens").chunks])
        n, tf = np.repeat(rows.column("_n").to_numpy(), count).astype(np.float64), tfs.to_numpy().astype(np.float64)
        row = np.repeat(np.arange(rows.num_rows), count)
        place = row // size * len(tokens.dictionary) + tokens.indices.to_numpy()  # of block and token
        order = np.argsort(place, kind="stable")
        place, weights = place[order], weight(tf, n)[order]
        begin = np.flatnonzero(np.diff(place, prepend=-1))
        ends = pa.array(np.append(begin, len(order)), pa.int32())
        block, token = np.divmod(place[begin], len(tokens.dictionary))
        keys = rows.column(key).combine_chunks().take(pa.array(row[order]))
        return pa.RecordBatch.from_arrays(
            [tokens.dictionary.take(pa.array(token)), pa.array(first + block), pa.array(np.maximum.reduceat(weights, begin)), pa.ListArray.from_arrays(ends, keys.cast(kind)), pa.ListArray.from_arrays(ends, pa.array(weights))],
            names=["token", "block", "top", "keys", "weights"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 33, None
        for b in (whole.slice(at, end - at) for whole in batches for at, end in parts(whole.column(whole.schema.get_field_index("tokens")))):
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if full := held.num_rows // size:
                yield made(held.slice(0, full * size), block)
                block, held = block + full, held.slice(full * size)
        if held is not None and held.num_rows:
            yield made(held, block)

    schema = T.StructType().add("token", "string").add("block", "long").add("top", "double").add("keys", T.ArrayType(each.schema[key].dataType)).add("weights", T.ArrayType(T.DoubleType()))
    return each.mapInArrow(run, schema).sortWithinPartitions("token", "block")


def bounds(index: DataFrame, words: Sequence[str], weights: DataFrame) -> DataFrame:
    """(block, bound): no document of a block scores more. Reads three short columns of the query's tokens."""
    top = index.where(F.col("token").isin(list(words))).select("token", "block", "top").join(F.broadcast(weights), "token")
    return top.groupBy("block").agg(F.sum(F.col("top") * F.col("query_weight")).alias("bound"))


def topk(index: DataFrame, query: str, k: int, key: str = "id", first: int = 8, report: dict | None = None) -> DataFrame:
    """(key, score) of the k best, as lexical_topk without idf. first: blocks that set the threshold.

    report: gets how many blocks hold any term of the query, and how many were read.
    """
    spark = index.sparkSession
    terms = [tuple(r) for r in query_terms(spark, query).collect()]
    words = [t for t, _ in terms]
    weights = spark.createDataFrame(terms, "token string, query_weight double")  # one row a word
    reach = cut(bounds(index, words, weights))  # a row a block
    kind = index.schema["keys"].dataType.elementType

    def scored(chosen: DataFrame) -> DataFrame:
        rows = index.where(F.col("token").isin(words)).select("token", "block", "keys", "weights").join(chosen.select("block"), "block", "left_semi").join(F.broadcast(weights), "token")
        hits = rows.select("query_weight", F.inline(F.arrays_zip(F.col("keys").alias("_k"), F.col("weights").alias("_v")))).toDF("query_weight", key, "_v")
        return hits.groupBy(key).agg(F.sum(F.col("_v") * F.col("query_weight")).alias("score"))

    leading = reach.orderBy(F.desc("bound"), "block").limit(first)
    best = [tuple(r) for r in scored(leading).orderBy(F.desc("score"), key).limit(k).collect()]
    least = best[-1][1] * (1 - 1e-9) if len(best) == k else -1.0
    rest = reach.join(F.broadcast(leading.select("block")), "block", "left_anti").where(F.col("bound") >= least)
    if report is not None:
        report |= {"blocks": reach.count(), "read": min(first, reach.count()) + rest.count()}
    found = spark.createDataFrame(best, T.StructType().add(key, kind).add("score", "double")).unionByName(scored(rest))
    return found.orderBy(F.desc("score"), key).limit(k)
