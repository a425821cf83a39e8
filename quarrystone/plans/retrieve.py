"""Retrieval: query -> two ranked lists -> fusion -> passages -> a context within the budget."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as T
from ..operators.providers import Embedder, HashedEmbedder
from ..operators.retrieval import assemble, hybrid_topk, pack, with_passages
from ..sources.collections import Collections


def hits(points: DataFrame, query: str, top_k: int = 10, config: EngineConfig | None = None, embedder: Embedder | None = None, where: Column | None = None, index: DataFrame | None = None) -> DataFrame:
    """Ranked passages: rank, context, document_section, chunk_role, entities, original_text, raptor_tree_node_level, n_tokens, score.

    index: stored postings (pid, token, tf, weight), as index() keeps them; without it the texts are read.
    """
    config = config or EngineConfig()
    vector = (embedder or HashedEmbedder(config.embedding_dimensions)).embed([query])[0]
    nodes = points.withColumnRenamed("dense", "embedding").withColumnRenamed("point_id", "pid")
    index = index if index is not None else nodes
    best = hybrid_topk(nodes, index, vector, query, top_k or config.top_k, config.rrf_k, "pid", where)
    found = nodes.join(F.broadcast(best), "pid")  # top_k rows
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "pid")))
    return ranked.select("rank", "context", "document_section", "chunk_role", "entities", "original_text", F.col("level").alias("raptor_tree_node_level"), "n_tokens", F.round("score", 4).alias("score"))


def context(found: DataFrame, budget: int = 1650) -> DataFrame:
    """One row: passages_text, total_tokens, num_passages, levels_used."""
    shown = T.passage("rank", "original_text", "raptor_tree_node_level", "document_section", "chunk_role", "entities", "score")
    return assemble(pack(with_passages(found, shown), budget))


def retrieve(store: Collections, query: str, collection: str, top_k: int = 10, config: EngineConfig | None = None, embedder: Embedder | None = None, where: Column | None = None) -> str:
    """JSON with the assembled passages, or with an error."""
    config = config or EngineConfig()
    if not collection:
        return json.dumps({"error": "a collection name is needed"})
    if not store.exists(collection):
        return json.dumps({"error": f"no collection {collection}"})
    index = store.postings(collection).withColumnRenamed("point_id", "pid")
    row = context(hits(store.read(collection), query, top_k, config, embedder, where, index), config.context_tokens).first()
    return json.dumps({"passages": row.asDict(recursive=True)}, ensure_ascii=False)


def status(store: Collections, collection: str | None = None) -> str:
    return json.dumps(store.status(collection), indent=2)
