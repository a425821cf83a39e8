"""Indexing: sources -> documents -> chunks -> enriched units -> vectors -> tree -> points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import text as T
from ..functions.checkpoints import cut, stored
from ..functions.tokens import Tokenizer
from ..operators import tree
from ..operators.aggregate import concat_by_source, numbered, run_summary
from ..operators.chunking import chunk, enrich
from ..operators.providers import Embedder, HashedEmbedder, Kept, LeadingWords, Retrying, TextProvider, complete, embed
from ..operators.ropes import source_chunks
from ..schema import NODE
from ..sources.collections import Collections, last_wins, points
from ..sources.files import read_sources


def units(docs: DataFrame, config: EngineConfig, enricher: TextProvider | None = None, tokenizer: Tokenizer | None = None) -> DataFrame:
    """Leaf nodes (NODE columns, first_seq and chunk_index) from documents (source, text, title, seq): joined by source, cut, enriched.

    Rows with an error, of files or pages that can't be read, are left out. With a plug-in tokenizer, whose tokens may reach over the
    edges of rows, each source is one string; otherwise none is.
    """
    docs = docs.where("error is null") if "error" in docs.columns else docs
    if tokenizer:
        chunks = chunk(concat_by_source(docs), config.chunk_size, config.chunk_overlap, tokenizer)
    else:
        chunks = source_chunks(docs, config.chunk_size, config.chunk_overlap)
    if config.prepend_metadata:
        chunks = chunks.withColumn("original_text", F.concat(F.col("title"), F.lit("\n"), F.col("original_text")))
    if enricher:
        chunks = complete(chunks, enricher, "Describe this chunk as JSON.", "original_text", "_answer")
    made = enrich(chunks, "_answer" if enricher else None).withColumn("id", T.unit_id("text"))
    made = made.withColumn("level", F.lit(0))
    for f in NODE.fields:
        if f.name not in made.columns:
            made = made.withColumn(f.name, F.lit(None).cast(f.dataType))
    return made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in NODE.fields], "first_seq", "chunk_index")


def index(spark: SparkSession, sources: Sequence[str], collection: str, store: Collections, config: EngineConfig | None = None, embedder: Embedder | Kept | None = None, summariser: TextProvider | Kept | None = None, enricher: TextProvider | Kept | None = None, web: DataFrame | None = None) -> dict:
    """Index sources into a collection and return a summary. Missing sources are an error for the whole call."""
    config = config or EngineConfig()
    if not collection:
        raise ValueError("a collection name is needed")
    if not isinstance(embedder, Kept):
        embedder = Retrying(embedder or HashedEmbedder(config.embedding_dimensions), config.max_retries)
    docs = read_sources(spark, sources, web, strict=True)
    leaves = stored(embed(units(docs.withColumn("seq", F.col("ord") * (1 << 48) + F.col("seq")), config, enricher), embedder, batch=config.embedding_batch_size))
    nodes = cut(last_wins(tree.build(ordered(leaves), summariser or LeadingWords(), embedder, config, kept=True), "id", "seq"))
    store.upsert(collection, points(nodes.withColumn("seq", F.lit(0))))
    return run_summary(nodes, collection).first().asDict(recursive=True)


def ordered(leaves: DataFrame) -> DataFrame:
    """leaves with seq: their order by source, as the sources were given, and chunk. No path decides it but within a folder."""
    return numbered(leaves, "first_seq", "source", "chunk_index").drop("first_seq", "chunk_index")
