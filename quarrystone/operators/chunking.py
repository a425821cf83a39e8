"""Chunking: sliding token windows, fixed character windows, a recursive splitter, and enrichment."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..functions.tokens import Tokenizer, count_tokens, decoded, encoded, tokens
from ..schema import ENRICHMENT


def windows(items: Column, size: int, overlap: int) -> Column:
    """Array of windows of an array: starts 0, size - overlap, ...; the last is the first that reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be at least 0 and below size")
    last = F.greatest(F.size(items) - overlap, F.lit(1)) - 1
    starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
    return F.transform(starts, lambda i: F.slice(items, i + 1, size))


def chunk(docs: DataFrame, size: int = 450, overlap: int = 90, tokenizer: Tokenizer | None = None, text: str = "text") -> DataFrame:
    """docs exploded to chunks: chunk_index, original_text, n_tokens. Blank texts give none; other columns are carried.

    The default tokens never leave the JVM; a plug-in tokenizer encodes and decodes in Arrow batches.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be at least 0 and below size")
    items = encoded(tokenizer)(text) if tokenizer else tokens(text)
    some = docs.where(~T.is_blank(text)).withColumn("_items", items)
    cut = some.select(*[c for c in docs.columns if c != text], F.posexplode(windows(F.col("_items"), size, overlap)).alias("chunk_index", "_window"))
    cut = cut.where(F.size("_window") > 0)  # not before: a filter on the items would have a plug-in encode each text twice
    joined = decoded(tokenizer)("_window") if tokenizer else F.array_join("_window", " ")
    return cut.withColumn("original_text", joined).withColumn("n_tokens", F.size("_window")).drop("_window")


def char_windows(text: Column | str, size: int = 12_000) -> Column:
    """Consecutive pieces of size characters; an empty text gives none."""
    t = T._c(text)
    n = F.coalesce(F.length(t), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size))
    return F.when(n > 0, F.transform(starts, lambda i: F.substring(t, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def recursive_split(text: str, size: int = 500, overlap: int = 50, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most size characters, split at the coarsest separator that serves, overlapping by whole splits."""
    if len(text) <= size:
        return [text] if text.strip() else []
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :] or ("",)
    parts = list(text) if sep == "" else text.split(sep)
    out: list[str] = []
    held: list[str] = []

    def flush():
        if joined := sep.join(held).strip():
            out.append(joined)

    for part in parts:
        if len(part) > size:
            flush()
            held.clear()
            out += recursive_split(part, size, overlap, finer)
            continue
        if held and len(sep.join([*held, part])) > size:
            flush()
            while held and (len(sep.join(held)) > overlap or len(sep.join([*held, part])) > size):
                held.pop(0)
        held.append(part)
    flush()
    return out


def recursive_pieces(text: Column | str, size: int = 500, overlap: int = 50) -> Column:
    """recursive_split as an array, in Arrow batches; null and blank texts give none."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([recursive_split(t or "", size, overlap) for t in texts], dtype=object)

    return run(T._c(text))


def register_recursive_split(spark, name: str = "recursive_split") -> None:
    """A table function: SELECT * FROM name(text, size, overlap)."""

    @F.udtf(returnType="piece_index int, piece string")
    class Split:
        def eval(self, text: str, size: int, overlap: int):
            yield from enumerate(recursive_split(text or "", size, overlap))

    spark.udtf.register(name, Split)


def enrich(chunks: DataFrame, answers: Column | str | None = None) -> DataFrame:
    """Adds context, document_section, chunk_role, entities, the enriched text, and n_tokens counted on it.

    answers: the provider's JSON for each chunk. Without one, a rule-based enricher that stays in the JVM: the chunk's
    opening words, its number, its place in the document, its longer capitalised words.
    """
    made = T.parse_enrichment(answers, ENRICHMENT) if answers is not None else rule_enrichment()
    out = chunks.withColumn("_e", made).select("*", "_e.*").drop("_e")
    out = out.withColumn("text", T.enriched_text("document_section", "chunk_role", "entities", "context", "original_text"))
    return out.withColumn("n_tokens", count_tokens("text"))


def rule_enrichment() -> Column:
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("original_text", F.lit("([A-Z][a-z]{5,})"), F.lit(1))))
    return F.struct(
        F.array_join(F.slice(F.split("original_text", " "), 1, 12), " ").alias("context"),
        F.concat(F.lit("Part "), (F.col("chunk_index") + 1).cast("string")).alias("document_section"),
        F.when(F.col("chunk_index") == 0, F.lit("definition")).when(F.col("n_tokens") < 450, F.lit("conclusion")).otherwise(F.lit("evidence")).alias("chunk_role"),
        F.slice(found, 1, 5).alias("entities"),
    )
