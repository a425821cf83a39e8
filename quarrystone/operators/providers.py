"""Providers: embedding, enrichment, summarising and translating, run in Arrow batches on the executors.

A provider is an object with the one method named below; it is pickled to the executors. The defaults are deterministic
and need no network. Outputs of a costly or random provider have to be materialised before they are read twice.
"""

from __future__ import annotations

import hashlib
import logging
import time
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import cut

log = logging.getLogger(__name__)


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class TextProvider(Protocol):
    def complete(self, prompt: str) -> str: ...


class TransientError(Exception):
    """What a provider raises for rate limits and time-outs; anything else is not tried again."""


@lru_cache(maxsize=1 << 17)
def _word_hash(w: str) -> int:
    return int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")


class HashedEmbedder:
    """Unit vectors from hashed words: texts that share words are close."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            ws = t.lower().split()
            h = np.fromiter(map(_word_hash, ws), dtype=np.uint64, count=len(ws))
            at = (h % np.uint64(self.dimensions)).astype(np.int64)
            v = np.bincount(at, weights=np.where(h >> np.uint64(63), 1.0, -1.0), minlength=self.dimensions).astype(np.float32)
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return out


class LeadingWords:
    """Summary by the first words of the text after the prompt's first line."""

    def __init__(self, words: int = 60):
        self.words = words

    def complete(self, prompt: str) -> str:
        return " ".join(prompt.partition("\n")[2].split()[: self.words])


class Retrying:
    """An embedder with back-off 1, 2, 4, ... seconds on transient errors: retries + 1 attempts."""

    def __init__(self, inner: Embedder, retries: int = 3, sleep: Callable[[float], None] = time.sleep):
        self.inner, self.retries, self.sleep = inner, retries, sleep

    def embed(self, texts: list[str]) -> list[list[float]]:
        for attempt in range(self.retries + 1):
            try:
                return self.inner.embed(texts)
            except TransientError as e:
                if attempt == self.retries:
                    raise
                log.warning("attempt %d failed: %s", attempt + 1, e)
                self.sleep(2**attempt)
        raise AssertionError


class Kept:
    """A provider whose answers are stored by a hash of its name, the instruction and the text, in a folder of the cluster.

    embed() and complete() then ask for each different text once a run, and only for those that no run has asked for; answers
    are stored before they are used, so a run that fails later finds them. Empty answers (failures) aren't stored. The name
    has to change with whatever changes the answers, such as a model or a temperature.
    """

    def __init__(self, spark: SparkSession, inner: Embedder | TextProvider, name: str, path: str):
        self.spark, self.inner, self.name, self.path = spark, inner, name, path.rstrip("/")

    def _stored(self, folder: str, schema: str) -> DataFrame:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder)

    def through(self, df: DataFrame, text: str, to: str, kind: str, instruction: str, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """df with column `to`: stored answers, and those of ask(rows without one), which get stored."""
        folder, schema = f"{self.path}/{'vectors' if kind != 'string' else 'answers'}", f"_qs_asked string, _qs_answer {kind}"
        asked = F.sha2(F.concat_ws("\x00", F.lit(self.name), F.lit(instruction), F.coalesce(F.col(text), F.lit(""))), 256)
        rows = cut(df.withColumn("_qs_asked", asked))
        once = rows.groupBy("_qs_asked").agg(F.first(text).alias(text))
        made = ask(once.join(self._stored(folder, schema), "_qs_asked", "left_anti")).select("_qs_asked", F.col(to).alias("_qs_answer"))
        made.where(F.col("_qs_answer") != "" if kind == "string" else F.col("_qs_answer").isNotNull()).write.mode("append").parquet(folder)
        answers = self._stored(folder, schema).groupBy("_qs_asked").agg(F.first("_qs_answer").alias("_qs_answer"))  # two runs may have asked at once
        answer = F.coalesce("_qs_answer", F.lit("")) if kind == "string" else F.col("_qs_answer")
        return rows.drop(to).join(answers, "_qs_asked", "left").withColumn(to, answer).drop("_qs_asked", "_qs_answer")


def embed(df: DataFrame, embedder: Embedder | Kept, text: str = "text", batch: int = 100, to: str = "embedding") -> DataFrame:
    """df with a vector for each row's text; rows keep their identity, so order doesn't matter."""
    if isinstance(embedder, Kept):
        return embedder.through(df, text, to, "array<float>", "", lambda rows: embed(rows, embedder.inner, text, batch, to))

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = [t or "" for t in s]
            out: list[list[float]] = []
            for i in range(0, len(texts), batch):
                out += embedder.embed(texts[i : i + batch])
            yield pd.Series(out, dtype=object)

    return df.withColumn(to, run.asNondeterministic()(text))  # or a filter on the answer would have it asked for twice


def complete(df: DataFrame, provider: TextProvider | Kept, instruction: str, text: str, to: str) -> DataFrame:
    """df with the provider's answer to instruction + text; a failure is logged and gives an empty answer."""
    if isinstance(provider, Kept):
        return provider.through(df, text, to, "string", instruction, lambda rows: complete(rows, provider.inner, instruction, text, to))

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for t in s:
                try:
                    out.append((provider.complete(f"{instruction}\n{t or ''}") or "").strip())
                except Exception:
                    log.exception("no answer")
                    out.append("")
            yield pd.Series(out, dtype=object)

    return df.withColumn(to, run.asNondeterministic()(text))  # or a filter on the answer would have it asked for twice


def translate(df: DataFrame, provider: TextProvider, text: str = "text", size: int = 12_000) -> DataFrame:
    """df with text translated piece by piece and joined by newlines; all other columns and all repeated rows kept.

    Rows get numbers from a checkpoint; only number and piece go to the provider, and only they are shuffled with the answers.
    """
    from .chunking import char_windows

    key = "_qs_row"
    rows = cut(df).withColumn(key, F.monotonically_increasing_id())
    pieces = rows.select(key, F.posexplode(char_windows(text, size)).alias("_i", "_piece"))
    done = complete(pieces, provider, "Translate the following to English.", "_piece", "_piece")
    joined = done.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_piece"))), lambda x: x["_piece"]), "\n").alias("_qs_new"))
    new = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.col(text)).otherwise(F.col("_qs_new"))
    return rows.join(joined, key, "left").select(*[new.alias(c) if c == text else F.col(c) for c in df.columns])
