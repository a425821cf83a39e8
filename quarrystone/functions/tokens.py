"""Tokens: white-space tokens as Column expressions by default, any tokenizer with encode and decode as a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .batches import parts
from .stem import OWN, Stems
from .text import _c, is_blank


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...
    def decode(self, tokens: list[int]) -> str: ...


def tokens(text: Column | str) -> Column:
    """White-space tokens; a blank text has none."""
    plain = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def count_tokens(text: Column | str) -> Column:
    return F.size(tokens(text))


# The lexical index's stop-words, and the characters of its longest token.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or "
    "because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t "
    "can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split(" ")
LONGEST = 40


def lexical_tokens(text: Column | str) -> Column:
    """Lower-cased tokens without punctuation, stop-words and overlong tokens, for the lexical index; not stemmed yet."""
    plain = F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(plain, r"\s+"), lambda x: (x != "") & ~x.isin(*STOP_WORDS) & (F.length(x) <= LONGEST))


def like(stems: Sequence[str]) -> Callable[[Column], Column]:
    """Whether a token may have one of these stems: stems keep their words' first two letters, but for those of a single letter
    and the listed exceptions. Spares most tokens of a text the way to the stemmer; equality is tested after it."""
    two, one = sorted({s[:2] for s in stems if len(s) > 1}), sorted({s for s in stems if len(s) == 1})
    odd = sorted(w for w, s in OWN.items() if s in stems)
    return lambda x: F.substring(x, 1, 2).isin(two) | F.substring(x, 1, 1).isin(one) | x.isin(odd)


_STEMS = Stems()


def stem_counts(rows: DataFrame, key: str, words: str, length: str, only: Sequence[str] | None = None) -> DataFrame:
    """(key, token, tf, length): a row for each different stem of a row's words. Nothing is shuffled.

    Each batch goes to Python once, where parts of a bounded number of words are handled at a time; a part's different words are
    stemmed, everything else is arithmetic on their numbers.
    """
    wanted = None if only is None else frozenset(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, end - at) for whole in batches for at, end in parts(whole.column(1))):
            lists = b.column(1)
            each = lists.flatten().dictionary_encode()
            stems = [_STEMS[w] for w in each.dictionary.to_pylist()]
            names = sorted({s for s in stems if wanted is None or s in wanted})
            if not names:
                continue
            place = {s: i for i, s in enumerate(names)}
            number = np.array([place.get(s, -1) for s in stems])[each.indices.to_numpy()]
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            pair, tf = np.unique((row * len(names) + number)[number >= 0], return_counts=True)
            at = pa.array(pair // len(names))
            yield pa.RecordBatch.from_arrays([pc.take(b.column(0), at), pc.take(pa.array(names), pa.array(pair % len(names))), pa.array(tf), pc.take(b.column(2), at)], names=[key, "token", "tf", length])

    schema = StructType([rows.schema[key], StructField("token", StringType()), StructField("tf", LongType()), StructField(length, IntegerType())])
    return rows.select(key, words, length).mapInArrow(run, schema)


def stem_lists(rows: DataFrame, key: str, words: str, length: str) -> DataFrame:
    """(key, length, tokens, tfs): what stem_counts counts, in one row for each row that has words; tokens in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, end - at) for whole in batches for at, end in parts(whole.column(1))):
            lists = b.column(1)
            each = lists.flatten().dictionary_encode()
            stems = [_STEMS[w] for w in each.dictionary.to_pylist()]
            names = sorted(set(stems))
            if not names:
                continue
            place = {s: i for i, s in enumerate(names)}
            number = np.array([place[s] for s in stems])[each.indices.to_numpy()]
            row = np.repeat(np.arange(b.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
            pair, tf = np.unique(row * len(names) + number, return_counts=True)
            head = np.flatnonzero(np.diff(pair // len(names), prepend=-1))
            ends, at = pa.array(np.append(head, len(pair)), pa.int32()), pa.array(pair[head] // len(names))
            tokens = pc.take(pa.array(names), pa.array(pair % len(names)))
            yield pa.RecordBatch.from_arrays([pc.take(b.column(0), at), pc.take(b.column(2), at), pa.ListArray.from_arrays(ends, tokens), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], names=[key, length, "tokens", "tfs"])

    schema = StructType([rows.schema[key], StructField(length, IntegerType()), StructField("tokens", ArrayType(StringType())), StructField("tfs", ArrayType(IntegerType()))])
    return rows.select(key, words, length).mapInArrow(run, schema)


def encoded(tokenizer: Tokenizer):
    """text -> array of token numbers. A tokenizer that works on columns (tokens, texts) does so."""
    if hasattr(tokenizer, "tokens"):
        return tokenizer.tokens

    @F.pandas_udf("array<int>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else list(tokenizer.encode(t)) for t in text], dtype=object)

    return run


def decoded(tokenizer: Tokenizer):
    if hasattr(tokenizer, "texts"):
        return tokenizer.texts
    @F.pandas_udf("string")
    def run(numbers: pd.Series) -> pd.Series:
        return pd.Series([None if n is None else tokenizer.decode(list(n)) for n in numbers], dtype=object)

    return run
