"""Entities and relations from leaves: a provider's nested answers become tables, and names that are spelt alike become one.

Like graph.py, this comes from a design, not from shipped behaviour.
"""

from __future__ import annotations

import json
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import cut, release, stored
from ..functions.text import _c
from .graph import merge_renamed
from .providers import TextProvider, complete

INSTRUCTION = 'List entities and relations of this text as JSON: {"entities": [{"name", "type", "description"}], "relations": [{"source", "target", "description", "strength"}]}.'
ANSWER = "entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,description:string,strength:int>>, _broken string"


#: Rows of different grams that are broadcast; beyond, they are shuffled.
FEW = 200_000


class Extracted(NamedTuple):
    """entities (name, type, description, source, chunk_id, seq), relations (source, target, description, strength, chunk_id, seq)
    and errors (chunk_id, error); seq orders the items of all chunks, as merge_entities and merge_relations want it."""

    entities: DataFrame
    relations: DataFrame
    errors: DataFrame


class SentenceOpenings:
    """A provider by rule: capitalised words of four letters and more, described by the rest of their sentence, each followed by the next."""

    PATTERN = r"([A-Z][a-z]{3,})([^.\n]*)"

    def complete(self, prompt: str) -> str:
        found = re.findall(self.PATTERN, prompt.partition("\n")[2])
        entities = [{"name": n, "type": "word", "description": d.strip(" ")} for n, d in found]
        relations = [{"source": a, "target": b, "description": "then"} for (a, _), (b, _) in zip(found, found[1:], strict=False)]
        return json.dumps({"entities": entities, "relations": relations}, ensure_ascii=False)


def extract(nodes: DataFrame, provider: TextProvider, text: str = "original_text", key: str = "id", seq: str = "seq", source: str = "source") -> Extracted:
    """What the provider finds in the leaves (level 0) of nodes. Each leaf is asked about once: the answers are checkpointed.

    A null or empty answer (a provider that failed) and one that isn't JSON of this form are errors of their chunk, and give
    nothing else. Items without a name, or without both ends, are left out; null lists are empty.
    """
    leaves = nodes.where("level = 0").select(F.col(key).alias("chunk_id"), F.col(seq).alias("_seq"), F.col(source).alias("source"), F.col(text).alias("_text"))
    answers = complete(leaves, provider, INSTRUCTION, "_text", "_answer").drop("_text")
    parsed = F.from_json("_answer", ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    silent = F.coalesce(F.trim("_answer") == "", F.lit(True))
    answers = stored(answers.select("chunk_id", "_seq", "source", parsed.alias("_a"), silent.alias("_silent")))
    error = F.when(F.col("_silent"), "no answer").when(F.col("_a").isNull() | F.col("_a._broken").isNotNull(), "unreadable answer")
    answers = answers.withColumn("error", error)
    fine = answers.where("error is null")
    order = F.struct(F.col("_seq").alias("seq"), "pos").alias("seq")

    def items(of: str, *fields: str) -> DataFrame:
        rows = fine.select("chunk_id", "_seq", "source", F.posexplode(f"_a.{of}").alias("pos", "_x")).withColumnRenamed("source", "_source")
        return rows.select(*[F.trim(f"_x.{f}").alias(f) if f in ("name", "source", "target") else F.col(f"_x.{f}").alias(f) for f in fields], "_source", "chunk_id", order)

    entities = items("entities", "name", "type", "description").where("name <> ''").withColumnRenamed("_source", "source")
    relations = items("relations", "source", "target", "description", "strength").where("source <> '' and target <> ''").drop("_source")
    return Extracted(entities, relations, answers.where("error is not null").select("chunk_id", "error"))


def grams(name: Column | str, q: int = 3) -> Column:
    """The different runs of q characters of a name in lower case, with its beginning and end marked."""
    plain = F.concat(F.lit("\x02" * (q - 1)), F.lower(F.regexp_replace(F.trim(_c(name)), r"\s+", " ")), F.lit("\x03"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(plain) - (q - 1)), lambda i: F.substring(plain, i, F.lit(q))))


def candidates(names: DataFrame, percent: int = 80, q: int = 3, short: int = 32) -> DataFrame:
    """(a, b), a < b: distinct names (name) whose grams may have a Jaccard similarity of percent or more; no such pair is missed.

    Sets that are so alike share at least `least` grams of either, and so one of the rarest m - least + 1 and two of the rarest
    m - least + 2 of its m. Names of up to `short` grams, and those that may be like one, meet at two such grams, which few others
    have; longer ones, of which there would be many twos, at one. Of those that meet, sizes and bitmaps rule out most: two sets
    differ in at least as many grams as bitmaps do in bits. All that is shuffled to meet is one row a name and meeting place.
    """
    sets = names.withColumn("_g", grams("name", q))
    bits = F.aggregate("_g", F.lit(0).cast("long"), lambda s, g: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))))
    rows = sets.select("name", F.explode("_g").alias("gram"))
    often = cut(rows.groupBy("gram").agg(F.count("*").alias("_n")))
    often = F.broadcast(often) if often.count() <= FEW else often
    ordered = rows.join(often, "gram").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "gram"))), lambda x: x["gram"]).alias("_g"))  # as many as a name has letters
    m = F.size("_g")
    ordered = ordered.select("name", m.alias("_m"), bits.alias("_bits"), "_g", (m - F.floor((percent * m + 99) / 100).cast("int")).alias("_differ"))
    two = F.slice("_g", F.lit(1), F.col("_differ") + 2)
    twos = F.flatten(F.transform(two, lambda x, i: F.transform(F.slice(two, i + 2, F.size(two)), lambda y: F.xxhash64(x, y))))
    one = F.transform(F.slice("_g", F.lit(1), F.col("_differ") + 1), lambda x: F.xxhash64(x))
    least = F.col("_m") - F.col("_differ")
    some = F.array().cast("array<bigint>")
    # the lesser of two is short: both meet at twos, unless one gram may be all they share; else at ones
    places = F.concat(F.when((least <= short) & (F.col("_m") > 1), twos).otherwise(some), F.when((F.col("_m") > short) | (least <= 1), one).otherwise(some))
    met = ordered.select("name", "_m", "_bits", F.explode(places).alias("_key")).repartition("_key")
    a, b = (met.select("_key", *[F.col(c).alias(c + x) for c in ("name", "_m", "_bits")]) for x in "ab")
    both = F.col("_ma") + F.col("_mb")
    apart = both - 2 * F.floor((percent * both + 99 + percent) / (100 + percent))
    fits = (100 * F.least("_ma", "_mb") >= percent * F.greatest("_ma", "_mb")) & (F.bit_count(F.col("_bitsa").bitwiseXOR(F.col("_bitsb"))) <= apart)
    return a.join(b, "_key").where((F.col("namea") < F.col("nameb")) & fits).select(F.col("namea").alias("a"), F.col("nameb").alias("b")).distinct()


def alike(names: DataFrame, percent: int = 80, q: int = 3) -> DataFrame:
    """(a, b), a < b: names (name) whose grams have a Jaccard similarity of percent or more; every such pair."""
    known = stored(names.select("name").where("name is not null").distinct())
    known = known.repartition(int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # short rows, long work: not by their bytes
    pairs = cut(candidates(known, percent, q))
    full = pairs.select("a", "b", grams("a", q).alias("_ga"), grams("b", q).alias("_gb"))
    shared = F.size(F.array_intersect("_ga", "_gb"))
    return full.where(100 * shared >= percent * (F.size("_ga") + F.size("_gb") - shared)).select("a", "b")


def canonical(mentions: DataFrame, percent: int = 80) -> DataFrame:
    """(name, canonical) of mentions (name): of a name and those like it the most frequent, the first in order of equals."""
    n = cut(mentions.where("name is not null").groupBy("name").agg(F.count("*").alias("n")))
    pairs = alike(n, percent)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(n.select(F.col("name").alias("a"), F.col("name").alias("b")))
    best = both.join(n.withColumnRenamed("name", "b"), "b").groupBy("a").agg(F.min(F.struct((-F.col("n")).alias("n"), "b")).alias("_best"))
    return best.select(F.col("a").alias("name"), F.col("_best.b").alias("canonical"))


def merged(found: Extracted, percent: int = 80) -> DataFrame:
    """merge_entities of resolved(found).entities, in which descriptions are shuffled once; twice are those of names with a like one."""
    names = cut(canonical(found.entities, percent))
    other = names.where("name <> canonical")
    own = names.where("name = canonical").join(other.select("canonical").distinct(), "canonical", "left_semi").select("name", "canonical")
    names = cut(other.unionByName(own))
    release(names.sparkSession, again=2)  # what names were compared by would lie beside all descriptions
    return merge_renamed(found.entities, names)


def resolved(found: Extracted, percent: int = 80) -> Extracted:
    """found with canonical names in entities and at both ends of relations (ends that no entity names stay as they are)."""
    names = cut(canonical(found.entities, percent))

    def renamed(df: DataFrame, column: str) -> DataFrame:
        to = names.withColumnRenamed("name", column)
        return df.join(to, column, "left").withColumn(column, F.coalesce("canonical", column)).drop("canonical")

    entities = renamed(found.entities, "name").select(*found.entities.columns)
    return found._replace(entities=entities, relations=renamed(renamed(found.relations, "source"), "target").select(*found.relations.columns))
