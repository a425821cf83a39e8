"""Conversation prefix trie by prefix doubling, and the turns that a shared prefix saves.

Method. Every different turn (role, text) gets a dense number. Blocks of 2, 4, 8, ... turns that begin at multiples of their
length are named in rounds, each pairing the names of two halves; a prefix of d turns is composed of the blocks of d's binary
digits, longest first, again a round for each power of two. After about 2 log2(longest) rounds over ever fewer rows, each
prefix of each conversation has its node's number. Numbers are dense ranks in a distributed sort by (name, name, conversation),
so a pair that a third of all conversations share lies in many partitions, and no join has such a key.

Nodes are grouped counts. A node is represented by its smallest member, so a conversation represents a last stretch of its own
prefixes. Sums over subtrees need no walk over the trie: every node below v is represented by one member of v, so v's sum is
that of its members' sums, from the end of each conversation back to v, over the nodes the member represents.

Input rows (conv_id, turn, role, text). A null conv_id belongs to no conversation and is left out; a null role or text is
empty; turns are ordered by turn, null first, and turns of equal number by the SHA-256 hash of role and text; repeated rows are
turns of their own. Turns are told apart by that hash, so very long texts are shuffled as 32 bytes. Other columns take no part,
whatever their names. An empty table gives no node. A conversation may hold any share of all turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checkpoints import cut
from .ranged import arranged, numbered, running

#: Of a list of ids, what is hashed or handed on at once.
PART_BYTES = 1 << 20
NOTHING = hashlib.sha256(b"").hexdigest()


class Trie(NamedTuple):
    """turns (conv_id, d, turn_hash, n_chars, length); members (conv_id, d, node, n_chars, ends), with a row of d = 0 for each
    conversation; nodes (node, conv_id, depth, parent, parent_conv_id, n_convs, n_children, n_leaves, saved)."""

    turns: DataFrame
    members: DataFrame
    nodes: DataFrame


def turn_hash() -> Column:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def positions(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_hash, n_chars): the turns of each conversation from 1, as a checkpoint in that order."""
    n_chars = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_hash().alias("turn_hash"), n_chars.alias("n_chars"))
    rows = rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_one", F.lit(1).cast("long"))
    return running(arranged(rows, "conv_id", "turn", "turn_hash", "_at"), ["conv_id"], {"pos": "_one"}).select("conv_id", "pos", "turn_hash", "n_chars")


def plain(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of the conversations as they are, for build()."""
    turns = cut(positions(conversations))
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("length"))
    return turns.withColumnRenamed("pos", "d"), cut(lengths)


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of conversations that share openings: c begins with the first h = crc32(c) % most turns of conversation
    c - c % every, and goes on with its own turns after its first h."""
    own = cut(positions(conversations))
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % every
    opening = own.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("_base"))  # fewer than `most` rows a group
    opening = opening.agg(F.array_sort(F.collect_list(F.struct("pos", "turn_hash", "n_chars"))).alias("_opening"))
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("_n")).withColumn("_h", h).withColumn("_base", base).join(opening, "_base", "left")
    convs = convs.withColumn("_opening", F.filter(F.coalesce("_opening", F.array().cast("array<struct<pos:bigint,turn_hash:binary,n_chars:bigint>>")), lambda x: x["pos"] <= F.col("_h")))
    convs = convs.withColumn("_m", F.size("_opening").cast("long"))
    convs = cut(convs.select("conv_id", "_h", "_m", "_opening", (F.col("_m") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))).alias("length")))
    first = convs.select("conv_id", F.inline("_opening")).withColumnRenamed("pos", "d")
    rest = own.where(F.col("pos") > h).join(convs.select("conv_id", "_h", "_m"), "conv_id")
    rest = rest.select("conv_id", (F.col("_m") + F.col("pos") - F.col("_h")).alias("d"), "turn_hash", "n_chars")
    return first.unionByName(rest), convs.select("conv_id", "length")


def _named(turns: DataFrame, longest: int) -> DataFrame:
    """(conv_id, d, node) for d >= 1. turns: (conv_id, d, name), dense names. Node 0 is the root."""
    blocks = [turns.select("conv_id", (F.col("d") - 1).alias("i"), "name")]
    while 2 << (len(blocks) - 1) <= longest:
        half = F.when(F.col("i") % 2 == 0, F.col("name")), F.when(F.col("i") % 2 == 1, F.col("name"))
        both = blocks[-1].groupBy("conv_id", F.shiftright("i", 1).alias("i")).agg(F.max(half[0]).alias("a"), F.max(half[1]).alias("b")).where("a is not null and b is not null")
        named, _ = numbered(arranged(both, "a", "b", "conv_id", "i"), ["a", "b"], "name")
        blocks.append(named.select("conv_id", "i", "name"))
    done, free = None, 1
    for k in reversed(range(len(blocks))):
        last = blocks[k].where("i % 2 = 0").select("conv_id", F.shiftleft("i", k).alias("_e"), F.col("name").alias("b"))
        if done is None:
            both = last.where("_e = 0").withColumn("a", F.lit(0).cast("long"))  # twice as many turns are more than any has
        else:
            both = last.join(done.select("conv_id", F.col("d").alias("_e"), F.col("node").alias("a")), ["conv_id", "_e"], "left")
        both = both.select(F.coalesce("a", F.lit(0)).cast("long").alias("a"), "b", "conv_id", (F.col("_e") + (1 << k)).alias("d"))
        named, free = numbered(arranged(both, "a", "b", "conv_id", "d"), ["a", "b"], "node", free)
        named = cut(named.select("conv_id", "d", "node"))  # each later round reads it
        done = named if done is None else done.unionByName(named)
    return done


def build(turns: DataFrame, lengths: DataFrame) -> Trie:
    """The trie of turns (conv_id, d from 1 without gaps, turn_hash, n_chars) and lengths (conv_id, length), the latter a checkpoint."""
    turns = arranged(turns.join(lengths, "conv_id"), "turn_hash", "conv_id", "d")
    longest = lengths.agg(F.max("length")).first()[0] or 0
    prefixes = _named(numbered(turns, ["turn_hash"], "name")[0], longest)
    ends = F.col("d") == F.col("length")
    members = prefixes.join(turns, ["conv_id", "d"]).select("conv_id", "d", "node", "n_chars", ends.alias("ends"))
    zero = F.lit(0).cast("long")
    members = cut(members.unionByName(lengths.select("conv_id", zero.alias("d"), zero.alias("node"), zero.alias("n_chars"), (F.col("length") == 0).alias("ends"))))
    nodes = members.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("d").alias("depth"), F.count("*").alias("n_convs"),
        F.max("n_chars").alias("n_chars"), F.bool_and("ends").alias("_leaf"),
    )
    above = members.select("conv_id", (F.col("d") + 1).alias("depth"), F.col("node").alias("parent"))
    nodes = cut(nodes.join(above, ["conv_id", "depth"], "left"))
    return Trie(turns, members, _summed(members, nodes))


def _summed(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes with n_children, the parent's conv_id, and sums over subtrees."""
    own = nodes.select("conv_id", F.col("depth").alias("d"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("_saved"), F.col("_leaf").cast("long").alias("_leaves"))
    each = members.select("conv_id", "d", "node").join(own, ["conv_id", "d"], "left").fillna(0, ["_saved", "_leaves"]).withColumn("_up", -F.col("d"))
    back = running(arranged(each, "conv_id", "_up"), ["conv_id"], {"saved": "_saved", "n_leaves": "_leaves"})
    below = back.groupBy("node").agg(F.sum("saved").alias("saved"), F.sum("n_leaves").alias("n_leaves"))
    kids = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    first = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("_leaf").join(below, "node").join(kids, "node", "left").join(first, "parent", "left")
    return out.select("node", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved")


def ends_hashes(members: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end: of their ids, ascending and joined by commas.

    Ids are sorted by ranges. A node whose ids lie within one partition is hashed there; of others, parts of about part_bytes
    go, in order, through one hash, as SHA-256 asks for: no list of ids is ever whole in memory.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda *row: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["node", "at", "part", "ends_sha256"])
        node, at, held, size, torn = None, None, [], 0, True  # the first node may have begun before
        for b in batches:
            for n, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n != node and node is not None:
                    joined = b",".join(held)
                    yield out(node, at, joined, None) if torn else out(node, at, None, hashlib.sha256(joined).hexdigest())
                    held, size, torn = [], 0, False
                elif size >= part_bytes:
                    yield out(node, at, b",".join(held), None)
                    held, size, torn = [], 0, True
                if not held:
                    node, at = n, c
                held.append(b"%d" % c)
                size += len(held[-1]) + 1
        if held:
            yield out(node, at, b",".join(held), None)  # and the last may go on

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for b in batches:
            for n, part in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if n != node:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(part)
                else:
                    state.update(b",")
                    state.update(part)
        if state:
            done.append((node, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["node", "ends_sha256"])

    ids = arranged(members.where("ends").select("node", "conv_id"), "node", "conv_id")
    found = cut(ids.mapInArrow(parts, "node long, at long, part binary, ends_sha256 string"))
    torn = found.where("part is not null").repartition("node").sortWithinPartitions("node", "at").mapInArrow(whole, "node long, ends_sha256 string")
    return found.where("part is null").select("node", "ends_sha256").unionByName(torn)


def with_turns(trie: Trie, conversations: DataFrame) -> DataFrame:
    """The trie's nodes with role and text of their last turn (null for the root)."""
    said = conversations.select(turn_hash().alias("turn_hash"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["turn_hash"])
    last = trie.turns.select("conv_id", F.col("d").alias("depth"), "turn_hash")
    return trie.nodes.join(last, ["conv_id", "depth"], "left").join(said, "turn_hash", "left").drop("turn_hash")


def report(conversations: DataFrame) -> DataFrame:
    """The contract's rows, for rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    trie = build(*rebuilt(conversations))
    out = trie.nodes.join(ends_hashes(trie.members), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
