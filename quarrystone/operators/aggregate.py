"""Ordered concatenation, statistics and the other grouped operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def ordered_concat(value: Column | str, order: Column | str, by: str) -> Column:
    """Aggregate: the values joined in ascending order of `order`. A group's text has to fit a string (2 GB)."""
    pairs = F.array_sort(F.collect_list(F.struct(T._c(order).alias("o"), T._c(value).alias("v"))))
    return F.array_join(F.transform(pairs, lambda x: x["v"]), by)


def concat_by_source(docs: DataFrame, seq: str = "seq", bits: int = 512) -> DataFrame:
    """One document for each source: texts joined in order, metadata of the first, and the document id."""
    first = lambda c: F.min_by(c, seq).alias(c)
    known = [c for c in ("title", "creation_date") if c in docs.columns]
    out = docs.groupBy("source").agg(ordered_concat("text", seq, T.DOCUMENT_JOIN).alias("text"), F.count("*").alias("n_parts"), F.min(seq).alias("first_seq"), *map(first, known))
    return out.withColumn("document_id", T.document_id("source", "text", bits))


def ingest_stats(chunks: DataFrame, price: float = 0.02) -> DataFrame:
    """Chunks, tokens, distinct sources, whole mean of tokens, and the price of embedding them."""
    total = F.coalesce(F.sum("n_tokens"), F.lit(0))
    return chunks.agg(F.count("*").alias("n_chunks"), total.cast("long").alias("total_tokens"), F.count_distinct("source").alias("n_sources"), F.floor(total / F.greatest(F.count("*"), F.lit(1))).alias("mean_tokens"), F.round(total * price / 1e6, 6).alias("cost"))


def level_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("level").agg(F.count("*").alias("n"))


def mode_first(df: DataFrame, group: str, value: str, pos: str) -> DataFrame:
    """(group, value): the most frequent value of each group, ties to the one seen first. Two aggregations, no window."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", (-F.col("first")).alias("f"))).alias(value))


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """df with `batch`: the row's number in ascending order of `order`, divided by size.

    The numbers need no single task: rows are dealt to quantile ranges of `order`, counted by range, and numbered within.
    """
    if size < 1:
        raise ValueError("size has to be positive")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = df.where(F.col(order).isNotNull())
    bounds = sorted(set(some.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01))) if parts > 1 and some.head(1) else []
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    ranged = df.withColumn("_part", F.coalesce(part, F.lit(0)))
    counts = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, rows = 0, []
    for p in sorted(counts):
        rows.append((p, before))
        before += counts[p]
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows or [(0, 0)], "_part int, _before long"))
    number = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1 + F.col("_before")
    return ranged.join(offsets, "_part").withColumn("batch", F.floor(number / size)).drop("_part", "_before")


def numbered(df: DataFrame, *order: str, to: str = "seq") -> DataFrame:
    """df with `to`: the row's number, from 0, in ascending order. Sorted by ranges and stored; nothing is in one task."""
    from ..functions.checkpoints import stored

    at = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = at.withColumn("_part", F.shiftright("_at", 33))
    before, rows = 0, []
    for r in sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # one row for each partition
        rows.append((r["_part"], before))
        before += r["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows or [(0, 0)], "_part long, _before long"))
    return placed.join(offsets, "_part").withColumn(to, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_at")


def cluster_inputs(members: DataFrame, most: int | None = None) -> DataFrame:
    """What a summary is made from. members: cluster_id, pos, id, original_text, source, document_id.

    Texts and child ids in member order with repeats, the first document, the source seen most (ties to the first).

    most: texts that begin after so many characters of their cluster are left out of its text before it is joined, for a
    reader that takes no more than that. Positions come from sums by slot of `pos`, so no cluster is one task's.
    """
    text = F.col("original_text")
    if most is not None:
        slot = members.withColumn("_slot", F.floor(F.col("pos") / 4096)).withColumn("_n", F.coalesce(F.length("original_text") + len(T.PASSAGE_JOIN), F.lit(0)))
        sums = slot.groupBy("cluster_id", "_slot").agg(F.sum("_n").alias("_s"))
        before = F.sum("_s").over(Window.partitionBy("cluster_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
        starts = sums.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") <= most + len(T.PASSAGE_JOIN)).select("cluster_id", "_slot", "_before")
        within = F.sum("_n").over(Window.partitionBy("cluster_id", "_slot").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
        members = slot.join(starts, ["cluster_id", "_slot"], "left").withColumn("_at", F.col("_before") + F.coalesce(within, F.lit(0)))
        text = F.when(F.col("_at") <= most + len(T.PASSAGE_JOIN), text)
    ordered = members.withColumn("_text", text).groupBy("cluster_id").agg(
        ordered_concat("_text", "pos", T.PASSAGE_JOIN).alias("text"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("children_ids"),
        F.min_by("document_id", "pos").alias("document_id"),
        F.count("*").alias("n_members"),
    )
    return ordered.join(mode_first(members, "cluster_id", "source", "pos"), "cluster_id")


def document_index(children: DataFrame) -> DataFrame:
    """(id, source, children): the distinct child ids of each node of each source, in order, joined with commas."""
    each = children.groupBy("id", "source").agg(F.array_sort(F.collect_set("child")).alias("_c"))
    return each.select("id", "source", F.array_join("_c", ",").alias("children"))


def status_rows(points: DataFrame) -> DataFrame:
    """(collection, points, status) of collections' points."""
    return points.groupBy("collection").agg(F.count("*").alias("points")).withColumn("status", F.lit("green"))


def multi_assigned(assignments: DataFrame) -> DataFrame:
    """Nodes in more than one cluster."""
    return assignments.groupBy("id").agg(F.count("*").alias("n_clusters")).where("n_clusters > 1")


def run_summary(nodes: DataFrame, collection: str) -> DataFrame:
    """One row: sources, chunks, total_nodes, levels, collection."""
    levels = nodes.groupBy("level").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("levels"))
    one = nodes.agg(F.array_sort(F.collect_set("source")).alias("sources"), F.count_if(F.col("level") == 0).alias("chunks"), F.count("*").alias("total_nodes"))
    return one.join(levels, how="cross").withColumn("collection", F.lit(collection))  # one row by one row


def thread_history(turns: DataFrame) -> DataFrame:
    """One row for each conversation: its turns in order."""
    line = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    return turns.groupBy("conv_id").agg(ordered_concat(line, "turn", "\n").alias("history"), F.count("*").alias("n_turns"))
