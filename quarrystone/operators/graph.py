"""Entities and relations. These operators come from a design, not from shipped behaviour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import cut
from .aggregate import ordered_concat


def merge_entities(found: DataFrame) -> DataFrame:
    """(name, type, description, source, chunk_id): by name; descriptions appended in order, the rest of the last seq."""
    last = lambda c: F.max_by(c, "seq").alias(c)
    return found.groupBy("name").agg(last("type"), ordered_concat("description", "seq", " | ").alias("description"), last("source"), last("chunk_id"))


def merge_renamed(found: DataFrame, names: DataFrame) -> DataFrame:
    """merge_entities of found with the names (name, canonical; each name once) replaced; names that aren't listed stay.

    Descriptions move to their own names, and only those of listed names once more: as the list comes as rows of the same
    grouping, there is no join that they would move for. A canonical name that has mentions of its own has to be listed too.
    """
    item = F.struct("seq", "description", "type", "source", "chunk_id")
    rows = found.select("name", item.alias("_item"), F.lit(None).cast("string").alias("_to"))
    rows = rows.unionByName(names.select("name", F.lit(None).cast(rows.schema["_item"].dataType).alias("_item"), F.col("canonical").alias("_to")))
    each = rows.groupBy("name").agg(F.collect_list("_item").alias("_items"), F.max("_to").alias("_to")).where(F.size("_items") > 0)
    listed = each.where("_to is not null").groupBy(F.col("_to").alias("name")).agg(F.flatten(F.collect_list("_items")).alias("_items"))
    ordered = each.where("_to is null").select("name", "_items").unionByName(listed).select("name", F.array_sort("_items").alias("_items"))
    last = lambda c: F.element_at("_items", -1)[c].alias(c)
    description = F.array_join(F.transform("_items", lambda x: x["description"]), " | ").alias("description")
    return ordered.select("name", last("type"), description, last("source"), last("chunk_id"))


def merge_relations(found: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(source, target, description, strength): by all but strength, of which the last stays, 5 by default.

    entities: relations whose ends aren't both in there are dropped.
    """
    if entities is not None:
        names = entities.select("name").distinct()
        for end in ("source", "target"):
            found = found.join(names.withColumnRenamed("name", end), end, "left_semi")
    return found.groupBy("source", "target", "description").agg(F.max_by(F.coalesce("strength", F.lit(5)), "seq").alias("strength"))


def search_entities(entities: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Entities whose name or description contains the query (its first 200 characters), whatever the case; by name."""
    q = F.lower(F.lit(query[:200]))
    hit = F.contains(F.lower("name"), q) | F.contains(F.lower("description"), q)
    return entities.where(F.coalesce(hit, F.lit(False))).orderBy("name").limit(limit)


def neighbourhood(entities: DataFrame, relations: DataFrame, limit: int = 30) -> DataFrame:
    """(name, type, description, relation, neighbour, strength): edges in either direction, the strongest first.

    entities: the few found by a search. An entity without an edge drops out.
    """
    out = relations.select("source", F.col("description").alias("relation"), F.col("target").alias("neighbour"), "strength")
    back = relations.select(F.col("target").alias("source"), F.col("description").alias("relation"), F.col("source").alias("neighbour"), "strength")
    edges = out.unionByName(back).withColumnRenamed("source", "name")
    return edges.join(entities.select("name", "type", "description"), "name").orderBy(F.desc("strength"), "name", "neighbour", "relation").limit(limit)


def format_context(edges: DataFrame) -> DataFrame:
    """One row, graph_context: each entity's line once, where it is first met, then its relations. edges: a top-k list."""
    order = Window.orderBy(F.desc("strength"), "name", "neighbour", "relation")
    rows = edges.withColumn("i", F.row_number().over(order))
    rows = rows.withColumn("new", F.row_number().over(Window.partitionBy("name").orderBy("i")) == 1)
    head = F.format_string("**%s** (%s): %s\n", "name", F.coalesce("type", F.lit("None")), F.coalesce("description", F.lit("None")))
    line = F.concat(F.when(F.col("new"), head).otherwise(F.lit("")), F.format_string("  -> %s -> **%s** (strength: %s/10)", "relation", "neighbour", F.col("strength").cast("string")))
    return rows.agg(F.concat(F.lit("Knowledge graph context:\n"), ordered_concat(line, "i", "\n")).alias("graph_context"))


def expand(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """(parent_id, id): the children of hits in a tree."""
    return nodes.join(hits.select("id"), "id", "left_semi").select(F.col("id").alias("parent_id"), F.explode("children_ids").alias("id"))


def reach(links: DataFrame, seeds: DataFrame, up: bool = False, most: int | None = None) -> DataFrame:
    """(seed, id, distance): what can be reached from seeds (id) over links (parent_id, id), downwards or up, seeds themselves at 0.

    Any number of levels, at most `most`. A round joins what the last one found with the links and drops what its seed has seen,
    so cycles end and every pair comes once, with its least distance. Nulls are no ends of links. (A recursive SQL expression
    would stop at a number of rows and carry each row's path to tell cycles.)
    """
    step = links.where("parent_id is not null and id is not null").select(*[F.col(c).alias(a) for c, a in zip(("id", "parent_id") if up else ("parent_id", "id"), ("_from", "_to"), strict=True)]).distinct()
    new = cut(seeds.where("id is not null").select(F.col("id").alias("seed"), "id", F.lit(0).alias("distance")).distinct())
    seen, distance = new, 0
    while (most is None or distance < most) and not new.isEmpty():
        distance += 1
        found = new.join(step, F.col("id") == F.col("_from")).select("seed", F.col("_to").alias("id")).distinct()
        new = cut(found.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("distance", F.lit(distance)))
        seen = seen.unionByName(new)
    return seen
