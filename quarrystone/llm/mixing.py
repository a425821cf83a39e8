"""Mixing sources to target weights by min-cost flow.

Documents that belong to the same sources form one membership pattern; only patterns are counted, so the flow network has
patterns and sources as nodes, not documents. Pattern p can give its words to each of its sources once at no cost, then
again at a cost that rises with each repetition (convex); a source takes as many words as its quota. The cheapest flow
that fills the quotas as far as the repetition limit lets it says how many words of each pattern are taken, and for whom.

Documents are then selected by a seeded hash, without sorting any pattern in one task: every pattern's words are summed
over a fixed number of hash slots, the slot in which the wanted amount is reached is found from the sums, and documents
are ordered within that slot alone. All documents of a pattern get the whole repetitions, the selected ones one more.

Null source: a source of its own, after all others in code point order. Null, empty and wordless texts have size 0 and
take nothing. A repeated row is a document of its own, selected together with its copies. An empty table gives an empty
result.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Hash slots per pattern; a slot holds a 65,536th of a pattern.
SLOTS = 1 << 16
#: Patterns that the driver's network takes at most.
MAX_PATTERNS = 100_000
#: Costs of the first, second, ... time a pattern is taken.
REPETITION_COSTS = (0, 1, 3, 7, 15, 31, 63, 127)


def words(text: Column | str) -> Column:
    """How many [^\\x20\\x09-\\x0D]+ a text has; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Shares of total by weight, each at most `most` times its size; what is over is shared among the rest by weight."""
    out, full = [0.0] * len(sizes), [False] * len(sizes)
    while True:
        left = total - sum(most * s for s, f in zip(sizes, full, strict=True) if f)
        weight = sum(w for w, f in zip(weights, full, strict=True) if not f)
        out = [most * s if f else (left * w / weight if weight else 0.0) for s, w, f in zip(sizes, weights, full, strict=True)]
        over = [o > most * s and not f for o, s, f in zip(out, sizes, full, strict=True)]
        if not any(over):
            return out
        full = [f or o for f, o in zip(full, over, strict=True)]


def min_cost_flow(patterns: Mapping[tuple, int], quotas: Mapping[object, int], most: int = 2) -> dict[tuple, dict[object, int]]:
    """Words that each pattern gives each of its sources; successive shortest paths over patterns and sources.

    patterns: the size of each tuple of sources. A pattern gives its size up to `most` times; the k-th time costs
    REPETITION_COSTS[k] a word. Quotas are filled as far as possible, at the least cost; ties go to the first names.
    """
    names = list(patterns)
    sources = list(quotas)
    of_pattern = {p: 1 + i for i, p in enumerate(names)}
    of_source = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    sink = 1 + len(names) + len(sources)
    graph: list[list[list]] = [[] for _ in range(sink + 1)]  # edges: to, capacity, cost, index of the reverse edge

    def edge(a, b, capacity, cost):
        graph[a].append([b, capacity, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p, size in patterns.items():
        for k in range(most):
            edge(0, of_pattern[p], size, REPETITION_COSTS[min(k, len(REPETITION_COSTS) - 1)])
        for s in p:
            if s in of_source:
                edge(of_pattern[p], of_source[s], most * size, 0)
    for s, quota in quotas.items():
        edge(of_source[s], sink, quota, 0)
    potential = [0] * (sink + 1)
    while True:
        dist, via = [float("inf")] * (sink + 1), [None] * (sink + 1)
        dist[0], heap = 0, [(0, 0)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for i, (b, capacity, cost, _) in enumerate(graph[a]):
                if capacity and d + (c := cost + potential[a] - potential[b]) < dist[b]:
                    dist[b], via[b] = d + c, (a, i)
                    heapq.heappush(heap, (dist[b], b))
        if dist[sink] == float("inf"):
            break
        potential = [p + (d if d < float("inf") else 0) for p, d in zip(potential, dist, strict=True)]
        path, b = [], sink
        while via[b]:
            a, i = via[b]
            path.append((a, i))
            b = a
        amount = min(graph[a][i][1] for a, i in path)
        for a, i in path:
            e = graph[a][i]
            e[1] -= amount
            graph[e[0]][e[3]][1] += amount
    named = {v: s for s, v in of_source.items()}
    return {p: {named[b]: graph[b][r][1] for b, _, _, r in graph[of_pattern[p]] if b in named and graph[b][r][1]} for p in names}


def select(sized: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """sized (with _qs_p: pattern number, _qs_size) plus _qs_times: how often each row is taken.

    wanted: (_qs_p, amount), the words to take from each pattern, with _qs_total its size; a small table. Each row is taken
    amount // total times, and as many more rows once more as bring the sum nearest to the amount.
    """
    spark = sized.sparkSession
    h = F.xxhash64("doc_id", "text", F.lit(seed))
    rows = sized.withColumn("_qs_h", h).withColumn("_qs_slot", F.pmod(F.xxhash64("_qs_h"), F.lit(SLOTS)).cast("int"))
    more = wanted.select("_qs_p", F.floor(F.col("amount") / F.col("_qs_total")).cast("int").alias("_qs_whole"), (F.col("amount") % F.col("_qs_total")).alias("_qs_more"))
    # the sum over slots: at most SLOTS rows a pattern
    sums = cut(rows.groupBy("_qs_p", "_qs_slot").agg(F.sum("_qs_size").alias("s")))
    before = F.sum("s").over(Window.partitionBy("_qs_p").orderBy("_qs_slot").rowsBetween(Window.unboundedPreceding, -1))
    edge = sums.withColumn("_qs_before", F.coalesce(before, F.lit(0))).join(F.broadcast(more), "_qs_p")
    edge = edge.where("_qs_before <= _qs_more and _qs_more < _qs_before + s").select("_qs_p", F.col("_qs_slot").alias("_qs_edge"), "_qs_before")
    plan = more.join(edge, "_qs_p", "left").select("_qs_p", "_qs_whole", "_qs_more", F.coalesce("_qs_edge", F.lit(-1)).alias("_qs_edge"), F.coalesce("_qs_before", F.lit(0)).alias("_qs_before")).collect()
    plan = F.broadcast(spark.createDataFrame([tuple(r) for r in plan], "_qs_p int, _qs_whole int, _qs_more long, _qs_edge int, _qs_before long"))
    # within the one slot of each pattern: a row is taken while more than half of it is still wanted
    inside = rows.join(plan, "_qs_p").where("_qs_slot = _qs_edge").groupBy("_qs_p", "_qs_h").agg(F.sum("_qs_size").alias("s"), F.max("_qs_more").alias("_qs_more"), F.max("_qs_before").alias("_qs_before"))
    inside = inside.withColumn("c", F.col("_qs_before") + F.sum("s").over(Window.partitionBy("_qs_p").orderBy("_qs_h")))
    chosen = inside.where("s > 0 and c - s / 2 <= _qs_more").select("_qs_p", "_qs_h", F.lit(True).alias("_qs_in"))
    planned = rows.join(plan, "_qs_p")
    return planned.join(cut(chosen), ["_qs_p", "_qs_h"], "left").withColumn("_qs_times", F.col("_qs_whole") + (F.coalesce("_qs_in", F.lit(False)) | (F.col("_qs_slot") < F.col("_qs_edge"))).cast("int"))


def mix(docs: DataFrame, sources: Column | None = None, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target and taken.

    sources: an array column of the sources a document belongs to; its source column alone by default. Sources by code
    point, null last, weigh `weights`, repeating. source_size and target are summed over a document's sources.
    """
    spark = docs.sparkSession
    pattern = F.array_sort(F.array_distinct(sources)) if sources is not None else F.array("source")
    pattern = F.transform(pattern, lambda s: F.coalesce(F.concat(F.lit("="), s), F.lit("")))  # "": the null source
    key = F.to_json(pattern)
    sized = docs.withColumn("_qs_size", words("text")).withColumn("_qs_key", key)
    counted = sized.groupBy("_qs_key").agg(F.max(pattern).alias("sources"), F.sum("_qs_size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(counted) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources")
    patterns = {tuple(r["sources"]): int(r["size"]) for r in sorted(counted, key=lambda r: r["_qs_key"])}
    names = sorted({s for p in patterns for s in p}, key=lambda s: (s == "", s))
    size = {s: sum(n for p, n in patterns.items() if s in p) for s in names}
    target = dict(zip(names, targets([size[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], share * sum(patterns.values()), most), strict=True))
    flow = min_cost_flow(patterns, {s: round(t) for s, t in target.items()}, most)
    number = {r["_qs_key"]: i for i, r in enumerate(sorted(counted, key=lambda r: r["_qs_key"]))}
    table = [(number[r["_qs_key"]], r["_qs_key"], sum(flow[tuple(r["sources"])].values()), max(1, int(r["size"])), sum(size[s] for s in r["sources"]), float(sum(target[s] for s in r["sources"]))) for r in counted]
    known = spark.createDataFrame(table, "_qs_p int, _qs_key string, amount long, _qs_total long, source_size long, target double")
    sized = sized.join(F.broadcast(known.select("_qs_p", "_qs_key", "source_size", "target")), "_qs_key")
    taken = select(sized, known.select("_qs_p", "amount", "_qs_total"), seed)
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    return taken.select(*own, F.col("_qs_size").alias("size"), "source_size", "target", (F.col("_qs_size") * F.col("_qs_times")).alias("taken"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
