"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprint: texts are lower-cased in A-Z and split at [\\x20\\x09-\\x0D]+; each run of `width` words, joined by a space
(fewer words: all of them), gives an XXH64 with seed 42; a bit is 1 if set in over half of these hashes, repeats
included. No words (null, empty, blank): fingerprint 0, linked like any other.

Links: fingerprints at distance 1 to 3 meet at a variant between them, and only one of the two has to go two steps:

* fingerprints of odd parity emit their 64 neighbours; those of even parity emit themselves, their 64 neighbours, and
  the variants with two flipped bits in the same half. Any three differing bits hold two in one half (the fewest such
  pairs that every triple contains), so an even and an odd fingerprint at distance 3 meet; at distance 1 the even one
  itself is the meeting point; at distance 2 both parities meet at a common neighbour.
* members of a variant's group are linked to one of them, the centre: the odd ones are neighbours of the variant, so
  all within 1 + 2 bits of each member; without one, the variant itself is the centre; each link is verified by its
  distance. A group holds at most 1 + 64 + 992 distinct fingerprints, so none is large, and no pairs within it are
  listed.

Equal fingerprints are one node, whatever their number. Variants are shuffled as packed blocks, 8 bytes each.

Two passes: fingerprints that are close to many others list their links again at every variant they share. So the first pass
emits one-step variants only, 65 at most, which link all at 1 or 2 bits; the second emits all, carries what the first has
linked, and lists a link only where it joins two components, once a bucket.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, buckets_for, by_bucket, components, cut, keyed, mix, pieces, release, shuffle_partitions, slices, small_or_shuffled, table

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_U = np.uint64
ONE = _U(1) << np.arange(64, dtype=_U)
TWO = np.array([ONE[a] | ONE[b] for half in (range(32), range(32, 64)) for a, b in combinations(half, 2)], dtype=_U)
#: What each parity flips.
MASKS = (np.concatenate((np.zeros(1, _U), ONE, TWO)), ONE)
#: The same for fingerprints at 1 or 2 bits.
ONE_STEP = (np.concatenate((np.zeros(1, _U), ONE)), ONE)
#: Fingerprints whose variants a task emits, about.
NODES = 4096
#: Variants in a bucket, about.
BUCKET = 1 << 20
#: Rows of groups of texts that a task compares at once, about.
GROUPED = 1 << 16
#: Bytes of sets of shingles of groups of texts that a task compares at once, about.
SET_BYTES = 16 << 20
#: Cells in which shingles are counted, to tell common from rare ones.
CELLS = 1 << 22
#: Bits of a text's bitmap at most: 1 KB. Texts of up to some 18,000 shingles are told apart by them.
WIDEST = 1 << 13
#: Per byte value, its bits as counters of 8 bits.
_SPREAD = np.array([sum(1 << 8 * i for i in range(8) if b >> i & 1) for b in range(256)], dtype=_U)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive groups of hashes, the bits set in over half of each; an empty group: 0."""
    out = np.zeros(len(counts), dtype=_U)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))[full]
    parts = -(-counts[full] // 255)  # a counter of 8 bits holds 255
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    inner = np.arange(parts.sum()) - np.repeat(first, parts)
    at = np.repeat(begin, parts) + 255 * inner
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for byte in range(8):
        lanes = np.add.reduceat(_SPREAD[octets[:, byte]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(lanes, first, axis=0)
        bits = (2 * ones > counts[full][:, None]).astype(_U)
        out[full] |= (bits << np.arange(8, dtype=_U)).sum(axis=1, dtype=_U) << _U(8 * byte)
    return out


def text_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of every shingle."""
    found, carry = [], []
    hashed = xxhash.xxh64_intdigest
    for piece in pieces(text.translate(LOWER)):
        ws = carry + piece.split()
        if len(ws) >= width:
            line = b" ".join(ws)
            ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1)
            starts = np.concatenate(([0], ends[:-1]))[: len(ws) - width + 1].tolist()
            found += [hashed(line[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
        carry = ws[len(ws) - min(len(ws), width - 1) :] if width > 1 else []
    if not found and carry:
        found = [hashed(b" ".join(carry), 42)]
    return np.array(found, dtype=_U)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, _qs_th, fp): fp is the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("_qs_th", pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                each = [text_hashes(t, width) for t in as_bytes(part.column("text"))]
                fp = majority(np.concatenate(each), np.array([len(h) for h in each], dtype=np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("_qs_th"), pa.array(fp.view(np.int64))], schema=schema)

    return keyed(docs).mapInArrow(run, "doc_id long, _qs_th long, fp long")


_BLOCK = "bucket long, x binary, comp binary, counts binary"
_PA_BLOCK = pa.schema([("bucket", pa.int64()), ("x", pa.binary()), ("comp", pa.binary()), ("counts", pa.binary())])


def _blocks(t: int, x: np.ndarray, comps: np.ndarray, n: int, masks: tuple[np.ndarray, np.ndarray]):
    """The variants of fingerprints x of table t: one row for each bucket.

    A row has, by mask, the fingerprints whose variants by this mask are in the bucket, how many each mask has, and their
    components, less the fingerprints themselves: nothing but zeros, which compress, where most are alone.
    """
    odd = np.bitwise_count(x) & 1
    zs, ats, flips = [], [], []
    for parity, first in ((0, 0), (1, len(masks[0]))):
        at = np.flatnonzero(odd == parity)
        zs.append((masks[parity][:, None] ^ x[at][None, :]).ravel())
        ats.append(np.tile(at, len(masks[parity])))
        flips.append(np.repeat(np.arange(first, first + len(masks[parity]), dtype=np.int32), len(at)))
    at, flip, every = np.concatenate(ats), np.concatenate(flips), sum(map(len, masks))
    linked = comps ^ x
    for b, own in by_bucket((mix(np.concatenate(zs)) % _U(n)).astype(np.int64), n):
        which = at[own]
        other = linked[which]
        yield t * n + b, x[which].tobytes(), other.tobytes() if other.any() else b"", np.bincount(flip[own], minlength=every).astype("<u4").tobytes()


def star_links(z: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places (centre, member) for each variant in z that several fingerprints x share."""
    # the centre comes first in its group: an odd fingerprint next to an even variant, or the nearest
    order = np.lexsort((np.bitwise_count(x ^ z), 1 - (np.bitwise_count(x) & 1), z))
    z, x = z[order], x[order]
    head = np.concatenate(([True], z[1:] != z[:-1]))
    centre = np.maximum.accumulate(np.where(head, np.arange(len(z)), 0))
    keep = ~head & (np.bitwise_count(x[centre] ^ x) <= 3) & (x[centre] != x)
    return np.stack((order[centre[keep]], order[keep]), axis=1)


def meetings(nodes: DataFrame, masks: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(t, a, b): fingerprints of table t that meet at a variant and are at 3 bits or fewer, in different components.

    nodes: (t, fp, comp), distinct (t, fp); comp is fp where it is alone. One link for each pair of components and bucket.
    """
    spark = nodes.sparkSession
    count = nodes.count()
    tables = (nodes.agg(F.max("t")).first()[0] or 0) + 1
    each = sum(map(len, masks)) // 2
    n = max(2 * shuffle_partitions(spark) // tables, 1, count // tables * each // BUCKET)
    every = np.concatenate(masks)

    def emit(batches):
        for batch in batches:
            t, fp, comps = (np.asarray(batch.column(c), dtype=np.int64) for c in ("t", "fp", "comp"))
            for k in np.unique(t).tolist():
                own = np.flatnonzero(t == k)
                for at in range(0, len(own), 2 * NODES):
                    pick = own[at : at + 2 * NODES]
                    yield table(_blocks(k, fp[pick].view(_U), comps[pick].view(_U), n, masks), _PA_BLOCK)

    def meet(group: pa.Table) -> pa.Table:
        zs, xs, comps = [], [], []
        for x, c, counts in zip(*(group.column(k).to_pylist() for k in ("x", "comp", "counts")), strict=True):
            xs.append(np.frombuffer(x, dtype=_U))
            comps.append(xs[-1] ^ np.frombuffer(c, dtype=_U) if c else xs[-1])
            zs.append(xs[-1] ^ np.repeat(every, np.frombuffer(counts, "<u4")))
        z, x, comp = (np.concatenate(v) for v in (zs, xs, comps))
        order = np.argsort(z)  # most variants are of one fingerprint alone: those go first
        s = z[order]
        same = s[1:] == s[:-1]
        shared = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
        pair = shared[star_links(z[shared], x[shared])] if len(shared) else np.empty((0, 2), np.int64)
        pair = pair[comp[pair[:, 0]] != comp[pair[:, 1]]]
        if len(pair):
            pair = pair[np.unique(np.sort(comp[pair], axis=1), axis=0, return_index=True)[1]]
        found = np.sort(x[pair].view(np.int64), axis=1)
        return pa.table({"t": pa.array(np.full(len(found), group.column("bucket")[0].as_py() // n, np.int32)), "a": pa.array(found[:, 0]), "b": pa.array(found[:, 1])})

    # blocks are tasks times buckets: a task has enough fingerprints, of one table, for blocks worth their number
    dealt = nodes.repartitionByRange(-(-count // NODES) or 1, "t", "fp").select("t", "fp", "comp")
    return dealt.mapInArrow(emit, _BLOCK).groupBy("bucket").applyInArrow(meet, "t int, a long, b long")


def near(nodes: DataFrame) -> DataFrame:
    """(t, a, b): links of one-step variants, which join all fingerprints of a table at 1 or 2 bits. nodes: (t, fp)."""
    return meetings(nodes.select("t", "fp", F.col("fp").alias("comp")), ONE_STEP)


def far(nodes: DataFrame, roots: DataFrame, by: str = "fp") -> DataFrame:
    """(t, a, b): links that join what is at 3 bits or fewer and not in one component (node, root) yet. by: the node's column."""
    placed = nodes.join(roots, nodes[by] == roots["node"], "left").select("t", "fp", F.coalesce("root", "fp").alias("comp"))
    return meetings(cut(placed), MASKS)


def links(nodes: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints fp, enough to connect all that are at 3 bits or fewer."""
    named = cut(nodes.select(F.lit(0).alias("t"), "fp"))
    first = cut(near(named).select("a", "b").distinct())
    return first.union(far(named, components(first)).select("a", "b")).distinct()


def groups(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, _qs_th, fp, component_id): one row for each row of docs; component_id is the smallest doc_id reachable.

    Ties and repeated rows share a fingerprint and so a component. A null doc_id is in a component but never names one,
    unless all are null.
    """
    prints = cut(fingerprints(docs, width))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(nodes.select("fp")))
    mapped = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = mapped.join(mapped.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "_qs_th", "fp", "component_id")


def distinct_texts(part: pa.RecordBatch) -> pa.RecordBatch:
    """The first row of each text hash of a chunk: many copies cost what one does."""
    th = np.asarray(part.column("_qs_th"), dtype=np.int64)
    _, first = np.unique(th, return_index=True)
    return part if len(first) == len(th) else part.take(pa.array(np.sort(first)))


def word_set_fingerprints(docs: DataFrame, tables: int) -> DataFrame:
    """(th, fps): for each distinct text, `tables` independent fingerprints of its set of words."""
    schema = pa.schema([("th", pa.int64()), ("fps", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for part in map(distinct_texts, slices(batch)):
                each = [np.unique(text_hashes(t, 1)) for t in as_bytes(part.column("text"))]
                counts = np.array([len(h) for h in each], dtype=np.int64)
                every = np.concatenate(each)
                fps = np.stack([majority(mix(every ^ mix(np.full(1, t + 1, _U))), counts) for t in range(tables)], axis=1)
                yield pa.RecordBatch.from_arrays([part.column("_qs_th"), pa.array(list(fps.view(np.int64)), pa.list_(pa.int64()))], schema=schema)

    return keyed(docs).mapInArrow(run, "th long, fps array<long>").dropDuplicates(["th"])


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(th, s): the sets of shingles, sorted, of the texts whose hash th is wanted."""
    schema = pa.schema([("th", pa.int64()), ("s", pa.binary())])

    def sets(batches):
        for batch in batches:
            for part in slices(batch):
                yield table(zip(part.column("_qs_th").to_pylist(), [np.unique(text_hashes(t, width)).tobytes() for t in as_bytes(part.column("text"))], strict=True), schema)

    touched = cut(wanted.toDF("_qs_th"))
    texts = keyed(docs).join(small_or_shuffled(touched, 16), "_qs_th", "left_semi").dropDuplicates(["_qs_th"])
    return texts.mapInArrow(sets, "th long, s binary")


def verified(docs: DataFrame, edges: DataFrame, width: int, similarity: float) -> DataFrame:
    """The edges (a, b) between distinct texts, by hash, whose sets of shingles have at least this Jaccard similarity."""
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches):
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "s", "s2")), strict=True):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                if not either or both >= similarity * either:
                    out.append((a, b))
            yield table(out, pairs)

    shingled = cut(shingle_sets(docs, edges.select("a").union(edges.select("b")).distinct(), width))
    sided = edges.join(shingled.select(F.col("th").alias("a"), "s"), "a").join(shingled.select(F.col("th").alias("b"), F.col("s").alias("s2")), "b")
    return sided.mapInArrow(compare, "a long, b long")


def commonness(docs: DataFrame, width: int) -> tuple[np.ndarray, DataFrame]:
    """Per cell of shingle hashes, twice the log2 of how often its shingles occur, and (th, bits): every text's bitmap.

    The cells order shingles; no result depends on them. Both come from one pass over the texts.
    """
    schema = pa.schema([("block", pa.int32()), ("th", pa.int64()), ("x", pa.binary())])

    def count(batches):
        own = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for part in slices(batch):
                each = [text_hashes(t, width) for t in as_bytes(part.column("text"))]
                cell, n = np.unique((np.concatenate(each) % _U(CELLS)).astype(np.int64), return_counts=True)
                own[cell] += n.astype(np.uint32)
                texts, first = np.unique(np.asarray(part.column("_qs_th"), dtype=np.int64), return_index=True)
                yield table([(None, th, bitmap(np.unique(each[i]))) for th, i in zip(texts.tolist(), first.tolist(), strict=True)], schema)
        yield table([(b, None, x.tobytes()) for b, x in enumerate(np.array_split(np.minimum(own, 255).astype(np.uint8), 64)) if x.any()], schema)

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.uint8).astype(np.int64) for x in group.column("x").to_pylist())
        return pa.Table.from_batches([table([(group.column("block")[0].as_py(), None, (2 * np.log2(1 + total)).astype(np.uint8).tobytes())], schema)])

    found = cut(keyed(docs).mapInArrow(count, "block int, th long, x binary"))
    out = np.array_split(np.zeros(CELLS, np.uint8), 64)
    for r in found.where("block is not null").groupBy("block").applyInArrow(add, "block int, th long, x binary").collect():
        out[r["block"]] = np.frombuffer(r["x"], np.uint8)
    return np.concatenate(out), found.where("th is not null").select("th", F.col("x").alias("bits")).dropDuplicates(["th"])


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, so many that two sets of the similarity share one of theirs; of an empty set, 0."""
    if not len(shingles):
        return np.zeros(1, _U)
    most = len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1
    return shingles[np.lexsort((shingles, common[(shingles % _U(CELLS)).astype(np.int64)]))[:most]]


def bitmap(shingles: np.ndarray) -> bytes:
    """For each cell, whether an odd number of the shingles fall there. Cells: the next power of two, 256 to WIDEST.

    Two sets differ in at least as many shingles as their bitmaps do in bits. A bitmap whose halves are xored is the
    narrower one of the same set.
    """
    cells = min(max(256, 1 << (len(shingles) - 1).bit_length()), WIDEST)
    odd = np.bincount((mix(shingles) & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: list[bytes]) -> dict[int, tuple[int, np.ndarray]]:
    """By width: the first bitmap that has it, and all from there on at this width. bits: by ascending width."""
    width, out, wider = np.array([len(x) for x in bits]), {}, None
    for w in np.unique(width)[::-1].tolist():
        own = np.flatnonzero(width == w)
        rows = np.frombuffer(b"".join(bits[own[0] : own[-1] + 1]), _U).reshape(len(own), -1)
        if wider is not None:
            while wider.shape[1] > rows.shape[1]:
                wider = wider[:, : wider.shape[1] // 2] ^ wider[:, wider.shape[1] // 2 :]
            rows = np.concatenate((rows, wider))
        out[w], wider = (int(own[0]), rows), rows
    return out


def prefix_groups(docs: DataFrame, roots: DataFrame, width: int, similarity: float, commonest: np.ndarray) -> DataFrame:
    """(g, th, size): the texts, by hash, of each group that shares a shingle of its prefixes and has several roots.

    Complete: a pair of the similarity holds at least that share of the larger set in common, so the prefixes, taken in one
    order for all texts, meet. roots: (node, root) of what is linked already; commonest: of cells, see commonness().
    """
    spark = docs.sparkSession
    common = spark.sparkContext.broadcast(commonest)
    n = buckets_for(docs, 8 << 20, 2.0)
    blocks = pa.schema([("bucket", pa.int32()), ("h", pa.binary()), ("times", pa.binary()), ("rows", pa.binary())])

    def emit(batches):
        for batch in batches:
            for part in map(distinct_texts, slices(batch)):
                each = [np.unique(text_hashes(t, width)) for t in as_bytes(part.column("text"))]
                th, root = (np.asarray(part.column(c), dtype=np.int64) for c in ("_qs_th", "root"))
                # roots are mostly the texts themselves: their differences compress to nothing
                rows = np.column_stack((th, th ^ root, np.array([len(x) for x in each], np.int64)))
                first = [prefix(x, similarity, common.value) for x in each]
                h, row = np.concatenate(first), np.repeat(np.arange(len(first)), [len(x) for x in first])
                out = []
                for b, own in by_bucket((mix(h) % _U(n)).astype(np.int64), n):
                    which, times = np.unique(row[own], return_counts=True)
                    out.append((b, h[own].tobytes(), times.astype("<u4").tobytes(), rows[which].T.tobytes()))
                yield table(out, blocks)

    def meet(group: pa.Table) -> pa.Table:
        hs, parts = [], []
        for h, times, rows in zip(*(group.column(c).to_pylist() for c in ("h", "times", "rows")), strict=True):
            hs.append(np.frombuffer(h, _U))
            parts.append(np.repeat(np.frombuffer(rows, "<i8").reshape(3, -1), np.frombuffer(times, "<u4"), axis=1))
        h, rows = np.concatenate(hs), np.concatenate(parts, axis=1)
        order = np.lexsort((rows[0], h))
        h, rows = h[order], rows[:, order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (rows[0, 1:] != rows[0, :-1])))
        h, (th, off, size) = h[new], rows[:, new]
        head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        several = np.flatnonzero(np.minimum.reduceat(th ^ off, head) != np.maximum.reduceat(th ^ off, head))
        ends, seen, pick, numbers = np.concatenate((head[1:], [len(h)])), set(), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for g in several:
            key = xxhash.xxh128_digest(th[head[g] : ends[g]].tobytes())
            if key not in seen:  # else the same texts share another shingle
                seen.add(key)
                pick.append(np.arange(head[g], ends[g]))
                numbers.append(np.full(len(pick[-1]), h[head[g]].view(np.int64)))
        pick = np.concatenate(pick)
        return pa.table([np.concatenate(numbers), th[pick], size[pick]], names=["g", "th", "size"])

    placed = keyed(docs).join(small_or_shuffled(roots, 16), F.col("_qs_th") == F.col("node"), "left").select("text", "_qs_th", F.coalesce("root", "_qs_th").alias("root"))
    return placed.mapInArrow(emit, "bucket int, h binary, times binary, rows binary").groupBy("bucket").applyInArrow(meet, "g long, th long, size long")


def _dealt(groups: DataFrame, roots: DataFrame, more: DataFrame, rows: int) -> DataFrame:
    """The texts of groups (g, th, ...) that have several roots, with `more` of each text; about `rows` of them have a number _qs_n."""
    placed = groups.join(roots, groups["th"] == roots["node"], "left").select(*groups.columns, F.coalesce("root", "th").alias("root"))
    several = placed.groupBy("g").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("g")
    # most groups have a few texts: thousands are handled at once
    n = max(2 * shuffle_partitions(groups.sparkSession), groups.count() // rows)
    return placed.join(several, "g", "left_semi").join(more, "th").withColumn("_qs_n", F.pmod(F.xxhash64("g"), F.lit(n)))


def _each_group(group: pa.Table):
    """(g, th, size, root, bits) of each g, its texts by ascending size."""
    g, th, size, root = (np.asarray(group.column(c), dtype=np.int64) for c in ("g", "th", "size", "root"))
    order = np.lexsort((th, size, g))
    g, th, size, root, bits = g[order], th[order], size[order], root[order], group.column("bits").take(pa.array(order)).to_pylist()
    head = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    for a, b in zip(head.tolist(), [*head[1:].tolist(), len(g)], strict=True):
        yield g[a], th[a:b], size[a:b], root[a:b], bits[a:b]


def _pairs(th: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.sort(th[places], axis=1)


def prefix_pairs(groups: DataFrame, roots: DataFrame, bits: DataFrame, similarity: float) -> DataFrame:
    """(a, b): texts of a group, of different roots, whose sizes and bitmaps (th, bits) allow the similarity: of those so many
    that they join all that the others join, at most one less than a group has texts.
    """

    def run(group: pa.Table) -> pa.Table:
        out = [_pairs(th, _allowed(size, root, bits, similarity, lambda i, j: j)) for _, th, size, root, bits in _each_group(group)]
        return pa.table(list(map(pa.array, np.concatenate(out).T)), names=["a", "b"])

    return _dealt(groups, roots, bits, GROUPED).groupBy("_qs_n").applyInArrow(run, "a long, b long").distinct()


def prefix_links(docs: DataFrame, groups: DataFrame, roots: DataFrame, bits: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b): texts of a group, of different roots, that have the similarity: so many that they join all that have it.

    Pairs are never listed. First the bitmaps tell which texts of a group have any partner left, a row each at most; those bring
    their sets of shingles to the group, where pairs are compared, and at most one link less than it has texts leaves it.
    """
    kind = groups.select("g", "th", "size").schema

    def some(group: pa.Table) -> pa.Table:
        out = [np.empty((3, 0), np.int64)]
        for g, th, size, root, bits in _each_group(group):
            own = np.unique(_allowed(size, root, bits, similarity))
            out.append(np.stack((np.full(len(own), g), th[own], size[own])))
        return pa.table(list(map(pa.array, np.concatenate(out, axis=1))), names=["g", "th", "size"])

    def run(group: pa.Table) -> pa.Table:
        out = [np.empty((0, 2), np.int64)]
        for _, th, size, root, packed in _each_group(group):
            sets = [np.frombuffer(x, _U) for x in packed]
            out.append(_pairs(th, _allowed(size, root, list(map(bitmap, sets)), similarity, lambda i, j, sets=sets: j[_similar(sets, i, j, similarity)])))
        return pa.table(list(map(pa.array, np.concatenate(out).T)), names=["a", "b"])

    left = cut(_dealt(groups, roots, bits, GROUPED).groupBy("_qs_n").applyInArrow(some, kind))
    sets = shingle_sets(docs, left.select("th").distinct(), width).withColumnRenamed("s", "bits")
    mean = left.agg(F.avg("size")).first()[0] or 0
    return _dealt(left, roots, sets, max(1, int(SET_BYTES // (8 * mean + 64)))).groupBy("_qs_n").applyInArrow(run, "a long, b long").distinct()


def _similar(sets: list[np.ndarray], i: int, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether set i and each of the sets j have the similarity; two empty ones have."""
    out = []
    for part in np.array_split(j, -(-len(j) // 256) or 1):
        n = np.array([len(sets[k]) for k in part], np.int64)
        flat = np.concatenate([sets[k] for k in part])
        common = np.zeros(len(flat) + 1, np.int64)
        if len(sets[i]):
            common[1:] = np.cumsum(sets[i][np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)] == flat)
        ends = np.cumsum(n)
        both = common[ends] - common[ends - n]
        either = len(sets[i]) + n - both
        out.append((either == 0) | (both >= similarity * either))
    return np.concatenate(out)


def _allowed(size: np.ndarray, root: np.ndarray, bits: list[bytes], similarity: float, pick=None) -> np.ndarray:
    """Places (j, i) of one group's texts, by ascending size, that have different roots and whose sizes and bitmaps allow the similarity.

    pick(i, j): which of the places j, nearest first, are taken with i. Then one of each component is, and joins it: a forest.
    """
    # of sizes m <= n and the similarity s, at least s * n are common: m >= s * n, and (m + n) * (1 - s) / (1 + s) differ
    low = np.searchsorted(size, similarity * size - 1e-9)
    joined, out, at = root.copy(), [np.empty((0, 2), np.int64)], folded(bits)
    for i in range(1, len(size)):
        smaller = slice(low[i], i)
        first, rows = at[len(bits[low[i]])]  # the narrowest of them
        apart = np.bitwise_count(rows[low[i] - first : i - first] ^ rows[i - first]).sum(axis=1, dtype=np.int64)
        j = np.flatnonzero((joined[smaller] != joined[i]) & (apart <= (size[smaller] + size[i]) * (1 - similarity) / (1 + similarity) + 1e-9))
        if pick and len(j):
            j = pick(i, low[i] + j[np.argsort(apart[j], kind="stable")])
            others, nearest = np.unique(joined[j], return_index=True)
            j = j[nearest] - low[i]
            joined[np.isin(joined, others)] = joined[i]
        out.append(np.stack((low[i] + j, np.full(len(j), i)), axis=1))
    return np.concatenate(out)


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8, tables: int = 1) -> DataFrame:
    """(doc_id, _qs_th, keeper): the keeper is the smallest (doc_id, text hash) of a row's group; one row for each distinct key.

    Groups: equal texts, and texts whose sets of `width`-word shingles have the similarity. Candidates come first from
    fingerprints of the set of words, in several independent tables that are linked by ball hashing in one shuffle: cheap for
    large groups of copies with replaced words, but neither complete (a passage more or less moves a fingerprint too far) nor
    more than a star. Then every pair that is not linked yet, shares a shingle of its prefixes and whose bitmaps allow it is
    compared, which misses none: where they meet, so that only links are listed, fewer than a group has texts. A link counts once
    its similarity is verified on the whole texts.
    """
    prints = cut(word_set_fingerprints(docs, tables))
    each = prints.select("th", F.posexplode("fps").alias("t", "fp"))
    nodes = cut(each.groupBy("t", "fp").agg(F.min("th").alias("id")))
    within = each.join(nodes, ["t", "fp"]).where("th <> id").select(F.col("id").alias("a"), F.col("th").alias("b"))
    a, b = nodes.select("t", F.col("fp").alias("a"), F.col("id").alias("x")), nodes.select("t", F.col("fp").alias("b"), F.col("id").alias("y"))
    texts = lambda found: found.join(a, ["t", "a"]).join(b, ["t", "b"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b")
    edges = cut(verified(docs, cut(texts(near(nodes)).union(within).distinct()), width, similarity))
    edges = cut(edges.union(verified(docs, cut(texts(far(nodes, components(edges), "id")).distinct()), width, similarity)))
    roots = components(edges)
    commonest, bits = commonness(docs, width)
    groups, bits = cut(prefix_groups(docs, roots, width, similarity, commonest)), cut(bits)
    rest = cut(prefix_pairs(groups, roots, bits, similarity))  # a few pairs of each group
    if rest.head(1):
        edges = cut(edges.union(verified(docs, rest, width, similarity)))
        roots = components(edges)
    rest = cut(prefix_links(docs, groups, roots, bits, width, similarity))  # what these have not joined
    if rest.head(1):
        roots = components(edges.union(rest))
    rows = docs.select("doc_id", F.xxhash64("text").alias("_qs_th")).distinct()
    placed = cut(rows.join(roots, rows["_qs_th"] == roots["node"], "left").select("doc_id", "_qs_th", F.coalesce("root", "_qs_th").alias("root")))
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_qs_th")).alias("first"))
    return placed.join(first, "root").select("doc_id", "_qs_th", F.struct("first.doc_id", "first._qs_th").alias("keeper"))


def dedup(docs: DataFrame, width: int = 5, similarity: float = 0.8, tables: int = 1) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id. All columns kept.

    The keys to drop are broadcast only if few. Rows that repeat both doc_id and text are one document: one stays.
    """
    near = cut(near_duplicates(docs, width, similarity, tables))
    drop = cut(near.where("not (doc_id <=> keeper.doc_id and _qs_th = keeper._qs_th)").select(F.col("doc_id").alias("_qs_id"), "_qs_th"))
    release(docs.sparkSession)
    left = docs.join(small_or_shuffled(drop, 32), F.col("_qs_id").eqNullSafe(docs["doc_id"]) & (F.col("_qs_th") == F.xxhash64(docs["text"])), "left_anti")
    # only keys that occur twice have to meet
    twice = cut(docs.groupBy(F.col("doc_id").alias("_qs_id"), F.xxhash64("text").alias("_qs_th")).count().where("count > 1").select("_qs_id", "_qs_th"))
    if not twice.head(1):
        return left
    same = F.col("_qs_id").eqNullSafe(left["doc_id"]) & (F.col("_qs_th") == F.xxhash64(left["text"]))
    repeated = left.join(small_or_shuffled(twice, 32), same, "left_semi")
    return left.join(small_or_shuffled(twice, 32), same, "left_anti").unionByName(repeated.withColumn("_qs_th", F.xxhash64("text")).dropDuplicates(["doc_id", "_qs_th"]).drop("_qs_th"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
