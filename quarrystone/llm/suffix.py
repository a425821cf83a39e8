"""Suffix-array dedup: every byte of a `width`-byte string that also starts earlier is removed.

The sort of all suffixes is done as difference-cover algorithms do it, from a sample of positions that is such that every
string meets it, but the sample is chosen by content, not by i mod 3, so that equal strings are sampled alike and one
position in about 26 is sorted instead of two in three; and order is needed only to the depth of `width` bytes.

1. Sample: of the width/2 + 1 consecutive (width/2)-grams of a string, the one of least hash, the leftmost of equals. Each
   string of `width` bytes has one such anchor; a string and its copy have it at the same offset.
2. Anchors whose gram occurs once are done: no string through them repeats. Counting them is a shuffle of 10 bytes each.
3. The suffixes at the other anchors are dealt by gram, sorted by their following bytes, and adjacent ones are compared:
   the lengths of common prefixes give each anchor's class at every depth.
4. The remaining suffixes, those between anchors, are merged in: a string that starts d bytes before its anchor is known by
   its d bytes, compared to the left in the same way, and by the class of the anchor's suffix at depth width - d. Within
   a class the earliest (doc_id, start) stays, all others are marked.

Equal texts are settled first: only the one of smallest doc_id is sorted, later ones go whole. Within a chunk of rows,
anchors in equal surroundings are one record, so a passage in very many documents is sorted once a chunk. Where an anchor
occurs over HOT times, its strings are dealt one by one, by their own content, so no group of anchors outgrows a task.

Earlier means a smaller (doc_id, start), a null doc_id before all; rows that repeat both doc_id and text are marked alike,
by others only. Null texts are empty; texts shorter than `width` keep all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, as_bytes, buckets_for, by_bucket, cut, keyed, mix, pack_gaps, release, rolling, slices, small_or_shuffled, table, unpack_gaps
from .decontaminate import union

_U = np.uint64
_BASE = 0x9FB21C651E98DF25
_NULL = -(1 << 63)
#: An anchor that occurs more often is split by the strings through it.
HOT = 5000
ROWS, TWICE, DEALT, FOUND, FOUND_HOT, HOTS = range(6)
_DDL = "bucket int, chunk long, kind byte, numbers binary, hashes binary, counts binary"
_PACKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int8()), ("numbers", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary())])


def anchors(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last, hash): anchors of the strings of width bytes in text; those that start in first..last have it."""
    q = width // 2
    n = len(text) - width + 1
    if n <= 0:
        e = np.empty(0, np.int64)
        return e, e, e, np.empty(0, _U)
    h = mix(rolling(text.astype(_U) + _U(1), q, _BASE))
    key = (h >> _U(32) << _U(32)) | np.arange(len(h), dtype=_U)  # least hash, then leftmost
    span, size = width - q + 1, 1
    while size * 2 <= span:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    if size < span:
        key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
    at = (key & _U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [n - 1]))
    return at[first], first, last, h[at[first]]


def _anchor_rows(part: pa.RecordBatch, width: int, n_buckets: int):
    """Packed rows of a chunk: its documents, its anchors for counting, and the places of those it has more than once."""
    ids = np.asarray(part.column("doc_id").cast(pa.int64()).fill_null(_NULL), dtype=np.int64)
    hashes = np.asarray(part.column("_qs_th"), dtype=np.int64)
    texts = as_bytes(part.column("text"))
    chunk = xxhash.xxh64_intdigest(ids.tobytes() + hashes.tobytes()) >> 1
    home, at, hs, base, starts = chunk % n_buckets, [], [], 0, []
    for t in texts:
        a, _, _, h = anchors(np.frombuffer(t, np.uint8), width)
        at.append(a + base)
        hs.append(h)
        starts.append(base)
        base += len(t) + 1
    yield home, chunk, ROWS, np.stack((ids, hashes, np.array(starts, np.int64))).tobytes(), b"", b""
    at, h = np.concatenate(at), np.concatenate(hs)
    if not len(at):
        return
    order = np.argsort(h, kind="stable")
    head = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
    times = np.diff(np.concatenate((head, [len(h)])))
    once, more = np.sort(order[head[times == 1]]), head[times > 1]
    if len(more):
        places = np.concatenate([at[order[a : a + n]] for a, n in zip(more, times[times > 1], strict=True)])
        yield home, chunk, TWICE, places.astype("<u4").tobytes(), h[order[more]].tobytes(), times[times > 1].astype("<u4").tobytes()
    pick = np.concatenate((once, order[more]))
    count = np.concatenate((np.ones(len(once), np.int64), times[times > 1]))
    for k, own in by_bucket((mix(h[pick]) % _U(n_buckets)).astype(np.int64), n_buckets):
        yield k, chunk, DEALT, pack_gaps(at[pick[own[own < len(once)]]]), h[pick[own]].tobytes(), count[own[own >= len(once)]].astype("<u4").tobytes()


def _count(hot: int):
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        out = [tuple(r.values()) for r in rows if r["kind"] in (ROWS, TWICE)]
        dealt = [r for r in rows if r["kind"] == DEALT]
        if dealt:
            places = [unpack_gaps(r["numbers"]) for r in dealt]
            each = [np.frombuffer(r["hashes"], _U) for r in dealt]
            times = [np.concatenate((np.ones(len(p), np.int64), np.frombuffer(r["counts"], "<u4").astype(np.int64))) for p, r in zip(places, dealt, strict=True)]
            h, t = np.concatenate(each), np.concatenate(times)
            _, inverse = np.unique(h, return_inverse=True)
            total = np.bincount(inverse, weights=t)[inverse]
            at = 0
            for r, p, e in zip(dealt, places, each, strict=True):
                mine = total[at : at + len(e)]
                at += len(e)
                single = mine[: len(p)]
                for kind, keep in ((FOUND, (single > 1) & (single <= hot)), (FOUND_HOT, single > hot)):
                    if keep.any():
                        out.append((r["bucket"], r["chunk"], kind, pack_gaps(p[keep]), b"", b""))
                if (often := e[len(p) :][mine[len(p) :] > hot]).size:
                    out.append((r["bucket"], r["chunk"], HOTS, b"", often.tobytes(), b""))
        return pa.Table.from_batches([table(out, _PACKED)])

    return run


_SITES = pa.schema([("doc_id", pa.int64()), ("_qs_th", pa.int64()), ("sites", pa.binary()), ("hot", pa.binary())])


def _sites(group: pa.Table) -> pa.Table:
    """Of one chunk: the anchors of each document that occur more than once, and which of them are hot."""
    rows, out = group.to_pylist(), []
    heads = [r["numbers"] for r in rows if r["kind"] == ROWS]
    hot = np.concatenate([np.empty(0, _U)] + [np.frombuffer(r["hashes"], _U) for r in rows if r["kind"] == HOTS])
    at, flag = [np.empty(0, np.int64)], [np.empty(0, bool)]
    for r in rows:
        if r["kind"] in (FOUND, FOUND_HOT):
            at.append(unpack_gaps(r["numbers"]))
            flag.append(np.full(len(at[-1]), r["kind"] == FOUND_HOT))
        elif r["kind"] == TWICE:
            at.append(np.frombuffer(r["numbers"], "<u4").astype(np.int64))
            flag.append(np.repeat(np.isin(np.frombuffer(r["hashes"], _U), hot), np.frombuffer(r["counts"], "<u4")))
    at, flag = np.concatenate(at), np.concatenate(flag)
    if heads and len(at):
        ids, hashes, starts = np.frombuffer(heads[0], "<i8").reshape(3, -1)
        order = np.argsort(at)
        at, flag = at[order], flag[order]
        doc = np.searchsorted(starts, at, side="right") - 1
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(doc)], strict=True):
            d = doc[a]
            out.append((int(ids[d]), int(hashes[d]), (at[a:b] - starts[d]).astype("<i4").tobytes(), np.packbits(flag[a:b]).tobytes()))
    return pa.Table.from_batches([table(out, _SITES)])


_RECORDS = pa.schema([("bucket", pa.int32()), ("done", pa.bool_()), ("docs", pa.binary()), ("shape", pa.binary()), ("bytes", pa.binary())])
_RECORDS_DDL = "bucket int, done boolean, docs binary, shape binary, bytes binary"


def _records(rows: list[tuple], width: int, n_buckets: int):
    """rows: (doc_id, th, text, sites, hot) of a chunk. Records of anchors by bucket, and spans that are settled here."""
    seen: dict[tuple, tuple[int, int]] = {}
    by: dict[int, list] = {}
    done = []
    q = width // 2
    for doc_id, th, text, sites, hot in sorted(rows, key=lambda r: (r[0], r[1])):
        at, first, last, _ = anchors(np.frombuffer(text, np.uint8), width)
        sites = np.frombuffer(sites, "<i4")
        flags = np.unpackbits(np.frombuffer(hot, np.uint8), count=len(sites)).astype(bool).tolist()
        i = np.searchsorted(at, sites)
        for a, lo, hi, is_hot in zip(at[i].tolist(), first[i].tolist(), last[i].tolist(), flags, strict=True):
            for s, e in ((x, x) for x in range(lo, hi + 1)) if is_hot else ((lo, hi),):
                around = text[s : e + width]
                key = around, a - s
                held = seen.get(key)
                if held is None:
                    seen[key] = doc_id, a
                    b = xxhash.xxh64_intdigest(around if is_hot else text[a : a + q], 1) % n_buckets
                    by.setdefault(b, []).append((doc_id, th, a, a - s, e - s, around))
                elif held != (doc_id, a):
                    done.append((doc_id, th, s, e + width))
    for b, rs in by.items():
        docs = np.array([(r[0], r[1]) for r in rs], "<i8")
        shape = np.array([(r[2], r[3], r[4]) for r in rs], "<i4")
        yield b, False, docs.tobytes(), shape.tobytes(), b"".join(r[5] for r in rs)
    if done:
        docs = np.array([d[:2] for d in done], "<i8")
        yield docs[0, 1] % n_buckets, True, docs.tobytes(), np.array([d[2:] for d in done], "<i4").tobytes(), b""


def _common(a: np.ndarray) -> np.ndarray:
    """How many leading bytes each row of a shares with the row before it."""
    equal = a[1:] == a[:-1]
    return np.concatenate(([0], np.where(equal.all(axis=1), a.shape[1], equal.argmin(axis=1))))


def _order(a: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(a), -(-a.shape[1] // 8) * 8), np.uint8)
    wide[:, : a.shape[1]] = a
    return np.lexsort(wide.view(">u8").T[::-1])


def marked(doc: np.ndarray, at: np.ndarray, before: np.ndarray, count: np.ndarray, around: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(record, start) of the strings that also start earlier, among those of these records.

    A record is an anchor at `at` of doc, with the count + 1 strings that start from `before` bytes before it on.
    """
    q = width // 2
    m = len(at)
    right, left = np.zeros((m, width), np.uint8), np.zeros((m, width - q), np.uint8)
    for i, (x, b) in enumerate(zip(around, before.tolist(), strict=True)):
        v = np.frombuffer(x, np.uint8)
        r = v[b : b + width]
        right[i, : len(r)] = r
        left[i, :b] = v[:b][::-1]
    by_place = np.lexsort((at, doc))  # the earliest first
    doc, at, before, count, right, left = doc[by_place], at[by_place], before[by_place], count[by_place], right[by_place], left[by_place]
    # the sorted suffixes and how much adjacent ones share; the same to the left
    r_order, l_order = _order(right), _order(left)
    r_common, l_common = _common(right[r_order]), _common(left[l_order])
    records, starts = [], []
    for d in range(width - q + 1):
        r_class, l_class = np.empty(m, np.int64), np.empty(m, np.int64)
        r_class[r_order] = np.cumsum(r_common < width - d)
        l_class[l_order] = np.cumsum(l_common < d)
        own = np.flatnonzero((d <= before) & (d >= before - count))
        if len(own) < 2:
            continue
        _, first, which = np.unique((r_class[own] << 32) | l_class[own], return_index=True, return_inverse=True)
        earliest = own[first[which]]
        later = own[(doc[own] != doc[earliest]) | (at[own] != at[earliest])]
        records.append(by_place[later])
        starts.append(at[later] - d)
    e = np.empty(0, np.int64)
    return np.concatenate([e, *records]), np.concatenate([e, *starts])


_SPANS = pa.schema([("doc_id", pa.int64()), ("_qs_th", pa.int64()), ("spans", pa.binary())])


def _by_doc(docs: np.ndarray, spans: np.ndarray):
    """Rows of _SPANS from (doc_id, th) and (start, end) arrays."""
    order = np.lexsort((spans[:, 0], docs[:, 1], docs[:, 0]))
    docs, spans = docs[order], spans[order]
    cuts = np.flatnonzero((docs[1:] != docs[:-1]).any(axis=1)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(docs)], strict=True):
        if b > a:
            yield int(docs[a, 0]), int(docs[a, 1]), union(spans[a:b]).astype("<i4").tobytes()


def _sort(width: int):
    def run(group: pa.Table) -> pa.Table:
        docs, spans = [np.empty((0, 2), np.int64)], [np.empty((0, 2), np.int64)]
        own_docs, own_shape, around = [], [], []
        for r in group.to_pylist():
            d = np.frombuffer(r["docs"], "<i8").reshape(-1, 2)
            if r["done"]:
                docs.append(d)
                spans.append(np.frombuffer(r["shape"], "<i4").reshape(-1, 2).astype(np.int64))
                continue
            shape = np.frombuffer(r["shape"], "<i4").reshape(-1, 3)
            ends = np.cumsum(shape[:, 2] + width).tolist()
            around += [r["bytes"][a:b] for a, b in zip([0, *ends], ends, strict=False)]
            own_docs.append(d)
            own_shape.append(shape)
        if around:
            d, shape = np.concatenate(own_docs), np.concatenate(own_shape).astype(np.int64)
            record, start = marked(d[:, 0], shape[:, 0], shape[:, 1], shape[:, 2], around, width)
            docs.append(d[record])
            spans.append(np.stack((start, start + width), axis=1))
        return pa.Table.from_batches([table(_by_doc(np.concatenate(docs), np.concatenate(spans)), _SPANS)])

    return run


def repeats(docs: DataFrame, width: int = 100, chunk_bytes: int = CHUNK_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, _qs_th, spans) for texts, the first of their equals, that hold bytes to remove; a null doc_id is _NULL."""
    n = buckets_for(docs, 4 << 20)

    def count(batches):
        for batch in batches:
            for part in slices(batch, limit=chunk_bytes):
                yield table(_anchor_rows(part, width, n), _PACKED)

    firsts = keyed(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL)))
    sites = firsts.mapInArrow(count, _DDL).groupBy("bucket").applyInArrow(_count(hot), _DDL).groupBy("chunk").applyInArrow(_sites, "doc_id long, _qs_th long, sites binary, hot binary")
    sites = cut(sites.dropDuplicates(["doc_id", "_qs_th"]))

    def deal(batches):
        for batch in batches:
            for part in slices(batch, limit=chunk_bytes // 2):
                rows = zip(part.column("doc_id").to_pylist(), part.column("_qs_th").to_pylist(), as_bytes(part.column("text")), part.column("sites").to_pylist(), part.column("hot").to_pylist(), strict=True)
                yield table(_records(list(rows), width, n), _RECORDS)

    joined = firsts.join(sites, ["doc_id", "_qs_th"])
    found = joined.select("doc_id", "_qs_th", "text", "sites", "hot").mapInArrow(deal, _RECORDS_DDL).groupBy("bucket").applyInArrow(_sort(width), "doc_id long, _qs_th long, spans binary")
    return cut(found.groupBy("doc_id", "_qs_th").agg(F.collect_list("spans").alias("s")).mapInPandas(_joined, "doc_id long, _qs_th long, spans binary"))


def _joined(frames):
    for f in frames:
        spans = [union(np.concatenate([np.frombuffer(x, "<i4").reshape(-1, 2) for x in s])).astype("<i4").tobytes() for s in f["s"]]
        yield pd.DataFrame({"doc_id": f["doc_id"], "_qs_th": f["_qs_th"], "spans": spans})


def removals(docs: DataFrame, width: int = 100, **options) -> DataFrame:
    """docs with _qs_spans (packed byte spans to remove) and _qs_whole (the text equals an earlier one)."""
    key = F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    rows = docs.select(F.coalesce("doc_id", F.lit(_NULL)).alias("_qs_id"), key.alias("k"))
    least = rows.groupBy("k").agg(F.min("_qs_id").alias("low"), F.max("_qs_id").alias("high")).where("high > low and k.n > 0").select(F.col("k").alias("l"), "low")
    # nothing that needs a key's rows together stands above this join, so that a hot text's rows can be split
    later = cut(rows.join(least, F.col("k") == F.col("l")).where("_qs_id > low").select("_qs_id", F.col("k.a").alias("_qs_th")))
    later = cut(later.distinct())
    same = lambda d: (F.col("_qs_id") == F.coalesce(d["doc_id"], F.lit(_NULL))) & (F.col("_qs_th") == F.xxhash64(d["text"]))
    firsts = docs.join(small_or_shuffled(later, 32), same(docs), "left_anti")
    found = repeats(firsts, width, **options).withColumnRenamed("doc_id", "_qs_id")
    every = found.select("_qs_id", "_qs_th", "spans", F.lit(False).alias("w")).unionByName(later.select("_qs_id", "_qs_th", F.lit(None).cast("binary").alias("spans"), F.lit(True).alias("w")))
    release(docs.sparkSession)
    joined = docs.join(every, same(docs), "left")
    whole = F.coalesce("w", F.lit(False)) & (F.octet_length("text") >= width)
    return joined.select(*[docs[c] for c in docs.columns], F.col("spans").alias("_qs_spans"), F.coalesce(whole, F.lit(False)).alias("_qs_whole"))


def kept_bytes(text: bytes, spans: bytes | None, whole: bool) -> tuple[bytes, int]:
    """What stays of a text, and how many spans go."""
    if whole:
        return b"", int(bool(text))
    if not spans:
        return text, 0
    out, at = [], 0
    gone = np.frombuffer(spans, "<i4").reshape(-1, 2).tolist()  # disjoint, and apart
    for a, b in gone:
        out.append(text[at:a])
        at = b
    return b"".join(out) + text[at:], len(gone)


def report(docs: DataFrame, width: int = 100, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for d, t, s, w in zip(part.column("doc_id").cast(pa.int64()).to_pylist(), as_bytes(part.column("text")), part.column("_qs_spans").to_pylist(), part.column("_qs_whole").to_pylist(), strict=True):
                    kept, n = kept_bytes(t, s, w)
                    out.append((d, len(t), len(t) - len(kept), n, hashlib.sha256(kept).hexdigest()))
                yield table(out, schema)

    return removals(docs.select("doc_id", "text"), width, **options).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, width: int = 100) -> DataFrame:
    """docs with the bytes removed; bytes that are no longer UTF-8 (a cut inside a character) become replacement characters."""

    @F.pandas_udf("string")
    def cleaned(text: pd.Series, spans: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else kept_bytes(t.encode(), s, w)[0].decode("utf-8", "replace") for t, s, w in zip(text, spans, whole, strict=True)], dtype=object)

    return removals(docs, width).withColumn("text", cleaned("text", "_qs_spans", "_qs_whole")).select(*docs.columns)
