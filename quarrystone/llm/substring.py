"""Substring dedup: Rabin-Karp hashes of every window of `width` tokens, counted in Spark, merged into removal intervals.

Tokens are [^\\x20\\x09-\\x0D]+, unchanged. Each token's XXH64 is a digit of two rolling polynomials: one is the window's
64-bit hash, the other deals the window to a bucket. A worker first counts within its chunk of rows, so that a window
reaches the shuffle at most once a chunk, however often it occurs: hot passages need no more room than rare ones.
Buckets count across chunks; the positions of windows that repeat go back to their chunk, are merged there into maximal
intervals, and are joined to the texts. Windows are judged on the input: no removal changes what another window equals.

Two windows are held equal if both hashes are: 64 bits and the bucket. With about a million windows to a bucket the chance
that a window is mistaken is about 2**-44, at every size of the input.

Null, empty and blank texts have no tokens; a text shorter than a window keeps all; a repeated row repeats its windows; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, as_bytes, buckets_for, by_bucket, cut, keyed, mix, pack_gaps, pieces, release, rolling, slices, table, unpack_gaps

_U = np.uint64
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F | 4)
PACKED = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int8()), ("numbers", pa.binary()), ("hashes", pa.binary())])
PACKED_DDL = "bucket int, chunk long, kind byte, numbers binary, hashes binary"
#: Kinds of packed rows: the rows of a chunk; places of windows that repeat; windows to be counted, first those seen once in
#: the chunk, with their places, then those seen more often.
ROWS, FOUND, DEALT = range(3)


def word_values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 of all words of all texts, and the number of words of each."""
    digest, out, counts = xxhash.xxh64_intdigest, [], []
    for t in texts:
        n = 0
        for p in pieces(t):
            ws = p.split()
            out.append(np.fromiter(map(digest, ws), dtype=_U, count=len(ws)))
            n += len(ws)
        counts.append(n)
    return np.concatenate(out) if out else np.empty(0, _U), np.array(counts, dtype=np.int64)


def _chunk_rows(part: pa.RecordBatch, width: int, n_buckets: int):
    """Packed rows of one chunk."""
    ids = np.asarray(part.column("doc_id").cast(pa.int64()).fill_null(0), dtype=np.int64)
    null = np.asarray(part.column("doc_id").is_null())
    texts = np.asarray(part.column("_qs_th"), dtype=np.int64)
    values, counts = word_values(as_bytes(part.column("text")))
    chunk = xxhash.xxh64_intdigest(b"".join((ids.tobytes(), null.tobytes(), texts.tobytes()))) >> 1
    home = chunk % n_buckets
    yield home, chunk, ROWS, np.stack((ids, null.astype(np.int64), texts, counts)).astype("<i8").tobytes(), b""
    # windows within one text only: those whose last word belongs to the text of the first
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.flatnonzero(np.arange(len(values)) + width <= ends)
    if not len(at):
        return
    hashes, other = rolling(values, width, _BASES[0])[at], rolling(values, width, _BASES[1])[at]
    bucket = (mix(other) % _U(n_buckets)).astype(np.int64)
    order = np.argsort(hashes, kind="stable")
    s, b = hashes[order], bucket[order]
    head = np.concatenate(([True], (s[1:] != s[:-1]) | (b[1:] != b[:-1])))
    alone = np.concatenate((head[1:], [True])) & head
    more = np.ones(len(at), dtype=bool)
    more[order[alone]] = False
    if more.any():
        yield home, chunk, FOUND, pack_gaps(at[more]), b""
    once, several = np.flatnonzero(~more), order[head & ~alone]
    pick = np.concatenate((once, several))  # in a bucket, those seen once come first and have a place to send back
    for k, own in by_bucket(bucket[pick], n_buckets):
        yield k, chunk, DEALT, pack_gaps(at[pick[own[own < len(once)]]]), hashes[pick[own]].tobytes()


def _count(group: pa.Table) -> pa.Table:
    """Of one bucket: the windows that repeat, for each chunk that holds one. A window seen more than once in a chunk has
    its places there found already; it only lets other chunks know."""
    rows = group.to_pylist()
    out = [(r["bucket"], r["chunk"], r["kind"], r["numbers"], b"") for r in rows if r["kind"] in (ROWS, FOUND)]
    dealt = [r for r in rows if r["kind"] == DEALT]
    if dealt:
        each = [np.frombuffer(r["hashes"], dtype=_U) for r in dealt]
        places = [unpack_gaps(r["numbers"]) for r in dealt]
        hashes = np.concatenate(each)
        sure = np.concatenate([np.arange(len(e)) >= len(p) for e, p in zip(each, places, strict=True)])
        order = np.argsort(hashes, kind="stable")
        s = hashes[order]
        head = np.concatenate(([True], s[1:] != s[:-1]))
        size = np.diff(np.concatenate((np.flatnonzero(head), [len(s)])))
        surely = np.logical_or.reduceat(sure[order], np.flatnonzero(head))
        repeats = np.zeros(len(s), dtype=bool)
        repeats[order] = np.repeat((size > 1) | surely, size)
        at = 0
        for r, e, p in zip(dealt, each, places, strict=True):
            mine = p[repeats[at : at + len(p)]]
            at += len(e)
            if len(mine):
                out.append((r["bucket"], r["chunk"], FOUND, pack_gaps(mine), b""))
    return pa.Table.from_batches([table(out, PACKED)])


def _merge(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("_qs_th", pa.int64()), ("spans", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_pylist()
        numbers = group.column("numbers").to_pylist()
        out: list[tuple] = []
        heads = [n for k, n in zip(kinds, numbers, strict=True) if k == ROWS]
        found = [unpack_gaps(n) for k, n in zip(kinds, numbers, strict=True) if k == FOUND]
        if found and heads:
            ids, null, texts, counts = np.frombuffer(heads[0], "<i8").reshape(4, -1)
            at = np.unique(np.concatenate(found))
            new = np.concatenate(([True], np.diff(at) > width))
            first = np.repeat(np.cumsum(counts) - counts, counts)
            owner = np.repeat(np.arange(len(counts)), counts)
            new[1:] |= owner[at[1:]] != owner[at[:-1]]
            start = at[new]
            end = np.concatenate((at[np.flatnonzero(new)[1:] - 1], at[-1:])) + width
            doc = owner[start]
            spans = np.stack((start - first[start], end - first[start]), axis=1).astype("<i8")
            cuts = np.flatnonzero(np.diff(doc)) + 1
            out = [(None if null[doc[a]] else int(ids[doc[a]]), int(texts[doc[a]]), spans[a:b].tobytes()) for a, b in zip([0, *cuts], [*cuts, len(doc)], strict=True)]
        return pa.Table.from_batches([table(out, schema)])

    return run


def repeats(docs: DataFrame, width: int = 35, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, _qs_th, spans) of the texts that hold a repeated window: maximal (start, end) token intervals, packed."""
    n = buckets_for(docs)

    def emit(batches):
        for batch in batches:
            for part in slices(batch, limit=chunk_bytes):
                yield table(_chunk_rows(part, width, n), PACKED)

    counted = keyed(docs).mapInArrow(emit, PACKED_DDL).groupBy("bucket").applyInArrow(_count, PACKED_DDL)
    spans = counted.groupBy("chunk").applyInArrow(_merge(width), "doc_id long, _qs_th long, spans binary")
    return cut(spans.dropDuplicates(["doc_id", "_qs_th"]))


def _with_spans(docs: DataFrame, width: int, **options) -> DataFrame:
    found = repeats(docs, width, **options).select(F.col("doc_id").alias("_qs_id"), F.col("_qs_th").alias("_qs_h"), "spans")
    release(docs.sparkSession)
    return docs.join(found, (F.xxhash64(docs["text"]) == F.col("_qs_h")) & docs["doc_id"].eqNullSafe(F.col("_qs_id")), "left")


def kept_words(text: bytes, spans: bytes | None) -> tuple[list[bytes], int, int]:
    """The words outside the spans, the number of all words, the number removed."""
    ws = text.split()
    if not spans:
        return ws, len(ws), 0
    keep = np.ones(len(ws), dtype=bool)
    for a, b in np.frombuffer(spans, "<i8").reshape(-1, 2):
        keep[a:b] = False
    return [ws[i] for i in np.flatnonzero(keep)], len(ws), int(len(ws) - keep.sum())


def report(docs: DataFrame, width: int = 35, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for d, t, s in zip(part.column("doc_id").cast(pa.int64()).to_pylist(), as_bytes(part.column("text")), part.column("spans").to_pylist(), strict=True):
                    kept, n, gone = kept_words(t, s)
                    out.append((d, n, gone, hashlib.sha256(b" ".join(kept)).hexdigest()))
                yield table(out, schema)

    joined = _with_spans(docs.select("doc_id", "text"), width, **options).select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame, width: int = 35) -> DataFrame:
    """docs with every repeated window's words removed; a touched text is its kept words, joined by one space."""
    @F.pandas_udf("string")
    def cleaned(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else b" ".join(kept_words(t.encode(), s)[0]).decode() for t, s in zip(text, spans, strict=True)], dtype=object)

    return _with_spans(docs, width).withColumn("text", cleaned("text", "spans")).select(*docs.columns)
