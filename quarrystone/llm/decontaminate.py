"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Words are maximal runs of ASCII letters, digits and non-ASCII bytes after lower-casing A-Z. A window is n consecutive
words of a test item; an item with fewer words, but at least one, is one window of all its words. A document's window is
first looked up by a rolling hash in a bitmap, then verified word for word. The test set is read in blocks under a fixed
size, each broadcast in its own pass, so a large test set needs more passes over the documents but no more memory.

Null, empty and wordless texts have no words and no hits; items with a null id or no words have no windows; repeated
items count once each id; an empty benchmark hits nothing, and an empty table of documents gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, keyed, pieces, rolling, slices, small_or_shuffled

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Lower-cases A-Z and turns every separator into a space.
NORMAL = bytes((lambda c: c if c in _KEEP else 0x20)(b + 32 if 0x41 <= b <= 0x5A else b) for b in range(256))
#: Bytes of benchmark text in one broadcast block. A worker holds about 58 bytes a byte of it (measured): some 120 MB.
BLOCK_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_BITS = 22
SCHEMA = "doc_id long, _qs_th long, n_words long, hits binary, items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class Windows:
    """The windows of some items: vocabulary, exact windows by length, and a bitmap of their rolling hashes."""

    def __init__(self, items: list[tuple[str, bytes]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.exact: dict[int, dict[bytes, set[str]]] = {}
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], dtype=np.int32)
            k = min(n, len(ids))
            for i in range(len(ids) - k + 1 if k else 0):
                self.exact.setdefault(k, {}).setdefault(ids[i : i + k].tobytes(), set()).add(item)
        self.bitmap = {}
        for k, seen in self.exact.items():
            self.bitmap[k] = np.zeros(1 << _BITS, dtype=bool)
            for w in seen:
                self.bitmap[k][self._slot(np.frombuffer(w, dtype=np.int32), k)] = True

    @staticmethod
    def _slot(ids: np.ndarray, k: int) -> np.ndarray:
        return (rolling(ids.astype(np.uint64), k, _BASE) >> np.uint64(64 - _BITS)).astype(np.int64)

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(start, length, items) of every window in ids; 0 is any other word, so only runs without 0 are looked at."""
        gaps = np.concatenate(([-1], np.flatnonzero(ids == 0), [len(ids)]))
        for k, seen in self.exact.items():
            for at in np.flatnonzero(np.diff(gaps) > k):
                start, run = gaps[at] + 1, ids[gaps[at] + 1 : gaps[at + 1]]
                for i in np.flatnonzero(self.bitmap[k][self._slot(run, k)]):
                    if items := seen.get(run[i : i + k].tobytes()):
                        yield int(start + i), k, items


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """SCHEMA for every row of docs: word count, packed (start, end) word spans that windows hit, and the items found."""
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = [_pass(docs, spark.sparkContext.broadcast(Windows([(r[0], r[1].encode()) for r in items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toLocalIterator()], n))) for b in range(blocks)]
    if blocks == 1:
        return found[0]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    merged = every.groupBy("doc_id", "_qs_th").agg(F.max("n_words").alias("n_words"), F.collect_list("hits").alias("h"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.expr(f"count(*) div {blocks}").alias("_qs_rows"))
    return merged.withColumn("_qs_row", F.explode(F.sequence(F.lit(1), "_qs_rows"))).mapInPandas(_merge, SCHEMA)


def _merge(frames):
    for x in frames:
        spans = [np.concatenate([np.frombuffer(h, "<i4").reshape(-1, 2) for h in hs] or [np.empty((0, 2), "<i4")]) for hs in x["h"]]
        yield x.assign(hits=[union(s).astype("<i4").tobytes() for s in spans]).drop(columns="h")[["doc_id", "_qs_th", "n_words", "hits", "items"]]


def union(spans: np.ndarray) -> np.ndarray:
    """Disjoint ascending spans that cover the same."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.concatenate(([True], spans[1:, 0] > reach[:-1]))
    ends = np.concatenate((np.flatnonzero(first)[1:] - 1, [len(spans) - 1]))
    return np.stack((spans[first, 0], reach[ends]), axis=1)


def _pass(docs: DataFrame, windows) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("_qs_th", pa.int64()), ("n_words", pa.int64()), ("hits", pa.binary()), ("items", pa.list_(pa.string()))])

    def run(batches):
        w = windows.value
        get = w.vocabulary.get
        for batch in batches:
            for part in slices(batch):
                texts = as_bytes(part.column("text"))
                n_words, ids = [], [np.zeros(1, np.int32)]
                for t in texts:
                    n = 0
                    for piece in pieces(t.translate(NORMAL)):
                        ws = piece.split()
                        ids.append(np.fromiter(map(get, ws, repeat(0)), dtype=np.int32, count=len(ws)))
                        n += len(ws)
                    ids.append(ids[0])
                    n_words.append(n)
                starts = np.cumsum([1] + [n + 1 for n in n_words])
                hits: dict[int, list[tuple[int, int]]] = {}
                items: dict[int, set[str]] = {}
                for at, k, its in w.find(np.concatenate(ids)):
                    d = int(np.searchsorted(starts, at, side="right")) - 1
                    hits.setdefault(d, []).append((at - starts[d], at - starts[d] + k))
                    items.setdefault(d, set()).update(its)
                spans = [union(np.array(sorted(hits[d]), dtype=np.int64)).astype("<i4").tobytes() if d in hits else b"" for d in range(len(texts))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("_qs_th"), pa.array(n_words, pa.int64()), pa.array(spans, pa.binary()), pa.array([sorted(items.get(d, ())) for d in range(len(texts))], pa.list_(pa.string()))], schema=schema)

    return keyed(docs).mapInArrow(run, SCHEMA)


def report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row for each row of docs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])

    def run(batches):
        for b in batches:
            hit = [int((s := np.frombuffer(h, "<i4").reshape(-1, 2))[:, 1].sum() - s[:, 0].sum()) for h in b.column("hits").to_pylist()]
            items = b.column("items").to_pylist()
            sha = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array(sha), pa.array([x > 0 for x in hit])], schema=schema)

    return scan(docs, benchmark, n).mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs without the rows that hold a window; all columns kept. The hit ids are broadcast only if few."""
    bad = cut(scan(docs, benchmark, n).where("length(hits) > 0").select(F.col("doc_id").alias("_qs_id"), F.col("_qs_th").alias("_qs_h")).distinct())
    return docs.join(small_or_shuffled(bad, 32), F.col("_qs_id").eqNullSafe(docs["doc_id"]) & (F.col("_qs_h") == F.xxhash64(docs["text"])), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs with the words of every window cut out of the text, from the first byte of the first to the last of the last.

    Touched texts only are joined back; all other rows pass unchanged.
    """
    import re

    found = cut(scan(docs, benchmark, n).where("length(hits) > 0").select(F.col("doc_id").alias("_qs_id"), F.col("_qs_th").alias("_qs_h"), "hits").dropDuplicates(["_qs_id", "_qs_h"]))
    token = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

    @F.pandas_udf("string")
    def cleaned(text, hits):
        out = []
        for t, h in zip(text, hits, strict=True):
            if h is None:
                out.append(t)
                continue
            raw, gone, at = t.encode(), [], 0
            where = [m.span() for m in token.finditer(raw)]
            for a, b in np.frombuffer(h, "<i4").reshape(-1, 2):
                gone.append(raw[at : where[a][0]])
                at = where[b - 1][1]
            out.append((b"".join(gone) + raw[at:]).decode())
        import pandas as pd

        return pd.Series(out, dtype=object)

    joined = docs.join(small_or_shuffled(found, 200), F.col("_qs_id").eqNullSafe(docs["doc_id"]) & (F.col("_qs_h") == F.xxhash64(docs["text"])), "left")
    return joined.withColumn("text", cleaned("text", "hits")).select(*docs.columns)
