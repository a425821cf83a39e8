"""Shared parts of the training-data operators: checkpoints, batching, hashing.

Conventions of every operator here
----------------------------------
* A row is known by ``(doc_id, xxhash64(text))``: a repeated ``doc_id`` stays several rows, and rows
  equal in both get equal results.
* A null text is an empty text. Extra columns are never touched, helper columns start with ``_qs_``.
* Texts are handled as UTF-8 bytes; ``bytes.split()`` splits at exactly ``[\\x20\\x09-\\x0D]+``.
* Packed blocks (numpy arrays in a binary column) take the place of one row per word, so that a
  shuffle carries 8 bytes a window. Chunks of rows follow the order of the input, so an operator's
  input has to be a table or checkpoint, as in every query here, not an unordered shuffle's result.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import release

#: Bytes of text that are handled at once in a Python worker.
CHUNK_BYTES = 8 << 20
#: A side of a join is broadcast up to this many bytes, after counting it; beyond, it is shuffled.
BROADCAST_BYTES = 8 << 20

_LIBC = ctypes.CDLL(None)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_U = np.uint64


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir. Only a local session may have one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df. What earlier steps were made from is released first.

    df itself is referred to until this returns: call release() before a last step that needs much room.
    """
    checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size of df (file sizes, for a scan) or else its bytes of text; only tunes the number of buckets."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2


def buckets_for(df: DataFrame, bytes_each: int = 8 << 20, blow_up: float = 4.0) -> int:
    """Buckets whose packed blocks stay near bytes_each, at least two to a shuffle partition."""
    return int(max(2 * shuffle_partitions(df.sparkSession), planned_bytes(df) * blow_up // bytes_each))


def small_or_shuffled(df: DataFrame, row_bytes: int) -> DataFrame:
    """df, with a broadcast hint only if its counted rows stay under BROADCAST_BYTES. df should be a checkpoint."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row key's second half."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("_qs_th"))


def trim() -> None:
    """Give memory that is free back to the system: workers live on between tasks, and would keep their peaks."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of at most limit bytes in column (or one row)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total = np.cumsum(size)
    at, n = 0, batch.num_rows
    while at < n:
        base = total[at] - size[at]
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
        trim()


def as_bytes(column: pa.Array) -> list[bytes]:
    """Texts as bytes, null as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def pieces(text: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """text cut at white space, so that a very long text never becomes one list of words."""
    at = 0
    while len(text) - at > size:
        m = _SPACE.search(text, at + size)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def powers(base: int, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _kept.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, dtype=_U)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _kept[base] = np.multiply.accumulate(step)
    return have[:n]


def rolling(values: np.ndarray, k: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes, modulo 2**64, of all k consecutive values: n - k + 1 of them."""
    n = len(values)
    if n < k:
        return np.empty(0, dtype=_U)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=_U)
        np.cumsum(values * powers(base, n), out=total[1:])
        return (total[k:] - total[:-k]) * powers(pow(base, -1, 1 << 64), n - k + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def pack_gaps(sorted_numbers: np.ndarray) -> bytes:
    """Ascending numbers under 2**32 as gaps in byte planes; the high planes compress to nothing."""
    gaps = np.diff(sorted_numbers.astype(np.uint32), prepend=np.uint32(0)).astype("<u4")
    return gaps.view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_gaps(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(packed, dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)


def by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket, of 0 to n - 1, that there is, and its places in ascending order. The cost doesn't grow with n."""
    order = np.argsort(bucket.astype(np.uint16) if n <= 1 << 16 else bucket, kind="stable")
    s = bucket[order]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(s)), bool), s[1:] != s[:-1])))
    for k, own in zip(s[head].tolist(), np.split(order, head[1:]), strict=False):  # without any, one empty part is left over
        yield k, own


def table(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b), by alternating large and small stars.

    Nodes of longs, nulls and self-links ignored; root is the smallest node. Every round is a grouped minimum (partial
    aggregation) and an equi-join that adaptive execution can split, so a hub needs no memory of its own size.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut(small.where("u <> v").distinct())
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if last == now:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
