"""Dense numbers and running sums over tables in the order of a key, without one task for a key.

arranged() deals rows to ranges of all its columns, so a hot key's rows lie in as many neighbouring partitions as they need,
if the columns after the key differ. Two passes over that checkpoint follow: the first returns one small row a partition (its
first and last key, the sums of its last key), from which the driver works out what each partition starts with; the second
numbers or sums. Keys have no nulls. A lost executor's partitions are read again from the checkpoint, in the same order.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.checkpoints import cut


def arranged(df: DataFrame, *columns: str) -> DataFrame:
    """A checkpoint of df in the order of columns, over all its partitions."""
    return cut(df.repartitionByRange(*columns).sortWithinPartitions(*columns))


class _Walk:
    """Tells where the key changes, from batch to batch."""

    def __init__(self, key: Sequence[str], last: tuple | None = None):
        self.key, self.last = key, last

    def heads(self, batch: pa.RecordBatch) -> np.ndarray:
        n, columns = batch.num_rows, [batch.column(batch.schema.get_field_index(k)) for k in self.key]
        new = np.zeros(n, dtype=bool)
        new[0] = self.last != tuple(c[0].as_py() for c in columns)
        for c in columns:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        self.last = tuple(c[n - 1].as_py() for c in columns)
        return new


def _sums(values: np.ndarray, new: np.ndarray, carry: int) -> np.ndarray:
    """Inclusive sums within runs; carry belongs to the rows before the first new key."""
    total = np.cumsum(values)
    run = np.cumsum(new)
    before = np.concatenate(([-carry], (total - values)[new]))
    return total - before[run]


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def _starts(df: DataFrame, key: Sequence[str], values: Sequence[str]) -> tuple[dict[int, tuple], int]:
    """For each partition (the key before it, the sums of that key so far, how many keys so far), and how many keys in all."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, first, n, tails = _Walk(key), None, 0, [0] * len(values)
        for b in batches:
            if not b.num_rows:
                continue
            new = walk.heads(b)
            if first is None:
                first = tuple(b.column(b.schema.get_field_index(k))[0].as_py() for k in key)
            n += int(new.sum())
            tails = [int(_sums(_column(b, v), new, t)[-1]) for v, t in zip(values, tails, strict=True)]
        if first is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "ends": pa.array([pickle.dumps((first, walk.last, n, tails))], pa.binary())})

    found, last, sums, keys = {}, None, [0] * len(values), 0
    for part, packed in sorted((r[0], bytes(r[1])) for r in df.select(*key, *values).mapInArrow(ends, "part int, ends binary").collect()):
        found[part] = (last, sums, keys)
        first, end, n, tails = pickle.loads(packed)
        same = first == last
        sums = [t + s for t, s in zip(tails, sums, strict=True)] if same and n == 1 else tails
        keys += n - same
        last = end
    return found, keys


def _with(df: DataFrame, names: Sequence[str]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])


def numbered(df: DataFrame, key: Sequence[str], name: str, start: int = 0) -> tuple[DataFrame, int]:
    """df, arranged by key, with a column name: start, start + 1, ... by key; and the first number that is left."""
    starts, n = _starts(df, key, ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, _, before = starts.get(TaskContext.get().partitionId(), (None, [], 0))
        walk = _Walk(key, last)
        for b in batches:
            if b.num_rows:
                number = before + np.cumsum(walk.heads(b))
                before = int(number[-1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number - 1 + start)], names=[*b.schema.names, name])

    return df.mapInArrow(run, _with(df, [name])), start + n


def running(df: DataFrame, key: Sequence[str], values: dict[str, str]) -> DataFrame:
    """df, arranged by key and an order, with the sum of each value (new name -> column) over its key's rows so far."""
    names, columns = list(values), list(values.values())
    starts, _ = _starts(df, key, columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums, _ = starts.get(TaskContext.get().partitionId(), (None, [0] * len(columns), 0))
        walk = _Walk(key, last)
        for b in batches:
            if b.num_rows:
                new = walk.heads(b)
                done = [_sums(_column(b, c), new, s) for c, s in zip(columns, sums, strict=True)]
                sums = [int(x[-1]) for x in done]
                yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, done)], names=[*b.schema.names, *names])

    return df.mapInArrow(run, _with(df, names))
