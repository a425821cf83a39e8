"""Byte-pair encoding with a given vocabulary of ranked byte strings.

A text is cut into pieces by a pattern in the JVM; an Arrow batch is handled in parts of a bounded number of pieces, of which the
different ones are encoded once each, and token numbers are dealt back to the rows by arithmetic. Within a piece the neighbours
that make the token of least rank are joined first, the leftmost of equals, until no neighbours make a token. A linked list and
a heap do that in n log n steps, so a piece of a million letters is no trouble. Texts hold nothing special: the names of special tokens are ordinary characters.

A null text has null tokens, an empty text none. decode() gives back a text exactly; a part of its tokens may begin or end
within a character, which then is U+FFFD.
"""

from __future__ import annotations

import base64
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .batches import parts
from .text import _c

#: Fixed value: contractions, then words, numbers and signs with a space before, then white space.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Pieces that a worker encodes at once: fewer would have rare ones, which aren't remembered, encoded more often.
PIECES = 1 << 20
#: Pieces whose tokens a worker remembers.
ROOM = 200_000


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token numbers of a piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here; 0 within a part
    before = list(range(-1, n - 1))  # where the part before begins
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)

    def offer(left: int, middle: int, right: int) -> None:
        if (r := ranks.get(piece[left:right])) is not None:
            heappush(heap, (r, left, middle, right))

    while heap:
        _, left, middle, right = heappop(heap)
        if end[left] != middle or end[middle] != right:
            continue  # one of the two has been joined to another
        end[left], end[middle] = right, 0
        if right < n:
            before[right] = left
            offer(left, right, end[right])
        if before[left] >= 0:
            offer(before[left], left, right)
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class RankedBPE:
    """A tokenizer: encode(column) and decode(numbers). Its ranks are pickled to tasks: a few megabytes, as long as the vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("a vocabulary has to hold every single byte")
        self.ranks, self.pattern = ranks, pattern
        self._kept: dict[str, list[int]] = {}
        self._table: pa.Array | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str, pattern: str = PATTERN, most: int = 1_000_000) -> RankedBPE:
        """From lines of a base64 token and its rank, on any file system that Spark reads; more than `most` lines are refused."""
        rows = spark.read.text(path).where("value <> ''").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{path} has more than {most} tokens")
        return cls({base64.b64decode(a): int(n) for a, n in (r[0].split() for r in rows)}, pattern)

    @cached_property
    def _words(self) -> dict[int, bytes]:
        return {n: b for b, n in self.ranks.items()}

    def pieces(self, text: Column | str) -> Column:
        """The parts of a text that are encoded by themselves; white space and classes as in Unicode."""
        return F.regexp_extract_all(_c(text), F.lit(f"(?U){self.pattern}"), F.lit(0))

    def of_piece(self, piece: str) -> list[int]:
        found = self._kept.get(piece)
        if found is None:
            found = merged(piece.encode(), self.ranks)
            if len(self._kept) < ROOM:
                self._kept[piece] = found
        return found

    def of_lists(self, lists: pa.Array) -> pa.Array:
        """Token numbers of each list of pieces, as a list."""
        return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *(self._of_part(lists.slice(a, b - a)) for a, b in parts(lists, PIECES))])

    def _of_part(self, lists: pa.Array) -> pa.Array:
        each = lists.flatten().dictionary_encode()
        tokens = [self.of_piece(p) for p in each.dictionary.to_pylist()]
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        every = np.fromiter((n for t in tokens for n in t), dtype=np.int32, count=int(sizes.sum()))
        at = each.indices.to_numpy()
        n = sizes[at]
        total = np.concatenate(([0], np.cumsum(n)))
        places = np.repeat(starts[at] - total[:-1], n) + np.arange(total[-1])
        rows = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))
        return pa.ListArray.from_arrays(pa.array(total[rows], pa.int32()), pa.array(every[places], pa.int32()), mask=lists.is_null())

    def tokens(self, text: Column | str) -> Column:
        """array<int> of token numbers."""
        own = RankedBPE(self.ranks, self.pattern)  # without what this one has kept

        @F.arrow_udf("array<int>")
        def run(lists: pa.Array) -> pa.Array:
            return own.of_lists(lists)

        return run(self.pieces(text))

    def decode(self, numbers) -> str:
        return b"".join(self._words[n] for n in numbers).decode("utf-8", "replace")

    def of_numbers(self, lists: pa.Array) -> pa.Array:
        """The text of each list of token numbers."""
        if self._table is None:
            words = {n: b for b, n in self.ranks.items()}
            self._table = pa.array([words.get(i, b"") for i in range(max(words) + 1)], pa.binary())
        return pa.concat_arrays([pa.array([], pa.string()), *(self._texts_of_part(lists.slice(a, b - a)) for a, b in parts(lists))])

    def _texts_of_part(self, lists: pa.Array) -> pa.Array:
        taken = self._table.take(lists.flatten())
        ends = np.frombuffer(taken.buffers()[1], np.int32)
        rows = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())))
        data, at = memoryview(taken.buffers()[2] or b""), ends[rows].tolist()
        return pa.array([None if none else str(data[x:y], "utf-8", "replace") for x, y, none in zip(at, at[1:], lists.is_null().to_pylist(), strict=False)], pa.string())

    def texts(self, numbers: Column | str) -> Column:
        own = RankedBPE(self.ranks, self.pattern)

        @F.arrow_udf("string")
        def run(lists: pa.Array) -> pa.Array:
            return own.of_numbers(lists)

        return run(_c(numbers))
