"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraphs.

A text is cut into paragraphs at newlines; a long line is cut further where the hash of a word says so, so that an edit
changes the paragraphs near it only. A paragraph's digest is the XXH64 of its
bytes and of how often it came before in the text, so the digests form a set. Each digest goes to three cells of a
sketch, one in each third; a cell keeps a count, the XOR of digests and the XOR of their checks. The sketch of one version
minus that of another holds the differing digests alone: peeling cells of a single digest recovers them. If cells are
left over, both sketches are built again with twice the cells, until peeling ends.

A fingerprint is the text's sketch at the smallest size: cells, paragraphs, then the cells in base64. Equal texts have equal
fingerprints. Likeness is 1 - (digests that differ) / (digests of both), and 1 for two empty texts.

Null texts are empty texts and have no paragraphs. Rows of equal doc_id follow each other by text, null first; a null
doc_id comes before all others.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, shuffle_partitions, table

_U = np.uint64
#: Cells of the smallest sketch; a multiple of three.
CELLS = 24
_WORD = re.compile(rb"\S+\s*")


def ends(text: bytes, begin: int = 0) -> list[int]:
    """Where paragraphs end, from begin on: at newlines, and after 64 bytes or more at a word whose hash divides by 8.

    An end depends on its own paragraph and the byte after it alone.
    """
    out = []
    while begin < len(text):
        line = text.find(b"\n", begin) + 1 or len(text)
        while line - begin > 64:
            for m in _WORD.finditer(text, begin + 64, line):
                if xxhash.xxh32_intdigest(m.group()) & 7 == 0:
                    begin = m.end()
                    out.append(begin)
                    break
            else:
                break
        if begin < line:
            out.append(line)
        begin = line
    return out


def hashes(text: bytes, at: list[int], begin: int = 0) -> list[int]:
    return [xxhash.xxh64_intdigest(text[a:b]) for a, b in zip([begin, *at], at, strict=False)]


def digests(paragraph_hashes: list[int]) -> np.ndarray:
    """A set: a hash that came before is hashed again with its number."""
    if len(set(paragraph_hashes)) == len(paragraph_hashes):
        return np.array(paragraph_hashes, dtype=_U)
    seen: Counter = Counter()
    out = []
    for h in paragraph_hashes:
        out.append(xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seen[h]) if h in seen else h)
        seen[h] += 1
    return np.array(out, dtype=_U)


def text_digests(text: bytes) -> np.ndarray:
    return digests(hashes(text, ends(text)))


def _check(d: np.ndarray) -> np.ndarray:
    return (d * _U(0x9E3779B97F4A7C15)) >> _U(48)


class Sketches:
    """Several sketches, one behind the other: for each cell a count, the XOR of digests and the XOR of checks."""

    def __init__(self, cells: np.ndarray):
        self.third = (cells // 3).astype(_U)
        self.begin = np.concatenate(([0], np.cumsum(cells)))
        n = int(self.begin[-1])
        self.owner = np.repeat(np.arange(len(cells)), cells)
        self.counts, self.digests, self.checks = np.zeros(n, np.int64), np.zeros(n, _U), np.zeros(n, _U)

    def put(self, d: np.ndarray, owner: np.ndarray, sign: np.ndarray) -> None:
        """Each digest goes to three cells of its owner's sketch, one in each third."""
        third, a = self.third[owner], d * _U(0xC2B2AE3D27D4EB4F)
        a ^= a >> _U(29)
        c = _check(d)
        for k in range(3):
            at = self.begin[owner] + ((a >> _U(21 * k) & _U(0x1FFFFF)) % third + _U(k) * third).astype(np.int64)
            np.add.at(self.counts, at, sign)
            np.bitwise_xor.at(self.digests, at, d)
            np.bitwise_xor.at(self.checks, at, c)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Digests, owners and signs that cells of one digest give up, and whether each owner's cells are all empty then."""
        found: list[tuple] = [(np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64))]
        for _ in range(200):
            pure = np.flatnonzero((np.abs(self.counts) == 1) & (_check(self.digests) == self.checks))
            if not len(pure):
                break
            d, owner = self.digests[pure], self.owner[pure]
            order = np.lexsort((d, owner))
            d, owner, sign = d[order], owner[order], self.counts[pure][order]
            new = np.concatenate(([True], (d[1:] != d[:-1]) | (owner[1:] != owner[:-1])))
            found.append((d[new], owner[new], sign[new]))
            self.put(d[new], owner[new], -sign[new])
        left = np.bincount(self.owner[(self.counts != 0) | (self.digests != 0) | (self.checks != 0)], minlength=len(self.third))
        return *(np.concatenate(x) for x in zip(*found, strict=True)), left == 0

    def texts(self, sizes: list[int]) -> list[str]:
        cells = np.zeros(len(self.counts), dtype=[("n", ">u2"), ("d", ">u8"), ("c", ">u2")])
        cells["n"], cells["d"], cells["c"] = self.counts & 0xFFFF, self.digests, self.checks
        return [f"{b - a}.{n}." + base64.b64encode(cells[a:b].tobytes()).decode() for a, b, n in zip(self.begin, self.begin[1:], sizes, strict=False)]


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, _U), *sets]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])


def sketches(sets: list[np.ndarray], cells: int = CELLS) -> list[str]:
    out = Sketches(np.full(len(sets), cells))
    d, owner = _flat(sets)
    out.put(d, owner, np.ones(len(d), np.int64))
    return out.texts([len(x) for x in sets])


def expected(a: np.ndarray, b: np.ndarray) -> int:
    """A guess at how many digests differ, from those that divide by 8; it only sets the first size to try."""
    x, y = (set(z[z & _U(7) == 0].tolist()) for z in (a, b))
    return max(abs(len(a) - len(b)), 8 * len(x ^ y))


def differing(lefts: list[np.ndarray], rights: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair the digests in the left alone and in the right alone, peeled from the difference of their sketches.

    Where cells are left over, that pair's sketches are built again with twice the cells.
    """
    out: list = [None] * len(lefts)
    todo = np.arange(len(lefts))
    cells = np.array([CELLS << max(0, int(1.3 * expected(a, b) - 1) // CELLS).bit_length() for a, b in zip(lefts, rights, strict=True)], dtype=np.int64)
    while len(todo):
        s = Sketches(cells[todo])
        for sets, sign in ((lefts, 1), (rights, -1)):
            d, owner = _flat([sets[i] for i in todo])
            s.put(d, owner, np.full(len(d), sign, np.int64))
        d, owner, sign, empty = s.peel()
        order = np.argsort(owner, kind="stable")
        d, sign = d[order], sign[order]
        bound = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(todo)))))
        for k in np.flatnonzero(empty):
            x, y = d[bound[k] : bound[k + 1]], sign[bound[k] : bound[k + 1]]
            out[todo[k]] = x[y > 0], x[y < 0]
        todo = todo[~empty]
        cells[todo] *= 2
        for i in todo[cells[todo] > [64 * (len(lefts[i]) + len(rights[i])) + 4 * CELLS for i in todo]]:
            out[i] = np.setdiff1d(lefts[i], rights[i]), np.setdiff1d(rights[i], lefts[i])  # two digests share all places
        todo = np.array([i for i in todo if out[i] is None], dtype=np.int64)
    return out


def likenesses(lefts: list[np.ndarray], rights: list[np.ndarray]) -> list[float]:
    return [1.0 - (len(x) + len(y)) / (len(a) + len(b)) if len(a) + len(b) else 1.0 for a, b, (x, y) in zip(lefts, rights, differing(lefts, rights), strict=True)]


def ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text, part): docs dealt to ranges of ascending doc_id.

    Ranges come from quantiles of doc_id.
    """
    spark = docs.sparkSession
    n = max(2 * shuffle_partitions(spark), 2)
    ids = docs.select("doc_id").where("doc_id is not null")
    at = ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)) if ids.head(1) else []
    bounds = sorted({int(x) for x in at})
    part = F.lit(0)
    if bounds:
        edges = F.array(*[F.lit(b) for b in bounds])
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))))
    return docs.select("doc_id", "text").withColumn("part", part)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    dealt = ranges(docs)
    # the first row of each range: ids and hashes only, then one row a range; as many as ranges, which are a setting
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id", F.col("text").isNotNull(), F.xxhash64("text"))
    firsts = sorted((r["part"], r["low"]) for r in dealt.groupBy("part").agg(F.min(order).alias("low")).collect())
    if not firsts:
        return docs.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    before = [(firsts[i - 1][0], low[1], low[3]) for i, (_, low) in enumerate(firsts)]
    lead = F.broadcast(docs.sparkSession.createDataFrame(before, "_qs_part int, _qs_id long, _qs_h long"))
    heads = dealt.join(lead, (F.xxhash64("text") == F.col("_qs_h")) & F.col("doc_id").eqNullSafe(F.col("_qs_id"))).select("doc_id", "text", F.col("_qs_part").alias("part"))
    rows = dealt.select("doc_id", "text", "part", F.lit(False).alias("last")).unionByName(heads.select("doc_id", "text", "part", F.lit(True).alias("last")))
    placed = rows.repartition(max(len(firsts), shuffle_partitions(docs.sparkSession)), "part").sortWithinPartitions("part", "last", F.col("doc_id").asc_nulls_first(), F.col("text").isNotNull(), F.xxhash64("text"))

    def finish(rows):
        """rows: (doc_id, text, paragraph ends, hashes, the next text, its digests)."""
        edited, own, new = [], [], []
        for _, t, at, hs, following, _ in rows:
            k = len(t) // 4
            e = (t[: len(t) - k] + following[:k]).encode()
            safe = bisect.bisect_left(at, len(t[: len(t) - k].encode()))  # these paragraphs end before the edit
            begin = at[safe - 1] if safe else 0
            own.append(digests(hs))
            new.append(digests(hs[:safe] + hashes(e, ends(e, begin), begin)))
            edited.append(hashlib.sha256(e).hexdigest())
        near = likenesses(own + own, new + [r[5] for r in rows])
        n = len(rows)
        return table(zip([r[0] for r in rows], [len(r[1]) for r in rows], edited, sketches(own), sketches(new), near[:n], near[n:], strict=True), schema)

    def run(batches):
        held, part, ended, rows, size = None, None, False, [], 0
        for batch in batches:
            for p, last, d, t in zip(*(batch.column(c).to_pylist() for c in ("part", "last", "doc_id", "text")), strict=True):
                if p != part:
                    held, part, ended = None, p, False
                if ended:  # a repeated row at the head of the next range
                    continue
                t = t or ""
                raw = t.encode()
                at = ends(raw)
                hs = hashes(raw, at)
                if held is not None:
                    rows.append((*held, t, digests(hs)))
                    size += len(t)
                held, ended = (d, t, at, hs), last
                if size > CHUNK_BYTES // 4:
                    yield finish(rows)
                    rows, size = [], 0
        if rows:
            yield finish(rows)

    return placed.select("part", "last", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
