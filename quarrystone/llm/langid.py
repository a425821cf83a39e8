"""Language identification in two steps: the family first, then the language among its relatives.

Features. A text's letters (lower case; marks stay with their letters, all else is one space) give runs of 1 to 4 characters,
hashed to WIDTH counts; square roots of their shares are a vector of length 1, so long and short texts compare. All of a text
counts, whatever its length. The share of a run is what tells languages apart, so no word lists are needed.

Model. Families are a parameter, codes of related languages; a language in none is a family of its own. One-versus-one linear
support vector machines (squared hinge, dual coordinate descent) separate families, and within each family its languages. A
machine is trained by a task of its own, all in one Spark job, from a bounded sample of labelled rows: at most `max_train`
rows in all, shared evenly by languages, those of least hash. Machines vote; the sum of margins (cut at 1) decides ties, then
the alphabet. score is the product, over both steps, of the logistic of the winner's least margin: near 1 when all its
machines agree clearly, below a half when another language beats it; 1 where there is nothing to choose.

A text that is null or without letters is `und`, with score 0; so is every text when nothing was learned. Rows of a null
language are not learned from. Empty tables give no rows. Repeated rows are answered alike, and each is learned from if chosen.
Extra columns take no part in a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checkpoints import cut
from .common import slices

#: Hashed runs of characters, and the longest run.
WIDTH, LONGEST = 1 << 12, 4
#: Texts that are turned into vectors at once, by characters.
ROOM = 1 << 20
#: Codes of related languages.
FAMILIES = {
    "germanic": "en de nl da sv no nb nn is fo fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt",
    "indic": "hi bn mr gu pa ne ur si",
    "iranian": "fa ku ps tg",
    "semitic": "ar he am mt",
    "dravidian": "ta te kn ml",
    "sinitic": "zh yue",
    "austronesian": "id ms tl jv",
}
NO_LANGUAGE = "und"


def _classes(_kept: list = []) -> np.ndarray:  # noqa: B006
    """For each code point: its lower-case letter, itself if it is a mark, else 0 for a space; negative if it is a letter."""
    if not _kept:
        out = np.zeros(0x110000, dtype=np.int32)
        for i in range(0x110000):
            kind = unicodedata.category(c := chr(i))[0]
            if kind == "L":
                low = c.lower()
                out[i] = -ord(low) if len(low) == 1 else -i
            elif kind == "M":
                out[i] = i
        _kept.append(out)
    return _kept[0]


def _counts(text: str) -> tuple[np.ndarray, int]:
    """Counts of the hashed runs of text, and its letters. Parts of a very long text overlap by LONGEST - 1 characters."""
    total, letters, held = np.zeros(WIDTH, dtype=np.float64), 0, np.zeros(1, dtype=np.int64)
    for at in range(0, len(text) or 1, ROOM):
        c = _classes()[np.frombuffer(text[at : at + ROOM].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        letters += int(np.count_nonzero(c < 0))
        c = np.abs(c).astype(np.int64)
        last = at + ROOM >= len(text)
        old = len(held)
        c = np.concatenate((held, c, [0] if last else []) if last else (held, c)).astype(np.int64)
        gap = np.concatenate(([False], (c[1:] == 0) & (c[:-1] == 0)))
        gap[:old] = False
        c = c[~gap]
        new = old if at else 0  # runs that end before this place were counted with the part before
        run = np.zeros(len(c), dtype=np.uint64)
        for n in range(1, LONGEST + 1):
            run = run[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :].astype(np.uint64)
            h = (run + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            h = (h >> np.uint64(40)).astype(np.int64) % WIDTH
            begin = max(0, new - n + 1)
            total += np.bincount(h[begin:], minlength=WIDTH)
        held = c[-(LONGEST - 1) :]
    return total, letters


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 (zero for texts without letters), and which texts have letters."""
    out, has = np.zeros((len(texts), WIDTH), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    for i, t in enumerate(texts):
        if t:
            counts, letters = _counts(t)
            if letters:
                has[i] = True
                out[i] = np.sqrt(counts / counts.sum())
    return out, has


def svm(x: np.ndarray, y: np.ndarray, cost: float = 8.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights, the last for a constant 1, of a linear machine with squared hinge loss; y is 1 or -1.

    Dual coordinate descent. Each side's cost is set against its size, so that a frequent language isn't preferred.
    """
    x = np.concatenate((x, np.ones((len(x), 1), dtype=x.dtype)), axis=1).astype(np.float64)
    weight = np.zeros(x.shape[1])
    alpha = np.zeros(len(x))
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    diagonal = 1 / (2 * cost * share)
    norms = np.einsum("ij,ij->i", x, x) + diagonal
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(x)):
            slope = y[i] * (weight @ x[i]) - 1 + diagonal[i] * alpha[i]
            if alpha[i] > 0 or slope < 0:
                new = max(0.0, alpha[i] - slope / norms[i])
                weight += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
                most = max(most, abs(slope))
        if most < 1e-2:
            break
    return weight.astype(np.float32)


class Level(NamedTuple):
    """names in order; machines between names[a[i]] (positive) and names[b[i]] (negative), weights a row each."""

    names: list[str]
    a: np.ndarray
    b: np.ndarray
    weights: np.ndarray

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the place of the winner in names, and the winner's least margin (infinite if it is alone)."""
        n = len(self.names)
        if n == 1:
            return np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        votes, least = np.zeros((len(x), n)), np.full((len(x), n), np.inf)
        for i, (a, b) in enumerate(zip(self.a, self.b, strict=True)):
            m = margin[:, i]
            votes[:, a] += (m > 0) + np.clip(m, -1, 1) / (4 * n)
            votes[:, b] += (m <= 0) - np.clip(m, -1, 1) / (4 * n)
            least[:, a] = np.minimum(least[:, a], m)
            least[:, b] = np.minimum(least[:, b], -m)
        best = votes.argmax(axis=1)
        return best, least[np.arange(len(x)), best]


class Model(NamedTuple):
    """families, and the languages of each; both empty if nothing was learned."""

    families: Level
    languages: dict[str, Level]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        x, has = vectors(texts)
        found, score = np.full(len(texts), NO_LANGUAGE, dtype=object), np.zeros(len(texts))
        rows = np.flatnonzero(has)
        if not self.families.names or not len(rows):
            return found.tolist(), score
        family, sure = self.families.choose(x[rows])
        for f in np.unique(family):
            own, level = rows[family == f], self.languages[self.families.names[f]]
            best, margin = level.choose(x[own])
            found[own] = [level.names[i] for i in best]
            score[own] = _logistic(sure[family == f]) * _logistic(margin)
        return found.tolist(), score


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.minimum(margin, 100)))


def _family_of(families: dict[str, str]) -> dict[str, str]:
    return {code: name for name, codes in families.items() for code in codes.split()}


def sample(rows: DataFrame, max_train: int) -> DataFrame:
    """(lang, text) of labelled rows (doc_id, text, lang): at most max_train in all, as many of each language, of least hash."""
    rows = rows.where("lang is not null and text is not null")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_train).collect()}
    each = max(1, max_train // max(1, len(n)))
    share = F.lit(0.0)
    for lang, m in n.items():  # a few more than needed, so that no task sorts a frequent language
        share = F.when(F.col("lang") == lang, min(1.0, (1.5 * each + 50) / m)).otherwise(share)
    at = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(13))
    rows = rows.select("lang", "text", at.alias("_at")).where(F.pmod("_at", F.lit(1 << 20)) < share * (1 << 20))
    first = Window.partitionBy("lang").orderBy("_at")
    return rows.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= each).select("lang", "text")


def train(rows: DataFrame, families: dict[str, str] | None = None, max_train: int = 3_000) -> Model:
    """The model, from labelled rows (doc_id, text, lang). Only vectors of the bounded sample leave the tasks, as sparse rows."""
    spark = rows.sparkSession

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b):
                texts = s.column(s.schema.get_field_index("text")).to_pylist()
                langs = s.column(s.schema.get_field_index("lang")).to_pylist()
                for lang, t in zip(langs, texts, strict=True):
                    x, has = vectors([t])
                    if has[0]:
                        at = np.flatnonzero(x[0]).astype(np.uint16)
                        yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.tobytes()], pa.binary()), pa.array([x[0][at].tobytes()], pa.binary())], names=["lang", "at", "x"])

    rows = cut(sample(rows, max_train).mapInArrow(sparse, "lang string, at binary, x binary")).orderBy("lang", "x", "at").collect()
    langs = sorted({r["lang"] for r in rows})
    family = {x: _family_of(FAMILIES if families is None else families).get(x, x) for x in langs}
    names = sorted(set(family.values()))
    packed = [(r["lang"], bytes(r["at"]), bytes(r["x"])) for r in rows]
    jobs = [("", a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    related = {f: [x for x in langs if family[x] == f] for f in names}
    jobs += [(f, a, b) for f, own in related.items() for i, a in enumerate(own) for b in own[i + 1 :]]
    shared = spark.sparkContext.broadcast((packed, family))  # at most max_train sparse rows

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, family = shared.value
        for b in batches:
            for level, one, other in zip(*(c.to_pylist() for c in b.columns), strict=True):
                side = (lambda lang: family[lang]) if level == "" else (lambda lang: lang)
                own = [r for r in packed if side(r[0]) in (one, other)]
                x = np.zeros((len(own), WIDTH), dtype=np.float32)
                for i, (_, at, v) in enumerate(own):
                    x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(v, np.float32)
                y = np.array([1.0 if side(r[0]) == one else -1.0 for r in own])
                yield pa.RecordBatch.from_arrays([*(pa.array([c]) for c in (level, one, other)), pa.array([svm(x, y).tobytes()], pa.binary())], names=["level", "one", "other", "weights"])

    got = {}
    if jobs:
        tasks = spark.createDataFrame(jobs, "level string, one string, other string").repartition(len(jobs))
        got = {(r["level"], r["one"], r["other"]): np.frombuffer(r["weights"], np.float32) for r in tasks.mapInArrow(fit, "level string, one string, other string, weights binary").collect()}

    def level(name: str, own: list[str]) -> Level:
        keys = [(a, b) for a in range(len(own)) for b in range(a + 1, len(own))]
        weights = np.array([got[name, own[a], own[b]] for a, b in keys], dtype=np.float32).reshape(len(keys), WIDTH + 1)
        return Level(own, np.array([a for a, _ in keys], dtype=np.int64), np.array([b for _, b in keys], dtype=np.int64), weights)

    return Model(level("", names), {f: level(f, own) for f, own in related.items()})


def predicted(docs: DataFrame, model: Model, *columns: str) -> DataFrame:
    """columns of docs, and lang_pred and score of its text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, n = shared.value, len(columns)
        for b in batches:
            for s in slices(b, "_qs_text"):
                for at in range(0, s.num_rows, 512):
                    part = s.slice(at, 512)
                    found, score = model.predict(part.column(n).to_pylist())
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(found, pa.string()), pa.array(score)], names=schema.names)

    return docs.select(*columns, F.col("text").alias("_qs_text")).mapInArrow(run, schema)


def held_out() -> Column:
    """A quarter of documents, by their id: those whose crc32 leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents that are not held out."""
    model = train(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return predicted(docs.withColumn("held_out", held_out()), model, "doc_id", "held_out").select("doc_id", "held_out", "lang_pred", "score")
