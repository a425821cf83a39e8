"""Collections of points, merged when read: a log of numbered commits, and parts that they name.

A part is a Parquet table of points partitioned by level, in ranges of point_id, and the lexical postings of their texts beside
it. An upsert writes one part with the rows it got, whatever the collection's size. A commit is a small file that lists the
parts in force, newest first; it is written aside and renamed to its number, which fails if that number is there. So a reader
sees a commit whole or not at all, and of two writers of a number one fails. A reader takes of each part the points that no
newer part has: an anti-join by keys, which are broadcast as long as they are few. When `compact_after` parts have gathered
they are merged to one. Parts that no commit in force names stay for those who read them, until vacuum().

Works on any file system that Spark can write to and that renames files in one step.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import point_id
from ..operators.aggregate import status_rows
from ..operators.retrieval import normalised, postings
from ..schema import NODE, PAYLOAD

_TYPES = {f.name: f.dataType for f in NODE.fields} | {"text_unit_id": T.StringType()}
POINT = T.StructType([T.StructField("point_id", T.DecimalType(20, 0)), *[T.StructField(c, _TYPES[c]) for c in PAYLOAD], T.StructField("dense", T.ArrayType(T.FloatType()))])
POSTING = "point_id decimal(20,0), level int, token string, tf long, weight double"


def points(nodes: DataFrame) -> DataFrame:
    """Points of nodes: id, payload, and the unit vector. The lexical side is a postings table of its own."""
    payload = [F.col("id").alias(c) if c == "text_unit_id" else F.col(c) for c in PAYLOAD]
    extra = ["seq"] if "seq" in nodes.columns else []
    return nodes.select(point_id("id").alias("point_id"), *payload, normalised("embedding").alias("dense"), *extra)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by order. An aggregation, so a hot key costs one row a task."""
    fields = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_r")).select(key, "_r.*")


class Conflict(RuntimeError):
    """Another writer has committed since this one began."""


class Collections:
    def __init__(self, spark: SparkSession, root: str, compact_after: int = 16):
        self.spark, self.root, self.compact_after = spark, root.rstrip("/"), compact_after
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._plainly = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # without overwriting

    def _log(self, name: str) -> str:
        return f"{self.root}/{name}/_log"

    def _version(self, name: str) -> int | None:
        """The number of the commit in force."""
        log = self._path(self._log(name))
        found = [s.getPath().getName() for s in self._fs.listStatus(log)] if self._fs.exists(log) else []
        return max((int(x.removesuffix(".json")) for x in found if x.endswith(".json") and not x.startswith(".")), default=None)

    def _parts(self, name: str, version: int | None = None) -> list[str]:
        """Parts in force, newest first."""
        version = self._version(name) if version is None else version
        if version is None:
            raise LookupError(name)
        stream = self._fs.open(self._path(f"{self._log(name)}/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))["parts"]
        finally:
            stream.close()

    def _commit(self, name: str, version: int, parts: list[str]) -> None:
        """Make this the commit of that number; Conflict if there is one."""
        aside = self._path(f"{self._log(name)}/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"parts": parts}).encode()))
        out.close()
        try:
            self._files.rename(aside, self._path(f"{self._log(name)}/{version:020d}.json"), self._plainly)
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                raise Conflict(f"another writer has changed {name}") from None
            raise

    def _write(self, name: str, rows: DataFrame) -> str:
        """A new part, in no commit yet."""
        part = f"p_{uuid.uuid4().hex}"
        path = f"{self.root}/{name}/{part}"
        rows.select(*POINT.names).repartitionByRange("point_id").sortWithinPartitions("point_id").write.partitionBy("level").parquet(path)
        stored = self.spark.read.schema(POINT).parquet(path)
        each = postings(stored.select(F.struct("point_id", "level").alias("p"), "text"), "p").select("p.*", "token", "tf", "weight")
        # by ranges of tokens, so that a query's few tokens are in few files and row groups; a frequent token has many ranges
        each.repartitionByRange("token", "point_id").sortWithinPartitions("token", "point_id").write.parquet(f"{path}_postings")
        return part

    def _merged(self, name: str, parts: list[str], suffix: str, schema) -> DataFrame:
        """Rows of each part whose point no newer part has."""
        read = lambda part, s, kind: self.spark.read.schema(kind).parquet(f"{self.root}/{name}/{part}{s}")
        out, newer = None, None
        for part in parts:
            rows = read(part, suffix, schema)
            rows = rows.join(newer, "point_id", "left_anti").select(*rows.columns) if newer is not None else rows
            out = rows if out is None else out.unionByName(rows)
            keys = read(part, "", POINT).select("point_id")
            newer = keys if newer is None else newer.unionByName(keys)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def exists(self, name: str) -> bool:
        return self._version(name) is not None

    def list(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if self.exists(s.getPath().getName()))

    def ensure(self, name: str) -> dict | None:
        """Statistics if the collection exists; else it is created, and None."""
        if not self.exists(name):
            try:
                self._commit(name, 0, [])
                return None
            except Conflict:
                pass  # someone else has created it
        return self.info(name)

    def info(self, name: str) -> dict | None:
        """A pure read; None if there is no such collection."""
        if not self.exists(name):
            return None
        row = status_rows(self.read(name).select(F.lit(name).alias("collection"))).first()
        return {"name": name, "points": row["points"] if row else 0, "status": "green"}

    def status(self, name: str | None = None) -> list[dict]:
        return [x for x in ([self.info(name)] if name else map(self.info, self.list())) if x]

    def drop(self, name: str) -> bool:
        return bool(self._fs.delete(self._path(f"{self.root}/{name}"), True))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The points of the commit in force now (or of an earlier one): later commits don't change this DataFrame."""
        return self._merged(name, self._parts(name, version), "", POINT)

    def postings(self, name: str) -> DataFrame:
        """(point_id, level, token, tf, weight) of the commit in force, stored in the order of tokens."""
        return self._merged(name, self._parts(name), "_postings", POSTING)

    def vacuum(self, name: str, seconds: float = 7 * 24 * 3600) -> int:
        """Delete parts that the commit in force doesn't name and that are not younger, and earlier commits as old: how many folders."""
        version, oldest, gone = self._version(name), time.time() - seconds, 0
        if version is None:
            return 0
        kept = set(self._parts(name, version))
        old = lambda s: s.getModificationTime() / 1000 < oldest
        for s in self._fs.listStatus(self._path(f"{self.root}/{name}")):
            folder = s.getPath().getName()
            if folder.startswith("p_") and folder.removesuffix("_postings") not in kept and old(s):
                gone += bool(self._fs.delete(s.getPath(), True))
        for s in self._fs.listStatus(self._path(self._log(name))):
            if s.getPath().getName() != f"{version:020d}.json" and old(s):
                self._fs.delete(s.getPath(), False)
        return gone

    def upsert(self, name: str, rows: DataFrame, attempts: int = 5) -> None:
        """Points by id, the last by seq wins, new ones over stored ones. Running it twice changes nothing.

        What is written are these rows alone. They don't depend on what is stored, so if another writer commits in between, the
        same part is committed after it.
        """
        if not self.exists(name):
            try:
                self._commit(name, 0, [])
            except Conflict:
                pass
        part = self._write(name, last_wins(rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(0)), "point_id", "seq"))
        for left in reversed(range(attempts)):
            version = self._version(name)
            parts = [part, *self._parts(name, version)]
            try:
                self._commit(name, version + 1, parts)
                break
            except Conflict:
                if not left:
                    raise
        if len(parts) > self.compact_after:
            try:
                self.compact(name)
            except Conflict:
                pass  # the next upsert will see to it

    def compact(self, name: str) -> None:
        """Merge the parts in force to one. Conflict if another writer commits meanwhile; then nothing has changed."""
        version = self._version(name)
        merged = self._write(name, self.read(name, version))
        self._commit(name, version + 1, [merged])

    def rebuild(self, name: str, rows: DataFrame) -> None:
        """Replace everything: what re-clustering old and new nodes together needs. Conflict if another writer commits meanwhile."""
        version = self._version(name)
        if version is None:
            self._commit(name, 0, [])
            version = 0
        order = rows if "seq" in rows.columns else rows.withColumn("seq", F.lit(0))
        self._commit(name, version + 1, [self._write(name, last_wins(order, "point_id", "seq"))])
