"""Documents from files: plain text, CSV, Markdown, HTML, and PDF.

Every reader gives DOCUMENT rows: title, text, source, creation_date, raw_data, seq, error. Blank documents drop out; a
source that can't be read gives one row with its error instead, so that others go on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text as T
from ..functions.html import clean_text, page_title
from ..functions.pdf import page_texts
from ..schema import DOCUMENT


def normalise(rows: DataFrame, title: str | None = None, seq: str | None = None) -> DataFrame:
    """Document rows from (source, text, ...): blank texts drop out, defaults are filled in."""
    named = F.coalesce(F.col(title), F.lit(T.NO_TITLE)) if title else F.lit(T.NO_TITLE)
    date = F.coalesce(F.col("creation_date"), F.lit("")) if "creation_date" in rows.columns else F.lit("")
    raw = F.col("raw_data") if "raw_data" in rows.columns else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return rows.where(~T.is_blank("text")).select(named.alias("title"), "text", "source", date.alias("creation_date"), raw.alias("raw_data"), (F.col(seq) if seq else F.lit(0)).cast("long").alias("seq"), F.lit(None).cast("string").alias("error"))


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return normalise(_whole(spark, path))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """The text without heading marks, emphasis, link targets, and fences."""
    t = F.regexp_replace("text", r"(?m)^\s{0,3}(#{1,6}|>|```\w*|[-*+])\s*", "")
    t = F.regexp_replace(t, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(\*\*|__|\*|`)(\S[^\n]*?)\1", "$2")
    return normalise(_whole(spark, path).withColumn("text", t))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    rows = _whole(spark, path).withColumn("title", page_title("text")).withColumn("text", clean_text("text"))
    return normalise(rows, "title")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One document for each row, a `column: value` line for each column; values as they are written."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', enforceSchema=False)
    columns = rows.columns
    with_source = rows.select("*", F.col("_metadata.file_path").alias("_source"), F.monotonically_increasing_id().alias("_seq"))
    return normalise(csv_rows(with_source, columns).withColumnRenamed("_source", "source"), seq="_seq")


def csv_rows(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """rows with text: their columns as `column: value` lines, null as an empty value."""
    return rows.withColumn("text", F.array_join(F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]), "\n"))


def read_pdf(spark: SparkSession, path: str, pages: Callable[[bytes], list] = page_texts) -> DataFrame:
    """One document for each page; a file or page that can't be read is a row with its error. Files of up to 2 GB.

    pages: bytes -> the pages' texts, or an error in a page's place; another PDF library's, if the deployment has one.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for source, content in zip(b.column(0), b.column(1), strict=True):  # a file at a time
                try:
                    got = pages(content.as_py())
                except Exception as e:  # noqa: BLE001 - whatever a library raises for a broken file
                    got = [e]
                texts = [None if isinstance(t, Exception) else t for t in got]
                errors = [f"{type(t).__name__}: {t}" if isinstance(t, Exception) else None for t in got]
                yield pa.RecordBatch.from_arrays([pa.array([source.as_py()] * len(got), pa.string()), pa.array(range(len(got)), pa.int64()), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["source", "seq", "text", "error"])

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "source string, seq long, text string, error string")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    title = F.when(F.col("error").isNull(), F.lit(T.NO_TITLE))
    some = rows.where(F.col("error").isNotNull() | ~T.is_blank("text"))  # one pass over the files, with the errors
    return some.select(title.alias("title"), "text", "source", F.lit("").alias("creation_date"), empty.alias("raw_data"), "seq", "error")


READERS = {".csv": read_csv, ".md": read_markdown, ".markdown": read_markdown, ".html": read_html, ".htm": read_html, ".pdf": read_pdf}


def read_source(spark: SparkSession, source: str, web: DataFrame | None = None) -> DataFrame:
    """Documents of one source. http(s) sources are looked up in web (url, html), pages that were fetched before."""
    source = source.strip()
    if source.startswith(("http://", "https://")):
        if web is None:
            raise FileNotFoundError(source)
        rows = web.where(F.col("url") == source).where("html is not null")
        return normalise(rows.select(F.col("url").alias("source"), page_title("html").alias("title"), clean_text("html").alias("text")), "title")
    name = source.lower().rstrip("/")
    reader = next((r for suffix, r in READERS.items() if name.endswith(suffix)), read_text)
    try:
        out = reader(spark, source)
    except AnalysisException as e:
        raise FileNotFoundError(source) from e
    # the source as asked for; a folder's files keep their own
    return out


def read_sources(spark: SparkSession, sources: Sequence[str], web: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Documents of all sources, numbered in order by `ord`; a source that can't be read gives a row with its error.

    strict: raise instead.
    """
    every = None
    for i, s in enumerate(sources):
        try:
            one = read_source(spark, s, web)
        except (FileNotFoundError, NotImplementedError) as e:
            if strict:
                raise
            one = spark.createDataFrame([(None, None, s, "", {}, 0, f"{type(e).__name__}: {e}")], DOCUMENT)
        one = one.withColumn("ord", F.lit(i))
        every = one if every is None else every.unionByName(one)
    return every if every is not None else spark.createDataFrame([], DOCUMENT + ", ord int")


def missing_sources(requested: DataFrame, present: DataFrame) -> DataFrame:
    return requested.join(present.select("source"), "source", "left_anti")


def read_manifest(spark: SparkSession, path: str, project: str) -> dict:
    """A stored manifest, or an empty one; at most one small row is read."""
    from ..schema import MANIFEST

    try:
        row = spark.read.schema(MANIFEST).json(path, multiLine=True).where(F.col("project") == project).first()
    except AnalysisException:
        row = None
    return json.loads(json.dumps(row.asDict(recursive=True))) if row else {"project": project, "visited": [], "saved_pages": []}


def write_texts(rows: DataFrame, path: str) -> None:
    """(project, url_key, text), partitioned by project; a project's partition is replaced as a whole."""
    (rows.select("project", "url_key", "text").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(path))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.withColumn("created_at", T.utc_now()).write.mode("overwrite").json(path)


def write_transcripts(rows: DataFrame, path: str) -> None:
    """(video_id, title, transcript) -> one text for each file name."""
    named = rows.select(T.transcript_name("video_id", "title").alias("file"), F.col("transcript").alias("value"))
    named.write.mode("overwrite").partitionBy("file").text(path)
