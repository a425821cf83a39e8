"""The corpus pipeline: documents -> quality -> near-dedup -> decontamination -> PII -> mixing.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of documents; the
last adds size, source_size, target and taken. STAGES is run by run() with each stage's result written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import decontaminate, mixing, pii, quality, simhash
from quarrystone.llm.common import cut

#: Of surrogates; a deployment passes its own secret here.
PII_KEY = b"quarrystone"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity is above their language's threshold go, as do texts without tokens."""
    return quality.keep(docs, _read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of copies and near copies stays."""
    return simhash.dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go."""
    return decontaminate.remove_documents(docs, _read(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities in the text get surrogates; n_chars follows the new text."""
    out = pii.scrub(docs, PII_KEY).drop("_qs_entities")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with how many of its words the mix takes, repeats counted: taken / size is its repeat factor, 0 leaves it out."""
    return mixing.mix(docs)


STAGES = [
    ("quality", quality_classifier),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii_surrogates),
    ("mixing", source_mixing),
]
#: SQL can express neither the language model nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)  # in the shared folder: later stages read the table again and again
    return docs
