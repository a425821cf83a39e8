"""Texts beyond one row: a rope is the rows (key, offset, piece) of a text that is never put together.

What concatenation by source or by entity makes as one string (aggregate.py), these make as pieces with running lengths, so that
a key with a third of all rows is as many tasks as its bytes ask for. Windows over a rope equal windows over the whole text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.checkpoints import cut
from ..functions.tokens import tokens


def running(df: DataFrame, key: str, order: Sequence[str], amount: str, out: str = "before") -> DataFrame:
    """df with `out`: the sum of `amount` over the rows of the same key that come before in `order`, and `total` of the key.

    Rows are sorted by ranges of (key, order) and summed by range; only the sums, a row for each key and range, are added up in one
    window a key. Rows equal in key and order stand in one range, in an order of their own: `order` should tell rows apart. Null
    keys are a key; a null amount counts nothing. The ranges are kept by a checkpoint, since they are drawn from a sample.
    """
    ranged = cut(df.repartitionByRange(F.col(key), *[F.col(c) for c in order]).withColumn("_part", F.spark_partition_id()))
    n = F.coalesce(F.col(amount).cast("long"), F.lit(0))
    sums = ranged.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_at")).agg(F.sum(n).alias("_sum"))
    of_key = Window.partitionBy("_key")
    earlier = of_key.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_key", "_at", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"), F.sum("_sum").over(of_key).alias("total"))
    inside = Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = ranged.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    joined = within.join(sums, (F.col("_part") == F.col("_at")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(out, F.col("_base") + F.col("_in")).drop("_part", "_at", "_key", "_base", "_in")


def placed(rows: DataFrame, key: str, seq: str, value: str, amount: Column, out: str) -> DataFrame:
    """(key, seq, value, amount, `out`, total): each row that isn't null at its place in `running` order of (seq, a hash of its value).

    Sums are made of the amounts alone; the values move once, to meet their places. Copies equal in key, seq and value are one row
    on the way and follow one another.
    """
    same = F.struct(F.col(key), F.col(seq), F.xxhash64(value)).alias("_same")  # a struct: null fields of it are equal in a join
    some = rows.where(F.col(value).isNotNull())
    slim = some.select(same, amount.cast("long").alias("amount")).groupBy("_same").agg(F.first("amount").alias("amount"), F.count("*").alias("_copies"))
    flat = slim.select(F.col(f"_same.{key}").alias("_rope"), F.col(f"_same.{seq}").alias("_seq"), "_same", "amount", "_copies", (F.col("amount") * F.col("_copies")).alias("_all"))
    at = running(flat, "_rope", ["_seq", "_same"], "_all", "_first").select("_same", "amount", "_copies", "_first", "total")
    values = some.select(same, value).groupBy("_same").agg(F.first(value).alias(value))
    each = values.join(at, "_same").withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
    return each.select(F.col(f"_same.{key}").alias(key), F.col(f"_same.{seq}").alias(seq), value, "amount", (F.col("_first") + F.col("_copy") * F.col("amount")).alias(out), "total")


def rope(rows: DataFrame, key: str, seq: str, value: str = "text", by: str = T.DOCUMENT_JOIN) -> DataFrame:
    """(key, seq, offset, piece, n_chars): the values in order of `seq`, each with its place in their joined text of n_chars.

    Null values aren't part of the text. The separator isn't stored: it stands after each piece but the last.
    """
    out = placed(rows, key, seq, value, F.length(value) + len(by), "offset")
    return out.select(key, seq, "offset", F.col(value).alias("piece"), (F.col("total") - len(by)).alias("n_chars"))


def heads(rows: DataFrame, key: str, seq: str, size: int, value: str = "text", by: str = T.DOCUMENT_JOIN) -> DataFrame:
    """(key, head): the first `size` characters of each key's joined text. No more of a row is moved than that."""
    short = rows.where(F.col(value).isNotNull()).select(key, seq, F.substring(value, 1, size).alias("piece"), (F.length(value) + len(by)).alias("_n"), F.xxhash64(value).alias("_h"))
    first = running(short, key, [seq, "_h"], "_n", "offset").where(F.col("offset") < size)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "piece"))), lambda x: x["piece"]), by)
    return first.groupBy(key).agg(F.substring(joined, 1, size).alias("head"))


def rope_chunks(rows: DataFrame, key: str, seq: str, size: int = 450, overlap: int = 90, value: str = "text") -> DataFrame:
    """(key, chunk_index, original_text, n_tokens): what `chunk` makes of the joined text of each key.

    Holds for every separator of white space, since white space ends a token. A row's tokens go to the windows they reach into, and
    a window brings together `size` tokens at most, whatever its key holds. Blank texts give no chunk.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap has to be at least 0 and below size")
    step = size - overlap
    at = placed(rows.select(key, seq, value), key, seq, value, F.size(tokens(value)), "_start").where("amount > 0")
    at = at.select(key, F.col("amount").alias("_n"), "_start", "total", tokens(value).alias("_tokens"))
    last = F.floor((F.greatest(F.col("total") - overlap, F.lit(1)) - 1) / step)
    low = F.greatest(F.floor((F.col("_start") - size) / step) + 1, F.lit(0))
    high = F.least(F.floor((F.col("_start") + F.col("_n") - 1) / step), last)
    reached = at.where(low <= high).withColumn("chunk_index", F.explode(F.sequence(low, high)))
    begin = F.col("chunk_index") * step - F.col("_start")  # of the window, counted from the row's first token
    some = F.slice("_tokens", (F.greatest(begin, F.lit(0)) + 1).cast("int"), (F.least(begin + size, F.col("_n")) - F.greatest(begin, F.lit(0))).cast("int"))
    shown = reached.select(key, "chunk_index", "_start", some.alias("_some")).select(key, "chunk_index", F.struct(F.col("_start").alias("o"), F.array_join("_some", " ").alias("t")).alias("_part"), F.size("_some").alias("_n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda x: x["t"]), " ")  # strings: an array of tokens is thrice as long
    out = shown.groupBy(key, "chunk_index").agg(joined.alias("original_text"), F.sum("_n").cast("int").alias("n_tokens"))
    return out.withColumn("chunk_index", F.col("chunk_index").cast("int"))


def source_chunks(docs: DataFrame, size: int = 450, overlap: int = 90, seq: str = "seq", bits: int = 512) -> DataFrame:
    """`chunk` of `concat_by_source` (source, chunk_index, original_text, n_tokens, document_id, first_seq, metadata), made of rows."""
    first = [F.min_by(c, seq).alias(c) for c in ("title", "creation_date") if c in docs.columns]
    about = docs.groupBy("source").agg(F.min(seq).alias("first_seq"), *first)
    begun = heads(docs, "source", seq, T.DOCUMENT_ID_HEAD).withColumnRenamed("source", "_s")
    about = about.join(begun, F.col("source").eqNullSafe(F.col("_s"))).withColumn("document_id", T.document_id("source", "head", bits)).drop("_s", "head")
    chunks = rope_chunks(docs, "source", seq, size, overlap).withColumnRenamed("source", "_s")
    return chunks.join(about, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
