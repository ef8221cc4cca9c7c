"""The bounded sample of labelled rows that a classifier is fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text is a multiple of 5. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, row_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label): at most ``rows`` labelled documents that aren't held out, chosen and ordered by a hash of the id.

    Null labels and ids are left out, and of what is chosen texts of more than ``row_bytes`` bytes, so that the sample is
    bounded in size; of several labels or texts for one id the largest counts. Only the ids chosen, ``rows`` at most, are
    broadcast; the texts come from one pass over the documents.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.withColumn("rank", F.xxhash64("doc_id", F.lit(label))).orderBy("rank", "doc_id").limit(rows)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") <= row_bytes)
    one = base.join(F.broadcast(chosen), "doc_id").groupBy("rank", "doc_id", "label").agg(F.max("text").alias("text"))
    return one.repartition(1).sortWithinPartitions("rank", "doc_id").select("doc_id", "text", "label")
