"""The corpus pipeline: classifier, exact and near de-duplication, substring removal, packing; each stage on what is left.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewarden.llm.bagminhash import near_duplicates
from framewarden.llm.chaining import without_repeats
from framewarden.llm.exact_stream import exact_duplicates
from framewarden.llm.mil import scorer
from framewarden.llm.packing import pack_documents
from framewarden.llm.queries import tokenizer_path
from framewarden.llm.staging import keep_rows, scratch, stage, unstage
from framewarden.llm.words import give_back, text_slices

#: Documents that score less are rejected.
QUALITY_CUT = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null text is scored as an empty one; rows are scored each, whatever
    their ids; without labels all stay."""
    score = scorer(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                yield part.filter(pa.array(score(texts) >= QUALITY_CUT))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays, and only one. Null texts are empty ones, null ids the smallest.

    Rows go by id and text: another text with the id of a copy stays. An empty table stays empty.
    """
    return keep_rows(docs, exact_duplicates(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest doc_id stays, and only one. Null texts are empty ones, null ids
    come last. Rows go by id and text: another text with the id of a copy stays. An empty table stays empty."""
    return keep_rows(docs, near_duplicates(docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has too are cut out; a document with no word left goes. Null and empty texts
    stay as they are, null ids come last. Rows go by id and text. Where there is a column n_chars it is that of what is left."""
    cut = without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences that the documents are packed into: a row per piece. A null or empty text is one end id; rows that
    repeat are packed each, null ids are carried through; an empty table gives no rows."""
    return pack_documents(docs, tokenizer_path())


STAGES = [("quality", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("substring dedup", substring_stage), ("packing", packing_stage)]

#: SQL can't express the stages: the tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, function) in enumerate(STAGES):
        with scratch(spark):
            out = stage(function(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
        if n:
            unstage(docs)
        docs = out
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
