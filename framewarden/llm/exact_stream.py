"""Exact de-duplication as a stateful stream: keyed state on disk that never expires, full bytes compared on hits.

The state is that of a streaming aggregation in RocksDB, keyed by the SHA-256 of the text. Its value is the stable
identifier of the copy that stays (the largest doc_id), the locator of its content (the file and the row in it) and the
number of copies so far. Each micro-batch is pre-aggregated before its shuffle, so a text that makes up a third of the
input costs one row per task. Nothing in the state expires: a copy of the first batch is still found in the last.

A digest with more than one copy is a hit. The content of the copy that stays is read by its locator, and the full text of
every other copy is compared with it; texts that are equal are brought together within each task first. If one digest turns
out to hold two texts, its documents are told apart by the text.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path
from .staging import BROADCAST_ROWS, semi_join, stage

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside for each
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def keyed_state(stream: DataFrame) -> DataFrame:
    """The stateful operator: rows (doc_id, digest, locator) in, the state of each digest that a batch touched out."""
    return stream.groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count("*").alias("copies"))


def locator() -> Column:
    """Where the content of a row lies: the file that it is read from, and its number there."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator")


def run_stream(stream: DataFrame, checkpoint: str | None = None) -> DataFrame:
    """Run the stream over all that is there now and return the state: digest, keep_id, locator, copies.

    With the ``checkpoint`` of an earlier run only what is new since then is read, against the state kept there.
    """
    spark = stream.sparkSession
    home = checkpoint or new_path(spark, "exact-stream")
    sink = f"{home}/updates"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")  # a batch that is run again replaces itself

    with settings(spark, STATE):
        query = keyed_state(stream).writeStream.outputMode("update").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    schema = "digest binary, keeper struct<doc_id: bigint, locator: struct<file: string, row: bigint>>, copies bigint, batch int"
    updates = spark.read.schema(schema).parquet(sink)
    return updates.groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("copies").alias("copies")).select("digest", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.locator").alias("locator"), "copies")


def exact_duplicates(
    docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest=sha256, max_bytes_per_trigger: str | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; of equal texts the row with the largest doc_id stays. ``path`` is the Parquet
    folder or file that ``docs`` was read from: the stream then reads it directly. Else (id, digest, locator) rows are staged
    and streamed, and where ``docs`` isn't a plain scan of files, so that its rows have no locators, it is staged first. A
    null text counts as empty, and empty texts are equal. Of rows that repeat both doc_id and text each has ``kept`` true if
    the id is the largest; a null doc_id is smaller than any other. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    if not path:
        try:
            docs.select("_metadata.row_index")
        except AnalysisException:
            docs = stage(docs, "contents")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(id_col).cast("long").alias("doc_id"), digest(text).alias("digest")]
    if path:
        reader = spark.readStream.schema(docs.schema)
        if max_bytes_per_trigger:
            reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
        stream = reader.parquet(_pattern(path)).select(*own, locator())
        ids = docs.select(*own)
    else:
        staged = stage(docs.select(*own, locator()), "digests")
        ids = staged.select("doc_id", "digest")
        stream = spark.readStream.schema(staged.schema).parquet(staged.staged_path)
    state = stage(run_stream(stream), "state")

    hits = state.where("copies > 1").select("digest", "locator.file", "locator.row")
    n = hits.count()
    keyed = docs.select(*own, text.alias("text"))
    copies = semi_join(keyed, hits.select("digest"), "digest", n)
    texts = stage(copies.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("copies")), "hits")
    # the content that a digest stands for, read by its locator
    places = hits.withColumnRenamed("digest", "known")
    places = F.broadcast(places) if n <= BROADCAST_ROWS // 8 else places.hint("merge")  # a row has less than 200 bytes
    content = docs.select(text.alias("content"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    content = content.join(places, ["file", "row"]).select(F.col("known").alias("digest"), "content")
    other = texts.join(content.hint("merge"), "digest", "left").where(~F.col("text").eqNullSafe(F.col("content")))
    clashes = stage(other.select("digest").distinct(), "clashes")

    known = state.select("digest", "keep_id", "copies")
    if clashes.isEmpty():
        found = ids.join(known.hint("merge"), "digest")
    else:  # one digest, several texts: those documents go by the text
        sure = known.join(F.broadcast(clashes) if clashes.count() <= 100_000 else clashes, "digest", "left_anti")
        by_text = keyed.join(clashes.hint("merge"), "digest", "left_semi").join(texts.hint("merge"), ["digest", "text"]).select("digest", "doc_id", "keep_id", "copies")
        found = ids.join(sure.hint("merge"), "digest").unionByName(by_text)
    return found.select(
        "doc_id", "keep_id", F.col("copies").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def _pattern(path: str) -> str:
    """The path as a pattern that only it matches: streams read a single file by a pattern only. Its own signs are escaped."""
    plain = path.rstrip("/")
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", plain[:-1]) + (f"[{plain[-1]}]" if plain[-1].isalnum() else re.sub(r"([\[\]{}*?\\])", r"\\\1", plain[-1]))
