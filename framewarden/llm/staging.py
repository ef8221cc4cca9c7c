"""Tables written to the shared folder of the cluster, to cut lineage and to be read more than once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, new_path

#: Rows of at most 16 bytes that may be broadcast; their number is counted before.
BROADCAST_ROWS = 500_000


#: The paths of the innermost scope of this thread.
_SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are staged inside are deleted at the end. A result that reads them is written, with ``keep``, before."""
    paths: list[str] = []
    before = _SCOPE.set(paths)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        for path in paths:
            delete(spark, path)


def stage(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: it is computed once and survives lost executors. ``options``: the writer's.

    An operator deletes what none of its results reads; the rest stays until the caller has written the result (`scratch`)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    scope = _SCOPE.get()
    if scope is not None and not keep:
        scope.append(path)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: all that was made of them is staged itself."""
    for df in tables:
        delete(df.sparkSession, df.staged_path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind: Spark (from 4.1) deletes them as each query ends, not when the driver next
    happens to collect garbage. For queries that are run once."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def text_batches(spark: SparkSession, rows: int = 2048) -> None:
    """Fewer rows to an Arrow batch than Spark's default of 10,000, for rows that hold whole texts; a set value stays.

    Spark reads the setting when a plan runs, which is after an operator has returned, so it is left as it is set here."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def semi_join(big: DataFrame, keys: DataFrame, on: str, n_keys: int) -> DataFrame:
    """Rows of ``big`` whose key is in ``keys`` (``n_keys`` rows, counted): broadcast within the bound, else shuffled."""
    keys = F.broadcast(keys) if n_keys <= BROADCAST_ROWS else keys.hint("shuffle_hash")
    return big.join(keys, on, "left_semi")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, upper and lower case aside."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept by ``verdicts`` (doc_id, text_sha256, kept), which has a row for each of them.

    Rows are told apart by id and text, null ids included; of rows that repeat both one stays if they are kept.
    """
    seen = verdicts.groupBy("doc_id", F.unhex("text_sha256").alias("digest")).agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    of, digest = fresh(docs, "of"), fresh(docs, "digest")
    keys = stage(seen.where("not kept or n > 1").select(F.col("doc_id").alias(of), F.col("digest").alias(digest), "kept"), "keys")
    n, n_once = keys.agg(F.count("*"), F.count_if("kept")).first()
    own_id, own_digest = docs[id_col].cast("long"), F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")), 256))

    def matched(some: DataFrame, count: int, how: str) -> DataFrame:
        hinted = F.broadcast(some) if count <= BROADCAST_ROWS // 4 else some.hint("shuffle_hash")  # a row has less than 64 bytes
        return docs.join(hinted, own_id.eqNullSafe(some[of]) & (own_digest == some[digest]), how)

    out = matched(keys, n, "left_anti")
    if n_once:
        again = matched(keys.where("kept").select(of, digest), n_once, "inner")
        out = out.unionByName(again.dropDuplicates([of, digest]).select(docs.columns))
    return out
