"""Readers and writers of run results, metrics, samples, indexes and chunked keyframes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INSTANCE = "struct<object_id: bigint, bbox_xywh: array<int>, area_px: bigint, center_xy: array<int>, score: double, prompt_label: string, prompt_id: int, cross_check_ok: boolean, warning: string>"
RESULT = f"schema string, run_id string, input_path string, prompt string, fps double, width int, height int, frames array<struct<frame_idx: bigint, instances: array<{INSTANCE}>>>"
METRICS = "frame bigint, fps double, eta_sec double, gpu_mem_mb double, instances int, detect_ms double, seg_ms double, reid_ms double, total_ms double"
SAMPLE = "t_sec double, gpu_util_pct double, mem_used_mb double, process_rss_mb double"
RUN = "run_id string, timestamp string, input_video string, prompt string, frames bigint, elapsed_sec double, fps_processed double, resolution string, models map<string,string>, stats_summary map<string,string>, gpu_stats map<string,string>, pipeline map<string,string>, out_dir string"
# The columns of the history CSV, with where they come from in a run record.
CSV_COLUMNS = [
    ("run_id", "run_id"), ("timestamp", "timestamp"), ("input_video", "input_video"), ("prompt", "prompt"), ("frames", "frames"), ("elapsed_sec", "elapsed_sec"),
    ("fps_processed", "fps_processed"), ("resolution", "resolution"), ("detect_model", "models.detect"), ("seg_model", "models.seg"), ("reid_model", "models.reid"),
    ("cross_check_model", "models.cross_check"), ("avg_detect_ms", "stats_summary.avg_detect_ms"), ("avg_seg_ms", "stats_summary.avg_seg_ms"),
    ("avg_reid_ms", "stats_summary.avg_reid_ms"), ("avg_total_ms", "stats_summary.avg_total_ms"), ("avg_gpu_util_pct", "gpu_stats.avg_gpu_util_pct"),
    ("peak_gpu_util_pct", "gpu_stats.peak_gpu_util_pct"), ("instances_peak", "stats_summary.instances_peak"), ("id_switches", "stats_summary.id_switches"),
    ("reid_recoveries", "stats_summary.reid_recoveries"), ("gpu_pipeline", "pipeline.gpu_pipeline"), ("infer_batch_size", "pipeline.infer_batch_size"), ("out_dir", "out_dir"),
]


#: Documents whose heads are broadcast; their number is counted.
BROADCAST_HEADS = 10_000


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(runs, instances) of result JSON files, nested frames and instances flattened.

    Documents with a line for the head, one for each frame and one for the end (`write_results`) are read as text, which Spark splits,
    so that many tasks read one run. Others are read whole, a document a task; only their names come to the driver."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    kind = F.when(F.col("value").rlike('^,?[{]"frame_idx":.*[}]$'), "frame").when(F.col("value").rlike('^[{].*"frames":\\[$'), "head").when(F.col("value") == "]}", "end")
    lines = lines.withColumn("kind", kind)
    told = lines.groupBy("file").agg(F.count_if(F.col("kind").isNull()).alias("other"), F.count_if(F.col("kind") == "head").alias("heads"), F.count_if(F.col("kind") == "end").alias("ends"))
    foreign = [r.file for r in told.where("other > 0 or heads <> 1 or ends <> 1").select("file").collect()]
    own = lines.where(~F.col("file").isin(foreign)) if foreign else lines
    heads = own.where("kind = 'head'").select("file", F.from_json(F.concat("value", F.lit("]}")), RESULT).alias("r"))
    hinted = F.broadcast(heads.select("file", "r.run_id")) if heads.count() <= BROADCAST_HEADS else heads.select("file", "r.run_id").hint("merge")
    one = F.from_json(F.regexp_replace("value", "^,", ""), f"struct<frame_idx: bigint, instances: array<{INSTANCE}>>")
    frames = own.where("kind = 'frame'").select("file", one.alias("f")).join(hinted, "file").select("run_id", "f")
    runs = heads.select("r.*").drop("frames")
    if foreign:
        whole = spark.read.schema(RESULT).option("multiLine", True).json(foreign)
        runs = runs.unionByName(whole.drop("frames"))
        frames = frames.unionByName(whole.select("run_id", F.explode("frames").alias("f")))
    rows = frames.select("run_id", "f.frame_idx", F.posexplode("f.instances").alias("inst_idx", "i"))
    return runs, rows.select("run_id", "frame_idx", "inst_idx", "i.*")


def write_results(runs: DataFrame, instances: DataFrame, path: str) -> None:
    """Result JSON, a document per run under ``run=...``, frames and instances in order.

    The document is written as the lines of a text file: head, a line per frame, end. A task sorts the lines of its runs and
    streams them; only the instances of one frame are ever held together."""
    columns = [c for c in instances.columns if c not in ("run_id", "frame_idx", "inst_idx")]
    frames = instances.groupBy("run_id", "frame_idx").agg(F.array_sort(F.collect_list(F.struct("inst_idx", *columns))).alias("instances"))
    first = frames.groupBy("run_id").agg(F.min("frame_idx").alias("first"))
    line = F.concat(F.when(F.col("frame_idx") == F.col("first"), "").otherwise(","), F.to_json(F.struct("frame_idx", "instances")))
    body = frames.join(first.hint("merge"), "run_id").select("run_id", F.lit(1).alias("part"), "frame_idx", line.alias("value"))
    # the object of the run's columns, left open; run_id is always in it
    head = F.concat(F.regexp_replace(F.to_json(F.struct(*runs.columns)), "[}]$", ""), F.lit(',"frames":['))
    ends = runs.select("run_id", F.explode(F.array(F.struct(F.lit(0).alias("part"), head.alias("value")), F.struct(F.lit(2).alias("part"), F.lit("]}").alias("value")))).alias("x"))
    lines = body.unionByName(ends.select("run_id", "x.part", F.lit(-1).cast("long").alias("frame_idx"), "x.value"))
    _write_documents(lines.withColumn("run", F.col("run_id")), "run", ["part", "frame_idx"], path)


def _write_documents(lines: DataFrame, key: str, order: list[str], path: str) -> None:
    """Text files of ``value``, one per ``key`` in a folder of that name, the lines in order."""
    lines.repartition(key).sortWithinPartitions(key, *order).select(key, "value").write.mode("overwrite").partitionBy(key).option("maxRecordsPerFile", 0).text(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Resource samples as JSON arrays, one per run in a folder ``run=...``, in the order of time."""
    first = samples.groupBy("run_id").agg(F.min("t_sec").alias("first"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("t_sec"))
    rows = samples.withColumn("place", place).join(first.hint("merge"), "run_id")
    columns = [c for c in samples.columns if c != "run_id"]
    value = F.concat(F.when(F.col("place") == 1, "[").otherwise(","), F.to_json(F.struct(*columns)), F.when(F.col("place") == F.col("n"), "]").otherwise(""))
    _write_documents(rows.select(F.col("run_id").alias("run"), "place", value.alias("value")), "run", ["place"], path)


def write_metrics(frames: DataFrame, path: str) -> None:
    """Per-frame metrics, a JSON object a line."""
    frames.select(F.to_json(F.struct(*frames.columns)).alias("value")).write.mode("overwrite").text(path)


#: Runs in an index document, at most; `upsert_runs` keeps the newest.
INDEX_ROWS = 500


def write_runs_index(index: DataFrame, path: str) -> None:
    """The index of runs as one document: a line per run, INDEX_ROWS at most."""
    every = Window.partitionBy(F.lit(0))  # of INDEX_ROWS at most
    index = index.limit(INDEX_ROWS)
    numbered = index.withColumns({"_n": F.row_number().over(every.orderBy("run_id")), "_last": F.count("*").over(every)})
    columns = index.columns
    value = F.concat(F.when(F.col("_n") == 1, '{"runs":[').otherwise(","), F.to_json(F.struct(*columns)), F.when(F.col("_n") == F.col("_last"), "]}").otherwise(""))
    numbered.select("_n", value.alias("value")).coalesce(1).sortWithinPartitions("_n").select("value").write.mode("overwrite").text(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Per-frame metrics, a JSON object a line; blank and malformed lines are skipped."""
    return spark.read.schema(METRICS).option("mode", "DROPMALFORMED").json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Resource samples from files that hold a JSON array each."""
    return spark.read.schema(SAMPLE).option("multiLine", True).json(path)


def read_runs_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of runs; a missing or invalid file is an empty table."""
    try:
        raw = spark.read.schema(f"runs array<struct<{RUN.replace(' string', ': string').replace(' bigint', ': bigint').replace(' double', ': double').replace(' map', ': map')}>>").option("multiLine", True).json(path)
    except AnalysisException:
        return spark.createDataFrame([], RUN)
    return raw.select(F.explode("runs").alias("r")).select("r.*")


def upsert_runs(index: DataFrame, new: DataFrame, keep: int = 500) -> DataFrame:
    """Run records with those of ``new`` in place of their older ones, newest first, ``keep`` at most. Both have ``arrival``."""
    latest = Window.partitionBy("run_id").orderBy(F.desc("arrival"))
    merged = index.unionByName(new).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
    return merged.orderBy(F.desc("arrival"), "run_id").limit(keep)


def flatten_runs(index: DataFrame) -> DataFrame:
    """The columns of the history CSV."""
    def at(path: str):
        head, _, key = path.partition(".")
        return F.col(head)[key] if key else F.col(head)

    return index.select(*[at(path).cast("string").alias(name) for name, path in CSV_COLUMNS])


def export_runs_csv(index: DataFrame, path: str) -> None:
    flatten_runs(index).write.mode("overwrite").option("header", True).csv(path)


def write_chunks(frames: DataFrame, path: str, span: int) -> None:
    """Keyframes as Parquet by run and chunk of ``span`` source frames; a chunk is one partition folder."""
    chunked = frames.withColumn("chunk_idx", F.floor(F.col("frame_idx") / span).cast("int"))
    chunked.repartition("run_id", "chunk_idx").sortWithinPartitions("run_id", "chunk_idx", "frame_idx").write.mode("overwrite").partitionBy("run_id", "chunk_idx").parquet(path)


def manifest(frames: DataFrame, span: int) -> DataFrame:
    """Per run and chunk: window bounds [start, end), keyframes."""
    return frames.groupBy("run_id", F.floor(F.col("frame_idx") / span).alias("chunk_idx")).agg(F.count("*").alias("n_frames")).withColumns({"start_frame": F.col("chunk_idx") * span, "end_frame": (F.col("chunk_idx") + 1) * span})


def keyframes_between(store: DataFrame, lo: int, hi: int, span: int) -> DataFrame:
    """Keyframes of [lo, hi]: the chunk predicate prunes folders, the frame predicate row groups."""
    return store.where(F.col("chunk_idx").between(lo // span, hi // span) & F.col("frame_idx").between(lo, hi))


def compact_chunks(store: DataFrame, partitions: int) -> DataFrame:
    """One frame-ordered dataset."""
    return store.repartitionByRange(partitions, "run_id", "frame_idx").sortWithinPartitions("run_id", "frame_idx")


def overlay_rows(base: DataFrame, late: DataFrame) -> DataFrame:
    """Rows of ``late`` in place of those of ``base`` with the same run and frame."""
    return base.join(late.select("run_id", "frame_idx").distinct(), ["run_id", "frame_idx"], "left_anti").unionByName(late)


def file_table(spark: SparkSession, path: str) -> DataFrame:
    """(dir, name, path, modified, bytes) of all files below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    return files.select(F.element_at(parts, -2).alias("dir"), F.element_at(parts, -1).alias("name"), "path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def report_violations(lines: DataFrame) -> DataFrame:
    """(run_id, violations) from the first line with 'Cross-check violations'; a bad number is 0. lines: (run_id, line_no, line)."""
    hit = lines.where(F.col("line").contains("Cross-check violations"))
    first = hit.groupBy("run_id").agg(F.min_by("line", "line_no").alias("line"))
    return first.select("run_id", F.coalesce(F.trim(F.element_at(F.split("line", ":"), -1)).try_cast("int"), F.lit(0)).alias("violations"))
