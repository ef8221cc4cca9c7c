"""Summaries of runs, samples, jobs and requests."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fmt_bytes
from .places import with_place

# Display texts of states and phases; others pass through.
STATUS = {"queued": "В очереди", "running": "Идёт обработка", "done": "Готово", "cancelled": "Отменена", "error": "Ошибка", "ready": "Готов", "building_engines": "Сборка TensorRT…", "starting": "Запуск…", "stopped": "Остановлен", "gpu_missing": "Нет GPU / CUDA"}
PHASE = {"queued": "Ожидание", "staging": "Подготовка файла", "preload": "Декод / preload", "inference": "Инференс (YOLO)", "pass2": "Pass2 / tracklets", "finalize": "Запись результатов", "done": "Завершено", "error": "Ошибка", "cancelled": "Отмена"}


def _lookup(values: dict[str, str]):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def stats_summary(frames: DataFrame) -> DataFrame:
    """Per run: averages per analysed frame, peak instances, recoveries; three digits."""
    avg = lambda c: F.round(F.sum(c) / F.greatest(F.lit(1), F.count("*")), 3).alias(f"avg_{c}")
    return frames.groupBy("run_id").agg(avg("detect_ms"), avg("reid_ms"), avg("cross_ms"), avg("infer_ms"), F.max("n_inst").alias("instances_peak"), F.sum("reid_recoveries").alias("reid_recoveries"))


def stride_summary(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """Source, processed and skipped frames and the reduction in per cent (one digit)."""
    from .reports import source_frames

    done = frames.groupBy("run_id").agg(F.countDistinct("frame_idx").alias("processed"))
    out = source_frames(frames, runs).join(done, "run_id", "left").withColumn("processed", F.coalesce("processed", F.lit(0)))
    skipped = F.greatest(F.lit(0).cast("long"), F.col("source_frames") - F.col("processed"))
    return out.withColumn("skipped", skipped).withColumn("reduction_pct", F.round(100.0 * F.col("skipped") / F.greatest(F.lit(1).cast("long"), F.col("source_frames")), 1))


def gpu_summary(samples: DataFrame) -> DataFrame:
    return samples.groupBy("run_id").agg(F.round(F.avg("gpu_util_pct"), 2).alias("avg_util"), F.max("gpu_util_pct").alias("peak_util"), F.round(F.avg("mem_used_mb"), 2).alias("avg_mem"), F.round(F.max("mem_used_mb"), 2).alias("peak_mem"), F.count("*").alias("n"))


def process_summary(samples: DataFrame) -> DataFrame:
    """Resident memory: first, peak (zeros don't count), last, and the peak above the first (0 at least)."""
    rss = F.col("process_rss_mb")
    out = samples.groupBy("run_id").agg(F.min_by(rss, "t_sec").alias("baseline"), F.max_by(rss, "t_sec").alias("end"), F.max(F.when(rss > 0, rss)).alias("top"), F.count("*").alias("samples"))
    peak = F.coalesce("top", "end")
    r = lambda c: F.round(c, 2)
    return out.select("run_id", r("baseline").alias("rss_baseline_mb"), r(peak).alias("rss_peak_mb"), r("end").alias("rss_end_mb"), r(F.greatest(F.lit(0.0), peak - F.col("baseline"))).alias("rss_delta_peak_mb"), "samples")


def resource_summary(readings: DataFrame, samples: DataFrame) -> DataFrame:
    """Memory of the process and of the device: baseline, peak, end, peak above the baseline (0 at least).

    ``readings`` (run_id; rss, alloc, reserved each with _baseline and _end) are taken apart from the samples (run_id, t_sec,
    process_rss_mb, cuda_allocated_mb, cuda_reserved_mb). Resident peaks leave zeros out; a run without samples falls back on its
    readings, the device on the larger of both."""
    rss = F.col("process_rss_mb")
    top = samples.groupBy("run_id").agg(F.max(F.when(rss > 0, rss)).alias("rss"), F.max("cuda_allocated_mb").alias("alloc"), F.max("cuda_reserved_mb").alias("reserved"), F.count("*").alias("n"))
    every = readings.join(top.hint("merge"), "run_id", "left").withColumn("samples", F.coalesce("n", F.lit(0)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rss_peak = F.when(F.col("samples") > 0, F.coalesce("rss", zero("rss_end"))).otherwise(F.coalesce(F.nullif("rss_end", F.lit(0.0)), "rss_baseline"))
    device = lambda c: F.when(F.col("samples") > 0, F.coalesce(F.col(c), F.col(f"{c}_end"))).otherwise(F.greatest(f"{c}_end", f"{c}_baseline"))
    r = lambda c, name: F.round(c, 2).alias(name)
    return every.select(
        "run_id", r(F.col("rss_baseline"), "rss_baseline_mb"), r(rss_peak, "rss_peak_mb"), r(zero("rss_end"), "rss_end_mb"), r(F.greatest(F.lit(0.0), rss_peak - F.col("rss_baseline")), "rss_delta_peak_mb"),
        r(F.col("alloc_baseline"), "alloc_baseline_mb"), r(device("alloc"), "alloc_peak_mb"), r(F.col("alloc_end"), "alloc_end_mb"), r(F.greatest(F.lit(0.0), device("alloc") - F.col("alloc_baseline")), "alloc_delta_peak_mb"),
        r(device("reserved"), "reserved_peak_mb"), r(F.col("reserved_end"), "reserved_end_mb"), "samples",
    )


def run_timings(timings: DataFrame, frames: DataFrame) -> DataFrame:
    """The seconds of each stage of a run and its speed: analysed frames by seconds of inference.

    ``timings``: run_id, wall, preload, infer, pass2, finalize, decode, gpu, cpu_finalize, fps, source_frames. A finalize time under
    0.01 is what the wall time leaves over."""
    t = timings.join(frames.groupBy("run_id").agg(F.countDistinct("frame_idx").alias("n")).hint("merge"), "run_id", "left")
    rest = F.greatest(F.lit(0.0), F.col("wall") - F.col("preload") - F.col("infer") - F.col("pass2"))
    r = lambda c, name: F.round(c, 3).alias(name)
    fps = F.when(F.col("infer") > 0, F.coalesce("n", F.lit(0)) / F.col("infer")).otherwise(0.0)
    return t.select(
        "run_id", r(F.col("preload"), "elapsed_preload_sec"), r(F.col("infer"), "elapsed_infer_sec"), r(F.col("pass2"), "elapsed_pass2_sec"), r(F.when(F.col("finalize") < 0.01, rest).otherwise(F.greatest(F.lit(0.0), F.col("finalize"))), "elapsed_finalize_sec"),
        r(F.when(F.col("fps") > 0, F.col("source_frames") / F.col("fps")).otherwise(0.0), "video_duration_sec"), r(fps, "fps_infer"), r(F.col("decode"), "stage_decode_sec"), r(F.col("gpu"), "stage_gpu_infer_sec"),
        r(F.col("cpu_finalize"), "stage_cpu_finalize_sec"), r(F.col("pass2"), "stage_pass2_sec"), r(F.col("wall"), "wall_sec"),
    )


def stage_totals(frames: DataFrame) -> DataFrame:
    s = lambda c: F.round(F.sum(c) / 1000.0, 5)
    return frames.groupBy("run_id").agg(s("detect_ms").alias("detect_sec"), s("reid_ms").alias("reid_sec"), s("cross_ms").alias("cross_sec"), s("infer_ms").alias("infer_sec"), F.round(F.count("*") / F.nullif(F.sum("infer_ms") / 1000.0, F.lit(0.0)), 3).alias("fps_infer"))


def realtime_ratio(frames: DataFrame, runs: DataFrame, limit: float = 1.15) -> DataFrame:
    """Inference seconds per second of video; ok if at most ``limit``."""
    from .reports import source_frames

    spent = frames.groupBy("run_id").agg((F.sum("infer_ms") / 1000.0).alias("sec"))
    video = source_frames(frames, runs).join(runs.select("run_id", "fps"), "run_id")
    ratio = F.col("sec") / F.nullif(F.col("source_frames") / F.col("fps"), F.lit(0.0))
    return video.join(spent, "run_id", "left").select("run_id", F.round(ratio, 4).alias("ratio"), (ratio <= limit).alias("realtime_ok"))


def compare_runs(frames: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs by ratio, the fastest first, with their place."""
    return with_place(realtime_ratio(frames, runs), [F.col("ratio").asc_nulls_last(), F.col("run_id")])


def chart_series(frames: DataFrame) -> DataFrame:
    """Averages of the stages of each run that take more than 0.01 ms, as (run_id, stage, avg_ms)."""
    stages = frames.groupBy("run_id").agg(*[F.avg(c).alias(c) for c in ("detect_ms", "reid_ms", "cross_ms")])
    long = stages.unpivot(["run_id"], ["detect_ms", "reid_ms", "cross_ms"], "stage", "avg_ms")
    return long.where("avg_ms > 0.01").withColumn("avg_ms", F.round("avg_ms", 3))


def frame_latency(metrics: DataFrame) -> DataFrame:
    """(run_id, frame, series, ms): the curves of the latency of each frame; a value that lacks is 0."""
    series = {"total": "total_ms", "detect": "detect_ms", "seg": "seg_ms", "reid": "reid_ms"}
    flat = metrics.select("run_id", "frame", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in series.items()])
    return flat.unpivot(["run_id", "frame"], list(series), "series", "ms")


def load_series(samples: DataFrame) -> DataFrame:
    """(run_id, t_sec, series, value): load and memory of the device over time."""
    flat = samples.select("run_id", "t_sec", F.col("gpu_util_pct").alias("util"), F.col("mem_used_mb").alias("memory"))
    return flat.unpivot(["run_id", "t_sec"], ["util", "memory"], "series", "value")


#: Bins of the histogram that finds the order statistics of a group.
BINS = 1024


def quantiles(rows: DataFrame, keys: list[str], column: str, shares: list[float]) -> DataFrame:
    """(keys, q): the exact quantiles of a column by group, between two order statistics by proportion; nulls are left out.

    Values are counted first. A histogram by group finds the bins that hold the wanted ranks, and only the values in these are
    sorted, bin by bin: no task holds a group's values."""
    x = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("x")).agg(F.count("*").alias("n"))
    span = x.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("total"))
    width = F.col("hi") - F.col("lo")
    place = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor((F.col("x") - F.col("lo")) / width * BINS))).otherwise(F.lit(0)).cast("int")
    binned = x.join(span.hint("merge"), keys).withColumn("bin", place)
    order = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy(*keys, "bin").agg(F.sum("n").alias("in_bin"), F.first("total").alias("total")).withColumn("before", F.coalesce(F.sum("in_bin").over(order), F.lit(0)))
    at = [F.lit(s) * (F.col("total") - 1) for s in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in at for f in (F.floor, F.ceil)]))
    wanted = bins.withColumn("ranks", F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("in_bin")))).where(F.size("ranks") > 0)
    inside = binned.select(*keys, "bin", "x", "n").join(wanted.hint("merge"), [*keys, "bin"])
    ends = F.col("before") + F.sum("n").over(Window.partitionBy(*keys, "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    hit = inside.withColumn("end", ends).withColumn("rank", F.explode(F.filter("ranks", lambda r: (r < F.col("end")) & (r >= F.col("end") - F.col("n")))))
    found = hit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("m"), F.first("total").alias("total"))
    value = lambda p: F.element_at("m", F.floor(p).cast("long")) + (p - F.floor(p)) * (F.element_at("m", F.ceil(p).cast("long")) - F.element_at("m", F.floor(p).cast("long")))
    return found.select(*keys, F.array(*[value(p) for p in at]).alias("q"))


def describe_samples(samples: DataFrame, column: str = "gpu_util_pct") -> DataFrame:
    """Count, mean, deviation, least, quartiles and greatest of a column by run, and the median of what isn't 0. Quartiles are exact."""
    c = F.col(column)
    out = samples.groupBy("run_id").agg(F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    q = quantiles(samples, ["run_id"], column, [0.25, 0.5, 0.75])
    nonzero = quantiles(samples.where(c != 0), ["run_id"], column, [0.5]).withColumnRenamed("q", "z")
    joined = out.join(q.hint("merge"), "run_id", "left").join(nonzero.hint("merge"), "run_id", "left")
    return joined.select("run_id", "n", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max", F.col("z")[0].alias("median_nonzero"))


def sample_frames(frames: DataFrame, stride: int) -> DataFrame:
    return frames.where(F.col("frame_idx") % max(1, stride) == 0)


def limit_duration(frames: DataFrame, runs: DataFrame, seconds: float | None) -> DataFrame:
    """Frames of the first ``seconds`` of each run; null or 0 and less keep all."""
    if not seconds or seconds <= 0:
        return frames
    top = runs.select("run_id", (F.lit(float(seconds)) * F.col("fps")).cast("long").alias("top"))
    return frames.join(top, "run_id").where("frame_idx < top").drop("top")


def frame_batches(frames: DataFrame, size: int) -> DataFrame:
    """(run_id, batch, slot, frame_idx): fixed batches of analysed frames; the tail is padded with frame -1."""
    order = Window.partitionBy("run_id").orderBy("frame_idx")
    n = frames.select("run_id", "frame_idx").withColumn("i", F.row_number().over(order) - 1)
    rows = n.select("run_id", F.floor(F.col("i") / size).alias("batch"), (F.col("i") % size).alias("slot"), "frame_idx")
    last = n.groupBy("run_id").agg(F.count("*").alias("n")).where(F.col("n") % size != 0)
    pad = last.select("run_id", F.floor(F.col("n") / size).alias("batch"), F.explode(F.sequence((F.col("n") % size).cast("int"), F.lit(size - 1))).alias("slot"), F.lit(-1).cast("long").alias("frame_idx"))
    return rows.unionByName(pad)


def frame_windows(frames: DataFrame, n: int) -> DataFrame:
    """(run_id, window, start_frame, end_frame, n_frames): decode windows of n analysed frames, [start, end) in the source."""
    order = Window.partitionBy("run_id").orderBy("frame_idx")
    w = frames.select("run_id", "frame_idx").withColumn("window", F.floor((F.row_number().over(order) - 1) / n))
    return w.groupBy("run_id", "window").agg(F.min("frame_idx").alias("start_frame"), (F.max("frame_idx") + 1).alias("end_frame"), F.count("*").alias("n_frames"))


def throttle(ticks: DataFrame, min_frames: int = 8, min_sec: float = 0.5) -> DataFrame:
    """Ticks (job_id, tick, current, total, ts) that are emitted: done, or far enough from the last emitted one.

    Each job's ticks are one sorted array, folded in order."""
    t = F.struct("tick", "current", "total", "ts")
    jobs = ticks.groupBy("job_id").agg(F.array_sort(F.collect_list(t)).alias("ticks"))

    def skip(acc, x):
        last = F.element_at(acc, -1)
        frames = F.when(F.size(acc) == 0, x["current"]).otherwise(x["current"] - last["current"])
        sec = F.when(F.size(acc) == 0, F.lit(1e9)).otherwise(x["ts"] - last["ts"])
        return (x["current"] < x["total"]) & (frames < min_frames) & (sec < min_sec)

    kept = F.aggregate("ticks", F.filter("ticks", lambda x: F.lit(False)), lambda acc, x: F.when(skip(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return jobs.select("job_id", F.explode(kept).alias("x")).select("job_id", "x.tick", "x.current", "x.total", "x.ts")


def recent_requests(req: DataFrame, n: int = 50) -> DataFrame:
    return req.orderBy(F.desc("ts"), F.desc("request_id")).limit(min(n, 200))


def list_jobs(jobs: DataFrame, n: int = 15) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "job_id").limit(max(0, n))


def latest_job(jobs: DataFrame) -> DataFrame:
    return list_jobs(jobs, 1)


def active_job(jobs: DataFrame) -> DataFrame:
    """The queued or running job that began last: by ``started_at``, or ``created_at`` where that is null or 0 (seconds, both)."""
    began = F.coalesce(F.nullif("started_at", F.lit(0.0)), "created_at", F.lit(0.0))
    return jobs.where(F.col("status").isin("queued", "running")).orderBy(began.desc(), "job_id").limit(1)


def run_history(runs: DataFrame, n: int = 15, by: str = "run_id") -> DataFrame:
    return runs.orderBy(F.desc(by)).limit(n)


#: Phases whose clock starts with the inference: speed leaves out upload and staging.
AFTER_STAGING = ("inference", "finalize", "done", "pass2")


def elapsed(jobs: DataFrame, now: float) -> DataFrame:
    """``jobs`` with elapsed_sec: from the start (from that of the inference where the phase is past staging and it is known, not 0) to
    the end, or ``now``; 0 for a job that hasn't started. All times are seconds."""
    start = F.when(F.lower(F.coalesce(F.nullif("phase", F.lit("")), F.lit("inference"))).isin(*AFTER_STAGING), F.coalesce(F.nullif("infer_started_at", F.lit(0.0)), "started_at")).otherwise(F.col("started_at"))
    return jobs.withColumn("elapsed_sec", F.when(F.col("started_at").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.coalesce("finished_at", F.lit(float(now))) - start)))


def job_states(jobs: DataFrame, now: float) -> DataFrame:
    """Progress of each job with elapsed time. A job without a total shows its stored progress (``stored``: struct of percent, fps,
    eta_seconds, elapsed_sec) if it has one."""
    fresh = job_progress(elapsed(jobs, now)).drop("status", "phase")
    seen = jobs.select("job_id", "status", "phase", "stored", F.col("total_frames").alias("_total")).join(elapsed(jobs, now).select("job_id", "elapsed_sec"), "job_id").join(fresh, "job_id")
    keep = (F.coalesce("_total", F.lit(0)) <= 0) & F.col("stored").isNotNull()
    return seen.select("job_id", "status", "phase", *[F.when(keep, F.col(f"stored.{c}")).otherwise(F.col(c)).alias(c) for c in ("percent", "fps", "eta_seconds", "elapsed_sec")])


def job_progress(jobs: DataFrame) -> DataFrame:
    """Progress columns from a job's last tick: percent, fps, eta."""
    cur, total, sec = F.greatest(F.lit(0).cast("long"), "current_frames"), F.greatest(F.lit(0).cast("long"), "total_frames"), F.greatest(F.lit(0.0), "elapsed_sec")
    fps = F.when((sec > 1e-6) & (cur > 0), cur / sec).otherwise(0.0)
    eta = F.when((fps > 1e-6) & (total > cur), (total - cur) / fps).otherwise(0.0)
    return jobs.select("job_id", "status", "phase", F.round(F.when(total > 0, 100.0 * cur / total).otherwise(0.0), 2).alias("percent"), F.round(fps, 8).alias("fps"), F.round(eta, 8).alias("eta_seconds"))


def with_labels(jobs: DataFrame) -> DataFrame:
    """Display texts of status and phase; unknown codes pass through."""
    show = lambda c, v: F.coalesce(F.try_element_at(_lookup(v), c), c)
    return jobs.withColumns({"status_text": show(F.col("status"), STATUS), "phase_text": F.coalesce(F.try_element_at(_lookup(PHASE), F.lower("phase")), "phase")})


def job_summary(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs with progress, texts and the size of the input file of the same number. files: (file_id, bytes), from a listing."""
    size = files.select(F.col("file_id").alias("job_id"), F.col("bytes").cast("long").alias("bytes"))
    return with_labels(job_progress(jobs)).join(size, "job_id", "left").select("job_id", "status_text", "phase_text", "percent", fmt_bytes(F.col("bytes")).alias("input_size"))


def memory_report(runs: DataFrame, batch: int) -> DataFrame:
    frame = F.col("width").cast("long") * F.col("height") * 3
    return runs.select("run_id", frame.alias("frame_bytes"), (frame * batch).alias("batch_bytes"), (frame * F.col("source_frame_count")).alias("preload_bytes"), fmt_bytes(frame * batch).alias("batch_text"))


def artifact_flags(files: DataFrame) -> DataFrame:
    has = lambda end: F.max(F.col("name").endswith(end)).alias(end.strip("_").split(".")[0])
    return files.groupBy("dir").agg(has("_result.json"), has("_annotated.mp4"), has("_packets_manifest.json"))


def list_artifacts(files: DataFrame, run: str) -> DataFrame:
    """(name, path, bytes) of the files of a run's folder by name. files: a listing (`file_table`), so no content is read."""
    return files.where(F.col("dir") == run).select("name", "path", "bytes").orderBy("name", "path")


def list_runs(files: DataFrame, limit: int = 80) -> DataFrame:
    """(dir, newest, markers): folders that hold a result or a manifest, the last modified first. files: a listing (`file_table`)."""
    marked = files.where(F.col("name").rlike("_(result|packets_manifest)\\.json$"))
    return marked.groupBy("dir").agg(F.max("modified").alias("newest"), F.count("*").alias("markers")).orderBy(F.desc("newest"), "dir").limit(limit)


def verify_trees(left: DataFrame, right: DataFrame) -> DataFrame:
    """(name, status): OK, MISMATCH or MISSING by SHA-256 of the contents of two trees (name, content)."""
    digest = lambda df, c: df.select("name", F.sha2("content", 256).alias(c))
    both = digest(left, "a").join(digest(right, "b").hint("merge"), "name", "full")
    status = F.when(F.col("a").isNull() | F.col("b").isNull(), "MISSING").when(F.col("a") == F.col("b"), "OK").otherwise("MISMATCH")
    return both.select("name", status.alias("status"))


def run_report(runs: DataFrame, frames: DataFrame, batch: int = 0) -> DataFrame:
    """The lines of each run's report as one text; with a batch size those of the memory of frames, batches and a preload as well."""
    s = stats_summary(frames).join(stride_summary(runs, frames), "run_id")
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c).cast("string"))
    parts = [line("Run", "run_id"), line("Source frames", "source_frames"), line("Processed frames", "processed"), line("Skipped frames", "skipped"), line("Peak instances", "instances_peak"), line("Re-id recoveries", "reid_recoveries")]
    if batch:
        s = s.join(memory_report(runs, batch), "run_id")
        parts.append(F.concat(F.lit("Memory: 1 frame = "), fmt_bytes(F.col("frame_bytes")), F.lit(" ("), F.col("frame_bytes").cast("string"), F.lit(f" B) | 1 batch ({batch} fr) = "), F.col("batch_text")))
        parts.append(F.when(F.col("preload_bytes") > 0, F.concat(F.lit("Preload RAM (frames only): "), fmt_bytes(F.col("preload_bytes")))))
    return s.select("run_id", F.concat_ws("\n", *parts).alias("report"))


def run_record(runs: DataFrame, frames: DataFrame) -> DataFrame:
    """The record of each run for the index: counts, speed, resolution, statistics as a struct.

    Times are summed as decimals, so that the sum doesn't depend on the order of the tasks."""
    total = F.sum(F.col("infer_ms").cast("decimal(18,6)")) * F.lit(Decimal("0.001"))
    spent = frames.groupBy("run_id").agg(F.countDistinct("frame_idx").alias("frames"), total.alias("total")).withColumn("sec", F.col("total").cast("double"))
    stats = stats_summary(frames).select("run_id", F.struct("avg_detect_ms", "avg_reid_ms", "avg_infer_ms", "instances_peak", "reid_recoveries").alias("stats_summary"))
    fps = F.when(F.col("sec") > 0, F.col("frames") / F.col("sec")).otherwise(0.0)
    return runs.join(spent, "run_id").join(stats, "run_id").select("run_id", F.col("input_path").alias("input_video"), "prompt", "frames", F.round("total", 3).cast("double").alias("elapsed_sec"), F.round(fps, 3).alias("fps_processed"), F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")).alias("resolution"), "stats_summary")


def resolve_overlay(defaults: dict[str, str], saved: DataFrame, user: DataFrame) -> DataFrame:
    """Overlay settings of each run by key: the user's over the saved over the defaults. saved, user: (run_id, settings map)."""
    base = F.create_map(*[F.lit(x) for p in defaults.items() for x in p])
    joined = saved.join(user.withColumnRenamed("settings", "u"), "run_id", "left")
    none = F.create_map().cast("map<string,string>")
    merge = lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))
    return joined.select("run_id", merge(merge(base, F.coalesce("settings", none)), F.coalesce("u", none)).alias("settings"))


def run_metadata(packets: DataFrame, result: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per run from three sources; values that are 0 or '' count as missing, the first source that has one wins."""
    p, r, s = (df.select("run_id", *[F.col(c).alias(f"{n}_{c}") for c in df.columns if c != "run_id"]) for n, df in (("p", packets), ("r", result), ("s", summary)))
    every = p.join(r, "run_id", "full").join(s, "run_id", "full")
    first = lambda c, missing, last: F.coalesce(*[F.nullif(F.col(f"{n}_{c}"), F.lit(missing)) for n in "prs"], F.lit(last)).alias(c)
    return every.select("run_id", first("fps", 0.0, 25.0), first("width", 0, 0), first("height", 0, 0), first("prompt", "", "person"), first("input_path", "", ""), F.greatest(F.lit(1), F.coalesce(*[F.nullif(F.col(f"{n}_frame_stride"), F.lit(0)) for n in "prs"], F.lit(1))).alias("frame_stride"))


def cross_check_flags(runs: DataFrame) -> DataFrame:
    """(run_id, cross_check): was the cross-check on? Yes if the pipeline or the saved overlay says so, or its model has a name.

    runs: run_id and maps of texts, each possibly null or empty: result_pipeline, summary_pipeline, record_pipeline (the first
    that holds anything counts), overlay, result_models, summary_models."""
    some = lambda *names: F.coalesce(*[F.when(F.size(n) > 0, F.col(n)) for n in names])
    on = lambda m: ~F.coalesce(F.lower(F.try_element_at(m, F.lit("cross_check_enabled"))), F.lit("")).isin("", "0", "false", "none")
    model = F.coalesce(F.lower(F.try_element_at(some("result_models", "summary_models"), F.lit("cross_check"))), F.lit(""))
    flag = on(some("result_pipeline", "summary_pipeline", "record_pipeline")) | on(F.col("overlay")) | ~model.isin("", "disabled", "none")
    return runs.select("run_id", flag.alias("cross_check"))


#: Endings of video files, and those of a copied source in the order in which they are looked for.
VIDEO = ("mp4", "mkv", "mov", "webm", "avi", "m4v")
SOURCE = ("mp4", "mkv", "mov", "webm")


def resolve_sources(runs: DataFrame, files: DataFrame) -> DataFrame:
    """(run_id, path) of the source of each run, the first of: the override, the recorded path, ``<run>_source.*`` in the run's folder, a
    file of the recorded name there, ``<name>_source.*`` there, the newest ``*_source`` of each ending there. Null if none exists.

    runs: run_id, input_path, override; files: a listing (dir, name, path, modified) with the run as folder. Each step is an equi-join."""
    clean = lambda c: F.trim(F.trim(F.col(c)), F.lit('"'))
    known = files.select("dir", "name", "path", "modified", F.lower(F.element_at(F.split("name", "[.]"), -1)).alias("ending"))
    named = runs.select("run_id", F.element_at(F.split(clean("input_path"), "/"), -1).alias("base"))
    wanted = runs.select("run_id", F.inline(F.array(*[F.struct(F.lit(n).alias("rank"), clean(c).alias("path")) for n, c in ((1, "override"), (2, "input_path"))])))
    direct = wanted.join(known.select("path").distinct().hint("merge"), "path").select("run_id", F.struct("rank", F.lit(0).alias("order"), F.lit("").alias("name")).alias("place"), "path")
    inside = named.join(known.hint("merge"), F.col("dir") == F.col("run_id"))
    base_ok = F.lower(F.element_at(F.split("base", "[.]"), -1)).isin(*VIDEO) & F.col("base").contains(".")
    stem = F.regexp_replace("base", "[.][^.]*$", "")
    kind = F.array_position(F.array(*[F.lit(e) for e in SOURCE]), F.col("ending"))
    newest = -F.unix_micros("modified")
    steps = [  # (rank, condition, order within)
        (3, F.col("name").startswith(F.concat("run_id", F.lit("_source."))) & F.col("ending").isin(*VIDEO), F.lit(0)),
        (4, base_ok & (F.col("name") == F.col("base")), F.lit(0)),
        (5, base_ok & F.col("name").startswith(F.concat(stem, F.lit("_source."))), F.lit(0)),
        (6, F.col("name").rlike("_source[.][^.]+$") & (kind > 0), newest),
    ]
    rank = F.coalesce(*[F.when(cond, F.struct(F.lit(n).alias("rank"), (order.cast("long") if n < 6 else kind.cast("long")).alias("order"), (F.lit(0).cast("long") if n < 6 else order.cast("long")).alias("age"), F.col("name"))) for n, cond, order in steps])
    own = inside.withColumn("place", rank).where("place is not null").select("run_id", "place", "path")
    first = direct.select("run_id", F.struct("place.rank", F.lit(0).cast("long").alias("order"), F.lit(0).cast("long").alias("age"), F.lit("").alias("name")).alias("place"), "path").unionByName(own)
    best = first.groupBy("run_id").agg(F.min_by("path", "place").alias("path"))
    return runs.select("run_id").join(best, "run_id", "left")
