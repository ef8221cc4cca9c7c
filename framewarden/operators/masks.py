"""Masks as run lengths, and keypoints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

# The 17 named points of a person and the edges between them.
KEYPOINTS = ["nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow", "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle"]
SKELETON = [(0, 1), (0, 2), (1, 3), (2, 4), (5, 6), (5, 7), (7, 9), (6, 8), (8, 10), (5, 11), (6, 12), (11, 12), (11, 13), (13, 15), (12, 14), (14, 16)]


def encode_runs(pixels: DataFrame) -> DataFrame:
    """(mask_id, p, v) -> (mask_id, counts): run lengths in row order, the first of zeros (0 if the mask starts set)."""
    order = Window.partitionBy("mask_id").orderBy("p")
    change = (F.col("v") != F.lag("v", 1, 0).over(order)).cast("int")
    runs = pixels.withColumn("c", change).withColumn("run", F.sum("c").over(order))
    lengths = runs.groupBy("mask_id", "run").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("run", "n")))
    counts = lengths.groupBy("mask_id").agg(ordered.alias("runs"))
    lead = F.when(F.col("runs")[0]["run"] > 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>"))
    return counts.select("mask_id", F.concat(lead, F.transform("runs", lambda r: r["n"])).alias("counts"))


def mask_geometry(masks: DataFrame) -> DataFrame:
    """(mask_id, height, width, counts) -> area, bounding box, centre of the set runs; null box and area 0 if none.

    Runs beyond height * width are cut; a run over a row's end spans the full width."""
    size = F.col("height").cast("long") * F.col("width")
    runs = masks.select("mask_id", "width", size.alias("size"), F.posexplode("counts").alias("pos", "n"))
    order = Window.partitionBy("mask_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(order), F.lit(0))
    spans = runs.withColumn("s", start).withColumn("e", F.least(F.col("s") + F.col("n"), "size") - 1).where((F.col("pos") % 2 == 1) & (F.col("e") >= F.col("s")))
    row = lambda c: F.floor(F.col(c) / F.col("width"))
    one = row("s") == row("e")
    spans = spans.select("mask_id", (F.col("e") - F.col("s") + 1).alias("n"), row("s").alias("ya"), row("e").alias("yb"), F.when(one, F.col("s") % F.col("width")).otherwise(0).alias("xa"), F.when(one, F.col("e") % F.col("width")).otherwise(F.col("width") - 1).alias("xb"))
    box = spans.groupBy("mask_id").agg(F.sum("n").alias("area_px"), F.min("xa").alias("x"), F.min("ya").alias("y"), F.max("xb").alias("xb"), F.max("yb").alias("yb"))
    w, h = (F.col("xb") - F.col("x") + 1), (F.col("yb") - F.col("y") + 1)
    found = box.select("mask_id", "area_px", F.col("x").cast("int").alias("bbox_x"), F.col("y").cast("int").alias("bbox_y"), w.cast("int").alias("bbox_w"), h.cast("int").alias("bbox_h"), (F.col("x") + F.floor(w / 2)).cast("int").alias("cx"), (F.col("y") + F.floor(h / 2)).cast("int").alias("cy"))
    return masks.select("mask_id").join(found.hint("merge"), "mask_id", "left").withColumn("area_px", F.coalesce("area_px", F.lit(0)))


def rect_runs(x: Column, y: Column, w: Column, h: Column, height: Column, width: Column) -> Column:
    """The runs of a filled rectangle inside a frame, in closed form."""
    x, y, w, h, height, width = (c.cast("long") for c in (x, y, w, h, height, width))
    lead = F.array(y * width + x)
    rows = F.when(w == width, F.array(w * h)).otherwise(F.concat(F.flatten(F.array_repeat(F.array(w, width - w), (h - 1).cast("int"))), F.array(w)))
    rest = height * width - ((y + h - 1) * width + x + w)
    return F.concat(lead, rows, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))


def _spans(counts: pa.Array, sizes: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of all set spans of a batch of masks, mask i at i * stride; cut at the mask's size, empty ones left out."""
    lists = counts.fill_null([]) if counts.null_count else counts
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    sums = np.cumsum(flat)
    ends = sums - np.repeat(np.concatenate([[0], sums])[first], lengths)
    at = np.flatnonzero((np.arange(len(flat)) - first[owner]) % 2 == 1)
    start, end = np.minimum(ends[at] - flat[at], sizes[owner[at]]), np.minimum(ends[at], sizes[owner[at]])
    some = end > start
    base = owner[at][some] * stride
    return base + start[some], base + end[some]


def _sweep(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The spans of a and b of all pairs merged by place: where a piece begins, its length, whether a and b are set there; the stride."""
    sizes = batch.column("height").to_numpy(zero_copy_only=False).astype(np.int64) * batch.column("width").to_numpy(zero_copy_only=False)
    stride = int(sizes.max(initial=0)) + 1
    (sa, ea), (sb, eb) = (_spans(batch.column(c), sizes, stride) for c in "ab")
    place = np.concatenate([sa, ea, sb, eb])
    order = np.argsort(place, kind="stable")
    step = [np.concatenate([np.full(len(v), d) for v, d in zip((sa, ea, sb, eb), deltas, strict=True)])[order] for deltas in ((1, -1, 0, 0), (0, 0, 1, -1))]
    place = place[order]
    last = np.flatnonzero(np.diff(place, append=place[-1:] + 1)) if len(place) else np.zeros(0, np.int64)
    in_a, in_b = (np.cumsum(d)[last] > 0 for d in step)
    begins = place[last]
    return begins, np.diff(begins, append=begins[-1:]), in_a, in_b, stride


def mask_overlap(pairs: DataFrame) -> DataFrame:
    """``pairs`` (height, width, a, b: run lengths) with area_a, area_b, inter_px, union_px and iou (0 without union) in place of a and b.

    The runs are merged by place, a batch of pairs at a time; no pixel is made. Null runs are an empty mask."""
    keys = [c for c in pairs.columns if c not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, length, in_a, in_b, stride = _sweep(batch)
            total = lambda where: np.bincount(begins[where] // stride, length[where], batch.num_rows).astype(np.int64)
            a, b, inter, union = total(in_a), total(in_b), total(in_a & in_b), total(in_a | in_b)
            iou = np.divide(inter, union, out=np.zeros(len(a)), where=union > 0)
            yield pa.record_batch([*(batch.column(c) for c in keys), *map(pa.array, (a, b, inter, union, iou))], [*keys, "area_a", "area_b", "inter_px", "union_px", "iou"])

    schema = StructType([pairs.schema[c] for c in keys])
    for c in ("area_a", "area_b", "inter_px", "union_px"):
        schema = schema.add(c, "long")
    return pairs.mapInArrow(run, schema.add("iou", "double"))


def mask_combine(pairs: DataFrame, how: str) -> DataFrame:
    """``pairs`` (height, width, a, b: run lengths) with ``counts`` in place of a and b: the runs of their intersection, union or
    difference (a without b). An empty mask has no runs."""
    keys = [c for c in pairs.columns if c not in ("a", "b")]
    rule = {"intersection": lambda a, b: a & b, "union": lambda a, b: a | b, "difference": lambda a, b: a & ~b}[how]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begins, length, in_a, in_b, stride = _sweep(batch)
            on = rule(in_a, in_b)
            start, end = begins[on], (begins + length)[on]
            joint = start[1:] == end[:-1]  # pieces that touch are one run
            start, end = start[np.concatenate([[True], ~joint])[: len(start)]], end[np.concatenate([~joint, [True]])[: len(end)]]
            edges = np.searchsorted(start, np.arange(batch.num_rows + 1) * stride)
            sizes = batch.column("height").to_numpy(zero_copy_only=False).astype(np.int64) * batch.column("width").to_numpy(zero_copy_only=False)
            rows = []
            for i, size in enumerate(sizes.tolist()):
                some = np.stack([start[edges[i] : edges[i + 1]], end[edges[i] : edges[i + 1]]], axis=1).ravel() - i * stride
                rows.append(np.diff(some, prepend=0, append=[size] if some[-1] < size else []) if len(some) else some)
            yield pa.record_batch([*(batch.column(c) for c in keys), pa.array(rows, pa.list_(pa.int64()))], [*keys, "counts"])

    return pairs.mapInArrow(run, StructType([pairs.schema[c] for c in keys]).add("counts", ArrayType(LongType())))


def keypoint_name(i: Column) -> Column:
    """The name of a point; one beyond the named ones is called by its number."""
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in KEYPOINTS]), i), F.concat(F.lit("kpt_"), i.cast("string")))


def keypoints_long(points: DataFrame, min_conf: float = 0.0) -> DataFrame:
    """Points of at least ``min_conf``, rounded to 2, 2 and 4 digits, with their names."""
    return points.where(F.col("conf") >= min_conf).select("run_id", "frame_idx", "id", keypoint_name(F.col("id")).alias("name"), F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("conf", 4).alias("conf"))


def skeleton_edges(points: DataFrame, width: int, height: int, min_conf: float = 0.25) -> DataFrame:
    """Edges of which both ends are confident and inside the frame."""
    good = points.where((F.col("conf") >= min_conf) & (F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height))
    edges = points.sparkSession.createDataFrame(SKELETON, "a int, b int")
    end = lambda c: good.select("run_id", "frame_idx", F.col("id").alias(c), F.col("x").alias(f"x_{c}"), F.col("y").alias(f"y_{c}"))
    return end("a").join(F.broadcast(edges), "a").join(end("b").hint("merge"), ["run_id", "frame_idx", "b"]).select("run_id", "frame_idx", "a", "b", "x_a", "y_a", "x_b", "y_b")
