"""Clean detections frame by frame: labels, duplicates, fallback segments, ids.

Frames are the unit of all joins here: (run_id, frame_idx) is the equi-key, the box condition stands beside it, so a pair
is only ever formed within a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Box, box, box_iou
from ..functions.text import label_match

FRAME = ["run_id", "frame_idx"]


def match_labels(df: DataFrame, terms: Column) -> DataFrame:
    """Rows whose label equals one of the terms; no terms keep all."""
    return df.where(label_match(F.col("label"), terms))


def accessory_filter(accessories: DataFrame, terms: Column, conf: float = 0.0) -> DataFrame:
    """Accessory boxes whose label matches the object prompt, of at least ``conf`` if that is more than 0."""
    return min_conf(match_labels(accessories, terms), conf)


def min_conf(df: DataFrame, conf: float) -> DataFrame:
    return df.where(F.col("conf") >= conf) if conf > 0 else df


def fallback_ids(det: DataFrame) -> DataFrame:
    """Identity without a tracker: the motion id, else the position from 1."""
    return det.withColumn("object_id", F.when(F.col("motion_id") >= 0, F.col("motion_id")).otherwise(F.col("det_idx") + 1).cast("long"))


def _struct_iou(a: Column, b: Column) -> Column:
    return box_iou(Box(a["x0"], a["y0"], a["x1"], a["y1"]), Box(b["x0"], b["y0"], b["x1"], b["y1"]))


def dedupe(det: DataFrame, iou: float = 0.55) -> DataFrame:
    """Greedy suppression: by falling confidence (ties in input order), drop a box that overlaps a kept one of its label.

    The frame's boxes are one sorted array, folded in place; a frame has tens of boxes."""
    columns = [c for c in det.columns if c not in FRAME]
    rows = F.struct((-F.col("conf")).alias("_order"), "det_idx", *[c for c in columns if c != "det_idx"])
    frames = det.groupBy(*FRAME).agg(F.array_sort(F.collect_list(rows)).alias("rows"))
    clash = lambda kept, r: F.exists(kept, lambda k: (F.lower(k["label"]) == F.lower(r["label"])) & (_struct_iou(k, r) >= iou))
    none = F.filter("rows", lambda r: F.lit(False))
    kept = F.aggregate("rows", none, lambda acc, r: F.when(clash(acc, r), acc).otherwise(F.concat(acc, F.array(r))))
    return frames.select(*FRAME, F.explode(kept).alias("r")).select(*FRAME, *[F.col(f"r.{c}").alias(c) for c in columns]).select(det.columns)


def merge_fallback(det: DataFrame, seg: DataFrame, iou: float = 0.25) -> DataFrame:
    """Detections, and the segments that no detection of their label covers, with motion id -1."""
    ref = det.select(*FRAME, F.lower("label").alias("dlabel"), *[F.col(c).alias(f"d{c}") for c in Box._fields])
    covered = (F.lower("label") == F.col("dlabel")) & (box_iou(box(), box("d")) >= iou)
    s, r = seg.alias("s"), ref.alias("r")
    on = (F.col("s.run_id") == F.col("r.run_id")) & (F.col("s.frame_idx") == F.col("r.frame_idx")) & covered
    new = s.join(r, on, "left_anti").select(*FRAME, F.lit(None).cast("int").alias("det_idx"), F.col("seg_idx"), *Box._fields, "label", "conf", F.lit(-1).cast("long").alias("motion_id"))
    old = det.select(*FRAME, "det_idx", F.lit(None).cast("int").alias("seg_idx"), *Box._fields, "label", "conf", F.col("motion_id").cast("long").alias("motion_id"))
    return old.unionByName(new)


def inherit_motion(det: DataFrame, iou: float = 0.25) -> DataFrame:
    """Detections without a motion id take that of the tracked box which they overlap most, ties to the first."""
    have = det.where("motion_id >= 0").select(*FRAME, F.col("det_idx").alias("ref_idx"), F.col("motion_id").alias("ref_motion"), *[F.col(c).alias(f"r{c}") for c in Box._fields])
    lack = det.where("motion_id < 0").select(*FRAME, "det_idx", *Box._fields)
    overlap = lack.join(have, FRAME).withColumn("o", box_iou(box(), box("r"))).where(F.col("o") >= iou)
    best = overlap.groupBy(*FRAME, "det_idx").agg(F.max_by("ref_motion", F.struct("o", -F.col("ref_idx"))).alias("found"))
    return det.join(best, [*FRAME, "det_idx"], "left").withColumn("motion_id", F.coalesce(F.when(F.col("motion_id") < 0, F.col("found")), "motion_id")).select(det.columns)


def match_segments(det: DataFrame, seg: DataFrame, iou: float = 0.5) -> DataFrame:
    """One-to-one matches of detections and segments of the same label, greedy by falling IoU: (run, frame, det, seg, iou).

    Unmatched detections have null seg_idx. Ties go to the smaller detection, then segment, number."""
    s = seg.select(*FRAME, "seg_idx", F.lower("label").alias("slabel"), *[F.col(c).alias(f"s{c}") for c in Box._fields])
    pairs = det.join(s, FRAME).where(F.lower("label") == F.col("slabel")).withColumn("iou", box_iou(box(), box("s"))).where(F.col("iou") >= iou)
    item = F.struct((-F.col("iou")).alias("o"), "det_idx", "seg_idx", "iou")
    frames = pairs.groupBy(*FRAME).agg(F.array_sort(F.collect_list(item)).alias("pairs"))
    taken = lambda acc, p: F.exists(acc, lambda k: (k["det_idx"] == p["det_idx"]) | (k["seg_idx"] == p["seg_idx"]))
    chosen = F.aggregate("pairs", F.filter("pairs", lambda p: F.lit(False)), lambda acc, p: F.when(taken(acc, p), acc).otherwise(F.concat(acc, F.array(p))))
    found = frames.select(*FRAME, F.explode(chosen).alias("p")).select(*FRAME, "p.det_idx", "p.seg_idx", "p.iou")
    return det.select(*FRAME, "det_idx").join(found.hint("merge"), [*FRAME, "det_idx"], "left")


def attach_embeddings(det: DataFrame, emb: DataFrame, width: int) -> DataFrame:
    """The embedding of each (frame, detection) slot; a missing one is a zero vector of ``width``."""
    joined = det.join(emb, [*FRAME, "det_idx"], "left")
    return joined.withColumn("embedding", F.coalesce("embedding", F.array_repeat(F.lit(0.0), width)))
