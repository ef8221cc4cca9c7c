"""Is a person wearing the accessory: verdict per person and frame, smoothed over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, as_struct, box, box_inter, box_inter_area, box_iou, upper_band
from .detections import FRAME, min_conf

WARNING = "NO HELMET"


def verdicts(persons: DataFrame, accessories: DataFrame, min_px: float = 1.0, min_iou: float = 0.0, helmet_min_conf: float = 0.0) -> DataFrame:
    """One row per person: ok, warning, highlight box h*, best_intersection_px, best_iou.

    Of the frame's accessories the best that qualifies (area >= min_px, or IoU >= min_iou > 0) by area, IoU and position
    decides; else the best miss is reported. A person without accessories in the frame is a miss of 0. The join is an
    equi-join on the frame and pre-aggregates to one row per person."""
    acc = min_conf(accessories, helmet_min_conf).select(*FRAME, "acc_idx", *[F.col(c).alias(f"a{c}") for c in Box._fields])
    pairs = persons.join(acc, FRAME, "left")
    none = F.col("acc_idx").isNull()  # greatest() and least() pass over nulls, so this has to be asked first
    area, iou = (F.when(none, 0.0).otherwise(x) for x in (box_inter_area(box(), box("a")), box_iou(box(), box("a"))))
    qualifies = (area >= min_px) | ((iou >= min_iou) if min_iou > 0 else F.lit(False))
    shown = F.coalesce(box_inter(box(), box("a")), as_struct(box("a")))
    # qualified ones first, then the larger area, IoU, and the earlier accessory
    rank = F.struct((qualifies & ~none).alias("ok"), area.alias("area"), iou.alias("iou"), (-F.col("acc_idx")).alias("n"))
    best = pairs.groupBy(*FRAME, "inst_idx").agg(
        F.max_by(F.struct(rank.alias("rank"), shown.alias("box")), rank).alias("best"),
        F.first("object_id").alias("object_id"),
        F.first(as_struct(box())).alias("own"),
    )
    ok = F.col("best.rank.ok")
    own = Box(*(F.col(f"own.{c}") for c in Box._fields))
    head = F.when(ok, F.col("best.box")).otherwise(as_struct(upper_band(own)))
    return best.select(
        *FRAME, "inst_idx", "object_id", ok.alias("ok"), F.when(ok, "").otherwise(WARNING).alias("warning"),
        *[head[c].alias(f"h{c}") for c in Box._fields],
        F.col("best.rank.area").alias("best_intersection_px"), F.col("best.rank.iou").alias("best_iou"),
    )


def smooth_verdicts(v: DataFrame, streak: int = 2) -> DataFrame:
    """A miss counts from the streak-th in a row of its identity on; an ok resets at once. Frames without the id don't count."""
    k = max(1, streak)
    order = Window.partitionBy("run_id", "object_id").orderBy("frame_idx", "inst_idx").rowsBetween(-(k - 1), 0)
    misses = F.count_if(~F.col("ok")).over(order)
    ok = F.col("ok") | (misses < k)
    return v.withColumn("smooth_ok", ok).withColumns({"ok": F.col("smooth_ok"), "warning": F.when(F.col("smooth_ok"), "").otherwise(F.col("warning"))}).drop("smooth_ok")


def is_violation(ok: Column) -> Column:
    return F.coalesce(~ok, F.lit(False))


def diagnose(frames: DataFrame, v: DataFrame) -> DataFrame:
    """Per run: frames, frames with people, with verdicts, with people but no verdict, ok and fail counts."""
    per_frame = v.groupBy(*FRAME).agg(F.count("ok").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(~F.col("ok")).alias("n_fail"))
    joined = frames.select(*FRAME, "n_inst").join(per_frame, FRAME, "left")
    people, judged = F.col("n_inst") > 0, F.coalesce(F.col("n"), F.lit(0)) > 0
    return joined.groupBy("run_id").agg(
        F.count("*").alias("frames"), F.count_if(people).alias("frames_with_people"), F.count_if(judged).alias("frames_with_verdicts"),
        F.count_if(people & ~judged).alias("people_no_verdicts"), F.coalesce(F.sum("n_ok"), F.lit(0)).alias("ok_count"), F.coalesce(F.sum("n_fail"), F.lit(0)).alias("fail_count"),
    )


def violations_total(v: DataFrame) -> DataFrame:
    return v.groupBy("run_id").agg(F.count_if(is_violation(F.col("ok"))).alias("violations"))
