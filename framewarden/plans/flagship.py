"""From detections to violators: the pipeline that the operators make up, on any tables of the schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.verdicts import is_violation, smooth_verdicts, verdicts

#: Effective parameters of the pipeline.
MIN_PX, MIN_IOU, MIN_CONF, STREAK = 20.0, 0.03, 0.30, 2


def judged(instances: DataFrame, accessories: DataFrame) -> DataFrame:
    """Smoothed verdicts with the pipeline's parameters."""
    return smooth_verdicts(verdicts(instances, accessories, MIN_PX, MIN_IOU, MIN_CONF), STREAK)


def violators(instances: DataFrame, accessories: DataFrame, runs: DataFrame, min_frames: int = 3) -> DataFrame:
    """Violators per run: violations, presence, second of the first violation (in the first row of the identity in its frame).

    The same as `qualified_violators` and `report_frame` of the judged rows, in one aggregation: these lie by identity in the
    order of frames already, so counts and first violation need no further shuffle."""
    order = Window.partitionBy("run_id", "object_id").orderBy("frame_idx", "inst_idx")
    first_slot = F.coalesce(F.lag("frame_idx").over(order) != F.col("frame_idx"), F.lit(True))
    miss = is_violation(F.col("ok"))
    rows = judged(instances, accessories).withColumn("first_slot", first_slot)
    counts = rows.groupBy("run_id", "object_id").agg(F.count_if(miss).alias("violations"), F.count("*").alias("presence"), F.min(F.when(miss & F.col("first_slot"), F.col("frame_idx"))).alias("first_violation"))
    good = counts.where(F.col("violations") >= max(1, min_frames)).join(runs.select("run_id", "fps"), "run_id")
    return good.select("run_id", "object_id", "violations", "presence", F.round(F.col("first_violation") / F.col("fps"), 6).alias("first_violation_sec"))
