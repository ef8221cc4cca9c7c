"""Violators, timelines, clip plans and incident rows. Inputs are instances with a smoothed verdict column ``ok``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, scale_round
from .detections import FRAME
from .verdicts import is_violation

ID = ["run_id", "object_id"]
VIOLATION = "coalesce(not ok, false)"
# Names of the months in dates of incident rows.
MONTHS = ["января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря"]


def violation_counts(v: DataFrame) -> DataFrame:
    return v.where(VIOLATION).groupBy(*ID).agg(F.count("*").alias("violations"))


def order_violators(v: DataFrame) -> DataFrame:
    """Violators of each run with their place: most violations first, then the smaller id."""
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("violations"), "object_id"))
    return violation_counts(v).withColumn("place", place)


def presence_counts(v: DataFrame) -> DataFrame:
    return v.groupBy(*ID).agg(F.count("*").alias("presence"))


def stable_ids(v: DataFrame) -> DataFrame:
    return v.select(*ID).distinct()


def violator_ids(v: DataFrame) -> DataFrame:
    return v.where(VIOLATION).select(*ID).distinct()


def qualified_violators(v: DataFrame, min_frames: int = 3, min_ratio: float = 0.0, min_rel: float = 0.0) -> DataFrame:
    """Violators with at least ``threshold`` violations: max(1, min_frames, int(largest count of the run x min_rel)), and
    of that ratio to presence if asked. One aggregation gives both counts."""
    counts = v.groupBy(*ID).agg(F.count_if(is_violation(F.col("ok"))).alias("violations"), F.count("*").alias("presence")).where("violations > 0")
    threshold = F.lit(max(1, min_frames)).cast("long")
    if min_rel > 0:
        threshold = F.greatest(threshold, (F.max("violations").over(Window.partitionBy("run_id")) * min_rel).cast("long"))
    out = counts.withColumn("threshold", threshold).where("violations >= threshold")
    return out.where((F.col("presence") == 0) | (F.col("violations") / F.col("presence") >= min_ratio)) if min_ratio > 0 else out


def report_violators(v: DataFrame, min_frames: int = 3, min_ratio: float = 0.0, min_rel: float = 0.0) -> DataFrame:
    """Qualified violators of each run; a run that has none lists everyone with a violation, threshold 0."""
    every = v.groupBy(*ID).agg(F.count_if(is_violation(F.col("ok"))).alias("violations"), F.count("*").alias("presence")).where("violations > 0")
    good = qualified_violators(v, min_frames, min_ratio, min_rel).select(*ID, "threshold")
    joined = every.join(good, ID, "left")
    none = F.max("threshold").over(Window.partitionBy("run_id")).isNull()
    return joined.withColumn("none", none).where("none or threshold is not null").select(*ID, "violations", "presence", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def _first_slot(v: DataFrame) -> DataFrame:
    """The first row of each identity in a frame."""
    return v.groupBy(*ID, "frame_idx").agg(F.min_by(F.coalesce("ok", F.lit(True)), "inst_idx").alias("ok"), F.min("inst_idx").alias("inst_idx"))


def person_rows(v: DataFrame, sid: int) -> DataFrame:
    """One person, first slot of each frame."""
    return _first_slot(v.where(F.col("object_id") == sid))


def violator_rows(v: DataFrame, sid: int) -> DataFrame:
    """One violator: frames whose first slot with the id isn't a violation are empty."""
    return person_rows(v, sid).where("not ok")


def presence_frames(v: DataFrame) -> DataFrame:
    return v.select(*ID, "frame_idx").distinct()


def violation_frames(v: DataFrame) -> DataFrame:
    return _first_slot(v).where("not ok").select(*ID, "frame_idx")


def clip_frames(v: DataFrame, ids: DataFrame) -> DataFrame:
    """Frames to encode for each id: where it is present (an id always is where it violates)."""
    return presence_frames(v).join(ids.select(*ID).distinct(), ID, "left_semi")


def report_frame(v: DataFrame) -> DataFrame:
    """Per violator: the frame of the report (first violation, else first presence), presence and violation frames."""
    slots = _first_slot(v)
    out = slots.groupBy(*ID).agg(F.min(F.when(~F.col("ok"), F.col("frame_idx"))).alias("first_violation"), F.min("frame_idx").alias("first_presence"), F.count("*").alias("presence_frames"), F.count_if(~F.col("ok")).alias("violation_frames"))
    return out.select(*ID, F.coalesce("first_violation", "first_presence").alias("report_frame"), "first_violation", "presence_frames", "violation_frames")


def seek_seconds(v: DataFrame, runs: DataFrame) -> DataFrame:
    """Where to start the player for an id: one second before its report frame, not below 0."""
    fps = runs.select("run_id", F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(25.0)).alias("fps"))
    return report_frame(v).join(fps, "run_id").select(*ID, F.greatest(F.lit(0.0), F.col("report_frame") / F.col("fps") - 1.0).alias("seek_sec"))


def overlay_timeline(frames: DataFrame, runs: DataFrame, t0: float | None = None, t1: float | None = None) -> DataFrame:
    """An event per keyframe: t0 = frame / fps, t1 = the next one's t0. With bounds the rows of the window and one held before.

    Without a window the last event lasts one frame; with one, at least to min(t1, its start + 2)."""
    fps = runs.select("run_id", F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(25.0)).alias("fps"))
    rows = frames.select(*FRAME).join(fps, "run_id").withColumn("t0", F.col("frame_idx") / F.col("fps"))
    order = Window.partitionBy("run_id").orderBy("frame_idx")
    if t0 is not None or t1 is not None:
        a, b = max(0.0, t0 or 0.0), None if t1 is None else max(0.0, t1)
        if b is not None:
            rows = rows.where(F.col("t0") <= b + 0.05)
        early = F.col("t0") < a - 0.05
        rows = rows.withColumn("early", early).withColumn("next_early", F.lead("early").over(order)).where("not early or next_early = false")
    nxt = F.lead("t0").over(order)
    last = F.col("t0") + 1.0 / F.col("fps")
    if t1 is not None:
        last = F.greatest(last, F.least(F.lit(max(0.0, t1)), F.col("t0") + 2.0))
    return rows.withColumn("t1", F.coalesce(nxt, last)).select(*FRAME, "t0", "t1")


def _scaled(boxes: DataFrame, width: float, height: float, runs: DataFrame) -> DataFrame:
    """Boxes on another frame size, in whole pixels."""
    scale = runs.select("run_id", (F.lit(float(width)) / F.col("width")).alias("sx"), (F.lit(float(height)) / F.col("height")).alias("sy"))
    return boxes.join(scale, "run_id").withColumns({c: scale_round(F.col(c), F.col("sx" if c[0] == "x" else "sy")) for c in Box._fields}).drop("sx", "sy")


def scale_accessories(accessories: DataFrame, width: float, height: float, runs: DataFrame) -> DataFrame:
    """Accessory boxes for the player: scaled, without those of which a side is 1 px or less."""
    return _scaled(accessories, width, height, runs).where("x1 - x0 > 1 and y1 - y0 > 1")


def player_boxes(v: DataFrame, accessories: DataFrame, width: float, height: float, runs: DataFrame) -> DataFrame:
    """Boxes scaled to the player: people (kind p, v = violation) and accessories (kind h, id 0); sides of at most 1 px go."""
    people = _scaled(v, width, height, runs).withColumn("n", F.col("inst_idx")).select(*FRAME, "n", F.col("object_id").alias("id"), "x0", "y0", "x1", "y1", F.expr(VIOLATION).cast("int").alias("v"), F.lit("p").alias("kind"))
    helmets = scale_accessories(accessories, width, height, runs).withColumn("n", F.col("acc_idx")).select(*FRAME, "n", F.lit(0).cast("long").alias("id"), "x0", "y0", "x1", "y1", F.lit(0).alias("v"), F.lit("h").alias("kind"))
    return people.unionByName(helmets)


def estimate_stride(frames: DataFrame, runs: DataFrame, first: int = 12, within: int = 600) -> DataFrame:
    """Upper median of the gaps of 1 to 8 between the first keyframes of a run, at least the declared stride (2 if unknown)."""
    order = Window.partitionBy("run_id").orderBy("frame_idx")
    head = frames.select(*FRAME).distinct().withColumns({"n": F.row_number().over(order), "gap": F.col("frame_idx") - F.lag("frame_idx").over(order), "start": F.min("frame_idx").over(Window.partitionBy("run_id"))})
    gaps = head.where((F.col("n") <= first) & (F.col("frame_idx") - F.col("start") <= within) & F.col("gap").between(1, 8))
    med = gaps.groupBy("run_id").agg(F.array_sort(F.collect_list("gap")).alias("g")).select("run_id", F.expr("g[cast(floor(size(g) / 2) as int)]").alias("gap"))
    declared = F.coalesce(F.nullif(F.col("frame_stride"), F.lit(0)), F.lit(2)).cast("long")
    return runs.join(med, "run_id", "left").select("run_id", F.greatest(declared, F.coalesce("gap", declared)).alias("stride"))


def hold_forward(frames: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, frame_idx, keyframe): each source frame with the last keyframe less than ``stride`` old. No as-of join: a
    keyframe expands over the frames up to the next one."""
    stride = estimate_stride(frames, runs)
    order = Window.partitionBy("run_id").orderBy("keyframe")
    keys = frames.select("run_id", F.col("frame_idx").alias("keyframe"), "n_inst").join(stride, "run_id").withColumn("next", F.lead("keyframe").over(order))
    last = F.least(F.coalesce(F.col("next"), F.col("keyframe") + F.col("stride")), F.col("keyframe") + F.col("stride")) - 1
    return keys.select("run_id", F.explode(F.sequence("keyframe", last)).alias("frame_idx"), "keyframe", "n_inst")


def hold_forward_full(frames: DataFrame, runs: DataFrame) -> DataFrame:
    """All source frames of each run; ``keyframe`` is null unless one that has people is held there."""
    held = hold_forward(frames, runs).where("n_inst > 0").drop("n_inst")
    n = source_frames(frames, runs)
    every = n.where("source_frames > 0").select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("source_frames") - 1)).alias("frame_idx"))
    return every.join(held.hint("merge"), FRAME, "left")


def source_frames(frames: DataFrame, runs: DataFrame) -> DataFrame:
    """Frames of the source: as recorded, else the largest frame + 1."""
    top = frames.groupBy("run_id").agg(F.max("frame_idx").alias("top"))
    n = F.coalesce(F.nullif(F.col("source_frame_count").cast("long"), F.lit(0).cast("long")), F.col("top") + 1, F.lit(0).cast("long"))
    return runs.join(top, "run_id", "left").select("run_id", n.alias("source_frames"))


def clip_plan(v: DataFrame, min_frames: int = 3) -> DataFrame:
    """Decision per violating id: INCLUDE or SKIP, frames to encode, output name."""
    counts = violator_ids(v).join(report_frame(v), ID)
    good = qualified_violators(v, min_frames).select(*ID, F.lit(True).alias("good"))
    return counts.join(good, ID, "left").select(
        *ID, F.when(F.col("good"), "INCLUDE").otherwise("SKIP").alias("decision"), F.when(F.col("good"), F.col("presence_frames")).otherwise(0).alias("clip_frames"),
        "violation_frames", F.concat("run_id", F.lit("_id"), F.col("object_id").cast("string"), F.lit(".mp4")).alias("output_name"),
    )


def clip_sequence(v: DataFrame, ids: DataFrame) -> DataFrame:
    """The frames of each clip, numbered from 0."""
    order = Window.partitionBy(*ID).orderBy("frame_idx")
    return clip_frames(v, ids).withColumn("out_idx", F.row_number().over(order) - 1)


def scene_counters(frames: DataFrame, v: DataFrame, accessories: DataFrame, keypoints: DataFrame | None = None) -> DataFrame:
    """Per frame: people, helmets, people without helmet; with ``keypoints`` (run, frame, inst, ...) those with key points."""
    people = v.groupBy(*FRAME).agg(F.count("*").alias("people"), F.count_if(is_violation(F.col("ok"))).alias("no_helmet"))
    helmets = accessories.groupBy(*FRAME).agg(F.count("*").alias("helmets"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = frames.select(*FRAME).join(people, FRAME, "left").join(helmets, FRAME, "left").select(*FRAME, zero("people"), zero("helmets"), zero("no_helmet"))
    if keypoints is None:
        return out
    posed = keypoints.groupBy(*FRAME).agg(F.countDistinct("inst_idx").alias("with_keypoints"))
    return out.join(posed.hint("merge"), FRAME, "left").select(*out.columns, zero("with_keypoints"))


def incident_time(raw: Column) -> Column:
    """A timestamp from one of the accepted formats; null if none fits."""
    forms = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd.MM.yyyy HH:mm"]
    return F.coalesce(*[F.try_to_timestamp(F.trim(raw), F.lit(f)) for f in forms])


def incident_text(ts: Column) -> Column:
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(ts))
    return F.concat(F.dayofmonth(ts).cast("string"), F.lit(" "), month, F.lit(" "), F.year(ts).cast("string"), F.lit(" г., "), F.date_format(ts, "HH:mm"))


def incident_rows(v: DataFrame, runs: DataFrame, organization: str = "", company: str = "", when: str = "2024-05-01T10:30", counts: DataFrame | None = None) -> DataFrame:
    """A row per qualified violator for the incident form; blanks become a dash. ``counts`` (run_id, object_id, presence_frames,
    violation_frames) of a request go before those of the scan, each where it isn't null."""
    org = (organization or company).strip() or "—"
    firm = (company or org).strip() or "—"
    frames = report_frame(v).join(qualified_violators(v).select(*ID), ID, "left_semi")
    if counts is not None:
        asked = counts.select(*ID, F.col("presence_frames").alias("_p"), F.col("violation_frames").alias("_v"))
        frames = frames.join(asked.hint("merge"), ID, "left").withColumns({"presence_frames": F.coalesce("_p", "presence_frames"), "violation_frames": F.coalesce("_v", "violation_frames")}).drop("_p", "_v")
    name = F.coalesce(F.nullif(F.element_at(F.split("input_path", "/"), -1), F.lit("")), F.lit("—"))
    time = incident_text(F.coalesce(incident_time(F.lit(when)), F.current_timestamp()))
    return frames.join(runs.select("run_id", name.alias("source_name")), "run_id").select(
        *ID, F.lit(org).alias("organization"), F.lit(firm).alias("company"), time.alias("incident_text"), F.concat(F.lit("№ "), F.col("object_id").cast("string")).alias("violator"),
        F.col("presence_frames"), F.col("violation_frames"), "report_frame", "source_name",
    )


def assemble_instances(instances: DataFrame, v: DataFrame, keypoints: DataFrame, runs: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Result rows of instances: mask and its geometry, verdict, key points as an array, prompt id and label slug id.

    The mask is that of ``masks`` (run, frame, inst, height, width, counts), else the box filled on the run's frame; rows whose mask is
    empty go. v: (run, frame, inst, ok, warning); keypoints: (run, frame, inst, id, x, y, conf). Instances may have a
    ``prompt_ref`` (`resolve_prompt_id`): those with one get it as prompt_id and, if the label has a slug, in ``slug_ids``. The runs of a
    filled box, some numbers a line, are made after the last join, so no join shuffles or sorts them."""
    from ..functions.geometry import box, rect_mask_geometry
    from ..functions.text import label_slug
    from .masks import mask_geometry, rect_runs

    key = [*FRAME, "inst_idx"]
    points = keypoints.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("id", "x", "y", "conf"))).alias("keypoints"))
    size = runs.select("run_id", "width", "height")
    rect = rect_mask_geometry(box(), F.col("width"), F.col("height"))
    rows = instances.join(size, "run_id").withColumns(rect)
    runs_of_box = rect_runs(*(F.col(f"bbox_{c}") for c in "xywh"), F.col("height"), F.col("width"))
    mask = F.struct("height", "width", runs_of_box.alias("counts"))
    if masks is not None:
        real = masks.select(F.struct(*key).alias("mask_id"), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), F.col("counts").cast("array<long>").alias("counts"))
        measured = mask_geometry(real).join(real.hint("merge"), "mask_id").select("mask_id.*", F.struct("height", "width", "counts").alias("_mask"), *[F.col(c).alias(f"_{c}") for c in rect])
        rows = rows.join(measured.hint("merge"), key, "left")
        drawn = F.col("_mask").isNotNull()
        rows = rows.withColumns({c: F.when(drawn, F.col(f"_{c}")).otherwise(F.col(c)) for c in rect})
        mask = F.when(drawn, F.col("_mask")).otherwise(mask)
    rows = rows.where("area_px > 0")
    prompt = F.col("prompt_ref") if "prompt_ref" in instances.columns else F.lit(None).cast("int")
    slug = label_slug(F.col("label"))
    judged = v.select(*key, F.col("ok").alias("cross_check_ok"), "warning")
    return rows.join(judged, key, "left").join(points.hint("merge"), key, "left").select(
        *key, "object_id", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "area_px", "cx", "cy", "score", F.col("label").alias("prompt_label"),
        prompt.alias("prompt_id"), F.when(prompt.isNotNull() & (slug != ""), F.create_map(F.concat(slug, F.lit("_id")), prompt)).alias("slug_ids"), mask.alias("mask"), "keypoints", "cross_check_ok", "warning",
    )


def scene_plan(frames: DataFrame, runs: DataFrame) -> DataFrame:
    """Per run: frames of the whole scene's clip and how many of them hold people."""
    full = hold_forward_full(frames, runs)
    return full.groupBy("run_id").agg(F.count("*").alias("clip_frames"), F.count("keyframe").alias("frames_with_people"))


def person_plan(v: DataFrame) -> DataFrame:
    """A clip for every id, violator or not: frames and output name."""
    clips = presence_frames(v).groupBy(*ID).agg(F.count("*").alias("clip_frames"))
    return clips.withColumn("output_name", F.concat("run_id", F.lit("_person"), F.col("object_id").cast("string"), F.lit(".mp4")))


def accessory_leaks(instances: DataFrame, accessories: DataFrame, id_map: DataFrame | None = None) -> DataFrame:
    """Accessories that also appear as instances (same frame, box and label), which must not be; empty if all is well."""
    same = [*FRAME, "label", "x0", "y0", "x1", "y1"]
    return accessories.select("acc_idx", *same).join(instances.select(*same), same, "left_semi")
