"""Boxes, crops and scaling. A box is four columns x0, y0, x1, y1 in pixels (double)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "", suffix: str = "") -> Box:
    """The box of columns like ``ax0``: prefix and suffix around the four names."""
    return Box(*(F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1")))


def as_struct(b: Box) -> Column:
    return F.struct(*(c.alias(n) for c, n in zip(b, Box._fields, strict=True)))


def box_area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b.x1 - b.x0) * F.greatest(F.lit(0.0), b.y1 - b.y0)


def box_inter_area(a: Box, b: Box) -> Column:
    """Area that two boxes share."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def box_inter(a: Box, b: Box) -> Column:
    """The shared box as a struct; null if it is empty."""
    x0, y0, x1, y1 = F.greatest(a.x0, b.x0), F.greatest(a.y0, b.y0), F.least(a.x1, b.x1), F.least(a.y1, b.y1)
    return F.when((x1 > x0) & (y1 > y0), as_struct(Box(x0, y0, x1, y1)))


def box_iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 without overlap or without area."""
    inter = box_inter_area(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def upper_band(b: Box, width: Column | None = None, height: Column | None = None, band: float = 0.35, inset: float = 0.15) -> Box:
    """The upper part of a person box, inset at the sides, clamped to the frame if its size is given."""
    w, h = F.greatest(F.lit(1.0), b.x1 - b.x0), F.greatest(F.lit(1.0), b.y1 - b.y0)
    x0, x1, y0, y1 = b.x0 + w * inset, b.x1 - w * inset, b.y0, b.y0 + h * band
    if width is not None:
        x0, x1 = (F.greatest(F.lit(0.0), F.least(x, width - 1.0)) for x in (x0, x1))
    if height is not None:
        y0, y1 = (F.greatest(F.lit(0.0), F.least(y, height - 1.0)) for y in (y0, y1))
    return Box(x0, y0, x1, y1)


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Box:
    return Box(x, y, x + w, y + h)


def center(b: Box) -> tuple[Column, Column]:
    return (b.x0 + b.x1) * 0.5, (b.y0 + b.y1) * 0.5


def diag(b: Box) -> Column:
    """Length of the diagonal; sides count as 1 at least."""
    return F.hypot(F.greatest(F.lit(1.0), b.x1 - b.x0), F.greatest(F.lit(1.0), b.y1 - b.y0))


def scale_round(x: Column, factor: Column) -> Column:
    """Half-even rounding of a scaled coordinate, as int."""
    return F.bround(x * factor).cast("int")


def scale_box(b: Box, sx: Column, sy: Column) -> Box:
    """A box (of a person or a head) on another frame size, in whole pixels."""
    return Box(scale_round(b.x0, sx), scale_round(b.y0, sy), scale_round(b.x1, sx), scale_round(b.y1, sy))


def scale_point(x: Column, y: Column, sx: Column, sy: Column) -> tuple[Column, Column]:
    """A centre on another frame size, in whole pixels."""
    return scale_round(x, sx), scale_round(y, sy)


def scale_keypoints(points: Column, sx: Column, sy: Column) -> Column:
    """An array of (id, x, y, conf) on another frame size: places to two digits, the rest as it is."""
    return F.transform(points, lambda p: F.struct(p["id"].alias("id"), F.round(p["x"] * sx, 2).alias("x"), F.round(p["y"] * sy, 2).alias("y"), p["conf"].alias("conf")))


def clip(x: Column, high: Column) -> Column:
    return F.greatest(F.lit(0), F.least(x, high))


def rect_mask_geometry(b: Box, width: Column, height: Column) -> dict[str, Column]:
    """Geometry of the filled rectangle of a box on the pixel grid, ends included; nulls where it is empty."""
    xa, xb = clip(F.floor(b.x0).cast("int"), width - 1), clip(F.ceil(b.x1).cast("int"), width - 1)
    ya, yb = clip(F.floor(b.y0).cast("int"), height - 1), clip(F.ceil(b.y1).cast("int"), height - 1)
    full = (xb > xa) & (yb > ya)
    w, h = xb - xa + 1, yb - ya + 1
    half = lambda v: F.floor(v / 2).cast("int")
    values = {"bbox_x": xa, "bbox_y": ya, "bbox_w": w, "bbox_h": h, "area_px": w.cast("long") * h, "cx": xa + half(w), "cy": ya + half(h)}
    return {k: F.when(full, v) for k, v in values.items()}


def crop_rect(b: Box, width: Column, height: Column, pad: float = 0.05) -> Column:
    """Padded, clamped crop rectangle in whole pixels (truncated) as a struct; null if empty."""
    w, h = b.x1 - b.x0, b.y1 - b.y0
    x0, y0 = F.greatest(F.lit(0.0), b.x0 - pad * w), F.greatest(F.lit(0.0), b.y0 - pad * h)
    x1, y1 = F.least(width - 1.0, b.x1 + pad * w), F.least(height - 1.0, b.y1 + pad * h)
    xa, ya, xb, yb = (v.cast("int") for v in (x0, y0, x1, y1))
    return F.when((xb > xa) & (yb > ya), as_struct(Box(xa, ya, xb, yb)))


def crop_ok(rect: Column, b: Box, width: Column, height: Column, reject_edge: bool = False, margin: float = 2.0, min_h: int = 48, min_w: int = 24) -> Column:
    """Whether a crop is good enough for an appearance vector: size, aspect, and (if asked) off the frame's edge."""
    h, w = rect["y1"] - rect["y0"], rect["x1"] - rect["x0"]
    aspect = h / F.greatest(F.lit(1.0), w.cast("double"))
    good = rect.isNotNull() & (h >= min_h) & (w >= min_w) & (aspect >= 0.35) & (aspect <= 5.0)
    if reject_edge:
        good &= ~((b.x0 <= margin) | (b.y0 <= margin) | (b.x1 >= width - 1.0 - margin) | (b.y1 >= height - 1.0 - margin))
    return F.coalesce(good, F.lit(False))


def torso_box(points: Column, b: Box, min_conf: float = 0.25, pad: float = 0.20, min_valid: int = 3) -> Column:
    """Box of shoulders and hips (ids 5, 6, 11, 12) from an array of (id, x, y, conf), padded and kept inside ``b``."""
    good = F.filter(points, lambda p: p["id"].isin(5, 6, 11, 12) & (p["conf"] >= min_conf))
    xs, ys = F.transform(good, lambda p: p["x"]), F.transform(good, lambda p: p["y"])
    w = F.greatest(F.lit(8.0), F.array_max(xs) - F.array_min(xs))
    h = F.greatest(F.lit(8.0), F.array_max(ys) - F.array_min(ys))
    x0, y0 = F.greatest(b.x0, F.array_min(xs) - pad * w), F.greatest(b.y0, F.array_min(ys) - pad * h)
    x1, y1 = F.least(b.x1, F.array_max(xs) + pad * w), F.least(b.y1, F.array_max(ys) + pad * h)
    return F.when((F.size(good) >= min_valid) & (x1 - x0 >= 8) & (y1 - y0 >= 8), as_struct(Box(x0, y0, x1, y1)))


def choose_crop(torso: Column, b: Box, min_ratio: float = 0.12, min_h: float = 36.0) -> Column:
    """The torso box where it is large enough against the person, else the person box."""
    person = F.greatest(F.lit(1.0), (b.x1 - b.x0) * (b.y1 - b.y0))
    w, h = torso["x1"] - torso["x0"], torso["y1"] - torso["y0"]
    large = torso.isNotNull() & (F.greatest(F.lit(1.0), w * h) >= min_ratio * person) & (h >= min_h)
    return F.when(large, torso).otherwise(as_struct(b))
