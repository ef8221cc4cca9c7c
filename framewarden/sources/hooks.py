"""Hooks for user models: functions from batches of rows to rows, run by mapInPandas with a declared schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DETECTIONS = "run_id string, frame_idx long, det_idx int, x0 double, y0 double, x1 double, y1 double, label string, conf double, motion_id long"


def _in_batches(parts: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        for at in range(0, len(pdf), size):
            yield pdf.iloc[at : at + size].reset_index(drop=True)


def score_frames(frames: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], batch: int = 32, schema: str = DETECTIONS) -> DataFrame:
    """Detections of ``fn`` on batches of at most ``batch`` frames."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _in_batches(parts, batch):
            yield fn(pdf)

    return frames.mapInPandas(run, schema)


def score_masks(frames: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], batch: int = 32) -> DataFrame:
    """Segments of ``fn``: (run_id, frame_idx, seg_idx, label, conf, height, width, counts)."""
    return score_frames(frames, fn, batch, "run_id string, frame_idx long, seg_idx int, label string, conf double, height int, width int, counts array<long>")


def embed_crops(crops: DataFrame, fn: Callable[[pd.Series], np.ndarray], chunk: int = 64, column: str = "crop") -> DataFrame:
    """``crops`` with ``embedding``: vectors of ``fn`` on chunks of crops, at length 1 (null where too short)."""

    @F.pandas_udf("array<double>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for at in range(0, len(s), chunk):
                v = np.asarray(fn(s.iloc[at : at + chunk]), float)
                n = np.linalg.norm(v, axis=1)
                out += [list(x / m) if m >= 1e-8 else None for x, m in zip(v, n, strict=True)]
            yield pd.Series(out)

    return crops.withColumn("embedding", embed(column))
