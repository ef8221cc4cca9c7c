"""Trackers on event time: frames may come in any order, in parts and more than once.

Rows wait in a list, an item for what a micro-batch brings of a run, until the watermark has passed their frame. A run has one timer,
that of its earliest waiting frame; it takes all complete frames in order through the tracker and sets the next one, so the list is
read once for all frames that are due. The tracker's state lies apart by track, motion id and gallery entry, so that a micro-batch
writes of it what it changed only. Rows later than the watermark are dropped by Spark; a row that comes again takes its own place.

The state store must be RocksDB (`rocksdb`).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .trackers import OUT, MotionTracker, Row, Track, Tracker

#: Some frames of a run, pickled (`_items`): Spark reads a schema for every row of a state, which takes longer than to track a frame.
WAITING = "frames binary"
#: So many frames are a row at most.
TOGETHER = 256
TRACK = "place int, live boolean, x0 double, y0 double, x1 double, y1 double, label string, motion long, misses long, ema array<double>, embs array<array<double>>, mean array<double>"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _list(v: np.ndarray | None) -> list[float] | None:
    return None if v is None else [float(x) for x in v]


def _array(v: list[float] | None) -> np.ndarray | None:
    return None if v is None else np.asarray(v, float)


def _items(part: pd.DataFrame) -> list[tuple]:
    """The rows of a part by frame: number, time, and what its detections have; the row without a detection is not among them."""
    ms = part["ts"].to_numpy().astype("datetime64[ms]").astype(np.int64).tolist()
    embs = part["embedding"] if "embedding" in part else [None] * len(part)
    out: dict[int, tuple] = {}
    columns = (part.frame_idx.tolist(), ms, part.det_idx.tolist(), part[["x0", "y0", "x1", "y1"]].to_numpy(float).tolist(), part.label, part.motion_id.tolist(), embs)
    for frame, at, det, box, label, motion, emb in zip(*columns, strict=True):
        item = out.setdefault(frame, (frame, at, [], [], [], [], []))
        if pd.notna(det):
            for values, value in zip(item[2:], (int(det), box, str(label), int(motion), _list(emb)), strict=True):
                values.append(value)
    return list(out.values())


def _packed(items: list[tuple]) -> list[tuple[bytes]]:
    """Items of `_items` as rows of the waiting list."""
    return [(pickle.dumps(items[n : n + TOGETHER]),) for n in range(0, len(items), TOGETHER)]


def tracks_of(tracker: Tracker) -> dict[int, tuple]:
    """The tracks as rows, by id, with their places in the order of the tracker."""
    if isinstance(tracker, MotionTracker):
        return {i: (n, True, *map(float, box), "", -1, misses, None, [], None) for n, (i, (box, misses)) in enumerate(tracker.live.items())}
    both = [(t, True) for t in tracker.live.values()] + [(t, False) for t in tracker.lost.values()]
    return {t.oid: (n, live, *map(float, t.box), t.label, int(t.motion), int(t.misses), _list(t.ema), [_list(e) for e in t.embs], _list(t.mean)) for n, (t, live) in enumerate(both)}


def put_tracks(tracker: Tracker, rows: dict[int, tuple]) -> None:
    for oid, (_, live, x0, y0, x1, y1, label, motion, misses, ema, embs, mean) in sorted(rows.items(), key=lambda x: x[1][0]):
        box = (x0, y0, x1, y1)
        if isinstance(tracker, MotionTracker):
            tracker.live[oid] = [box, misses]
        else:
            track = Track(oid, label, box, motion, misses, False, _array(ema), [_array(e) for e in embs], _array(mean))
            (tracker.live if live else tracker.lost)[oid] = track


class EventTracker(StatefulProcessor):
    """The tracker of each run, its state in the store between micro-batches."""

    def __init__(self, make: Callable[[], Tracker]) -> None:
        self.make = make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.timer = handle.getValueState("timer", "ms long")
        self.tracks = handle.getMapState("tracks", "object_id long", TRACK)
        self.motions = handle.getMapState("motions", "motion long", "object_id long")
        self.gallery = handle.getMapState("gallery", "object_id long", "place int, vector array<double>, last_frame long, updates long")
        self.facts = handle.getValueState("facts", "next_id long, recoveries long, frame long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.facts.get()[3] if self.facts.exists() else -1
        new: list[tuple] = []
        for part in rows:
            part = part[part["frame_idx"] > last]  # frames that were taken through the tracker are done
            if len(part):
                new += _items(part)
        if new:
            self.waiting.appendList(_packed(new))
            self._wake(min(item[1] for item in new) + 1)
        yield from ()

    def _wake(self, at: int) -> None:
        """The run's timer goes off at ``at`` at the latest."""
        before = self.timer.get()[0] if self.timer.exists() else None
        if before is None or at < before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        frames: dict[int, dict[int, Row]] = {}
        rest = []
        for item in (item for row in self.waiting.get() for item in pickle.loads(row[0])):
            if item[1] >= watermark:
                rest.append(item)
                continue
            dets = frames.setdefault(item[0], {})
            for det, box, label, motion, emb in zip(*item[2:], strict=True):
                dets[det] = Row(tuple(box), label, motion, _array(emb))
        self.timer.clear()
        if rest:
            self.waiting.put(_packed(rest))
            self._wake(min(item[1] for item in rest) + 1)
        else:
            self.waiting.clear()
        if not frames:
            return
        tracker, before = self._load()
        out: list[tuple] = []
        for frame in sorted(frames):
            dets = sorted(frames[frame].items())
            ids = tracker.step([r for _, r in dets])
            out += [(key[0], frame, det, i) for (det, _), i in zip(dets, ids, strict=True)]
        self._save(tracker, before, max(frames))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "frame_idx", "det_idx", "object_id"]).astype({"det_idx": "int32"})

    def _load(self) -> tuple[Tracker, tuple[dict, dict, dict]]:
        tracker = self.make()
        tracks = {k[0]: tuple(v) for k, v in self.tracks.iterator()}
        motions = {k[0]: v[0] for k, v in self.motions.iterator()} if hasattr(tracker, "by_motion") else {}
        gallery = {k[0]: tuple(v) for k, v in self.gallery.iterator()} if getattr(tracker, "gallery", None) is not None else {}
        put_tracks(tracker, tracks)
        if self.facts.exists():
            tracker.next_id, tracker.recoveries, tracker.frame, _ = self.facts.get()
        if hasattr(tracker, "by_motion"):
            tracker.by_motion = dict(motions)
        known = getattr(tracker, "gallery", None)
        if known is not None:
            for oid, (_, vector, last_frame, updates) in sorted(gallery.items(), key=lambda x: x[1][0]):
                known.vectors[oid], known.last_frame[oid], known.updates[oid] = _array(vector), last_frame, updates
                known.width = len(vector)
        return tracker, (tracks, motions, gallery)

    def _save(self, tracker: Tracker, before: tuple[dict, dict, dict], last: int) -> None:
        known = getattr(tracker, "gallery", None)
        gallery = {} if known is None else {i: (n, _list(v), int(known.last_frame[i]), int(known.updates[i])) for n, (i, v) in enumerate(known.vectors.items())}
        after = (tracks_of(tracker), {m: (i,) for m, i in getattr(tracker, "by_motion", {}).items()}, gallery)
        old = (before[0], {m: (i,) for m, i in before[1].items()}, before[2])
        for state, was, now in zip((self.tracks, self.motions, self.gallery), old, after, strict=True):
            for k in was.keys() - now.keys():
                state.removeKey((k,))
            for k, v in now.items():
                if was.get(k) != v:
                    state.updateValue((k,), v)
        self.facts.update((int(tracker.next_id), int(getattr(tracker, "recoveries", 0)), int(getattr(tracker, "frame", -1)), int(last)))

    def close(self) -> None:
        pass


def track_events(det: DataFrame, make: Callable[[], Tracker] = MotionTracker, delay: str = "10 seconds") -> DataFrame:
    """(run_id, frame_idx, det_idx, object_id) of a stream of detections with an event time ``ts``, the same for all rows of a frame and
    growing with the frame. A frame is answered when the watermark, ``delay`` behind the latest row of any run, has passed it. For
    frames without detections the stream has rows without det_idx (`with_frames`)."""
    grouped = det.withWatermark("ts", delay).groupBy("run_id")
    return grouped.transformWithStateInPandas(statefulProcessor=EventTracker(make), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
