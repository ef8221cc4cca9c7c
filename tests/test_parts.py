"""Runs cut at dead gaps, frames in any order on event time, and re-entry, against plain trackers."""

import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewarden.plans.queries import QUERIES, event_stream
from framewarden.streaming import trackers as T
from framewarden.streaming.event_trackers import EventTracker, rocksdb, track_events

DET = "run_id string, frame_idx long, det_idx int, x0 double, y0 double, x1 double, y1 double, label string, conf double, motion_id long, embedding array<double>"


def scene(seed, frames=600, runs=3, quiet=0.6):
    """Detections with long stretches without any, and all analysed frames."""
    rng = random.Random(seed)
    rows, analysed = [], []
    for r in range(runs):
        f, xs = 0, []
        while f < frames:
            n = rng.randint(1, 40)
            if rng.random() < quiet:
                n = rng.choice([3, 12, 13, 14, 40, 90])
            else:
                xs = [rng.uniform(0, 300) for _ in range(rng.randint(1, 4))]
                for k in range(n):
                    xs = [x + rng.uniform(-4, 4) for x in xs]
                    rows += [(f"r{r}", f + k, i, x, 0.0, x + 30, 60.0, "person", 0.9, rng.choice([-1, -1, i]), [float(i == j) for j in range(4)]) for i, x in enumerate(xs) if rng.random() < 0.8]
            analysed += [(f"r{r}", f + k) for k in range(n)]
            f += n
    return rows, analysed


def whole(rows, analysed, make):
    """Each run by one tracker, frame by frame."""
    out = []
    by_frame = {}
    for r in rows:
        by_frame.setdefault(r[:2], []).append(r)
    trackers = {}
    for key in sorted(set(analysed)):
        t = trackers.setdefault(key[0], make())
        dets = sorted(by_frame.get(key, []), key=lambda r: r[2])
        ids = t.step([T.Row(r[3:7], r[7], r[9], np.array(r[10])) for r in dets])
        out += [(*key, r[2], i) for r, i in zip(dets, ids, strict=True)]
    return sorted(out)


MAKES = [lambda: T.MotionTracker(max_age=12), lambda: T.MaskletTracker(buffer=2), lambda: T.AppearanceTracker(buffer=12), lambda: T.MaskletTracker(buffer=0), lambda: T.MaskletTracker(buffer=2, reentry=True, reentry_misses=1)]


@pytest.mark.parametrize("which", range(len(MAKES)))
def test_cut_runs_equal_whole_ones(spark, which):
    make = MAKES[which]
    for seed in (1, 2):
        rows, analysed = scene(seed)
        det = spark.createDataFrame(rows, DET).repartition(3)
        frames = spark.createDataFrame(analysed, "run_id string, frame_idx long").repartition(2)
        assert sorted(tuple(r) for r in T.track(det, make, frames).collect()) == whole(rows, analysed, make)
        if make().forgets_after is not None:
            parts = T.dead_gaps(det, frames, make().forgets_after)
            assert parts.select("run_id", "part").distinct().count() > 3 + 2


@pytest.mark.parametrize("which", [0, 1, 2, 4])
def test_shuffled_micro_batches_equal_batch(spark, tmp_path, which):
    make = MAKES[which]
    rows, analysed = scene(7, frames=160, runs=2, quiet=0.3)
    want = whole(rows, analysed, make)
    det = T.with_frames(spark.createDataFrame(rows, DET), spark.createDataFrame(analysed, "run_id string, frame_idx long")).withColumn("ts", F.timestamp_seconds(F.col("frame_idx") + 1000))
    late = F.floor((F.col("frame_idx") + F.pmod(F.xxhash64("frame_idx", "det_idx", "run_id"), F.lit(40))) / 50)
    for n in range(4):
        part = det.where(late == n)
        part.unionByName(part.where("frame_idx % 5 = 0")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # some come twice
    end = det.limit(1).withColumns({"run_id": F.lit("end"), "frame_idx": F.lit(9999).cast("long"), "ts": F.timestamp_seconds(F.lit(9999))})
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with rocksdb(spark):
        stream = spark.readStream.schema(det.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = track_events(stream, make, "60 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_event_stream_has_the_whole_table(spark):
    """Also frames after the 300th, in the fixtures and far beyond them."""
    sf = "/root/testdata/sf0.01"
    got = sorted(tuple(r) for r in QUERIES["motion_track_events"](spark, sf).collect())
    assert max(r[1] for r in got) > 300
    assert got == sorted(tuple(r) for r in QUERIES["motion_track"](spark, sf).collect())


def test_event_stream_has_no_last_frame(spark):
    rows, analysed = scene(5, frames=80, runs=2, quiet=0.3)
    rows += [(r[0], r[1] + 120_000, *r[2:]) for r in rows]
    analysed += [(r, f + 120_000) for r, f in analysed]
    fx = SimpleNamespace(spark=spark, detections=spark.createDataFrame(rows, DET), frames=spark.createDataFrame(analysed, "run_id string, frame_idx long"))
    assert sorted(tuple(r) for r in event_stream(fx).collect()) == whole(rows, analysed, T.MotionTracker)


def best_pairs(gain):
    """The assignment with the largest sum of gains, by dynamic programming over sets of rows."""
    n, best = len(gain), {0: (0.0, ())}
    for t in range(len(gain[0]) if n else 0):
        nxt = dict(best)
        for mask, (total, pairs) in best.items():
            for d in range(n):
                if not mask >> d & 1 and gain[d][t] > 0:
                    new = mask | 1 << d
                    if new not in nxt or total + gain[d][t] > nxt[new][0] + 1e-12:
                        nxt[new] = (total + gain[d][t], (*pairs, (d, t)))
        best = nxt
    return max(best.values(), key=lambda x: x[0])[1]


class PlainMasklets:
    """The rules written out: bind by motion, best sum of overlaps, lost or remembered looks, new."""

    def __init__(self, buffer=8, sim=0.65, misses=15, match=0.30):
        self.buffer, self.sim, self.misses, self.match = buffer, sim, misses, match
        self.tracks, self.looks, self.motion, self.next = {}, {}, {}, 1

    def step(self, rows):
        lost = {i: t for i, t in self.tracks.items() if t["lost"]}
        if len(lost) > 64:
            keep = sorted(lost, key=lambda i: lost[i]["m"])[:64]
            self.tracks = {i: t for i, t in self.tracks.items() if not t["lost"] or i in keep}
        got, seen = {}, set()
        for d, r in enumerate(rows):
            i = self.motion.get(r.motion) if r.motion >= 0 else None
            if i in self.tracks and i not in got.values() and not (self.tracks[i]["m"] == 0 and T.iou(r.box, self.tracks[i]["box"]) < 0.05):
                got[d] = i
        free = [d for d in range(len(rows)) if d not in got]
        pool = [i for i in self.tracks if i not in got.values()]
        gain = [[T.iou(rows[d].box, self.tracks[i]["box"]) * (1.0 if rows[d].label.lower() == self.tracks[i]["label"].lower() else 0.5) - self.match for i in pool] for d in free]
        for a, b in best_pairs(gain):
            got[free[a]] = pool[b]
        out, start = [], dict(got)
        for stage in (1, 2):
            for d, r in enumerate(rows):
                if stage == 1 and d in start:
                    continue
                if stage == 1:
                    i = self.recall(r, set(got.values()), True)
                    if i is not None:
                        got[d] = i
                        self.tracks.setdefault(i, {"box": r.box, "label": r.label, "m": max(self.misses, self.buffer + 1), "lost": True, "motion": r.motion, "ema": self.looks.get(i)})
                    continue
                i = got.get(d)
                if i is None:
                    i = self.recall(r, set(got.values()), False)
                    if i is not None:
                        got[d] = i
                        self.tracks.setdefault(i, {"box": r.box, "label": r.label, "m": max(self.misses, self.buffer + 1), "lost": True, "motion": r.motion, "ema": self.looks.get(i)})
                if i is None:
                    i, self.next = self.next, self.next + 1
                    self.tracks[i] = {"ema": None, "motion": r.motion}
                t = self.tracks[i]
                t.update(box=r.box, label=r.label, m=0, lost=False, motion=r.motion)
                if r.motion >= 0:
                    self.motion[r.motion] = i
                v = T.unit(r.emb, 1e-3)
                if v is not None:
                    t["ema"] = v if t["ema"] is None else T.unit(0.35 * v + 0.65 * t["ema"])
                    old = self.looks.get(i)
                    if old is None:
                        self.looks[i] = v
                    elif old @ v >= 0.45:
                        self.looks[i] = T.unit(0.65 * old + 0.35 * v)
                seen.add(i)
                out.append(i)
        for i, t in list(self.tracks.items()):
            if t["lost"]:
                t["m"] += 1
            elif i not in seen:
                t["m"] += 1
                if t["m"] > self.buffer:
                    t["lost"] = True
                    t["m"] += 1
            if t["lost"] and t["m"] > self.buffer * 10:
                del self.tracks[i]
        return out

    def recall(self, r, taken, lost_too):
        v = T.unit(r.emb, 1e-3)
        if v is None:
            return None
        options = []
        if lost_too:
            options += [(float(v @ t["ema"]), i) for i, t in self.tracks.items() if t["lost"] and i not in taken and t["m"] >= self.misses and t["ema"] is not None]
        best = max(options, key=lambda x: x[0], default=(-1.0, None))
        live = {i for i, t in self.tracks.items() if not t["lost"]}
        known = max(((float(x @ v), i) for i, x in self.looks.items() if i not in taken | live), key=lambda x: x[0], default=(-1.0, None))
        if known[0] >= self.sim and known[0] > best[0]:
            best = known
        return best[1] if best[0] >= self.sim else None


def test_reentry_query_against_plain_rules(spark):
    from framewarden.plans.fixtures import Fixtures
    from framewarden.plans.queries import leaving

    sf = "/root/testdata/sf0.01"
    fx = Fixtures(spark, sf)
    rows = leaving(fx).select("run_id", "frame_idx", "det_idx", "x0", "y0", "x1", "y1", "label", "conf", "motion_id", "embedding").collect()
    analysed = [tuple(r) for r in fx.frames.select("run_id", "frame_idx").collect()]
    got = sorted(tuple(r) for r in QUERIES["masklet_track_reentry"](spark, sf).collect())
    assert got == whole([tuple(r) for r in rows], analysed, PlainMasklets)
    first = {r[3] for r in got if r[1] < 200}
    assert first & {r[3] for r in got if 400 <= r[1] < 600}  # some came back elsewhere




class CountedState:
    """A state variable in memory that counts the calls."""

    def __init__(self, calls):
        self.items, self.calls = {}, calls

    def __getattr__(self, name):
        def call(*args):
            self.calls[name] = self.calls.get(name, 0) + 1
            if name in ("appendList", "put"):
                self.items[None] = (self.items.get(None, []) if name == "appendList" else []) + args[0]
            elif name in ("update", "updateValue"):
                self.items[args[0] if len(args) > 1 else None] = args[-1]
            elif name in ("clear", "removeKey"):
                self.items.pop(args[0] if args else None, None)
            return {"exists": None in self.items, "get": self.items.get(None, ()), "iterator": iter(self.items.items())}.get(name)

        return call


class CountedHandle:
    def __init__(self):
        self.calls, self.timers = {}, set()

    def getListState(self, *_):  # noqa: N802
        return CountedState(self.calls)

    getMapState = getValueState = getListState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_run_has_one_timer_and_its_rows_are_read_once(spark):
    handle, events = CountedHandle(), EventTracker(T.MotionTracker)
    events.init(handle)
    rows = [(f, d, pd.Timestamp(f + 1000, unit="s"), 10.0 + 40 * d, 0.0, 40.0 + 40 * d, 60.0, "person", -1) for f in range(150) for d in range(5)]
    part = pd.DataFrame(rows, columns=["frame_idx", "det_idx", "ts", "x0", "y0", "x1", "y1", "label", "motion_id"])
    for some in (part[part.frame_idx >= 75], part[part.frame_idx < 75]):
        assert not list(events.handleInputRows(("r",), iter([some]), None))
    assert handle.timers == {1_000_001}
    handle.timers.clear()
    out = list(events.handleExpiredTimer(("r",), Clock(1_100_000), None))
    assert [len(x) for x in out] == [500] and sorted(set(out[0].object_id)) == [1, 2, 3, 4, 5]
    assert handle.timers == {1_100_001}  # the first frame that isn't due
    assert sum(handle.calls.values()) < 50  # not some for every row


def test_frames_wait_together():
    handle, events = CountedHandle(), EventTracker(T.MotionTracker)
    events.init(handle)
    rows = [(f, 0, pd.Timestamp(f + 1000, unit="s"), 10.0, 0.0, 40.0, 60.0, "person", -1) for f in range(600)]
    part = pd.DataFrame(rows, columns=["frame_idx", "det_idx", "ts", "x0", "y0", "x1", "y1", "label", "motion_id"])
    for n in range(2):
        assert not list(events.handleInputRows(("r",), iter([part[part.frame_idx % 2 == n]]), None))
    assert len(events.waiting.items[None]) == 4  # two rows of 300 frames each
    handle.timers.clear()
    out = list(events.handleExpiredTimer(("r",), Clock(1_580_000), None))
    assert out[0].frame_idx.tolist() == list(range(580)) and set(out[0].object_id) == {1}
    assert len(events.waiting.items[None]) == 1 and handle.timers == {1_580_001}
