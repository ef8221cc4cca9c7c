"""All registered queries: name -> (Spark query on the fixtures, the same as DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import vectors as VEC
from ..operators import detections as D
from ..operators import linking as L
from ..operators import masks as M
from ..operators import prompts as P
from ..operators import reports as R
from ..operators import runs as U
from ..operators import verdicts as V
from ..sources import hooks, io
from ..sources.shared import new_path
from ..streaming import trackers as S
from ..streaming.event_trackers import rocksdb, track_events
from . import flagship
from .fixtures import Fixtures, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def register(name: str, sql: str | None = None):
    def keep(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Fixtures(spark, sf_dir))

        query.__name__ = name
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = with_fixtures(sql, DUCK_VIEWS)
        return f

    return keep


AREA = "greatest(0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * greatest(0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0))"


def area_sql(a: str, b: str) -> str:
    return AREA.format(a=a, b=b)


def iou_sql(a: str, b: str) -> str:
    i = area_sql(a, b)
    size = lambda t: f"({t}x1 - {t}x0) * ({t}y1 - {t}y0)"
    return f"CASE WHEN {i} > 0 THEN {i} / ({size(a)} + {size(b)} - {i}) ELSE 0 END"


#: Views of the oracle's own.
DUCK_VIEWS = {
    "ck_pairs": f"""SELECT p.run_id, p.frame_idx, p.inst_idx, p.object_id, p.x0, p.y0, p.x1, p.y1, a.acc_idx, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1,
 CASE WHEN a.acc_idx IS NULL THEN 0 ELSE {area_sql("p.", "a.")} END AS area, CASE WHEN a.acc_idx IS NULL THEN 0 ELSE {iou_sql("p.", "a.")} END AS iou
 FROM fx_instances p LEFT JOIN (SELECT * FROM fx_accessories WHERE conf >= 0.30) a ON p.run_id = a.run_id AND p.frame_idx = a.frame_idx""",
    "ck_best": """SELECT * FROM (SELECT *, acc_idx IS NOT NULL AND (area >= 20 OR iou >= 0.03) AS ok,
 row_number() OVER (PARTITION BY run_id, frame_idx, inst_idx ORDER BY (acc_idx IS NOT NULL AND (area >= 20 OR iou >= 0.03)) DESC, area DESC, iou DESC, acc_idx) AS rn FROM ck_pairs) t WHERE rn = 1""",
    "ck_raw": """SELECT run_id, frame_idx, inst_idx, object_id, ok, CASE WHEN ok THEN '' ELSE 'NO HELMET' END AS warning,
 CASE WHEN ok THEN greatest(x0, ax0) ELSE x0 + (x1 - x0) * 0.15 END AS hx0, CASE WHEN ok THEN greatest(y0, ay0) ELSE y0 END AS hy0,
 CASE WHEN ok THEN least(x1, ax1) ELSE x1 - (x1 - x0) * 0.15 END AS hx1, CASE WHEN ok THEN least(y1, ay1) ELSE y0 + (y1 - y0) * 0.35 END AS hy1,
 area AS best_intersection_px, iou AS best_iou FROM ck_best""",
    "ck_smooth": """SELECT * EXCLUDE (ok, warning, misses), ok OR misses < 2 AS ok, CASE WHEN ok OR misses < 2 THEN '' ELSE warning END AS warning
 FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, object_id ORDER BY frame_idx, inst_idx ROWS 1 PRECEDING) AS misses FROM ck_raw) t""",
    "ck_counts": "SELECT run_id, object_id, count(*) FILTER (NOT ok) AS violations, count(*) AS presence FROM ck_smooth GROUP BY 1, 2 HAVING count(*) FILTER (NOT ok) > 0",
    "ck_slots": "SELECT run_id, object_id, frame_idx, arg_min(ok, inst_idx) AS ok FROM ck_smooth GROUP BY 1, 2, 3",
    "ck_report": """SELECT run_id, object_id, coalesce(min(frame_idx) FILTER (NOT ok), min(frame_idx)) AS report_frame, min(frame_idx) FILTER (NOT ok) AS first_violation,
 count(*) AS presence_frames, count(*) FILTER (NOT ok) AS violation_frames FROM ck_slots GROUP BY 1, 2""",
    "ck_source": """SELECT r.run_id, CAST(coalesce(nullif(source_frame_count, 0), top + 1, 0) AS BIGINT) AS source_frames, r.fps
 FROM fx_runs r LEFT JOIN (SELECT run_id, max(frame_idx) AS top FROM fx_frames GROUP BY 1) t USING (run_id)""",
    "ck_gaps": """SELECT run_id, list(gap ORDER BY gap) AS g FROM (SELECT run_id, frame_idx, row_number() OVER w AS n, frame_idx - lag(frame_idx) OVER w AS gap, min(frame_idx) OVER (PARTITION BY run_id) AS f0
 FROM fx_frames WINDOW w AS (PARTITION BY run_id ORDER BY frame_idx)) t WHERE n <= 12 AND frame_idx - f0 <= 600 AND gap BETWEEN 1 AND 8 GROUP BY 1""",
    "ck_stride": "SELECT r.run_id, CAST(greatest(frame_stride, coalesce(g[CAST(floor(len(g) / 2) AS INT) + 1], frame_stride)) AS BIGINT) AS stride FROM fx_runs r LEFT JOIN ck_gaps USING (run_id)",
    "ck_held": """SELECT run_id, unnest(generate_series(keyframe, least(coalesce(nxt, keyframe + stride), keyframe + stride) - 1)) AS frame_idx, keyframe, n_inst
 FROM (SELECT f.run_id, frame_idx AS keyframe, n_inst, stride, lead(frame_idx) OVER (PARTITION BY f.run_id ORDER BY frame_idx) AS nxt FROM fx_frames f JOIN ck_stride USING (run_id)) t""",
    "ck_tracklets": """SELECT run_id, object_id, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame, count(*) AS n_frames, arg_min(inst_idx, frame_idx * 100 + inst_idx) AS first_inst_idx,
 arg_min(x0, frame_idx * 100 + inst_idx) AS fx0, arg_min(y0, frame_idx * 100 + inst_idx) AS fy0, arg_min(x1, frame_idx * 100 + inst_idx) AS fx1, arg_min(y1, frame_idx * 100 + inst_idx) AS fy1,
 arg_max(x0, frame_idx * 100 + inst_idx) AS lx0, arg_max(y0, frame_idx * 100 + inst_idx) AS ly0, arg_max(x1, frame_idx * 100 + inst_idx) AS lx1, arg_max(y1, frame_idx * 100 + inst_idx) AS ly1
 FROM fx_instances WHERE object_id > 0 GROUP BY 1, 2""",
    "ck_vectors": "SELECT t.*, v.embedding AS e, sqrt(list_dot_product(v.embedding, v.embedding)) AS norm FROM ck_tracklets t JOIN fx_tracklet_vectors v USING (run_id, object_id)",
    "ck_links": """SELECT a.run_id, a.object_id AS id_a, b.object_id AS id_b, b.start_frame - a.end_frame - 1 AS gap, list_dot_product(a.e, b.e) / (a.norm * b.norm) AS similarity,
 least(1, sqrt(((a.lx0 + a.lx1) / 2 - (b.fx0 + b.fx1) / 2) ** 2 + ((a.ly0 + a.ly1) / 2 - (b.fy0 + b.fy1) / 2) ** 2)
  / greatest(1, 0.5 * (sqrt((a.lx1 - a.lx0) ** 2 + (a.ly1 - a.ly0) ** 2) + sqrt((b.fx1 - b.fx0) ** 2 + (b.fy1 - b.fy0) ** 2)))) AS apart
 FROM ck_vectors a JOIN ck_vectors b ON a.run_id = b.run_id AND a.object_id <> b.object_id AND a.end_frame < b.start_frame""",
    "ck_edges": """SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, start_a, start_b, id_a, id_b) AS n FROM
 (SELECT l.*, similarity - apart * 0.15 - gap / 300.0 * 0.10 AS score, a.start_frame AS start_a, b.start_frame AS start_b FROM ck_links l
  JOIN ck_tracklets a ON a.run_id = l.run_id AND a.object_id = id_a JOIN ck_tracklets b ON b.run_id = l.run_id AND b.object_id = id_b WHERE similarity >= 0.65 AND gap <= 300) t""",
    # members with their cluster c, the least id in it; an edge at a time
    "ck_merging": """SELECT run_id, CAST(0 AS BIGINT) AS n, list({'o': object_id, 's': start_frame, 'e': end_frame, 'c': object_id} ORDER BY object_id) AS m FROM ck_tracklets GROUP BY run_id
 UNION ALL SELECT run_id, n, CASE WHEN ca = cb OR len(list_filter(m, lambda x: x.c = ca AND len(list_filter(m, lambda y: y.c = cb AND x.s <= y.e AND y.s <= x.e)) > 0)) > 0 THEN m
  ELSE list_transform(m, lambda x: {'o': x.o, 's': x.s, 'e': x.e, 'c': CASE WHEN x.c = ca OR x.c = cb THEN least(ca, cb) ELSE x.c END}) END
 FROM (SELECT g.run_id, e.n, g.m, list_filter(g.m, lambda x: x.o = e.id_a)[1].c AS ca, list_filter(g.m, lambda x: x.o = e.id_b)[1].c AS cb FROM ck_merging g JOIN ck_edges e ON e.run_id = g.run_id AND e.n = g.n + 1) t""",
    "ck_final": """SELECT run_id, x.o AS object_id, x.c AS final_id FROM (SELECT run_id, unnest(arg_max(m, n)) AS x FROM ck_merging GROUP BY run_id) t""",
    "ck_remapped": "SELECT i.*, coalesce(f.final_id, i.object_id) AS new_id FROM fx_instances i LEFT JOIN ck_final f USING (run_id, object_id)",
    # one-to-one matches: the pairs of a frame in order, what they take so far
    "ck_match": f"""SELECT *, row_number() OVER (PARTITION BY run_id, frame_idx ORDER BY iou DESC, det_idx, seg_idx) AS n FROM (SELECT d.run_id, d.frame_idx, d.det_idx, s.seg_idx, {iou_sql("d.", "s.")} AS iou
 FROM fx_detections d JOIN fx_segments s ON d.run_id = s.run_id AND d.frame_idx = s.frame_idx AND lower(d.label) = lower(s.label)) t WHERE iou >= 0.45""",
    "ck_taking": """SELECT run_id, frame_idx, CAST(0 AS BIGINT) AS n, CAST([] AS INT[]) AS dets, CAST([] AS INT[]) AS segs FROM (SELECT DISTINCT run_id, frame_idx FROM ck_match) f
 UNION ALL SELECT p.run_id, p.frame_idx, p.n, CASE WHEN list_contains(dets, p.det_idx) OR list_contains(segs, p.seg_idx) THEN dets ELSE list_append(dets, CAST(p.det_idx AS INT)) END,
  CASE WHEN list_contains(dets, p.det_idx) OR list_contains(segs, p.seg_idx) THEN segs ELSE list_append(segs, CAST(p.seg_idx AS INT)) END
 FROM ck_taking t JOIN ck_match p ON p.run_id = t.run_id AND p.frame_idx = t.frame_idx AND p.n = t.n + 1""",
    "ck_taken": """SELECT run_id, frame_idx, unnest(arg_max(dets, n)) AS det_idx, unnest(arg_max(segs, n)) AS seg_idx FROM ck_taking GROUP BY 1, 2""",
    # greedy suppression: the boxes of a frame in order, what is kept so far
    "ck_boxes": "SELECT *, row_number() OVER (PARTITION BY run_id, frame_idx ORDER BY conf DESC, det_idx) AS n FROM fx_detections",
    "ck_keeping": f"""SELECT run_id, frame_idx, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(d INT, l VARCHAR, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) AS kept FROM (SELECT DISTINCT run_id, frame_idx FROM fx_detections) f
 UNION ALL SELECT b.run_id, b.frame_idx, b.n, CASE WHEN len(list_filter(kept, lambda k: k.l = lower(b.label) AND ({iou_sql("k.", "b.")}) >= 0.55)) > 0 THEN kept
  ELSE list_append(kept, {{'d': CAST(b.det_idx AS INT), 'l': lower(b.label), 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}}) END FROM ck_keeping t JOIN ck_boxes b ON b.run_id = t.run_id AND b.frame_idx = t.frame_idx AND b.n = t.n + 1""",
    # a gallery: the observations of an identity in order, its vector so far
    "ck_seen": """SELECT run_id, object_id, frame_idx, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u, row_number() OVER (PARTITION BY run_id, object_id ORDER BY frame_idx) AS n
 FROM (SELECT run_id, object_id, frame_idx, CAST(embedding AS DOUBLE[]) AS v FROM fx_observations) t""",
    "ck_gallery": """SELECT run_id, object_id, n, u AS v, frame_idx AS last_frame, CAST(1 AS BIGINT) AS n_updates FROM ck_seen WHERE n = 1
 UNION ALL SELECT run_id, object_id, n, CASE WHEN near THEN list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) ELSE v END, frame_idx, n_updates + CASE WHEN near THEN 1 ELSE 0 END
 FROM (SELECT s.run_id, s.object_id, s.n, s.frame_idx, g.v, g.n_updates, list_dot_product(g.v, s.u) >= 0.45 AS near, list_transform(list_zip(g.v, s.u), lambda z: 0.65 * z[1] + 0.35 * z[2]) AS w
  FROM ck_gallery g JOIN ck_seen s ON s.run_id = g.run_id AND s.object_id = g.object_id AND s.n = g.n + 1) t""",
    # the motion tracker: tracks (id, box, misses) in the order of their creation, frame after frame
    "ck_steps": """SELECT f.run_id, f.frame_idx, row_number() OVER (PARTITION BY f.run_id ORDER BY f.frame_idx) AS n, coalesce(d.rows, []) AS rows FROM fx_frames f
 LEFT JOIN (SELECT run_id, frame_idx, list({'d': CAST(det_idx AS INT), 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1} ORDER BY det_idx) AS rows FROM fx_detections GROUP BY 1, 2) d USING (run_id, frame_idx)""",
    "ck_tracking": f"""SELECT run_id, CAST(-1 AS BIGINT) AS frame_idx, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(i BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, m BIGINT)[]) AS live, CAST(1 AS BIGINT) AS next_id, CAST([] AS STRUCT(d INT, i BIGINT)[]) AS out FROM (SELECT DISTINCT run_id FROM fx_frames) r
 UNION ALL SELECT run_id, frame_idx, n, list_filter(list_concat(list_transform(live, lambda t: CASE WHEN list_position(hit_t, t.i) > 0
   THEN {{'i': t.i, 'x0': rows[hit_d[list_position(hit_t, t.i)]].x0, 'y0': rows[hit_d[list_position(hit_t, t.i)]].y0, 'x1': rows[hit_d[list_position(hit_t, t.i)]].x1, 'y1': rows[hit_d[list_position(hit_t, t.i)]].y1, 'm': CAST(0 AS BIGINT)}}
   ELSE {{'i': t.i, 'x0': t.x0, 'y0': t.y0, 'x1': t.x1, 'y1': t.y1, 'm': t.m + 1}} END), list_transform(fresh, lambda k: {{'i': next_id + list_position(fresh, k) - 1, 'x0': rows[k].x0, 'y0': rows[k].y0, 'x1': rows[k].x1, 'y1': rows[k].y1, 'm': CAST(0 AS BIGINT)}})), lambda t: t.m <= 30),
  next_id + len(fresh), list_transform(range(1, len(rows) + 1), lambda k: {{'d': rows[k].d, 'i': CASE WHEN list_position(hit_d, k) > 0 THEN hit_t[list_position(hit_d, k)] ELSE next_id + list_position(fresh, k) - 1 END}})
 FROM (SELECT *, list_filter(range(1, len(rows) + 1), lambda k: coalesce(list_position(hit_d, k), 0) = 0) AS fresh FROM (SELECT *, list_transform(hits, lambda h: h.t) AS hit_t, list_transform(hits, lambda h: h.d) AS hit_d FROM (
  SELECT run_id, frame_idx, n, live, next_id, rows, list_reduce(list_transform(list_sort(pairs), lambda p: {{'o': p.o, 'k': p.k, 't': p.t, 'd': p.d}}), lambda acc, p: CASE WHEN len(list_filter(acc, lambda a: a.t = p.t OR a.d = p.d)) > 0 THEN acc ELSE list_append(acc, p) END,
    CAST([] AS STRUCT(o DOUBLE, k BIGINT, t BIGINT, d BIGINT)[])) AS hits FROM (
   SELECT s.run_id, s.frame_idx, s.n, g.live, g.next_id, s.rows, list_filter(flatten(list_transform(range(1, len(g.live) + 1), lambda k: list_transform(range(1, len(s.rows) + 1), lambda j: {{'o': -({iou_sql("g.live[k].", "s.rows[j].")}), 'k': k, 't': g.live[k].i, 'd': j}}))), lambda p: p.o <= -0.3) AS pairs
   FROM ck_tracking g JOIN ck_steps s ON s.run_id = g.run_id AND s.n = g.n + 1) a) b) c) e""",
    "ck_emitting": """SELECT job_id, CAST(0 AS BIGINT) AS tick, CAST(NULL AS BIGINT) AS last, CAST(NULL AS DOUBLE) AS last_ts, FALSE AS emitted FROM (SELECT DISTINCT job_id FROM fx_ticks) j
 UNION ALL SELECT job_id, tick, CASE WHEN e THEN current ELSE last END, CASE WHEN e THEN ts ELSE last_ts END, e FROM
 (SELECT k.job_id, k.tick, k.current, k.ts, m.last, m.last_ts, m.last IS NULL OR k.current >= k.total OR k.current - m.last >= 8 OR k.ts - m.last_ts >= 0.5 AS e FROM ck_emitting m JOIN fx_ticks k ON k.job_id = m.job_id AND k.tick = m.tick + 1) t""",
    "ck_labels": """SELECT run_id, frame_idx, det_idx AS inst_idx, CASE WHEN conf < 0.2 THEN 'Worker person ' WHEN conf < 0.3 THEN 'fork' WHEN conf < 0.5 THEN 'Helmet' WHEN conf < 0.6 THEN 'vest' WHEN conf < 0.65 THEN '  ' WHEN conf < 0.7 THEN NULL ELSE label END AS label FROM fx_detections""",
    "ck_terms": "SELECT * FROM (VALUES ('person', 1), ('forklift', 2), ('on', 4)) t(term, term_id)",
    "ck_resolved": """SELECT *, min(inst_idx) OVER (PARTITION BY run_id, frame_idx, l) AS first_idx FROM (SELECT i.*, lower(trim(label)) AS l, (SELECT arg_min(term_id, (CASE WHEN term = lower(trim(i.label)) THEN 0 ELSE 1000 END) + term_id)
 FROM ck_terms WHERE trim(i.label) <> '' AND (contains(term, lower(trim(i.label))) OR contains(lower(trim(i.label)), term))) AS found FROM ck_labels i) t""",
    "ck_spans": """SELECT mask_id, min(p % 8) AS x, max(p % 8) AS xb, min(CAST(floor(p / 8) AS INT)) AS y, max(CAST(floor(p / 8) AS INT)) AS yb, count(*) AS n FROM
 (SELECT mask_id, p FROM fx_pixels WHERE v = 1) t GROUP BY 1""",
    "ck_segs": r"SELECT prompt_id, prompt, list_filter(list_transform(string_split(trim(translate(prompt, chr(10) || ';', ' .')), '.'), lambda s: trim(s)), lambda s: s <> '') AS parts, CASE WHEN len(parts) = 0 AND trim(prompt) <> '' THEN [trim(prompt)] ELSE parts END AS segs FROM fx_prompts",
    "ck_masks": "SELECT mask_id, 8 AS height, 8 AS width, CASE WHEN first(v0) = 1 THEN list_prepend(0, list(n ORDER BY run)) ELSE list(n ORDER BY run) END AS counts FROM ck_runs GROUP BY mask_id",
    "ck_runs": """SELECT mask_id, run, count(*) AS n, max(v0) AS v0 FROM (SELECT mask_id, p, v, v0, sum(c) OVER (PARTITION BY mask_id ORDER BY p) AS run
 FROM (SELECT mask_id, p, v, first_value(v) OVER w AS v0, CASE WHEN v <> lag(v, 1, 0) OVER w THEN 1 ELSE 0 END AS c FROM fx_pixels WINDOW w AS (PARTITION BY mask_id ORDER BY p)) a) b GROUP BY 1, 2""",
    "ck_good": "SELECT * FROM fx_keypoints WHERE conf >= 0.25 AND x >= 0 AND y >= 0 AND x < 1280 AND y < 720",
    "ck_torso": """SELECT run_id, frame_idx, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS byy, count(*) AS n FROM fx_keypoints WHERE id IN (5, 6, 11, 12) AND conf >= 0.25 GROUP BY 1, 2""",
    "ck_torso_box": """SELECT run_id, frame_idx, greatest(300, ax - 0.2 * greatest(8, bx - ax)) AS x0, greatest(100, ay - 0.2 * greatest(8, byy - ay)) AS y0,
 least(980, bx + 0.2 * greatest(8, bx - ax)) AS x1, least(620, byy + 0.2 * greatest(8, byy - ay)) AS y1 FROM ck_torso WHERE n >= 3""",
    "ck_torso_ok": "SELECT * FROM ck_torso_box WHERE x1 - x0 >= 8 AND y1 - y0 >= 8",
    "ck_chosen": """SELECT k.run_id, k.frame_idx, CASE WHEN t.run_id IS NOT NULL AND greatest(1, (x1 - x0) * (y1 - y0)) >= 0.12 * 680 * 520 AND y1 - y0 >= 36 THEN 1 ELSE 0 END AS torso
 FROM (SELECT DISTINCT run_id, frame_idx FROM fx_keypoints) k LEFT JOIN ck_torso_ok t USING (run_id, frame_idx)""",
    "ck_padded": """SELECT run_id, frame_idx, det_idx, x0, y0, x1, y1, CAST(trunc(greatest(0, x0 - 0.05 * (x1 - x0))) AS INT) AS xa, CAST(trunc(greatest(0, y0 - 0.05 * (y1 - y0))) AS INT) AS ya,
 CAST(trunc(least(1279, x1 + 0.05 * (x1 - x0))) AS INT) AS xb, CAST(trunc(least(719, y1 + 0.05 * (y1 - y0))) AS INT) AS yb FROM fx_detections""",
}
DUCK_VIEWS["ck_steps_gaps"] = DUCK_VIEWS["ck_steps"].replace("FROM fx_detections", "FROM fx_detections WHERE frame_idx % 400 < 200")
DUCK_VIEWS["ck_tracking_gaps"] = DUCK_VIEWS["ck_tracking"].replace("ck_tracking", "ck_tracking_gaps").replace("ck_steps", "ck_steps_gaps")


def smooth(fx: Fixtures) -> DataFrame:
    return flagship.judged(fx.instances, fx.accessories)


def raw(fx: Fixtures) -> DataFrame:
    return V.verdicts(fx.instances, fx.accessories, flagship.MIN_PX, flagship.MIN_IOU, flagship.MIN_CONF)


def tracklets(fx: Fixtures) -> DataFrame:
    return L.build_tracklets(fx.instances).join(fx.tracklet_vectors, ["run_id", "object_id"])


def candidates(fx: Fixtures) -> DataFrame:
    return L.link_candidates(tracklets(fx), max_gap=MAX_GAP, min_sim=0.65)


#: Frames between tracklets that are linked, at most.
MAX_GAP = 300


HEAD = ["hx0", "hy0", "hx1", "hy1", "best_intersection_px", "best_iou"]
ROUND_HEAD = ", ".join(f"round({c}, 6) AS {c}" for c in HEAD)
KEYS = "run_id, frame_idx"

# --- verdicts, violators, reports ---
register("violators_flagship", "SELECT c.run_id, c.object_id, violations, presence, round(first_violation / 25.0, 6) AS first_violation_sec FROM ck_counts c JOIN ck_report r USING (run_id, object_id) WHERE violations >= 3")(
    lambda fx: flagship.violators(fx.instances, fx.accessories, fx.runs)
)
register("verdicts", f"SELECT {KEYS}, inst_idx, object_id, ok, warning, {ROUND_HEAD} FROM ck_raw")(lambda fx: r6(raw(fx), *HEAD))
register("smooth_verdicts", f"SELECT {KEYS}, inst_idx, object_id, ok, warning, {ROUND_HEAD} FROM ck_smooth")(lambda fx: r6(smooth(fx), *HEAD))
register("violation_counts", "SELECT run_id, object_id, violations FROM ck_counts")(lambda fx: R.violation_counts(smooth(fx)))
register("presence_counts", "SELECT run_id, object_id, count(*) AS presence FROM fx_instances GROUP BY 1, 2")(lambda fx: R.presence_counts(smooth(fx)))
register("stable_ids", "SELECT DISTINCT run_id, object_id FROM fx_instances")(lambda fx: R.stable_ids(fx.instances))
register("violator_ids", "SELECT run_id, object_id FROM ck_counts")(lambda fx: R.violator_ids(smooth(fx)))
register("qualified_violators", "SELECT *, greatest(CAST(3 AS BIGINT), CAST(trunc(m * 0.5) AS BIGINT)) AS threshold FROM (SELECT * FROM (SELECT *, max(violations) OVER (PARTITION BY run_id) AS m FROM ck_counts) t) u WHERE violations >= greatest(3, trunc(m * 0.5)) AND violations / presence >= 0.1".replace("SELECT *, greatest", "SELECT run_id, object_id, violations, presence, greatest", 1))(
    lambda fx: R.qualified_violators(smooth(fx), 3, 0.1, 0.5)
)
register("report_violators", "SELECT run_id, object_id, violations, presence, CASE WHEN m >= 8 THEN 8 ELSE 0 END AS threshold FROM (SELECT *, max(violations) OVER (PARTITION BY run_id) AS m FROM ck_counts) t WHERE m < 8 OR violations >= 8")(
    lambda fx: R.report_violators(smooth(fx), 8)
)
register("order_violators", "SELECT run_id, object_id, violations, row_number() OVER (PARTITION BY run_id ORDER BY violations DESC, object_id) AS place FROM ck_counts")(lambda fx: R.order_violators(smooth(fx)))
register("diagnose", """SELECT f.run_id, count(*) AS frames, count(*) FILTER (n_inst > 0) AS frames_with_people, count(*) FILTER (coalesce(n, 0) > 0) AS frames_with_verdicts,
 count(*) FILTER (n_inst > 0 AND coalesce(n, 0) = 0) AS people_no_verdicts, CAST(coalesce(sum(n_ok), 0) AS BIGINT) AS ok_count, CAST(coalesce(sum(n - n_ok), 0) AS BIGINT) AS fail_count
 FROM fx_frames f LEFT JOIN (SELECT run_id, frame_idx, count(*) AS n, count(*) FILTER (ok) AS n_ok FROM ck_smooth GROUP BY 1, 2) v USING (run_id, frame_idx) GROUP BY 1""")(lambda fx: V.diagnose(fx.frames, smooth(fx)))
register("violations_total", "SELECT run_id, count(*) FILTER (NOT ok) AS violations FROM ck_smooth GROUP BY 1")(lambda fx: V.violations_total(smooth(fx)))
register("report_frame", "SELECT * FROM ck_report")(lambda fx: R.report_frame(smooth(fx)))
register("seek_seconds", "SELECT run_id, object_id, round(greatest(0, report_frame / 25.0 - 1), 6) AS seek_sec FROM ck_report")(lambda fx: r6(R.seek_seconds(smooth(fx), fx.runs), "seek_sec"))
register("person_rows", "SELECT * FROM ck_slots WHERE object_id = 3")(lambda fx: R.person_rows(smooth(fx), 3).drop("inst_idx"))
register("violator_rows", "SELECT * FROM ck_slots WHERE object_id = 3 AND NOT ok")(lambda fx: R.violator_rows(smooth(fx), 3).drop("inst_idx"))
register("presence_frames", "SELECT DISTINCT run_id, object_id, frame_idx FROM fx_instances")(lambda fx: R.presence_frames(fx.instances))
register("violation_frames", "SELECT run_id, object_id, frame_idx FROM ck_slots WHERE NOT ok")(lambda fx: R.violation_frames(smooth(fx)))
register("clip_plan", """SELECT run_id, object_id, CASE WHEN violations >= 3 THEN 'INCLUDE' ELSE 'SKIP' END AS decision, CASE WHEN violations >= 3 THEN presence_frames ELSE 0 END AS clip_frames, violation_frames,
 concat(run_id, '_id', object_id, '.mp4') AS output_name FROM ck_counts JOIN ck_report USING (run_id, object_id)""")(lambda fx: R.clip_plan(smooth(fx)))
register("clip_sequence", "SELECT run_id, object_id, frame_idx, CAST(row_number() OVER (PARTITION BY run_id, object_id ORDER BY frame_idx) - 1 AS INT) AS out_idx FROM ck_slots JOIN (SELECT run_id, object_id FROM ck_counts WHERE violations >= 3) q USING (run_id, object_id)")(
    lambda fx: (lambda v: R.clip_sequence(v, R.qualified_violators(v)))(smooth(fx))
)
register("scene_counters", """SELECT f.run_id, f.frame_idx, coalesce(people, 0) AS people, coalesce(helmets, 0) AS helmets, coalesce(no_helmet, 0) AS no_helmet, coalesce(with_keypoints, 0) AS with_keypoints FROM fx_frames f
 LEFT JOIN (SELECT run_id, frame_idx, count(DISTINCT id < 9) AS with_keypoints FROM fx_keypoints GROUP BY 1, 2) k USING (run_id, frame_idx)
 LEFT JOIN (SELECT run_id, frame_idx, count(*) AS people, count(*) FILTER (NOT ok) AS no_helmet FROM ck_smooth GROUP BY 1, 2) p USING (run_id, frame_idx)
 LEFT JOIN (SELECT run_id, frame_idx, count(*) AS helmets FROM fx_accessories GROUP BY 1, 2) h USING (run_id, frame_idx)""")(lambda fx: R.scene_counters(fx.frames, smooth(fx), fx.accessories, fx.keypoints.withColumn("inst_idx", (F.col("id") < 9).cast("int"))))
register("incident_rows", """SELECT run_id, object_id, 'Site' AS organization, 'Acme' AS company, '1 мая 2024 г., 10:30' AS incident_text, concat('№ ', object_id) AS violator, CASE WHEN object_id % 2 = 0 THEN 77 ELSE presence_frames END AS presence_frames, violation_frames, report_frame, concat(run_id, '.mp4') AS source_name
 FROM ck_report JOIN ck_counts USING (run_id, object_id) WHERE violations >= 3""")(
    lambda fx: R.incident_rows(smooth(fx), fx.runs, "Site", "Acme", counts=R.stable_ids(fx.instances).where("object_id % 2 = 0").selectExpr("run_id", "object_id", "77L AS presence_frames", "CAST(NULL AS BIGINT) AS violation_frames"))
)
register("overlay_timeline", "SELECT run_id, frame_idx, round(frame_idx / 25.0, 6) AS t0, round(coalesce(lead(frame_idx) OVER (PARTITION BY run_id ORDER BY frame_idx) / 25.0, frame_idx / 25.0 + 0.04), 6) AS t1 FROM fx_frames")(
    lambda fx: r6(R.overlay_timeline(fx.frames, fx.runs), "t0", "t1")
)
register("overlay_timeline_window", """SELECT run_id, frame_idx, round(t, 6) AS t0, round(coalesce(lead(t) OVER (PARTITION BY run_id ORDER BY frame_idx), greatest(t + 0.04, least(9, t + 2))), 6) AS t1 FROM
 (SELECT *, lead(t) OVER (PARTITION BY run_id ORDER BY frame_idx) AS nt FROM (SELECT run_id, frame_idx, frame_idx / 25.0 AS t FROM fx_frames) a WHERE t <= 9.05) b WHERE t >= 4.95 OR nt >= 4.95""")(
    lambda fx: r6(R.overlay_timeline(fx.frames, fx.runs, 5.0, 9.0), "t0", "t1")
)
register("player_boxes", """SELECT run_id, frame_idx, inst_idx AS n, object_id AS id, CAST(round_even(x0 * 0.5, 0) AS INT) AS x0, CAST(round_even(y0 * 0.5, 0) AS INT) AS y0, CAST(round_even(x1 * 0.5, 0) AS INT) AS x1, CAST(round_even(y1 * 0.5, 0) AS INT) AS y1,
 CASE WHEN ok THEN 0 ELSE 1 END AS v, 'p' AS kind FROM fx_instances JOIN (SELECT run_id, frame_idx, inst_idx, ok FROM ck_smooth) s USING (run_id, frame_idx, inst_idx)
 UNION ALL SELECT run_id, frame_idx, acc_idx, 0, CAST(round_even(x0 * 0.5, 0) AS INT), CAST(round_even(y0 * 0.5, 0) AS INT), CAST(round_even(x1 * 0.5, 0) AS INT), CAST(round_even(y1 * 0.5, 0) AS INT), 0, 'h' FROM fx_accessories""")(
    lambda fx: R.player_boxes(fx.instances.join(smooth(fx).select("run_id", "frame_idx", "inst_idx", "ok"), ["run_id", "frame_idx", "inst_idx"]), fx.accessories, 640, 360, fx.runs)
)
register("estimate_stride", "SELECT * FROM ck_stride")(lambda fx: R.estimate_stride(fx.frames, fx.runs))
register("hold_forward", "SELECT run_id, frame_idx, keyframe, CAST(n_inst AS BIGINT) AS n_inst FROM ck_held")(lambda fx: R.hold_forward(fx.frames, fx.runs))
register("hold_forward_full", "SELECT s.run_id, s.frame_idx, h.keyframe FROM (SELECT run_id, unnest(generate_series(0, source_frames - 1)) AS frame_idx FROM ck_source WHERE source_frames > 0) s LEFT JOIN (SELECT * FROM ck_held WHERE n_inst > 0) h USING (run_id, frame_idx)")(
    lambda fx: R.hold_forward_full(fx.frames, fx.runs)
)
register("source_frames", "SELECT run_id, source_frames FROM ck_source")(lambda fx: R.source_frames(fx.frames, fx.runs))

# --- geometry ---
register("box_iou", f"SELECT a.run_id, a.frame_idx, a.inst_idx, b.acc_idx, {area_sql('a.', 'b.')} AS area, round({iou_sql('a.', 'b.')}, 6) AS iou FROM fx_instances a JOIN fx_accessories b USING (run_id, frame_idx)")(
    lambda fx: fx.instances.join(fx.accessories.select("run_id", "frame_idx", "acc_idx", *[F.col(c).alias(f"b{c}") for c in G.Box._fields]), D.FRAME).select("run_id", "frame_idx", "inst_idx", "acc_idx", G.box_inter_area(G.box(), G.box("b")).alias("area"), F.round(G.box_iou(G.box(), G.box("b")), 6).alias("iou"))
)
register("upper_band", "SELECT run_id, frame_idx, inst_idx, round(greatest(0, least(x0 + (x1 - x0) * 0.15, 1279)), 6) AS bx0, round(greatest(0, least(y0, 719)), 6) AS by0, round(greatest(0, least(x1 - (x1 - x0) * 0.15, 1279)), 6) AS bx1, round(greatest(0, least(y0 + (y1 - y0) * 0.35, 719)), 6) AS by1 FROM fx_instances")(
    lambda fx: fx.instances.select("run_id", "frame_idx", "inst_idx", *[F.round(c, 6).alias(f"b{n}") for n, c in zip(G.Box._fields, G.upper_band(G.box(), F.lit(1280.0), F.lit(720.0)), strict=True)])
)
RECT = "CAST(greatest(0, least(floor(x0), 1279)) AS INT) AS xa, CAST(greatest(0, least(ceil(x1), 1279)) AS INT) AS xb, CAST(greatest(0, least(floor(y0), 719)) AS INT) AS ya, CAST(greatest(0, least(ceil(y1), 719)) AS INT) AS yb"
register("rect_mask_geometry", f"""SELECT run_id, frame_idx, inst_idx, xa AS bbox_x, ya AS bbox_y, xb - xa + 1 AS bbox_w, yb - ya + 1 AS bbox_h, CAST(xb - xa + 1 AS BIGINT) * (yb - ya + 1) AS area_px,
 CAST(xa + floor((xb - xa + 1) / 2) AS INT) AS cx, CAST(ya + floor((yb - ya + 1) / 2) AS INT) AS cy FROM (SELECT run_id, frame_idx, inst_idx, {RECT} FROM fx_instances) t WHERE xb > xa AND yb > ya""")(
    lambda fx: fx.instances.select("run_id", "frame_idx", "inst_idx", *[c.alias(n) for n, c in G.rect_mask_geometry(G.box(), F.lit(1280), F.lit(720)).items()]).where("area_px is not null")
)
register("crop_rect", "SELECT run_id, frame_idx, det_idx, xa, ya, xb, yb FROM ck_padded WHERE xb > xa AND yb > ya")(
    lambda fx: fx.detections.withColumn("r", G.crop_rect(G.box(), F.lit(1280.0), F.lit(720.0))).where("r is not null").select("run_id", "frame_idx", "det_idx", F.col("r.x0").alias("xa"), F.col("r.y0").alias("ya"), F.col("r.x1").alias("xb"), F.col("r.y1").alias("yb"))
)
register("crop_ok", """SELECT run_id, frame_idx, det_idx, xb > xa AND yb > ya AND yb - ya >= 48 AND xb - xa >= 24 AND (yb - ya) / greatest(1.0, xb - xa) BETWEEN 0.35 AND 5 AND NOT (x0 <= 2 OR y0 <= 2 OR x1 >= 1277 OR y1 >= 717) AS good FROM ck_padded""")(
    lambda fx: fx.detections.withColumn("r", G.crop_rect(G.box(), F.lit(1280.0), F.lit(720.0))).select("run_id", "frame_idx", "det_idx", G.crop_ok(F.col("r"), G.box(), F.lit(1280.0), F.lit(720.0), True).alias("good"))
)
register("scale_geometry", "SELECT run_id, frame_idx, inst_idx, " + ", ".join(f"CAST(round_even({c} * CAST({s} AS DOUBLE), 0) AS INT) AS {c}" for c, s in (("x0", 1.5), ("y0", 1.5), ("x1", 1.5), ("y1", 1.5))) + " FROM fx_instances")(
    lambda fx: fx.instances.select("run_id", "frame_idx", "inst_idx", *[G.scale_round(F.col(c), F.lit(1.5)).alias(c) for c in G.Box._fields])
)
def person() -> G.Box:
    return G.Box(*(F.lit(v) for v in (300.0, 100.0, 980.0, 620.0)))


def torso(fx: Fixtures) -> DataFrame:
    points = fx.keypoints.groupBy("run_id", "frame_idx").agg(F.collect_list(F.struct("id", "x", "y", "conf")).alias("p"))
    return points.withColumn("t", G.torso_box(F.col("p"), person()))


register("torso_box", "SELECT run_id, frame_idx, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1 FROM ck_torso_ok")(lambda fx: r6(torso(fx).where("t is not null").select("run_id", "frame_idx", "t.*"), *G.Box._fields))
register("choose_crop", "SELECT * FROM ck_chosen")(lambda fx: torso(fx).withColumn("c", G.choose_crop(F.col("t"), person())).select("run_id", "frame_idx", F.when(F.col("c.x0") != 300.0, 1).when((F.col("c.x1") != 980.0) | (F.col("c.y0") != 100.0), 1).otherwise(0).alias("torso")))
register("encode_runs", "SELECT mask_id, array_to_string(counts, ',') AS counts FROM ck_masks")(lambda fx: M.encode_runs(fx.pixels).select("mask_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts")))
# a run over the end of a row spans the full width
register("mask_geometry", """SELECT m.mask_id, coalesce(n, 0) AS area_px, CAST(CASE WHEN wraps THEN 0 ELSE x END AS INT) AS bbox_x, y AS bbox_y, CAST(CASE WHEN wraps THEN 8 ELSE xb - x + 1 END AS INT) AS bbox_w, yb - y + 1 AS bbox_h,
 CAST(CASE WHEN wraps THEN 4 ELSE x + floor((xb - x + 1) / 2) END AS INT) AS cx, CAST(y + floor((yb - y + 1) / 2) AS INT) AS cy
 FROM (SELECT mask_id, bool_or(v = 1 AND w = 1 AND p % 8 = 0 AND p > 0) AS wraps FROM (SELECT mask_id, p, v, lag(v, 1, 0) OVER (PARTITION BY mask_id ORDER BY p) AS w FROM fx_pixels) t GROUP BY 1) m LEFT JOIN ck_spans USING (mask_id)""")(
    lambda fx: M.mask_geometry(M.encode_runs(fx.pixels).withColumns({"height": F.lit(8), "width": F.lit(8)}))
)
register("keypoints_long", "SELECT run_id, frame_idx, id, round(x, 2) AS x, round(y, 2) AS y, round(conf, 4) AS conf FROM fx_keypoints WHERE conf >= 0.25")(lambda fx: M.keypoints_long(fx.keypoints, 0.25).drop("name"))
EDGES = ", ".join(f"({a}, {b})" for a, b in M.SKELETON)
register("skeleton_edges", f"SELECT p.run_id, p.frame_idx, e.a, e.b, round(p.x, 6) AS x_a, round(p.y, 6) AS y_a, round(q.x, 6) AS x_b, round(q.y, 6) AS y_b FROM (VALUES {EDGES}) e(a, b) JOIN ck_good p ON p.id = e.a JOIN ck_good q ON q.id = e.b AND q.run_id = p.run_id AND q.frame_idx = p.frame_idx")(
    lambda fx: r6(M.skeleton_edges(fx.keypoints, 1280, 720), "x_a", "y_a", "x_b", "y_b")
)

# --- detections ---
register("label_match", "SELECT run_id, frame_idx, det_idx FROM fx_detections WHERE lower(label) IN ('person', 'hard-hat')")(lambda fx: D.match_labels(fx.detections, F.array(F.lit("person"), F.lit("hard-hat"))).select("run_id", "frame_idx", "det_idx"))
register("min_conf", "SELECT run_id, frame_idx, acc_idx, conf FROM fx_accessories WHERE conf >= 0.30")(lambda fx: D.min_conf(fx.accessories, 0.30).select("run_id", "frame_idx", "acc_idx", "conf"))
register("fallback_ids", "SELECT run_id, frame_idx, det_idx, CAST(CASE WHEN motion_id >= 0 THEN motion_id ELSE det_idx + 1 END AS BIGINT) AS object_id FROM fx_detections")(lambda fx: D.fallback_ids(fx.detections).select("run_id", "frame_idx", "det_idx", "object_id"))
register("merge_fallback", f"""SELECT run_id, frame_idx, det_idx, CAST(NULL AS INT) AS seg_idx, x0, y0, x1, y1, label, conf, CAST(motion_id AS BIGINT) AS motion_id FROM fx_detections
 UNION ALL SELECT run_id, frame_idx, NULL, seg_idx, x0, y0, x1, y1, label, conf, -1 FROM fx_segments s WHERE NOT EXISTS (SELECT 1 FROM fx_detections d WHERE d.run_id = s.run_id AND d.frame_idx = s.frame_idx AND lower(d.label) = lower(s.label) AND ({iou_sql("s.", "d.")}) >= 0.25)""")(
    lambda fx: D.merge_fallback(fx.detections, fx.segments)
)
register("inherit_motion", f"""SELECT run_id, frame_idx, det_idx, CAST(coalesce(m, motion_id) AS BIGINT) AS motion_id FROM fx_detections LEFT JOIN
 (SELECT a.run_id, a.frame_idx, a.det_idx, arg_max(b.motion_id, ({iou_sql("a.", "b.")}) * 1000 - b.det_idx / 1e6) AS m FROM fx_detections a JOIN fx_detections b USING (run_id, frame_idx)
  WHERE a.motion_id < 0 AND b.motion_id >= 0 AND ({iou_sql("a.", "b.")}) >= 0.25 GROUP BY 1, 2, 3) t USING (run_id, frame_idx, det_idx)""")(lambda fx: D.inherit_motion(fx.detections).select("run_id", "frame_idx", "det_idx", F.col("motion_id").cast("long").alias("motion_id")))
register("dedupe", "SELECT run_id, frame_idx, unnest(list_transform(arg_max(kept, n), lambda k: k.d)) AS det_idx FROM ck_keeping GROUP BY 1, 2")(lambda fx: D.dedupe(fx.detections).select("run_id", "frame_idx", "det_idx"))
register("match_segments", "SELECT run_id, frame_idx, det_idx, t.seg_idx, round(iou, 6) AS iou FROM fx_detections LEFT JOIN ck_taken t USING (run_id, frame_idx, det_idx) LEFT JOIN ck_match m USING (run_id, frame_idx, det_idx, seg_idx)")(
    lambda fx: r6(D.match_segments(fx.detections, fx.segments, 0.45), "iou")
)
register("accessory_filter", "SELECT run_id, frame_idx, acc_idx, label, conf FROM fx_accessories WHERE lower(label) = 'helmet' AND conf >= 0.30 AND acc_idx % 2 = 0")(
    lambda fx: D.accessory_filter(fx.accessories.withColumn("label", F.when(F.col("acc_idx") % 2 == 0, F.col("label")).otherwise("vest")), F.array(F.lit("Helmet ")), 0.30).select("run_id", "frame_idx", "acc_idx", "label", "conf")
)
register("attach_embeddings", "SELECT run_id, frame_idx, det_idx, round(coalesce(CAST(embedding[1] AS DOUBLE), 0), 6) AS first, round(coalesce(CAST(embedding[64] AS DOUBLE), 0), 6) AS last, round(coalesce(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)), 0), 6) AS squares, CAST(64 AS INT) AS width FROM fx_detections LEFT JOIN (SELECT run_id, frame_idx, CAST(0 AS INT) AS det_idx, embedding FROM fx_observations) o USING (run_id, frame_idx, det_idx)")(
    lambda fx: D.attach_embeddings(fx.detections, fx.observations.select("run_id", "frame_idx", F.lit(0).alias("det_idx"), F.col("embedding").cast("array<double>").alias("embedding")), 64).select(
        "run_id", "frame_idx", "det_idx", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.col("embedding")[63], 6).alias("last"), F.round(VEC.dot(F.col("embedding"), F.col("embedding")), 6).alias("squares"), F.size("embedding").alias("width")
    )
)
# --- prompts and classes ---
register("prompt_terms", "SELECT prompt_id, array_to_string(list_distinct_ordered, '|') AS terms FROM (SELECT prompt_id, list_transform(list_filter(list_zip(range(len(l)), l), lambda z: list_position(l, z[2]) = z[1] + 1), lambda z: z[2]) AS list_distinct_ordered FROM (SELECT prompt_id, list_transform(segs, lambda s: lower(s)) AS l FROM ck_segs) a) b")(
    lambda fx: fx.prompts.select("prompt_id", F.array_join(T.prompt_terms(F.col("prompt")), "|").alias("terms"))
)
register("prompt_ids", "SELECT prompt_id, term, CAST(min(i) AS INT) AS term_id FROM (SELECT prompt_id, lower(unnest(segs)) AS term, generate_subscripts(segs, 1) AS i FROM ck_segs) t GROUP BY 1, 2")(lambda fx: P.prompt_ids(fx.prompts))
register("label_slug", "SELECT prompt_id, trim(regexp_replace(lower(trim(prompt)), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM fx_prompts")(lambda fx: fx.prompts.select("prompt_id", T.label_slug(F.col("prompt")).alias("slug")))
register("filter_classes", "SELECT class_id, name FROM fx_classes WHERE contains(lower(name), 'widget') OR CAST(class_id AS VARCHAR) = 'widget'")(lambda fx: P.filter_classes(fx.classes, "Widget"))
#: Two catalogs whose ids differ, in the same order; in the second pair two names change places.
register("catalogs_in_sync", """SELECT (SELECT list(name ORDER BY class_id) FROM fx_classes) = (SELECT list(name ORDER BY class_id * 3 + 7) FROM fx_classes) AS same,
 (SELECT list(name ORDER BY class_id) FROM fx_classes) = (SELECT list(name ORDER BY CASE class_id WHEN 3 THEN 12 WHEN 12 THEN 3 ELSE class_id END) FROM fx_classes) AS swapped""")(
    lambda fx: P.catalogs_in_sync(fx.classes, fx.classes.withColumn("class_id", F.col("class_id") * 3 + 7)).withColumnRenamed("in_sync", "same").crossJoin(
        P.catalogs_in_sync(fx.classes, fx.classes.withColumn("class_id", F.expr("CASE class_id WHEN 3 THEN 12 WHEN 12 THEN 3 ELSE class_id END"))).withColumnRenamed("in_sync", "swapped")
    )
)
register("merge_prompt", "SELECT prompt_id, concat(array_to_string(list_transform(list_filter(list_zip(range(len(l)), l), lambda z: list_position(l, z[2]) = z[1] + 1), lambda z: z[2]), '. ')) AS merged FROM (SELECT prompt_id, list_append(list_transform(segs, lambda s: lower(s)), 'helmet') AS l FROM ck_segs) a")(
    lambda fx: fx.prompts.select("prompt_id", T.merge_prompt(F.col("prompt"), F.array(F.lit(" Helmet "))).alias("merged"))
)
register("resolve_prompt_id", """SELECT run_id, frame_idx, inst_idx, label, CAST(CASE WHEN l <> '' THEN coalesce(found, 4 + dense_rank() OVER (PARTITION BY run_id, frame_idx, coalesce(l <> '' AND found IS NULL, FALSE) ORDER BY CASE WHEN found IS NULL THEN first_idx END)) END AS INT) AS prompt_ref FROM ck_resolved""")(
    lambda fx: P.resolve_prompt_id(
        fx.detections.select("run_id", "frame_idx", F.col("det_idx").alias("inst_idx"), F.expr("CASE WHEN conf < 0.2 THEN 'Worker person ' WHEN conf < 0.3 THEN 'fork' WHEN conf < 0.5 THEN 'Helmet' WHEN conf < 0.6 THEN 'vest' WHEN conf < 0.65 THEN '  ' WHEN conf < 0.7 THEN NULL ELSE label END").alias("label")),
        fx.spark.createDataFrame([("person", 1), ("forklift", 2), ("on", 4)], "term string, term_id int"),
    )
)
# --- linking and identity ---
CORNERS = ("x0", "y0", "x1", "y1")
register("build_tracklets", "SELECT run_id, object_id, start_frame, end_frame, n_frames, first_inst_idx, " + ", ".join(f"f{c} AS first_{c}, l{c} AS last_{c}" for c in CORNERS) + " FROM ck_tracklets")(
    lambda fx: L.build_tracklets(fx.instances).select("run_id", "object_id", "start_frame", "end_frame", "n_frames", "first_inst_idx", *[F.col(f"{n}_box.{c}").alias(f"{n}_{c}") for n in ("first", "last") for c in CORNERS])
)
register("mean_embedding", """SELECT run_id, object_id, pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY run_id, object_id)), 5) AS x FROM (SELECT run_id, object_id, pos, avg(x) AS m FROM
 (SELECT run_id, object_id, unnest(generate_series(1, len(e))) AS pos, unnest(list_transform(e, lambda v: v / norm)) AS x FROM (SELECT run_id, object_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM fx_observations) a) b GROUP BY 1, 2, 3) c""")(
    lambda fx: L.mean_embedding(fx.observations, ["run_id", "object_id"]).select("run_id", "object_id", F.posexplode("embedding").alias("pos", "x")).select("run_id", "object_id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 5).alias("x"))
)
register("sample_tracklets", """SELECT run_id, object_id, frame_idx, inst_idx FROM (SELECT run_id, object_id, frame_idx, inst_idx, row_number() OVER (PARTITION BY run_id, object_id ORDER BY frame_idx, inst_idx) - 1 AS i, count(*) OVER (PARTITION BY run_id, object_id) AS n FROM fx_instances WHERE object_id > 0) t
 WHERE n <= 8 OR list_contains(list_transform(range(8), lambda j: CAST(round_even(j * (n - 1) / 7.0, 0) AS BIGINT)), i)""")(lambda fx: L.sample_tracklets(fx.instances, 8))
register("link_candidates", "SELECT run_id, id_a, id_b, gap, round(similarity, 6) AS similarity, round(score, 6) AS score FROM ck_edges")(lambda fx: r6(candidates(fx).select("run_id", "id_a", "id_b", "gap", "similarity", "score"), "similarity", "score"))
register("link_candidates_any_gap", "SELECT run_id, id_a, id_b, gap, round(similarity, 6) AS similarity, round(similarity - apart * 0.15, 6) AS score FROM ck_links WHERE similarity >= 0.65")(
    lambda fx: r6(L.link_candidates(tracklets(fx), max_gap=0, min_sim=0.65).select("run_id", "id_a", "id_b", "gap", "similarity", "score"), "similarity", "score")
)
register("link_tracklets", "SELECT run_id, object_id, final_id, n_frames FROM ck_final JOIN ck_tracklets USING (run_id, object_id)")(lambda fx: L.link_tracklets(tracklets(fx), candidates(fx)))
register("remap_ids", "SELECT run_id, frame_idx, inst_idx, new_id AS object_id, x0, y0, x1, y1, score, label, new_id <> object_id AS changed FROM ck_remapped")(lambda fx: L.remap_ids(fx.instances, L.link_tracklets(tracklets(fx), candidates(fx))))
register("link_summary", "SELECT run_id, count(*) AS tracklets_in, count(DISTINCT final_id) AS ids_out, count(*) - count(DISTINCT final_id) AS merges, any_value(changed) AS remapped_instances FROM ck_final JOIN (SELECT run_id, count(*) FILTER (new_id <> object_id) AS changed FROM ck_remapped GROUP BY 1) c USING (run_id) GROUP BY 1")(
    lambda fx: L.link_summary(L.link_tracklets(tracklets(fx), candidates(fx)))
)
register("changed_ids", "SELECT run_id, object_id, final_id FROM ck_final WHERE final_id <> object_id")(lambda fx: L.changed_ids(L.link_tracklets(tracklets(fx), candidates(fx))).select("run_id", "object_id", "final_id"))
register("gallery_query", """SELECT query_id, object_id, round(sim, 6) AS similarity FROM (SELECT q.query_id, g.object_id, list_dot_product(q.e, g.embedding) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(g.embedding, g.embedding)) AS sim,
 row_number() OVER (PARTITION BY q.query_id ORDER BY list_dot_product(q.e, g.embedding) / sqrt(list_dot_product(g.embedding, g.embedding)) DESC, g.object_id) AS rn
 FROM (SELECT frame_idx AS query_id, run_id, CAST(embedding AS DOUBLE[]) AS e FROM fx_observations) q JOIN fx_tracklet_vectors g USING (run_id)) t WHERE rn = 1 AND sim >= 0.5""")(
    lambda fx: r6(L.gallery_query(fx.observations.select("run_id", F.col("frame_idx").alias("query_id"), "embedding"), fx.tracklet_vectors.withColumn("insert_order", F.col("object_id")), None, 0.5), "similarity")
)
register("gallery_query_excluding", """SELECT query_id, object_id, round(sim, 6) AS similarity FROM (SELECT q.query_id, g.object_id, list_dot_product(q.e, g.embedding) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(g.embedding, g.embedding)) AS sim,
 row_number() OVER (PARTITION BY q.query_id ORDER BY list_dot_product(q.e, g.embedding) / sqrt(list_dot_product(g.embedding, g.embedding)) DESC, g.object_id) AS rn
 FROM (SELECT frame_idx AS query_id, run_id, CAST(embedding AS DOUBLE[]) AS e FROM fx_observations) q JOIN fx_tracklet_vectors g USING (run_id) WHERE (q.query_id + g.object_id) % 5 <> 0) t WHERE rn = 1 AND sim >= 0.3""")(
    lambda fx: (lambda queries: r6(L.gallery_query(queries, fx.tracklet_vectors.withColumn("insert_order", F.col("object_id")), queries.join(fx.tracklet_vectors.drop("embedding"), "run_id").where("(query_id + object_id) % 5 = 0").select("query_id", "object_id"), 0.3), "similarity"))(
        fx.observations.select("run_id", F.col("frame_idx").alias("query_id"), "embedding")
    )
)
register("gallery_update", """SELECT run_id, object_id, CAST(len(v) AS INT) AS dim, last_frame, n_updates, pos, round(v[pos], 5) AS x FROM (SELECT run_id, object_id, arg_max(v, n) AS v, arg_max(last_frame, n) AS last_frame, arg_max(n_updates, n) AS n_updates FROM ck_gallery GROUP BY 1, 2) t,
 generate_series(1, 64) AS g(pos)""")(
    lambda fx: S.gallery_update(fx.observations).select("run_id", "object_id", "dim", "last_frame", "n_updates", F.posexplode("embedding").alias("pos", "x")).select("run_id", "object_id", "dim", "last_frame", "n_updates", (F.col("pos") + 1).cast("long").alias("pos"), F.round("x", 5).alias("x"))
)
register("motion_track", "SELECT run_id, frame_idx, x.d AS det_idx, x.i AS object_id FROM (SELECT run_id, frame_idx, unnest(out) AS x FROM ck_tracking) t")(lambda fx: S.track(fx.detections, S.MotionTracker, fx.frames))
def leaving(fx: Fixtures) -> DataFrame:
    """People who go and come back elsewhere, with vectors of their slots: every second 200 frames no one is there, and every other time
    they are there they are mirrored, with other motion ids."""
    turn = F.floor(F.col("frame_idx") / 400) % 2
    some = fx.detections.where("frame_idx % 400 < 200 and det_idx < 5")
    mirrored = [F.when(turn == 1, 1280 - F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x0", "x1"), ("x1", "x0"))]
    moved = some.select("run_id", "frame_idx", "det_idx", *mirrored, F.col("y0"), F.col("y1"), "label", "conf", F.lit(-1).cast("long").alias("motion_id"))
    looks = fx.spark.read.parquet(f"{fx.sf_dir}/embeddings.parquet").where("vec_id < 5").select(F.col("vec_id").cast("int").alias("det_idx"), F.col("embedding").cast("array<double>").alias("embedding"))
    return moved.join(F.broadcast(looks), "det_idx", "left")  # five rows


def recalling() -> S.MaskletTracker:
    return S.MaskletTracker(reentry=True, reentry_sim=0.65, reentry_misses=15, buffer=8)


register("masklet_track_reentry")(lambda fx: S.track(leaving(fx), recalling, fx.frames))


def event_stream(fx: Fixtures) -> DataFrame:
    """The detections as a stream in which frames come up to 60 late, a file for every 72 frames; the last one brings a run that moves
    the clock on."""
    path, out = new_path(fx.spark, "events"), new_path(fx.spark, "tracked")
    every = S.with_frames(fx.detections, fx.frames).withColumn("ts", F.timestamp_seconds(F.col("frame_idx") + 1000))
    late = F.floor((F.col("frame_idx") + F.pmod(F.xxhash64("frame_idx", "det_idx"), F.lit(60))) / 72)
    # the rows are made once, by all tasks; a file is then put together from its part
    dealt = every.withColumn("late", late)
    staged = new_path(fx.spark, "dealt")
    dealt.write.partitionBy("late").parquet(staged)
    dealt = fx.spark.read.schema(dealt.schema).parquet(staged)
    tops = dict(dealt.groupBy("late").agg(F.max("frame_idx")).collect())
    for n in sorted(tops):
        dealt.where(F.col("late") == n).drop("late").coalesce(1).write.mode("append").parquet(path)
    after = max(tops.values(), default=0) + 1000  # further on than the stream's delay
    end = dealt.drop("late").limit(1).withColumns({"run_id": F.lit("end"), "frame_idx": F.lit(after).cast("long"), "ts": F.timestamp_seconds(F.lit(after + 1000))})
    end.coalesce(1).write.mode("append").parquet(path)
    with rocksdb(fx.spark):
        stream = fx.spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(path)
        track_events(stream, S.MotionTracker, "100 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return fx.spark.read.schema(S.OUT).parquet(out)


register("motion_track_events", "SELECT run_id, frame_idx, x.d AS det_idx, x.i AS object_id FROM (SELECT run_id, frame_idx, unnest(out) AS x FROM ck_tracking) t")(lambda fx: event_stream(fx))
# half of the time no one is there: the runs are cut
register("motion_track_gaps", "SELECT run_id, frame_idx, x.d AS det_idx, x.i AS object_id FROM (SELECT run_id, frame_idx, unnest(out) AS x FROM ck_tracking_gaps) t")(lambda fx: S.track(fx.detections.where("frame_idx % 400 < 200"), S.MotionTracker, fx.frames))
register("masklet_track")(lambda fx: S.track(fx.detections, S.MaskletTracker, fx.frames))
register("reid_track")(
    lambda fx: S.track(D.attach_embeddings(fx.detections, fx.tracklet_vectors.select("run_id", (F.col("object_id") * 2 % 2000).alias("frame_idx"), F.lit(0).alias("det_idx"), "embedding"), 64), S.AppearanceTracker, fx.frames)
)

# --- runs, samples, jobs, files ---
register("stats_summary", "SELECT run_id, " + ", ".join(f"round(avg({c}), 3) AS avg_{c}" for c in ("detect_ms", "reid_ms", "cross_ms", "infer_ms")) + ", CAST(max(n_inst) AS BIGINT) AS instances_peak, CAST(sum(reid_recoveries) AS BIGINT) AS reid_recoveries FROM fx_frames GROUP BY 1")(lambda fx: U.stats_summary(fx.frames))
register("stride_summary", """SELECT run_id, source_frames, processed, greatest(0, source_frames - processed) AS skipped, round(100.0 * CAST(greatest(0, source_frames - processed) AS DOUBLE) / greatest(1, source_frames), 1) AS reduction_pct
 FROM ck_source JOIN (SELECT run_id, count(DISTINCT frame_idx) AS processed FROM fx_frames GROUP BY 1) p USING (run_id)""")(lambda fx: U.stride_summary(fx.runs, fx.frames))
register("gpu_summary", "SELECT run_id, round(avg(gpu_util_pct), 2) AS avg_util, max(gpu_util_pct) AS peak_util, round(avg(mem_used_mb), 2) AS avg_mem, round(max(mem_used_mb), 2) AS peak_mem, count(*) AS n FROM fx_samples GROUP BY 1")(lambda fx: U.gpu_summary(fx.samples))
register("process_summary", """SELECT run_id, round(b, 2) AS rss_baseline_mb, round(coalesce(top, e), 2) AS rss_peak_mb, round(e, 2) AS rss_end_mb, round(greatest(0, coalesce(top, e) - b), 2) AS rss_delta_peak_mb, samples FROM
 (SELECT run_id, arg_min(process_rss_mb, t_sec) AS b, arg_max(process_rss_mb, t_sec) AS e, max(process_rss_mb) FILTER (process_rss_mb > 0) AS top, count(*) AS samples FROM fx_samples GROUP BY 1) t""")(lambda fx: U.process_summary(fx.samples))
register("stage_totals", "SELECT run_id, round(sum(detect_ms) / 1000.0, 5) AS detect_sec, round(sum(reid_ms) / 1000.0, 5) AS reid_sec, round(sum(cross_ms) / 1000.0, 5) AS cross_sec, round(sum(infer_ms) / 1000.0, 5) AS infer_sec, round(count(*) / nullif(sum(infer_ms) / 1000.0, 0), 3) AS fps_infer FROM fx_frames GROUP BY 1")(lambda fx: U.stage_totals(fx.frames))
RATIO = "SELECT run_id, round(sec / nullif(source_frames / fps, 0), 4) AS ratio, sec / nullif(source_frames / fps, 0) <= 1.15 AS realtime_ok FROM ck_source LEFT JOIN (SELECT run_id, sum(infer_ms) / 1000.0 AS sec FROM fx_frames GROUP BY 1) s USING (run_id)"
register("realtime_ratio", RATIO)(lambda fx: U.realtime_ratio(fx.frames, fx.runs))
register("compare_runs", f"SELECT *, CAST(row_number() OVER (ORDER BY ratio NULLS LAST, run_id) AS INT) AS place FROM ({RATIO}) t")(lambda fx: U.compare_runs(fx.frames, fx.runs))
register("chart_series", "SELECT run_id, stage, round(avg(v), 3) AS avg_ms FROM (SELECT run_id, 'detect_ms' AS stage, detect_ms AS v FROM fx_frames UNION ALL SELECT run_id, 'reid_ms', reid_ms FROM fx_frames UNION ALL SELECT run_id, 'cross_ms', cross_ms FROM fx_frames) t GROUP BY 1, 2 HAVING avg(v) > 0.01")(lambda fx: U.chart_series(fx.frames))
register("describe_samples", """SELECT run_id, count(*) AS n, round(avg(gpu_util_pct), 4) AS mean, round(stddev_samp(gpu_util_pct), 4) AS std, min(gpu_util_pct) AS min, quantile_cont(gpu_util_pct, 0.25) AS p25, quantile_cont(gpu_util_pct, 0.5) AS p50,
 quantile_cont(gpu_util_pct, 0.75) AS p75, max(gpu_util_pct) AS max, median(gpu_util_pct) FILTER (gpu_util_pct <> 0) AS median_nonzero FROM fx_samples GROUP BY 1""")(lambda fx: U.describe_samples(fx.samples))
register("sample_frames", "SELECT run_id, frame_idx FROM fx_frames WHERE frame_idx % 6 = 0")(lambda fx: U.sample_frames(fx.frames, 6).select("run_id", "frame_idx"))
register("limit_duration", "SELECT run_id, frame_idx FROM fx_frames WHERE frame_idx < 312")(lambda fx: U.limit_duration(fx.frames, fx.runs, 12.5).select("run_id", "frame_idx"))
register("frame_batches", """SELECT run_id, CAST(floor(i / 64) AS BIGINT) AS batch, CAST(i % 64 AS BIGINT) AS slot, frame_idx FROM (SELECT run_id, frame_idx, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx) - 1 AS i FROM fx_frames) t
 UNION ALL SELECT run_id, CAST(floor(n / 64) AS BIGINT), unnest(generate_series(n % 64, 63)), -1 FROM (SELECT run_id, count(*) AS n FROM fx_frames GROUP BY 1) u WHERE n % 64 <> 0""")(lambda fx: U.frame_batches(fx.frames, 64).select("run_id", "batch", F.col("slot").cast("long").alias("slot"), "frame_idx"))
register("frame_windows", "SELECT run_id, w AS window, min(frame_idx) AS start_frame, max(frame_idx) + 1 AS end_frame, count(*) AS n_frames FROM (SELECT run_id, frame_idx, CAST(floor((row_number() OVER (PARTITION BY run_id ORDER BY frame_idx) - 1) / 100) AS BIGINT) AS w FROM fx_frames) t GROUP BY 1, 2")(lambda fx: U.frame_windows(fx.frames, 100))
register("manifest", "SELECT run_id, c AS chunk_idx, count(*) AS n_frames, c * 256 AS start_frame, (c + 1) * 256 AS end_frame FROM (SELECT run_id, CAST(floor(frame_idx / 256) AS BIGINT) AS c FROM fx_frames) t GROUP BY 1, 2")(lambda fx: io.manifest(fx.frames, 256))
register("overlay_rows", "SELECT run_id, frame_idx, CASE WHEN frame_idx % 10 = 0 THEN 0 ELSE n_inst END AS n_inst FROM fx_frames")(
    lambda fx: io.overlay_rows(fx.frames.select("run_id", "frame_idx", "n_inst"), fx.frames.where("frame_idx % 10 = 0").select("run_id", "frame_idx", F.lit(0).cast("long").alias("n_inst")))
)
register("keyframes_between", "SELECT run_id, frame_idx, n_inst FROM fx_frames WHERE frame_idx BETWEEN 300 AND 700")(lambda fx: io.keyframes_between(fx.frames.withColumn("chunk_idx", F.floor(F.col("frame_idx") / 256)), 300, 700, 256).select("run_id", "frame_idx", "n_inst"))
register("upsert_runs", "SELECT concat('run_', job_id % 700) AS run_id, max(job_id) AS arrival FROM fx_jobs GROUP BY 1 ORDER BY 2 DESC LIMIT 500")(
    lambda fx: (lambda j: io.upsert_runs(j.where("arrival % 2 = 0"), j.where("arrival % 2 = 1")))(fx.jobs.select(F.concat(F.lit("run_"), (F.col("job_id") % 700).cast("string")).alias("run_id"), F.col("job_id").alias("arrival")))
)
register("verify_trees", "SELECT name, CASE WHEN file_id % 7 = 0 THEN 'MISSING' WHEN file_id % 5 = 0 THEN 'MISMATCH' ELSE 'OK' END AS status FROM (SELECT file_id, concat(name, '#', file_id) AS name FROM fx_files) t")(
    lambda fx: (lambda f: U.verify_trees(f.select("name", "content"), f.where("file_id % 7 <> 0").select("name", F.when(F.col("file_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")).alias("content"))))(fx.files.withColumn("name", F.concat("name", F.lit("#"), F.col("file_id").cast("string"))))
)
register("artifact_flags", "SELECT dir, bool_or(ends_with(name, '_result.json')) AS result, bool_or(ends_with(name, '_annotated.mp4')) AS annotated, bool_or(ends_with(name, '_packets_manifest.json')) AS packets_manifest FROM fx_files GROUP BY 1")(lambda fx: U.artifact_flags(fx.files))
def listing(fx: Fixtures) -> DataFrame:
    """The files as `io.file_table` lists them; the last modified have the largest number."""
    return fx.files.select("file_id", "dir", "name", F.concat("dir", F.lit("/"), "name", F.lit("#"), F.col("file_id").cast("string")).alias("path"), F.timestamp_seconds("file_id").alias("modified"), F.octet_length("content").cast("long").alias("bytes"))


register("list_runs", "SELECT dir, max(file_id) AS newest, count(*) AS markers FROM fx_files WHERE regexp_matches(name, '_(result|packets_manifest)\\.json$') GROUP BY 1 ORDER BY 2 DESC LIMIT 80")(lambda fx: U.list_runs(listing(fx)).withColumn("newest", F.unix_seconds("newest")))
register("list_artifacts", "SELECT name, concat(dir, '/', name, '#', file_id) AS path, strlen(content) AS bytes FROM fx_files WHERE dir = 'run_6'")(lambda fx: U.list_artifacts(listing(fx), "run_6"))
def source_files(fx: Fixtures) -> DataFrame:
    """A listing in which each run has other sources."""
    k, run = F.col("k").cast("string"), F.col("run_id")
    file = lambda folder, name, some, modified=0: F.struct(F.expr(some).alias("there"), folder.alias("dir"), name.alias("name"), F.timestamp_seconds(F.col("k") + modified).alias("modified"))
    files = [
        file(run, F.lit("old_source.mkv"), "true"), file(run, F.lit("other_source.mkv"), "true", 5), file(run, F.lit("zz_source.mp4"), "k % 2 = 0", -5), file(run, F.concat(k, F.lit(".mp4")), "k % 3 = 0"), file(run, F.concat(k, F.lit("_source.avi")), "k % 4 = 0"),
        file(run, F.concat(run, F.lit("_source.mov")), "k % 5 = 0"), file(F.lit("videos"), F.concat(k, F.lit(".mp4")), "k % 7 = 0"), file(F.lit("x"), k, "k % 11 = 0"), file(run, F.lit("notes_source.txt"), "true", 9),
    ]
    return fx.order_runs.select(F.inline(F.array(*files))).where("there").select("dir", "name", F.concat(F.lit("/"), "dir", F.lit("/"), "name").alias("path"), "modified")


register("resolve_sources", """SELECT run_id, CASE WHEN k % 11 = 0 THEN concat('/x/', k) WHEN k % 7 = 0 THEN input_path ELSE concat('/', run_id, '/', CASE WHEN k % 5 = 0 THEN concat(run_id, '_source.mov') WHEN k % 3 = 0 THEN concat(k, '.mp4') WHEN k % 4 = 0 THEN concat(k, '_source.avi')
 WHEN k % 2 = 0 THEN 'zz_source.mp4' ELSE 'other_source.mkv' END) END AS path FROM fx_order_runs""")(lambda fx: U.resolve_sources(fx.order_runs.withColumn("override", F.concat(F.lit(' "/x/'), F.col("k").cast("string"), F.lit('" '))), source_files(fx)))


def pipelines(fx: Fixtures) -> DataFrame:
    on, other, none = (F.create_map(F.lit(k), F.lit("true")) for k in ("cross_check_enabled", "stride", "x"))
    model = lambda name: F.create_map(F.lit("cross_check"), F.lit(name))
    empty, null = F.map_filter(none, lambda k, v: F.lit(False)), F.lit(None).cast("map<string,string>")
    return fx.order_runs.select(
        "run_id", F.when(F.col("k") % 7 == 0, on).when(F.col("k") % 7 == 1, other).when(F.col("k") % 7 == 2, empty).otherwise(null).alias("result_pipeline"), F.when(F.col("k") % 3 == 0, on).otherwise(null).alias("summary_pipeline"),
        F.when(F.col("k") % 13 == 0, on).otherwise(null).alias("record_pipeline"), F.when(F.col("k") % 11 == 0, F.create_map(F.lit("cross_check_enabled"), F.lit("1"))).otherwise(null).alias("overlay"),
        F.when(F.col("k") % 5 == 0, model("Disabled")).when(F.col("k") % 5 == 1, empty).otherwise(null).alias("result_models"), F.when(F.col("k") % 2 == 0, model("helmet_v2")).otherwise(model("")).alias("summary_models"),
    )


register("cross_check_flags", "SELECT run_id, (CASE WHEN k % 7 = 0 THEN TRUE WHEN k % 7 = 1 THEN FALSE ELSE k % 3 = 0 OR k % 13 = 0 END) OR k % 11 = 0 OR (k % 5 <> 0 AND k % 2 = 0) AS cross_check FROM fx_order_runs")(lambda fx: U.cross_check_flags(pipelines(fx)))
register("run_metadata", """SELECT run_id, CASE WHEN fps = 0 THEN 30 ELSE fps END AS fps, width, height, CASE WHEN prompt <> '' THEN prompt WHEN k % 2 = 1 THEN 'helmet' ELSE 'person' END AS prompt, input_path,
 CASE WHEN frame_stride > 0 THEN frame_stride WHEN k % 2 = 1 THEN 3 ELSE 1 END AS frame_stride FROM fx_order_runs""")(
    lambda fx: (
        lambda p: U.run_metadata(
            p.drop("k"),
            p.select("run_id", F.lit(30.0).alias("fps"), F.lit(640).alias("width"), F.lit(0).alias("height"), F.lit("").alias("prompt"), F.lit("").alias("input_path"), F.lit(0).alias("frame_stride")),
            p.where("k % 2 = 1").select("run_id", F.lit(50.0).alias("fps"), F.lit(0).alias("width"), F.lit(480).alias("height"), F.lit("helmet").alias("prompt"), F.lit("s").alias("input_path"), F.lit(3).alias("frame_stride")),
        )
    )(fx.order_runs.select("run_id", "k", "fps", "width", "height", "prompt", "input_path", "frame_stride"))
)
register("resolve_overlay", "SELECT run_id, '0.45' AS alpha, CASE WHEN k % 3 = 0 THEN 'user' ELSE priority END AS boxes FROM fx_order_runs")(
    lambda fx: U.resolve_overlay(
        {"alpha": "0.45", "boxes": "default"}, fx.order_runs.select("run_id", F.create_map(F.lit("boxes"), F.col("priority")).alias("settings")), fx.order_runs.where("k % 3 = 0").select("run_id", F.create_map(F.lit("boxes"), F.lit("user")).alias("settings"))
    ).select("run_id", F.col("settings")["alpha"].alias("alpha"), F.col("settings")["boxes"].alias("boxes"))
)
register("recent_requests", "SELECT * FROM fx_requests ORDER BY ts DESC, request_id DESC LIMIT 50")(lambda fx: U.recent_requests(fx.requests))
register("list_jobs", "SELECT job_id, status, created_at FROM fx_jobs ORDER BY created_at DESC, job_id LIMIT 15")(lambda fx: U.list_jobs(fx.jobs).select("job_id", "status", "created_at"))
register("latest_job", "SELECT job_id, status FROM fx_jobs ORDER BY created_at DESC, job_id LIMIT 1")(lambda fx: U.latest_job(fx.jobs).select("job_id", "status"))
register("active_job", "SELECT job_id, status FROM fx_job_states WHERE status IN ('queued', 'running') ORDER BY coalesce(nullif(started_at, 0), created_at) DESC, job_id LIMIT 1")(lambda fx: U.active_job(fx.job_states).select("job_id", "status"))
#: The clock of the fixture.
NOW = 1e6
register("job_states", f"""SELECT job_id, status, phase, CASE WHEN keep THEN stored_percent ELSE round(CASE WHEN total_frames > 0 THEN 100.0 * CAST(current_frames AS DOUBLE) / total_frames ELSE 0 END, 2) END AS percent, CASE WHEN keep THEN 1.5 ELSE round(speed, 8) END AS fps,
 CASE WHEN keep THEN 2.5 ELSE round(CASE WHEN speed > 1e-6 AND total_frames > current_frames THEN (total_frames - current_frames) / speed ELSE 0 END, 8) END AS eta_seconds, CASE WHEN keep THEN 3.5 ELSE elapsed END AS elapsed_sec
 FROM (SELECT *, CASE WHEN elapsed > 1e-6 AND current_frames > 0 THEN current_frames / elapsed ELSE 0 END AS speed FROM (SELECT *, total_frames = 0 AND job_id % 4 = 0 AS keep, CASE WHEN started_at IS NULL THEN 0 ELSE greatest(0, coalesce(finished_at, {NOW:.0f})
  - CASE WHEN phase <> 'staging' THEN coalesce(nullif(infer_started_at, 0), started_at) ELSE started_at END) END AS elapsed FROM fx_job_states) a) b""")(
    lambda fx: U.job_states(fx.job_states.withColumn("stored", F.expr("CASE WHEN job_id % 4 = 0 THEN named_struct('percent', stored_percent, 'fps', 1.5D, 'eta_seconds', 2.5D, 'elapsed_sec', 3.5D) END")), NOW)
)
PROGRESS = "round(100.0 * CAST(current_frames AS DOUBLE) / total_frames, 2) AS percent"
register("job_progress", f"SELECT job_id, status, phase, {PROGRESS}, round(current_frames / elapsed_sec, 8) AS fps, round(CASE WHEN total_frames > current_frames AND current_frames > 0 THEN (total_frames - current_frames) / (current_frames / elapsed_sec) ELSE 0 END, 8) AS eta_seconds FROM fx_jobs")(lambda fx: U.job_progress(fx.jobs))
register("with_labels", "SELECT job_id, CASE status " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in U.STATUS.items()) + " ELSE status END AS status_text, CASE phase " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in U.PHASE.items()) + " ELSE phase END AS phase_text FROM fx_jobs")(lambda fx: U.with_labels(fx.jobs).select("job_id", "status_text", "phase_text"))
register("job_summary", f"SELECT job_id, {PROGRESS}, CASE WHEN n IS NULL THEN '—' WHEN n < 1024 THEN concat(n, ' B') ELSE printf('%.2f KB', n / 1024.0) END AS input_size FROM fx_jobs LEFT JOIN (SELECT file_id AS job_id, strlen(content) AS n FROM fx_files) f USING (job_id)")(lambda fx: U.job_summary(fx.jobs, listing(fx)).select("job_id", "percent", "input_size"))
register("throttle", "SELECT job_id, tick FROM ck_emitting WHERE emitted")(
    lambda fx: U.throttle(fx.ticks.select("job_id", F.col("tick").cast("long").alias("tick"), "current", "total", "ts")).select("job_id", "tick")
)
register("memory_report", "SELECT run_id, CAST(width AS BIGINT) * height * 3 AS frame_bytes, CAST(width AS BIGINT) * height * 96 AS batch_bytes, CAST(width AS BIGINT) * height * 3 * source_frame_count AS preload_bytes, CASE WHEN width = 1280 THEN '84.38 MB' ELSE '189.84 MB' END AS batch_text FROM fx_order_runs")(
    lambda fx: U.memory_report(fx.order_runs, 32)
)
register("run_history", "SELECT run_id FROM fx_order_runs ORDER BY run_id DESC LIMIT 15")(lambda fx: U.run_history(fx.order_runs).select("run_id"))
register("run_report", """SELECT run_id, concat_ws(chr(10), concat('Run: ', run_id), concat('Source frames: ', source_frames), concat('Processed frames: ', processed), concat('Skipped frames: ', greatest(0, source_frames - processed)), concat('Peak instances: ', peak), concat('Re-id recoveries: ', recoveries),
 'Memory: 1 frame = 2.64 MB (2764800 B) | 1 batch (32 fr) = 84.38 MB', CASE WHEN source_frame_count > 0 THEN concat('Preload RAM (frames only): ', printf('%.2f GB', 2764800.0 * source_frame_count / 1073741824)) END) AS report
 FROM ck_source JOIN (SELECT run_id, count(DISTINCT frame_idx) AS processed, CAST(max(n_inst) AS BIGINT) AS peak, CAST(sum(reid_recoveries) AS BIGINT) AS recoveries FROM fx_frames GROUP BY 1) s USING (run_id) JOIN (SELECT run_id, source_frame_count FROM fx_runs) r USING (run_id)""")(lambda fx: U.run_report(fx.runs, fx.frames, 32))
#: Readings of the process at both ends of each run, and runs that nothing was sampled of.
READINGS = """SELECT run_id, CAST(1000 AS DOUBLE) AS rss_baseline, CAST(700 AS DOUBLE) AS rss_end, CAST(5 AS DOUBLE) AS alloc_baseline, CAST(7 AS DOUBLE) AS alloc_end, CAST(9 AS DOUBLE) AS reserved_baseline, CAST(3 AS DOUBLE) AS reserved_end FROM fx_runs
 UNION ALL SELECT concat(run_id, '_idle'), 1000, 0, 5, 7, 9, 3 FROM fx_runs"""
register("resource_summary", f"""SELECT run_id, rss_baseline AS rss_baseline_mb, round(CASE WHEN n > 0 THEN coalesce(rss, rss_end) ELSE coalesce(nullif(rss_end, 0), rss_baseline) END, 2) AS rss_peak_mb, rss_end AS rss_end_mb,
 round(greatest(0, CASE WHEN n > 0 THEN coalesce(rss, rss_end) ELSE coalesce(nullif(rss_end, 0), rss_baseline) END - rss_baseline), 2) AS rss_delta_peak_mb, alloc_baseline AS alloc_baseline_mb, round(CASE WHEN n > 0 THEN alloc ELSE greatest(alloc_end, alloc_baseline) END, 2) AS alloc_peak_mb,
 alloc_end AS alloc_end_mb, round(greatest(0, CASE WHEN n > 0 THEN alloc ELSE greatest(alloc_end, alloc_baseline) END - alloc_baseline), 2) AS alloc_delta_peak_mb, round(CASE WHEN n > 0 THEN reserved ELSE greatest(reserved_end, reserved_baseline) END, 2) AS reserved_peak_mb, reserved_end AS reserved_end_mb, coalesce(n, 0) AS samples
 FROM ({READINGS}) r LEFT JOIN (SELECT run_id, max(process_rss_mb) FILTER (process_rss_mb > 0) AS rss, max(gpu_util_pct) AS alloc, max(mem_used_mb) AS reserved, count(*) AS n FROM fx_samples GROUP BY 1) s USING (run_id)""")(
    lambda fx: (lambda runs: U.resource_summary(fx.spark.sql(READINGS.replace("fx_runs", "{runs}"), runs=runs), fx.samples.withColumnsRenamed({"gpu_util_pct": "cuda_allocated_mb", "mem_used_mb": "cuda_reserved_mb"})))(fx.runs)
)
TIMINGS = """SELECT run_id, CAST(100 AS DOUBLE) AS wall, CAST(10.5 AS DOUBLE) AS preload, CAST(CASE WHEN run_id LIKE '%0' THEN 0 ELSE 50 END AS DOUBLE) AS infer, CAST(5.25 AS DOUBLE) AS pass2, CAST(CASE WHEN run_id LIKE '%1' THEN 0.001 ELSE 20 END AS DOUBLE) AS finalize, CAST(7.1234 AS DOUBLE) AS decode,
 CAST(40.0004 AS DOUBLE) AS gpu, CAST(3 AS DOUBLE) AS cpu_finalize, fps, source_frame_count AS source_frames FROM fx_runs"""
register("run_timings", f"""SELECT run_id, preload AS elapsed_preload_sec, infer AS elapsed_infer_sec, pass2 AS elapsed_pass2_sec, round(CASE WHEN finalize < 0.01 THEN greatest(0, wall - preload - infer - pass2) ELSE finalize END, 3) AS elapsed_finalize_sec, round(source_frames / fps, 3) AS video_duration_sec,
 round(CASE WHEN infer > 0 THEN n / infer ELSE 0 END, 3) AS fps_infer, round(decode, 3) AS stage_decode_sec, round(gpu, 3) AS stage_gpu_infer_sec, cpu_finalize AS stage_cpu_finalize_sec, pass2 AS stage_pass2_sec, wall AS wall_sec
 FROM ({TIMINGS}) t LEFT JOIN (SELECT run_id, count(DISTINCT frame_idx) AS n FROM fx_frames GROUP BY 1) f USING (run_id)""")(lambda fx: U.run_timings(fx.spark.sql(TIMINGS.replace("fx_runs", "{runs}"), runs=fx.runs), fx.frames))
register("frame_latency", """SELECT run_id, frame_idx AS frame, 'total' AS series, infer_ms AS ms FROM fx_frames UNION ALL SELECT run_id, frame_idx, 'detect', detect_ms FROM fx_frames UNION ALL SELECT run_id, frame_idx, 'seg', 0 FROM fx_frames UNION ALL SELECT run_id, frame_idx, 'reid', reid_ms FROM fx_frames""")(
    lambda fx: U.frame_latency(fx.frames.select("run_id", F.col("frame_idx").alias("frame"), F.col("infer_ms").alias("total_ms"), "detect_ms", F.lit(None).cast("double").alias("seg_ms"), "reid_ms"))
)
register("load_series", "SELECT run_id, t_sec, 'util' AS series, gpu_util_pct AS value FROM fx_samples UNION ALL SELECT run_id, t_sec, 'memory', mem_used_mb FROM fx_samples")(lambda fx: U.load_series(fx.samples))
register("run_record", """SELECT r.run_id, input_path AS input_video, prompt, frames, CAST(round(total, 3) AS DOUBLE) AS elapsed_sec, round(frames / CAST(total AS DOUBLE), 3) AS fps_processed, '1280x720' AS resolution FROM fx_runs r
 JOIN (SELECT run_id, count(DISTINCT frame_idx) AS frames, sum(CAST(infer_ms AS DECIMAL(18, 6))) * CAST(0.001 AS DECIMAL(4, 3)) AS total FROM fx_frames GROUP BY 1) s USING (run_id)""")(lambda fx: U.run_record(fx.runs, fx.frames).drop("stats_summary"))
# --- assembly and plans ---
def assembled(fx: Fixtures) -> DataFrame:
    """Some instances have a mask of two short runs, some an empty one, the others only their box."""
    named = P.resolve_prompt_id(fx.instances, fx.spark.createDataFrame([("worker", 1), ("person", 2)], "term string, term_id int"))
    rect = G.rect_mask_geometry(G.box(), F.lit(1280), F.lit(720))
    start = rect["bbox_y"].cast("long") * 1280 + rect["bbox_x"]
    counts = F.when(F.col("object_id") % 7 == 0, F.array().cast("array<long>")).otherwise(F.array(start, F.lit(10).cast("long"), F.lit(1270).cast("long"), F.lit(5).cast("long")))
    masks = fx.instances.where("object_id % 3 = 0 or object_id % 7 = 0").select("run_id", "frame_idx", "inst_idx", F.lit(720).alias("height"), F.lit(1280).alias("width"), counts.alias("counts"))
    return R.assemble_instances(named, smooth(fx), fx.keypoints.withColumn("inst_idx", F.lit(0)), fx.runs, masks)


register("assemble_instances", f"""SELECT t.run_id, t.frame_idx, t.inst_idx, object_id, xa AS bbox_x, CASE WHEN object_id % 3 = 0 THEN 2 ELSE yb - ya + 1 END AS bbox_h, CASE WHEN object_id % 3 = 0 THEN 15 ELSE CAST(xb - xa + 1 AS BIGINT) * (yb - ya + 1) END AS area_px, score, CAST(2 AS INT) AS person_id,
 CAST(coalesce(k.n, -1) AS INT) AS n_keypoints, ok AS cross_check_ok, warning, CAST(ya AS BIGINT) * 1280 + xa AS lead, CAST(CASE WHEN object_id % 3 = 0 THEN 4 ELSE 2 * (yb - ya + 1) + 1 END AS INT) AS n_runs
 FROM (SELECT *, {RECT} FROM fx_instances) t JOIN (SELECT run_id, frame_idx, inst_idx, ok, warning FROM ck_smooth) s USING (run_id, frame_idx, inst_idx)
 LEFT JOIN (SELECT run_id, frame_idx, 0 AS inst_idx, count(*) AS n FROM fx_keypoints GROUP BY 1, 2) k ON k.run_id = t.run_id AND k.frame_idx = t.frame_idx AND k.inst_idx = t.inst_idx WHERE xb > xa AND yb > ya AND object_id % 7 <> 0""")(
    lambda fx: assembled(fx).select(
        "run_id", "frame_idx", "inst_idx", "object_id", "bbox_x", "bbox_h", "area_px", "score", F.col("slug_ids")["person_id"].alias("person_id"), F.coalesce(F.size("keypoints"), F.lit(-1)).alias("n_keypoints"), "cross_check_ok", "warning",
        F.col("mask.counts")[0].alias("lead"), F.size("mask.counts").alias("n_runs"),
    )
)


def mask_pairs(fx: Fixtures) -> DataFrame:
    """Each mask and the one with the next number."""
    one = M.encode_runs(fx.pixels)
    return one.select("mask_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("counts").alias("a")).join(one.select((F.col("mask_id") - 1).alias("mask_id"), F.col("counts").alias("b")).hint("merge"), "mask_id")


PIXEL_PAIRS = "SELECT a.mask_id, a.p, a.v AS va, b.v AS vb FROM fx_pixels a JOIN fx_pixels b ON b.mask_id = a.mask_id + 1 AND b.p = a.p"
register("mask_overlap", f"SELECT mask_id, CAST(sum(va) AS BIGINT) AS area_a, CAST(sum(vb) AS BIGINT) AS area_b, CAST(sum(va * vb) AS BIGINT) AS inter_px, CAST(sum(greatest(va, vb)) AS BIGINT) AS union_px, round(coalesce(sum(va * vb) / CAST(nullif(sum(greatest(va, vb)), 0) AS DOUBLE), 0), 6) AS iou FROM ({PIXEL_PAIRS}) t GROUP BY 1")(
    lambda fx: r6(M.mask_overlap(mask_pairs(fx)).drop("height", "width"), "iou")
)
COMBINED = " UNION ALL ".join(f"SELECT '{how}' AS how, mask_id, p, {rule} AS v FROM ({PIXEL_PAIRS}) t" for how, rule in (("intersection", "va * vb"), ("union", "greatest(va, vb)"), ("difference", "va * (1 - vb)")))
# the runs of the pixels, counted and put in order
register("mask_combine", f"""SELECT how, mask_id, array_to_string(CASE WHEN max(v0) = 1 THEN list_prepend(0, list(n ORDER BY run)) ELSE list(n ORDER BY run) END, ',') AS counts FROM
 (SELECT how, mask_id, run, count(*) AS n, max(v0) AS v0, max(filled) AS filled FROM (SELECT how, mask_id, v0, filled, sum(c) OVER (PARTITION BY how, mask_id ORDER BY p) AS run
  FROM (SELECT how, mask_id, p, first_value(v) OVER w AS v0, max(v) OVER (PARTITION BY how, mask_id) AS filled, CASE WHEN v <> lag(v, 1, 0) OVER w THEN 1 ELSE 0 END AS c FROM ({COMBINED}) t WINDOW w AS (PARTITION BY how, mask_id ORDER BY p)) a) b GROUP BY 1, 2, 3) c WHERE filled = 1 GROUP BY 1, 2""")(
    lambda fx: reduce(DataFrame.unionByName, [M.mask_combine(mask_pairs(fx), how).select(F.lit(how).alias("how"), "mask_id", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts")) for how in ("intersection", "union", "difference")]).where("counts <> ''")
)
register("scene_plan", "SELECT s.run_id, count(*) AS clip_frames, count(h.keyframe) AS frames_with_people FROM (SELECT run_id, unnest(generate_series(0, source_frames - 1)) AS frame_idx FROM ck_source WHERE source_frames > 0) s LEFT JOIN (SELECT * FROM ck_held WHERE n_inst > 0) h USING (run_id, frame_idx) GROUP BY 1")(
    lambda fx: R.scene_plan(fx.frames, fx.runs)
)
register("person_plan", "SELECT run_id, object_id, count(DISTINCT frame_idx) AS clip_frames, concat(run_id, '_person', object_id, '.mp4') AS output_name FROM fx_instances GROUP BY 1, 2")(lambda fx: R.person_plan(fx.instances))
register("accessory_leaks", "SELECT acc_idx, run_id, frame_idx, label, a.x0, a.y0, a.x1, a.y1 FROM fx_accessories a SEMI JOIN fx_instances USING (run_id, frame_idx, label, x0, y0, x1, y1)")(lambda fx: R.accessory_leaks(fx.instances, fx.accessories))
register("enrich_tracklets", """SELECT run_id, object_id, object_id % 3 = 0 AS filled, round(e[1] / norm, 5) AS first, round(e[64] / norm, 5) AS last FROM ck_vectors""")(
    lambda fx: L.enrich_tracklets(
        tracklets(fx).withColumn("embedding", F.when(F.col("object_id") % 3 != 0, VEC.l2_normalize(F.col("embedding")))), fx.instances,
        fx.instances.join(fx.tracklet_vectors, ["run_id", "object_id"]).select("run_id", "frame_idx", "inst_idx", "embedding"), 8, fx.runs,
    ).select("run_id", "object_id", "filled", F.round(F.col("embedding")[0], 5).alias("first"), F.round(F.col("embedding")[63], 5).alias("last"))
)
register("l2_normalize", "SELECT run_id, object_id, round(e[1] / norm, 6) AS first FROM ck_vectors")(lambda fx: fx.tracklet_vectors.select("run_id", "object_id", F.round(VEC.l2_normalize(F.col("embedding"))[0], 6).alias("first")))
register("fmt_texts", """SELECT job_id, CASE WHEN elapsed_sec IS NULL OR elapsed_sec < 0 THEN '—' WHEN elapsed_sec < 60 THEN printf('%.1f с', elapsed_sec)
 WHEN floor(elapsed_sec / 60) < 60 THEN concat(CAST(floor(elapsed_sec / 60) AS BIGINT), ' мин ', CAST(round_even(elapsed_sec - 60 * floor(elapsed_sec / 60), 0) AS INT), ' с')
 ELSE concat(CAST(floor(elapsed_sec / 3600) AS BIGINT), ' ч ', CAST(floor(elapsed_sec / 60) AS BIGINT) % 60, ' мин') END AS elapsed FROM fx_jobs""")(
    lambda fx: fx.jobs.select("job_id", T.fmt_sec(F.col("elapsed_sec")).alias("elapsed"))
)

# --- geometry on another frame size ---
register("box_centres", "SELECT run_id, frame_idx, inst_idx, round((x0 + x1) / 2, 6) AS cx, round((y0 + y1) / 2, 6) AS cy, round(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2), 6) AS diag, x0 + (x1 - x0) AS right_x, CAST(round_even((x0 + x1) / 2 * CAST(0.5 AS DOUBLE), 0) AS INT) AS scaled_cx, CAST(round_even((y0 + y1) / 2 * CAST(1.5 AS DOUBLE), 0) AS INT) AS scaled_cy FROM fx_instances")(
    lambda fx: fx.instances.select(
        "run_id", "frame_idx", "inst_idx", F.round(G.center(G.box())[0], 6).alias("cx"), F.round(G.center(G.box())[1], 6).alias("cy"), F.round(G.diag(G.box()), 6).alias("diag"),
        G.xywh_to_xyxy(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).x1.alias("right_x"),
        *[c.alias(n) for n, c in zip(("scaled_cx", "scaled_cy"), G.scale_point(*G.center(G.box()), F.lit(0.5), F.lit(1.5)), strict=True)],
    )
)
register("scale_heads", "SELECT run_id, frame_idx, inst_idx, " + ", ".join(f"CAST(round_even(h{c} * CAST({k} AS DOUBLE), 0) AS INT) AS {c}" for c, k in (("x0", 0.5), ("y0", 1.5), ("x1", 0.5), ("y1", 1.5))) + " FROM ck_raw")(
    lambda fx: raw(fx).select("run_id", "frame_idx", "inst_idx", *[c.alias(n) for n, c in zip(G.Box._fields, G.scale_box(G.box("h"), F.lit(0.5), F.lit(1.5)), strict=True)])
)
register("scale_keypoints", "SELECT run_id, frame_idx, id, round(x * CAST(0.5 AS DOUBLE), 2) AS x, round(y * CAST(1.5 AS DOUBLE), 2) AS y FROM fx_keypoints")(
    lambda fx: fx.keypoints.groupBy("run_id", "frame_idx").agg(F.collect_list(F.struct("id", "x", "y", "conf")).alias("p")).select("run_id", "frame_idx", F.explode(G.scale_keypoints(F.col("p"), F.lit(0.5), F.lit(1.5))).alias("q")).select("run_id", "frame_idx", "q.id", "q.x", "q.y")
)
register("scale_accessories", "SELECT * FROM (SELECT run_id, frame_idx, acc_idx, " + ", ".join(f"CAST(round_even({c} * CAST(20.0 AS DOUBLE) / {n}, 0) AS INT) AS {c}" for c, n in (("x0", 1280), ("y0", 720), ("x1", 1280), ("y1", 720))) + " FROM fx_accessories) t WHERE x1 - x0 > 1 AND y1 - y0 > 1")(
    lambda fx: R.scale_accessories(fx.accessories, 20, 20, fx.runs).select("run_id", "frame_idx", "acc_idx", *G.Box._fields)
)

# --- sources and sinks: written to the shared folder and read back ---
def results(fx: Fixtures) -> DataFrame:
    path = new_path(fx.spark, "results")
    rows = fx.instances.select("run_id", "frame_idx", "inst_idx", "object_id", "score", F.col("label").alias("prompt_label"), F.array(*[F.col(c).cast("int") for c in G.Box._fields]).alias("bbox_xywh"))
    io.write_results(fx.runs.select("run_id", "input_path", "prompt", "fps", "width", "height"), rows, path)
    runs, instances = io.read_results(fx.spark, path)
    return instances.join(runs.select("run_id", "fps", "input_path").hint("merge"), "run_id")


register("results_json", "SELECT run_id, frame_idx, inst_idx, object_id, score, label AS prompt_label, CAST(x0 AS INT) AS x, CAST(y1 AS INT) AS y, fps, input_path FROM fx_instances JOIN fx_runs USING (run_id)")(
    lambda fx: results(fx).select("run_id", "frame_idx", "inst_idx", "object_id", "score", "prompt_label", F.col("bbox_xywh")[0].alias("x"), F.col("bbox_xywh")[3].alias("y"), "fps", "input_path")
)


def metrics(fx: Fixtures) -> DataFrame:
    path = new_path(fx.spark, "metrics")
    io.write_metrics(fx.frames.select(F.concat("run_id", F.lit("#"), F.col("frame_idx").cast("string")).alias("note"), F.col("frame_idx").alias("frame"), "detect_ms", "reid_ms", F.col("n_inst").alias("instances")), path)
    # blank and broken lines among them
    fx.frames.select(F.when(F.col("frame_idx") % 2 == 0, "").otherwise("{broken").alias("value")).write.mode("append").text(path)
    return io.read_metrics(fx.spark, path)


register("metrics_jsonl", "SELECT frame_idx AS frame, detect_ms, reid_ms, CAST(n_inst AS INT) AS instances FROM fx_frames")(lambda fx: metrics(fx).select("frame", "detect_ms", "reid_ms", "instances"))


def samples(fx: Fixtures) -> DataFrame:
    path = new_path(fx.spark, "samples")
    io.write_samples(fx.samples, path)
    return io.read_samples(fx.spark, path)


register("samples_json", "SELECT t_sec, gpu_util_pct, mem_used_mb, process_rss_mb FROM fx_samples")(lambda fx: samples(fx).select("t_sec", "gpu_util_pct", "mem_used_mb", "process_rss_mb"))


def index(fx: Fixtures) -> DataFrame:
    """The index of the last 500 runs, written, read and flattened; a missing one is empty."""
    path = new_path(fx.spark, "index")
    rows = fx.order_runs.orderBy(F.desc("k")).limit(500).select("run_id", F.col("input_path").alias("input_video"), "prompt", F.col("source_frame_count").alias("frames"), F.create_map(F.lit("detect"), F.col("priority")).alias("models"), F.create_map(F.lit("instances_peak"), F.col("width").cast("string")).alias("stats_summary"))
    io.write_runs_index(rows, path)
    return io.read_runs_index(fx.spark, path).unionByName(io.read_runs_index(fx.spark, f"{path}-missing"))


def history_csv(fx: Fixtures) -> DataFrame:
    path = new_path(fx.spark, "history")
    io.export_runs_csv(index(fx), path)
    return fx.spark.read.option("header", True).csv(path)


INDEX = "SELECT concat('run_', o_orderkey) AS run_id, concat('/videos/', o_orderkey, '.mp4') AS input_video, o_custkey AS frames, o_orderpriority AS priority, CASE WHEN o_orderkey % 2 = 0 THEN 1280 ELSE 1920 END AS width FROM orders ORDER BY o_orderkey DESC LIMIT 500"
register("runs_index", f"SELECT run_id, input_video, frames, priority AS detect FROM ({INDEX}) t")(lambda fx: index(fx).select("run_id", "input_video", "frames", F.col("models")["detect"].alias("detect")))
register("history_csv", f"SELECT run_id, input_video, CAST(frames AS VARCHAR) AS frames, priority AS detect_model, CAST(width AS VARCHAR) AS instances_peak, CAST(NULL AS VARCHAR) AS out_dir FROM ({INDEX}) t")(
    lambda fx: history_csv(fx).select("run_id", "input_video", "frames", "detect_model", "instances_peak", "out_dir")
)


def chunk_store(fx: Fixtures) -> DataFrame:
    path = new_path(fx.spark, "chunks")
    io.write_chunks(fx.frames.select("run_id", "frame_idx", "n_inst"), path, 256)
    return fx.spark.read.parquet(path)


register("chunk_store", "SELECT run_id, CAST(floor(frame_idx / 256) AS INT) AS chunk_idx, frame_idx, n_inst FROM fx_frames WHERE frame_idx BETWEEN 200 AND 600")(
    lambda fx: io.keyframes_between(chunk_store(fx), 200, 600, 256).select("run_id", "chunk_idx", "frame_idx", F.col("n_inst").cast("long").alias("n_inst"))
)
# in frame order: the place of a frame in the merged set is that in its run
register("compact_chunks", "SELECT run_id, frame_idx, row_number() OVER (PARTITION BY run_id ORDER BY frame_idx) AS place FROM fx_frames")(
    lambda fx: io.compact_chunks(chunk_store(fx), 1).withColumn("m", F.monotonically_increasing_id()).select("run_id", "frame_idx", F.row_number().over(Window.partitionBy("run_id").orderBy("m")).alias("place"))
)
register("report_violations", "SELECT run_id, CASE WHEN count(*) FILTER (NOT ok) % 3 = 0 THEN 0 ELSE CAST(count(*) FILTER (NOT ok) AS INT) END AS violations FROM ck_smooth GROUP BY 1")(
    lambda fx: io.report_violations(
        U.run_report(fx.runs, fx.frames).select("run_id", F.posexplode(F.split("report", "\n")).alias("line_no", "line")).unionByName(
            V.violations_total(smooth(fx)).select("run_id", F.explode(F.array(F.lit(100), F.lit(101))).alias("line_no"), F.concat(F.lit("  Cross-check violations: "), F.when(F.col("violations") % 3 == 0, "many").otherwise(F.col("violations").cast("string"))).alias("line"))
        )
    )
)

# --- streams: a table replayed as a file stream ---
def replay(fx: Fixtures, rows: DataFrame, order: str, batches: int) -> DataFrame:
    """``rows`` as a stream that brings them in the order of a column, some at a time."""
    path = new_path(fx.spark, "replay")
    rows.repartitionByRange(batches, order).write.parquet(path)
    return fx.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def smoothed(fx: Fixtures) -> DataFrame:
    out = new_path(fx.spark, "smoothed")
    # one file: its rows are in any order, the operator sorts those of an identity
    stream = replay(fx, raw(fx).select("run_id", "frame_idx", "inst_idx", "object_id", "ok").coalesce(1), "frame_idx", 1)
    S.smooth_stream(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return fx.spark.read.parquet(out)


register("smooth_stream", "SELECT run_id, frame_idx, inst_idx, object_id, ok FROM ck_smooth")(lambda fx: smoothed(fx))


def recent_view(fx: Fixtures) -> DataFrame:
    out = new_path(fx.spark, "requests")
    S.recent_requests_stream(replay(fx, fx.requests, "ts", 4), out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return S.recent_requests_view(fx.spark, out, fx.requests.schema)


register("recent_requests_stream", "SELECT request_id, path, status_code FROM fx_requests ORDER BY ts DESC, request_id DESC LIMIT 200")(lambda fx: recent_view(fx).select("request_id", "path", "status_code"))


# --- hooks: a model stood in for by arithmetic ---
def boxes_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """One box a frame that has people, from its number."""
    some = pdf[pdf.n_inst > 0]
    x = (some.frame_idx % 50).astype(float)
    return pd.DataFrame({"run_id": some.run_id, "frame_idx": some.frame_idx, "det_idx": 0, "x0": x, "y0": x + 1, "x1": x + 20, "y1": x + 41, "label": "person", "conf": 0.5, "motion_id": -1})


def masks_of(pdf: pd.DataFrame) -> pd.DataFrame:
    """A mask of as many pixels as the frame has people."""
    n = pdf.n_inst.astype(int)
    return pd.DataFrame({"run_id": pdf.run_id, "frame_idx": pdf.frame_idx, "seg_idx": 0, "label": "person", "conf": 0.25, "height": 4, "width": 4, "counts": [[2, k, 14 - k] for k in n]})


def vectors_of(crops: pd.Series) -> np.ndarray:
    """The length of a text and the number of its lines."""
    return np.array([[len(t), t.count("\n")] for t in crops], float).reshape(-1, 2)


register("score_frames", "SELECT run_id, frame_idx, CAST(0 AS INT) AS det_idx, CAST(frame_idx % 50 AS DOUBLE) AS x0, CAST(frame_idx % 50 + 1 AS DOUBLE) AS y0, CAST(frame_idx % 50 + 20 AS DOUBLE) AS x1, CAST(frame_idx % 50 + 41 AS DOUBLE) AS y1, 'person' AS label, CAST(0.5 AS DOUBLE) AS conf, CAST(-1 AS BIGINT) AS motion_id FROM fx_frames WHERE n_inst > 0")(
    lambda fx: hooks.score_frames(fx.frames.select("run_id", "frame_idx", "n_inst"), boxes_of, 32)
)
register("score_masks", "SELECT run_id, frame_idx, CAST(n_inst AS BIGINT) AS area_px, CASE WHEN n_inst > 0 THEN CAST(0 AS INT) END AS bbox_y FROM fx_frames")(
    lambda fx: M.mask_geometry(hooks.score_masks(fx.frames.select("run_id", "frame_idx", "n_inst"), masks_of).withColumn("mask_id", F.struct("run_id", "frame_idx"))).select("mask_id.run_id", "mask_id.frame_idx", "area_px", "bbox_y")
)
register("embed_crops", "SELECT file_id, CASE WHEN n > 0 OR l > 0 THEN round(n / sqrt(n * n + l * l), 6) END AS x, CASE WHEN n > 0 OR l > 0 THEN round(l / sqrt(n * n + l * l), 6) END AS y FROM (SELECT file_id, CAST(length(content) AS DOUBLE) AS n, CAST(length(content) - length(replace(content, chr(10), '')) AS DOUBLE) AS l FROM (SELECT file_id, coalesce(content, '') AS content FROM fx_files) a) t")(
    lambda fx: hooks.embed_crops(fx.files.select("file_id", F.coalesce("content", F.lit("")).alias("crop")), vectors_of, 64).select("file_id", F.round(F.col("embedding")[0], 6).alias("x"), F.round(F.col("embedding")[1], 6).alias("y"))
)
