"""Registered queries over frames as bytes and over regions of single frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeline.operators import frames, pixels
from tapeline.plans import views as V
from tapeline.plans.queries import CLASS_PROBES, frames_of, query
from tapeline.plans.views import sql

SPEC = frames.Spec(
    threshold=127.3,
    bright=frames.Bright(50, 30, 100),
    lines=frames.Lines([("white", (255, 255, 255)), ("orange", (255, 215, 0)), ("blue", (0, 0, 255)), ("red", (255, 0, 0))], 80, 5, 4),
    panel=frames.Panel((255, 215, 215), 30, True, 155, 200),
    probes=[(c, c, 0, x, y, 255, 255, 255, 165) for c, (x, y) in CLASS_PROBES.items()],
    slots=[("a", 5, 5), ("a", 10, 6), ("b", 20, 7), ("b", 30, 8)],
    sides={"a": (200, 200, 200), "b": (200, 200, 200)},
    side_tol=90,
    black_tol=250,
)

#: All pixels of frames of 60 x 40; one that is not in v_pixels is black.
FULL = """v_full AS (
  SELECT frame_id, x, y, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b
  FROM (SELECT frame_id, unnest(range(60)) AS x, y FROM (SELECT frame_id, unnest(range(40)) AS y FROM (SELECT DISTINCT frame_id FROM v_pixels)))
  LEFT JOIN v_pixels USING (frame_id, x, y))"""

FEATURES_SQL = """
SELECT CAST(f.frame_id % 3 AS VARCHAR) AS video_id, CAST(f.frame_id // 3 + 1 AS BIGINT) AS t,
  CAST(m.r AS INTEGER) AS r, CAST(m.g AS INTEGER) AS g, CAST(m.b AS INTEGER) AS b, n_white,
  CAST(bx1 AS INTEGER) AS bx1, CAST(by1 AS INTEGER) AS by1, CAST(bx2 AS INTEGER) AS bx2, CAST(by2 AS INTEGER) AS by2,
  coalesce(lines, '') AS lines, CAST(px1 AS INTEGER) AS px1, CAST(py1 AS INTEGER) AS py1, CAST(px2 AS INTEGER) AS px2, CAST(py2 AS INTEGER) AS py2, playing, coalesce(classes, '') AS classes
FROM (SELECT DISTINCT frame_id FROM v_full) f
JOIN (
  SELECT frame_id, floor(avg(r) + 0.5) AS r, floor(avg(g) + 0.5) AS g, floor(avg(b) + 0.5) AS b,
    count(*) FILTER (WHERE 0.299 * r + 0.587 * g + 0.114 * b > 127.3) AS n_white
  FROM v_full GROUP BY frame_id) m USING (frame_id)
JOIN (
  SELECT frame_id, coalesce(min(x) FILTER (WHERE w AND x < 50 AND y < 30), 0) AS bx1, coalesce(min(y) FILTER (WHERE w AND x < 50 AND y < 30), 0) AS by1,
    coalesce(1 + max(x) FILTER (WHERE w AND x <= 50 AND y < 30), 0) AS bx2, coalesce(1 + max(y) FILTER (WHERE w AND x < 50 AND y <= 30), 0) AS by2
  FROM (SELECT *, r >= 155 AND g >= 155 AND b >= 155 AS w FROM v_full) GROUP BY frame_id) b USING (frame_id)
LEFT JOIN (
  SELECT frame_id, string_agg(concat(y, ':', n), ',' ORDER BY y) AS lines FROM (
    SELECT frame_id, i, min(y) AS y, count(*) AS n FROM (
      SELECT frame_id, y, y - row_number() OVER (PARTITION BY frame_id ORDER BY y) AS i FROM (
        SELECT frame_id, y, bool_or(c = 'w') AS w, bool_or(c = 'o') AS o, bool_or(c = 'b') AS b, bool_or(c = 'r') AS r FROM (
          SELECT frame_id, y, CASE WHEN r >= 175 AND g >= 175 AND b >= 175 THEN 'w' WHEN r >= 175 AND g BETWEEN 135 AND 295 AND b <= 80 THEN 'o'
            WHEN r <= 80 AND g <= 80 AND b >= 175 THEN 'b' WHEN r >= 175 AND g <= 80 AND b <= 80 THEN 'r' END AS c FROM v_full)
        GROUP BY frame_id, y)
      WHERE w AND ((coalesce(o, false) AND coalesce(b, false)) OR coalesce(r, false)))
    GROUP BY frame_id, i)
  WHERE y + n - 1 < 39 AND n BETWEEN 1 AND 9 GROUP BY frame_id) l USING (frame_id)
JOIN (
  SELECT e.frame_id, coalesce(min(q.x) FILTER (WHERE q.x > 0), 0) AS px1, e.y1 AS py1, coalesce(max(q.x), 0) AS px2, e.y2 AS py2 FROM (
    SELECT f.frame_id, coalesce(max(p.y) FILTER (WHERE NOT p.hit AND p.y <= v.fourth - 2), 0) AS y1, coalesce(v.bottom + 2, 0) AS y2
    FROM (SELECT DISTINCT frame_id FROM v_full) f
    LEFT JOIN (
      SELECT frame_id, max(CASE WHEN k = 1 THEN e END) AS bottom, max(CASE WHEN k = 4 THEN s END) AS fourth FROM (
        SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY e DESC) AS k FROM (
          SELECT frame_id, i, min(y) AS s, max(y) AS e FROM (
            SELECT frame_id, y, y - row_number() OVER (PARTITION BY frame_id ORDER BY y) AS i FROM v_full WHERE x = 30 AND r >= 100 AND g >= 60 AND b >= 60)
          GROUP BY ALL))
      GROUP BY frame_id) v ON v.frame_id = f.frame_id
    LEFT JOIN (SELECT frame_id, y, r >= 100 AND g >= 60 AND b >= 60 AS hit FROM v_full WHERE x = 30) p ON p.frame_id = f.frame_id
    GROUP BY f.frame_id, v.bottom) e
  LEFT JOIN (SELECT * FROM v_full WHERE x < 15 AND r >= 55 AND g >= 15 AND b >= 15) q ON q.frame_id = e.frame_id AND q.y = e.y1
  GROUP BY ALL) p USING (frame_id)
JOIN (
  SELECT frame_id, bool_and(anyone AND every) AS playing FROM (
    SELECT frame_id, side, bool_or(own) AS anyone, bool_and(own OR (r <= 250 AND g <= 250 AND b <= 250)) AS every FROM (
      SELECT *, abs(r - 200) <= 90 AND abs(g - 200) <= 90 AND abs(b - 200) <= 90 AS own
      FROM v_full JOIN (VALUES ('a', 5, 5), ('a', 10, 6), ('b', 20, 7), ('b', 30, 8)) AS s(side, x, y) USING (x, y))
    GROUP BY ALL) GROUP BY frame_id) g USING (frame_id)
LEFT JOIN (
  SELECT frame_id, string_agg(cls, ',' ORDER BY cls) AS classes
  FROM v_full JOIN (VALUES """ + ", ".join(f"('{c}', {x}, {y})" for c, (x, y) in CLASS_PROBES.items()) + """) AS s(cls, x, y) USING (x, y)
  WHERE least(r, g, b) >= 90 GROUP BY frame_id) c USING (frame_id)
"""


@query(sql("", "v_pixels").rstrip() + ", " + FULL + FEATURES_SQL)
def frame_features(spark, d):
    """Mean colour, white pixels, bright box, text runs, panel, players and matched templates of each frame, from one pass over its bytes."""
    found = frames.frame_features(frames_of(spark, d), SPEC)
    boxes = [F.col(f"{name}.{c}").alias(f"{short}{c}") for name, short in (("box", "b"), ("panel", "p")) for c in ("x1", "y1", "x2", "y2")]
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["y"].cast("string"), r["height"].cast("string"))), ",").alias("lines")
    classes = F.array_join(F.array_sort(F.map_keys("modes")), ",").alias("classes")
    return found.select("video_id", F.col("t").cast("long").alias("t"), "mean.r", "mean.g", "mean.b", "n_white", *boxes, lines, "playing", classes)


@query(sql("""
SELECT region, a.frame_id, count(*) AS n, CAST(sum(a.x - x1) AS BIGINT) AS sx, CAST(sum(a.y - y1) AS BIGINT) AS sy
FROM v_pixels a JOIN (
  SELECT frame_id, 'small' AS region, frame_id % 30 AS x1, frame_id % 20 AS y1, frame_id % 30 + 12 AS x2, frame_id % 20 + 9 AS y2 FROM (SELECT DISTINCT frame_id FROM v_pixels)
  UNION ALL SELECT frame_id, 'large', -5, frame_id % 7, 100000 + frame_id, 35 FROM (SELECT DISTINCT frame_id FROM v_pixels WHERE frame_id % 3 = 0)) g
ON a.frame_id = g.frame_id AND a.x >= x1 AND a.x < x2 AND a.y >= y1 AND a.y < y2 GROUP BY ALL""", "v_pixels"))
def crop_by_frame(spark, d):
    """Regions of single frames, some far larger than the frame."""
    own, f = V.pixels(spark, d), F.col("frame_id")
    ids = own.select("frame_id").distinct()
    box = lambda name, *sides: (F.lit(name).alias("region"), *(F.lit(s).cast("long").alias(c) if isinstance(s, int) else s.cast("long").alias(c) for s, c in zip(sides, ("x1", "y1", "x2", "y2"), strict=True)))
    small = ids.select("frame_id", *box("small", f % 30, f % 20, f % 30 + 12, f % 20 + 9))
    large = ids.where(f % 3 == 0).select("frame_id", *box("large", -5, f % 7, 100000 + f, 35))
    held = pixels.crop_regions(own, small.unionByName(large))
    return held.groupBy("region", "frame_id").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
