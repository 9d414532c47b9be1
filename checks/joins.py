"""Joins in space and time, and the keyed joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, hav, r
from epicell.fixtures import with_views
from epicell.operators.followups import elapsed_since_last, followup_exists, forward_label_join, forward_labels
from epicell.operators.lines import polyline_segments
from epicell.operators.nearest import (
    coastal_flag,
    nearest_centroid_attr,
    nearest_line_km,
    nearest_station,
    nearest_vertex_km,
)
from epicell.operators.neighbors import radius_join, window_neighbors

DAY = 86_400_000_000
AB = hav("a.latitude", "a.longitude", "b.latitude", "b.longitude")
# the plain distance join; the latitude test only spares trigonometry and follows from the distance
NEAR = f"abs(a.latitude - b.latitude) <= 1.8 AND {AB} <= 200"

# shared SQL pieces ---------------------------------------------------------
SEGMENTS = """, o AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS rn,
   lead(lat) OVER (PARTITION BY line_id ORDER BY seq) AS nlat, lead(lon) OVER (PARTITION BY line_id ORDER BY seq) AS nlon FROM line_vertices),
 segments AS (SELECT line_id, seq, lat AS lat_a, lon AS lon_a, coalesce(nlat, lat) AS lat_b, coalesce(nlon, lon) AS lon_b
   FROM o WHERE nlat IS NOT NULL OR rn = 1)"""


def mx(lon: str) -> str:
    return f"(radians({lon}) * 6378137.0::DOUBLE)"


def my(lat: str) -> str:
    return f"(ln(tan(pi() / 4 + radians({lat}) / 2)) * 6378137.0::DOUBLE)"


PLANE = f""", seg_m AS (SELECT line_id, {mx('lon_a')} AS ax, {my('lat_a')} AS ay, {mx('lon_b')} AS bx, {my('lat_b')} AS bby FROM segments),
 ev_m AS (SELECT event_id, {mx('longitude')} AS px, {my('latitude')} AS py FROM catalog)"""

SEG_DIST = """sqrt(pow(px - (ax + t * (bx - ax)), 2) + pow(py - (ay + t * (bby - ay)), 2))"""
# ---------------------------------------------------------------------------


# all pairs of the whole table; shown per left row, because the pairs themselves are many millions
@check(
    "radius_join",
    with_views("catalog")
    + f""", p AS (SELECT a.event_id AS left_id, b.event_id AS right_id, {AB} AS km FROM catalog a JOIN catalog b ON {NEAR})
    SELECT left_id, count(*) AS n_pairs, CAST(sum(right_id) AS BIGINT) AS sum_right, {r('round(avg(km), 4)')} AS mean_km, {r('max(km)')} AS max_km FROM p GROUP BY left_id""",
)
def _(t):
    pairs = radius_join(t.catalog, t.catalog)
    return pairs.groupBy("left_id").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.sum("right_id").alias("sum_right"),
        F.round(F.avg("distance_km"), 4).alias("mean_km"),
        F.max("distance_km").alias("max_km"),
    )


@check(
    "window_neighbors",
    with_views("catalog")
    + f"""SELECT a.event_id, b.event_id AS neighbor_id, a.event_us - b.event_us AS age_us, {r('b.magnitude')} AS neighbor_magnitude
    FROM catalog a JOIN catalog b ON b.event_us >= a.event_us - 90 * {DAY} AND b.event_us < a.event_us AND b.magnitude >= 4 AND {NEAR}
    WHERE a.magnitude >= 4""",
)
def _(t):
    return window_neighbors(t.catalog.where("magnitude >= 4"), t.catalog, 90)


@check(
    "forward_label_join",
    with_views("catalog")
    + f""", d AS (SELECT *, event_us // {DAY} AS dy FROM catalog)
    SELECT a.event_id, min(b.dy - a.dy) AS min_days FROM d a JOIN d b
      ON b.dy > a.dy AND b.dy <= a.dy + 365 AND CAST(b.magnitude AS FLOAT) >= 5 AND {NEAR} GROUP BY a.event_id""",
)
def _(t):
    return forward_label_join(t.catalog, t.catalog)


FORWARD_LABELS = (
    with_views("catalog")
    + f""", d AS (SELECT *, event_us // {DAY} AS dy FROM catalog),
    m AS (SELECT a.event_id, min(b.dy - a.dy) AS gap FROM d a JOIN d b
      ON b.dy > a.dy AND b.dy <= a.dy + 365 AND CAST(b.magnitude AS FLOAT) >= 5 AND {NEAR} GROUP BY a.event_id)"""
)


@check(
    "forward_labels",
    FORWARD_LABELS
    + f"""SELECT event_id, event_us, {r('latitude')} AS ref_lat, {r('longitude')} AS ref_lon,
      strftime(make_timestamp(event_us), '%Y-%m-%d') AS ref_date,
      CASE WHEN gap <= 7 THEN 1 ELSE 0 END AS label_7d, CASE WHEN gap <= 30 THEN 1 ELSE 0 END AS label_30d,
      CASE WHEN gap <= 365 THEN 1 ELSE 0 END AS label_365d FROM d LEFT JOIN m USING (event_id)""",
)
def _(t):
    return forward_labels(t.catalog)


@check(
    "followup_exists",
    with_views("catalog")
    + f""", s AS (SELECT *, event_us // 1000000 * 1000000 AS us FROM catalog),
    h AS (SELECT DISTINCT a.event_id FROM s a JOIN catalog b ON b.event_us >= a.us + 1000000 AND b.event_us <= a.us + 30 * {DAY}
      AND b.magnitude >= 5 AND {NEAR})
    SELECT event_id, event_id IN (SELECT event_id FROM h) AS has_followup FROM catalog""",
)
def _(t):
    return followup_exists(t.catalog, t.catalog, 30)


@check(
    "elapsed_since_last",
    with_views("catalog")
    + f""", m AS (SELECT a.event_id, max(b.event_us) AS last_us FROM catalog a JOIN catalog b
      ON b.event_us < a.event_us AND a.magnitude >= 4 AND b.magnitude >= 4 AND {NEAR} GROUP BY a.event_id)
    SELECT event_id, {r('(event_us - last_us) / 1000000')} AS elapsed_since_last_s
    FROM catalog LEFT JOIN m USING (event_id) WHERE magnitude >= 4""",
)
def _(t):
    return elapsed_since_last(t.catalog.where("magnitude >= 4"), t.catalog)


@check(
    "elapsed_since_last_live",
    with_views("catalog")
    + f""", m AS (SELECT a.event_id, max(b.event_us) AS last_us FROM catalog a JOIN catalog b
      ON b.event_us < a.event_us AND b.event_us >= a.event_us - 90 * {DAY} AND a.magnitude >= 4 AND b.magnitude >= 4 AND {NEAR} GROUP BY a.event_id)
    SELECT event_id, {r('(event_us - last_us) / 1000000')} AS elapsed_since_last_s
    FROM catalog LEFT JOIN m USING (event_id) WHERE magnitude >= 4""",
)
def _(t):
    return elapsed_since_last(t.catalog.where("magnitude >= 4"), t.catalog, lookback_days=90)


STATION_DIST = hav("e.latitude", "e.longitude", "s.lat", "s.lon")
NEAREST_STATION = f""", st AS (SELECT * FROM stations WHERE quality IN ('A', 'B', 'C') AND lat IS NOT NULL AND lon IS NOT NULL AND azi IS NOT NULL),
    n AS (SELECT e.event_id, arg_min(s, (round(d, 9), s.station_id)) AS s, min(d) AS d FROM
      (SELECT e.event_id, s, {STATION_DIST} AS d FROM catalog e, st s) e GROUP BY e.event_id)"""


@check(
    "nearest_station",
    with_views("catalog", "stations")
    + NEAREST_STATION
    + f"""SELECT event_id,
      CASE WHEN d > 500 THEN 4 ELSE CASE trim(s.regime) WHEN 'NF' THEN 0 WHEN 'TF' THEN 1 WHEN 'SS' THEN 2 WHEN 'NS' THEN 3 WHEN 'TS' THEN 3 ELSE 4 END END AS stress_regime_enc,
      {r('CASE WHEN d > 500 THEN 0 ELSE sin(radians(s.azi)) END')} AS shmax_sin,
      {r('CASE WHEN d > 500 THEN 0 ELSE cos(radians(s.azi)) END')} AS shmax_cos,
      CASE WHEN d > 500 THEN 0 ELSE CASE s.quality WHEN 'A' THEN 4 WHEN 'B' THEN 3 ELSE 2 END END AS wsm_quality_enc,
      {r('d')} AS wsm_dist_km FROM n""",
)
def _(t):
    return nearest_station(t.catalog, t.stations)


VERTEX_DIST = hav("e.latitude", "e.longitude", "v.lat", "v.lon")


@check(
    "nearest_vertex_km",
    with_views("catalog", "line_vertices")
    + f"""SELECT e.event_id, {r(f'min({VERTEX_DIST})')} AS dist_to_plate_boundary_km FROM catalog e, line_vertices v GROUP BY e.event_id""",
)
def _(t):
    return nearest_vertex_km(t.catalog, t.line_vertices)


CHORD = (
    "sqrt(pow(cos(radians(e.latitude)) * cos(radians(e.longitude)) - cos(radians(v.lat)) * cos(radians(v.lon)), 2)"
    " + pow(cos(radians(e.latitude)) * sin(radians(e.longitude)) - cos(radians(v.lat)) * sin(radians(v.lon)), 2)"
    " + pow(sin(radians(e.latitude)) - sin(radians(v.lat)), 2))"
)


@check(
    "nearest_vertex_km_chord",
    with_views("catalog", "line_vertices")
    + f"""SELECT e.event_id, {r(f'round(2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, min({CHORD}) / 2)), 2)')} AS dist_fault_km
      FROM catalog e, line_vertices v GROUP BY e.event_id""",
)
def _(t):
    return nearest_vertex_km(t.catalog, t.line_vertices, "dist_fault_km", two_decimals=True)


@check(
    "coastal_flag",
    with_views("catalog", "line_vertices")
    + f"""SELECT e.event_id, CASE WHEN round(min({VERTEX_DIST}), 2) < 100 THEN 1 ELSE 0 END AS "IsCoastal" FROM catalog e, line_vertices v GROUP BY e.event_id""",
)
def _(t):
    return coastal_flag(t.catalog, t.line_vertices)


@check(
    "polyline_segments",
    with_views("line_vertices")
    + SEGMENTS
    + f"SELECT line_id, seq, {r('lat_a')} AS lat_a, {r('lon_a')} AS lon_a, {r('lat_b')} AS lat_b, {r('lon_b')} AS lon_b FROM segments",
)
def _(t):
    return polyline_segments(t.line_vertices)


@check(
    "nearest_line_km",
    with_views("catalog", "line_vertices")
    + SEGMENTS
    + PLANE
    + f""", p AS (SELECT event_id, px, py, ax, ay, bx, bby, coalesce(greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (bby - ay))
        / nullif(pow(bx - ax, 2) + pow(bby - ay, 2), 0))), 0) AS t FROM ev_m, seg_m)
    SELECT event_id, {r(f'min({SEG_DIST}) / 1000')} AS dist_km FROM p GROUP BY event_id""",
)
def _(t):
    return nearest_line_km(t.catalog, polyline_segments(t.line_vertices))


NEAREST_CENTROID = """, l AS (SELECT *, sqrt(pow(bx - ax, 2) + pow(bby - ay, 2)) AS len FROM seg_m),
    c AS (SELECT line_id, coalesce(sum(len * (ax + bx) / 2) / nullif(sum(len), 0), avg((ax + bx) / 2)) AS cx,
      coalesce(sum(len * (ay + bby) / 2) / nullif(sum(len), 0), avg((ay + bby) / 2)) AS cy FROM l GROUP BY line_id),
    n AS (SELECT event_id, arg_min(line_id, (round(sqrt(pow(px - cx, 2) + pow(py - cy, 2)), 3), line_id)) AS line_id FROM ev_m, c GROUP BY event_id),
    ty AS (SELECT DISTINCT line_id, slip_type FROM line_vertices)"""
SLIP_CASE = """CASE lower(trim(slip_type)) WHEN 'normal' THEN 1 WHEN 'reverse' THEN 2 WHEN 'thrust' THEN 2 WHEN 'blind thrust' THEN 2
      WHEN 'strike-slip' THEN 3 WHEN 'sinistral' THEN 3 WHEN 'dextral' THEN 3 WHEN 'oblique' THEN 4 ELSE 0 END"""


@check(
    "nearest_centroid_attr",
    with_views("catalog", "line_vertices")
    + SEGMENTS
    + PLANE
    + NEAREST_CENTROID
    + f"SELECT event_id, {SLIP_CASE} AS fault_slip_type_enc FROM n JOIN ty USING (line_id)",
)
def _(t):
    types = t.line_vertices.select("line_id", "slip_type").distinct()
    return nearest_centroid_attr(t.catalog, polyline_segments(t.line_vertices), types)
