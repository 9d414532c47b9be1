"""Nearest-object search without comparing every event with every object.

Events are mapped to small query cells, whose number is bounded by the size of the globe.
For each query cell a bound on the distance to its nearest object comes from the occupied
cells around it, looked for on the finest of several grids that has one in reach. All
objects that can be nearest to any point of the query cell lie within that bound plus the
cell's diameter (triangle inequality), so the candidates per query cell are few and exact.
Everything is an equi-join on integer keys; Spark chooses the strategy by measured size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicell.constants import COAST_KM, STATION_MAX_KM
from epicell.functions.encodings import azimuth_sin_cos, encode_quality, encode_regime, encode_slip
from epicell.functions.geo import (
    chord_sq,
    chord_to_km,
    haversine_km,
    point_segment_dist_m,
    unit_xyz,
    web_mercator,
)
from epicell.operators.cells import cell_center, cell_reach_km, explode_cover, home_cell
from epicell.session import settle

MAX_CELLS_PER_OBJECT = 64
# candidates of a query cell that an event meets in one row
LIST_ROWS = 512


class SphereGrid:
    """Points on the sphere; distances in kilometres. Points are (a, b) = (lat, lon)."""

    query_size = 0.25
    # grids from fine to coarse as (cell size, how far to look); the last look covers everything
    levels = ((0.5, 60.0), (2.0, 250.0), (8.0, 1000.0), (30.0, 4000.0))
    far = 20_100.0

    def cell(self, a: Column, b: Column, size: float | Column) -> Column:
        return home_cell(a, b, size)

    def center(self, cell: Column, size: float | Column) -> tuple[Column, Column]:
        return cell_center(cell, size)

    def reach(self, cell: Column, size: float | Column) -> Column:
        return cell_reach_km(cell, size)

    def cover(self, df: DataFrame, radius: Column, size: Column) -> DataFrame:
        return explode_cover(df, "qa", "qb", radius, size)

    def gap(self, a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
        return haversine_km(a1, b1, a2, b2)


class PlaneGrid:
    """The web-mercator plane; distances in metres. Points are (a, b) = (x, y); no wrapping."""

    query_size = 25_000.0
    levels = ((50_000.0, 60_000.0), (250_000.0, 300_000.0), (1_250_000.0, 1_500_000.0), (6_250_000.0, 7_500_000.0))
    far = 4.0e8
    stride = 1_000_000
    offset = 500_000

    def key(self, i: Column, j: Column) -> Column:
        return (i + self.offset) * self.stride + (j + self.offset)

    def cell(self, a: Column, b: Column, size: float | Column) -> Column:
        return self.key(F.floor(a / size), F.floor(b / size))

    def center(self, cell: Column, size: float | Column) -> tuple[Column, Column]:
        i = F.floor(cell / self.stride) - self.offset
        j = F.pmod(cell, F.lit(self.stride)) - self.offset
        return (i + 0.5) * size, (j + 0.5) * size

    def reach(self, cell: Column, size: float | Column) -> Column:
        return (size if isinstance(size, Column) else F.lit(size)) * math.sqrt(0.5) + 1e-3

    def box(self, df: DataFrame, low: tuple[Column, Column], high: tuple[Column, Column], size: Column) -> DataFrame:
        boxed = df.withColumn("box_i", F.explode(F.sequence(F.floor(low[0] / size), F.floor(high[0] / size))))
        boxed = boxed.withColumn("box_j", F.explode(F.sequence(F.floor(low[1] / size), F.floor(high[1] / size))))
        return boxed.withColumn("cell", self.key(F.col("box_i"), F.col("box_j"))).drop("box_i", "box_j")

    def cover(self, df: DataFrame, radius: Column, size: Column) -> DataFrame:
        a, b, r = F.col("qa"), F.col("qb"), radius + 1.0
        return self.box(df, (a - r, b - r), (a + r, b + r), size)

    def gap(self, a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
        return F.hypot(a1 - a2, b1 - b2)


def _per_level(grid, df: DataFrame) -> DataFrame:
    """Each row once per grid, with level, size and look."""
    grids = [
        F.struct(F.lit(k).alias("level"), F.lit(size).alias("size"), F.lit(look).alias("look"))
        for k, (size, look) in enumerate(grid.levels)
    ]
    return df.withColumn("grid", F.explode(F.array(*grids))).select("*", "grid.*").drop("grid")


def _everywhere(grid, df: DataFrame) -> DataFrame:
    """Each row in the one cell of the level that covers everything."""
    return df.withColumns({"level": F.lit(len(grid.levels)), "cell": F.lit(0).cast("bigint")})


def _placed(grid, objects: DataFrame, box: tuple[str, str, str, str] | None) -> DataFrame:
    """Objects under their (level, cell, own) keys.

    A point lies in one cell of each level. A long object joins the levels on which its box
    is small; `own` marks the first of them, through which finer searches find it.
    """
    if box is None:
        at = grid.cell(F.col("oa"), F.col("ob"), F.col("size"))
        near = _per_level(grid, objects).withColumn("cell", at).drop("size", "look")
        return near.unionByName(_everywhere(grid, objects)).withColumn("own", F.lit(False))

    a1, b1, a2, b2 = (F.col(c) for c in box)
    low = (F.least(a1, a2), F.least(b1, b2))
    high = (F.greatest(a1, a2), F.greatest(b1, b2))

    def cells(size: float) -> Column:
        across = [F.floor(h / size) - F.floor(w / size) + 1 for w, h in zip(low, high)]
        return across[0] * across[1]

    own = F.lit(len(grid.levels))
    for k, (size, _) in reversed(list(enumerate(grid.levels))):
        own = F.when(cells(size) <= MAX_CELLS_PER_OBJECT, k).otherwise(own)
    known = objects.withColumn("own_level", own)
    near = _per_level(grid, known).where(F.col("own_level") <= F.col("level"))
    near = grid.box(near, low, high, F.col("size")).drop("size", "look")
    both = near.unionByName(_everywhere(grid, known))
    first_here = F.col("own_level") == F.col("level")
    kinds = F.when(first_here, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return both.withColumn("own", F.explode(kinds)).drop("own_level")


def candidates(
    grid, queries: DataFrame, objects: DataFrame, distance: Column, box: tuple[str, str, str, str] | None = None
) -> DataFrame:
    """(qcell, lists, object columns): all objects that can be nearest to some point of the query cell, and how many
    lists of about LIST_ROWS they fill.

    `queries` has `qcell`; `objects` has an anchor point (oa, ob) and, when extended, the four
    corner columns of `box`. `distance` is the exact distance of (qa, qb) to an object.
    """
    far_level = len(grid.levels)
    qa, qb = grid.center(F.col("qcell"), grid.query_size)
    cells = queries.select("qcell").distinct().select(
        "qcell", qa.alias("qa"), qb.alias("qb"), grid.reach(F.col("qcell"), grid.query_size).alias("q_reach")
    )
    # step 1: an upper bound of the distance from the centre, on the finest level with a cell in reach
    at = grid.cell(F.col("oa"), F.col("ob"), F.col("size"))
    occupied = _per_level(grid, objects.select("oa", "ob")).select("level", at.alias("cell")).distinct()
    around = grid.cover(_per_level(grid, cells), F.col("look"), F.col("size"))
    seen = around.join(occupied, ["level", "cell"])
    ca, cb = grid.center(F.col("cell"), F.col("size"))
    bound = grid.gap(F.col("qa"), F.col("qb"), ca, cb) + grid.reach(F.col("cell"), F.col("size"))
    query = ["qcell", "qa", "qb", "q_reach"]
    bounds = seen.select(*query, "level", bound.alias("bound")).unionByName(
        _everywhere(grid, cells).select(*query, "level", F.lit(grid.far).alias("bound"))
    )
    best = bounds.groupBy(*query).agg(F.min(F.struct("level", "bound")).alias("best"))
    radius = F.col("best.bound") + F.col("q_reach") * 2
    aimed = best.select("qcell", "qa", "qb", "q_reach", F.col("best.level").alias("aim"), radius.alias("radius"))
    # step 2: everything within that bound, from the level aimed at; objects too long for it
    # from the level on which they first appear
    looks = grid.cover(_per_level(grid, aimed).where(F.col("aim") <= F.col("level")), F.col("radius"), F.col("size"))
    looks = looks.drop("size", "look").unionByName(_everywhere(grid, aimed))
    looks = looks.withColumn("own", F.col("aim") < F.col("level"))
    if box is None:
        looks = looks.where(~F.col("own"))
    found = looks.join(_placed(grid, objects, box), ["level", "cell", "own"])
    found = found.where(distance <= F.col("radius"))
    found = found.select("qcell", "q_reach", distance.alias("from_center"), *objects.columns)
    # a box meets several cells of a look
    found = found if box is None else found.distinct()
    # written once: read twice below, and its true size decides how the events are joined with it
    found = settle(found, "candidates")
    # step 3: the bound was for cells, the nearest object itself is closer
    lists = F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("lists")
    closest = found.groupBy("qcell").agg(F.min("from_center").alias("closest"), lists)
    kept = found.join(closest, "qcell").where(F.col("from_center") <= F.col("closest") + F.col("q_reach") * 2)
    return kept.select("qcell", "lists", *objects.columns)


def _closest(
    events: DataFrame, found: DataFrame, gap: Callable[[Column, Column], Column], payload: Sequence[str], carry: Sequence[str]
) -> DataFrame:
    """One row per event: the closest candidate, ties by payload order (the id comes first). `gap` is the distance to
    a candidate at (oa, ob).

    An event meets the candidates of its cell as lists and keeps the best of each, so what is sorted by event grows with
    the events and not with the pairs. An event without a candidate, because there is no object or it has no
    place, keeps a row of NULLs.
    """
    columns = [c for c in found.columns if c not in ("qcell", "lists")]
    dealt = F.pmod(F.xxhash64(*columns), F.col("lists"))
    near = found.groupBy("qcell", dealt.alias("list")).agg(F.collect_list(F.struct(*columns)).alias("near"))
    joined = events.join(near.drop("list"), "qcell", "left")
    ranked = F.transform("near", lambda o: F.struct(gap(o["oa"], o["ob"]).alias("gap"), *[o[c].alias(c) for c in payload]))
    first = joined.select(*carry, F.array_min(ranked).alias("first"))
    best = F.min(F.struct(*[F.col("first")[c].alias(c) for c in ("gap", *payload)])).alias("best")
    return first.groupBy(*carry).agg(best).select(*carry, "best.*")


def _sphere_events(events: DataFrame) -> DataFrame:
    q = home_cell(F.col("latitude"), F.col("longitude"), SphereGrid.query_size)
    return events.select("event_id", "latitude", "longitude", q.alias("qcell"))


def _plane_events(events: DataFrame) -> DataFrame:
    x, y = web_mercator(F.col("longitude"), F.col("latitude"))
    placed = events.select("event_id", x.alias("ex"), y.alias("ey"))
    return placed.withColumn("qcell", PlaneGrid().cell(F.col("ex"), F.col("ey"), PlaneGrid.query_size))


def nearest_point(events: DataFrame, points: DataFrame, payload: Sequence[str]) -> DataFrame:
    """(event_id, gap in km, payload) of the nearest point; `points` has oa = lat, ob = lon."""
    grid = SphereGrid()
    placed = _sphere_events(events)
    found = candidates(grid, placed, points, haversine_km(F.col("qa"), F.col("qb"), F.col("oa"), F.col("ob")))
    return _closest(placed, found, lambda a, b: haversine_km(F.col("latitude"), F.col("longitude"), a, b), payload, ["event_id"])


def usable_stations(stations: DataFrame) -> DataFrame:
    """Quality A, B or C with a place and an azimuth."""
    return stations.where(F.col("quality").isin("A", "B", "C")).dropna(subset=["lat", "lon", "azi"])


def nearest_station(events: DataFrame, stations: DataFrame, max_km: float = STATION_MAX_KM) -> DataFrame:
    """Stress state of the nearest usable station; beyond `max_km` the defaults, but the true distance."""
    # copies of a station at one place can never be told apart by distance: keep the first
    points = usable_stations(stations).groupBy(F.col("lat").alias("oa"), F.col("lon").alias("ob")).agg(
        F.min(F.struct("station_id", "azi", "regime", "quality")).alias("s")
    )
    points = points.select("oa", "ob", "s.*")
    best = nearest_point(events, points, ["station_id", "azi", "regime", "quality"])
    near = F.coalesce(F.col("gap") <= max_km, F.lit(False))
    azi_sin, azi_cos = azimuth_sin_cos(F.col("azi"))
    return best.select(
        "event_id",
        F.when(near, encode_regime(F.col("regime"))).otherwise(F.lit(4)).alias("stress_regime_enc"),
        F.when(near, azi_sin).otherwise(F.lit(0.0)).alias("shmax_sin"),
        F.when(near, azi_cos).otherwise(F.lit(0.0)).alias("shmax_cos"),
        F.when(near, encode_quality(F.col("quality"))).otherwise(F.lit(0)).alias("wsm_quality_enc"),
        F.col("gap").alias("wsm_dist_km"),
    )


def nearest_vertex_km(
    events: DataFrame, vertices: DataFrame, name: str = "dist_to_plate_boundary_km", two_decimals: bool = False
) -> DataFrame:
    """Great-circle distance to the nearest vertex. `two_decimals` is the chord variant."""
    points = vertices.select(F.col("lat").alias("oa"), F.col("lon").alias("ob")).dropna().distinct()
    best = nearest_point(events, points, ["oa", "ob"])
    if not two_decimals:
        return best.select("event_id", F.col("gap").alias(name))
    back = events.select("event_id", "latitude", "longitude").join(best, "event_id")
    chord = F.sqrt(
        chord_sq(unit_xyz(F.col("latitude"), F.col("longitude")), unit_xyz(F.col("oa"), F.col("ob")))
    )
    return back.select("event_id", F.round(chord_to_km(chord), 2).alias(name))


def coastal_flag(events: DataFrame, coast: DataFrame) -> DataFrame:
    """1 when the nearest coast vertex is closer than 100 km (on the two-decimal distance)."""
    near = nearest_vertex_km(events, coast, "coast_km", two_decimals=True)
    return near.select("event_id", F.coalesce((F.col("coast_km") < COAST_KM).cast("int"), F.lit(0)).alias("IsCoastal"))


def _plane_segments(segments: DataFrame) -> DataFrame:
    ax, ay = web_mercator(F.col("lon_a"), F.col("lat_a"))
    bx, by = web_mercator(F.col("lon_b"), F.col("lat_b"))
    return segments.select("line_id", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))


def nearest_line_km(events: DataFrame, segments: DataFrame, name: str = "dist_km") -> DataFrame:
    """Planar web-mercator distance to the union of all lines, in kilometres."""
    grid = PlaneGrid()
    corners = ("ax", "ay", "bx", "by")
    objects = _plane_segments(segments).select(*corners).distinct()
    objects = objects.withColumn("oa", F.col("ax")).withColumn("ob", F.col("ay"))
    placed = _plane_events(events)
    ends = [F.col(c) for c in corners]
    found = candidates(grid, placed, objects, point_segment_dist_m(F.col("qa"), F.col("qb"), *ends), corners)
    gap = point_segment_dist_m(F.col("ex"), F.col("ey"), *ends)
    # only the distance is wanted: a plain minimum aggregates in hash form
    joined = placed.join(found.withColumn("found", F.lit(True)), "qcell", "left")
    best = joined.groupBy("event_id").agg(F.min(F.when(F.col("found"), gap)).alias("gap"))
    return best.select("event_id", (F.col("gap") / 1000.0).alias(name))


def line_centroids(segments: DataFrame) -> DataFrame:
    """Length-weighted centroid per line in the plane; a line without length is its point."""
    ends = _plane_segments(segments)
    length = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    mid_x, mid_y = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    total = F.sum(length)
    return ends.groupBy("line_id").agg(
        F.coalesce(F.try_divide(F.sum(length * mid_x), total), F.avg(mid_x)).alias("oa"),
        F.coalesce(F.try_divide(F.sum(length * mid_y), total), F.avg(mid_y)).alias("ob"),
    )


def nearest_centroid_attr(
    events: DataFrame, segments: DataFrame, line_types: DataFrame, name: str = "fault_slip_type_enc"
) -> DataFrame:
    """Slip code of the line whose centroid is nearest in the plane. `line_types`: line_id, slip_type."""
    grid = PlaneGrid()
    objects = line_centroids(segments)
    placed = _plane_events(events)
    found = candidates(grid, placed, objects, F.hypot(F.col("qa") - F.col("oa"), F.col("qb") - F.col("ob")))
    best = _closest(placed, found, lambda a, b: F.hypot(F.col("ex") - a, F.col("ey") - b), ["line_id"], ["event_id"])
    coded = line_types.select("line_id", encode_slip(F.col("slip_type")).alias(name))
    return best.join(coded, "line_id", "left").select("event_id", F.coalesce(F.col(name), F.lit(0)).alias(name))
