"""Distance and time-window joins as equi-joins on (cell, time bucket).

Spark plans a bare distance predicate as a nested loop. Here the right side gets one
home cell per row, the left side is expanded to the cells its disc meets, a bounded time
span adds a bucket key, and the exact predicates run on the candidates. The result is
exact: every true pair is found once, because the right row has one home cell and bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicell.constants import DAY_US, MIN_MAG_WINDOW, RADIUS_KM
from epicell.functions.geo import chord_sq, chord_to_km, km_to_chord, unit_xyz
from epicell.functions.timeparse import floor_div
from epicell.operators.cells import cell_center, cell_reach_km, explode_cover, home_cell
from epicell.session import settle

CELL_DEG = 2.0
# a (cell, bucket) block is cut once either side has more rows than this
BLOCK_ROWS = 100_000
# the same where every pair of a block is a row of the result: a tile is at most the square of this many pairs
PAIR_BLOCK_ROWS = 10_000
# right rows that a left row meets as one list
LIST_ROWS = 512


@dataclass(frozen=True)
class TimeSpan:
    """right - left must lie in [lo, hi] (or [lo, hi) when `hi_open`), in integer units."""

    left: str
    right: str
    lo: int
    hi: int
    hi_open: bool = False
    # a bucket is so many spans long
    spans: int = 1

    @property
    def width(self) -> int:
        return max(1, (self.hi - self.lo) * self.spans)

    def left_buckets(self) -> Column:
        last = self.hi - 1 if self.hi_open else self.hi
        left = F.col(self.left)
        return F.sequence(floor_div(left + self.lo, self.width), floor_div(left + last, self.width))

    def right_bucket(self) -> Column:
        return floor_div(F.col(self.right), self.width)

    def holds(self) -> Column:
        gap = F.col(self.right) - F.col(self.left)
        upper = gap < self.hi if self.hi_open else gap <= self.hi
        return (gap >= self.lo) & upper


def near_pairs(
    left: DataFrame,
    right: DataFrame,
    left_at: tuple[str, str],
    right_at: tuple[str, str],
    km: float = RADIUS_KM,
    span: TimeSpan | None = None,
    deg: float = CELL_DEG,
    listed: bool = False,
    distance: str | None = None,
) -> DataFrame:
    """All pairs within `km` (and within the time span); column names of the sides must differ.

    `listed` is for sides without a time span, where most rows of a block are pairs: a left row meets lists of right
    rows, which costs less a pair than to join the rows, and blocks are cut smaller and not merged into few tasks; the
    right rows should differ. `distance` names a column for the kilometres of a pair.

    Hot (cell, bucket) blocks are counted and cut in both directions, at every size of the input. The
    left side is then dealt out by block: a block is a bounded number of pairs, so the pairs of
    a small input are not left to the one task that would read it.
    """
    l_xyz = dict(zip(("l_x", "l_y", "l_z"), unit_xyz(*[F.col(c) for c in left_at])))
    r_xyz = dict(zip(("r_x", "r_y", "r_z"), unit_xyz(*[F.col(c) for c in right_at])))

    smaller = {"block_rows": PAIR_BLOCK_ROWS} if listed else {}
    l_keyed, r_keyed, keys = in_blocks(left, right, left_at, right_at, km, span, deg, **smaller)
    r_keyed = r_keyed.withColumns(r_xyz)
    # the repeated side is dealt out without its vectors, which are made from the place where it arrives
    l_keyed = (l_keyed.repartition(tasks(left), *keys) if listed else l_keyed.repartition(*keys)).withColumns(l_xyz)

    limit = km_to_chord(km) ** 2
    gap = chord_sq(
        (F.col("l_x"), F.col("l_y"), F.col("l_z")),
        (F.col("r_x"), F.col("r_y"), F.col("r_z")),
    )
    if listed:
        # dealt as well: whichever side the runtime may broadcast, the other one stays in many tasks
        lists = in_lists(r_keyed, keys).repartition(tasks(left), *keys)
        pairs = l_keyed.join(lists, keys).select("*", F.inline("near")).drop("near")
    else:
        pairs = l_keyed.join(r_keyed, keys)
    pairs = pairs.where(gap <= limit)
    if distance is not None:
        pairs = pairs.withColumn(distance, chord_to_km(F.sqrt(gap)))
    if span is not None:
        pairs = pairs.where(span.holds())
    return pairs.drop("l_x", "l_y", "l_z", "r_x", "r_y", "r_z", *keys)


def in_blocks(
    left: DataFrame,
    right: DataFrame,
    left_at: tuple[str, str],
    right_at: tuple[str, str],
    km: float,
    span: TimeSpan | None,
    deg: float = CELL_DEG,
    **cut: int,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides under the keys of their blocks, hot blocks cut: rows within `km` and the span meet in exactly one.

    A left row is repeated only for cells that have a right row. Their number is bounded by the globe; they are written
    first, so Spark knows how few they are.
    """
    keys = ["cell"]
    r_keyed = right.withColumn("cell", home_cell(*[F.col(c) for c in right_at], deg))
    if span is not None:
        r_keyed = r_keyed.withColumn("bucket", span.right_bucket())
        keys.append("bucket")
    right_rows = settle(r_keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), "block-rows")
    occupied = settle(right_rows.select("cell").distinct(), "occupied-cells")
    l_keyed = explode_cover(left, *left_at, km, deg).join(occupied, "cell", "left_semi")
    if span is not None:
        l_keyed = l_keyed.withColumn("bucket", F.explode(span.left_buckets()))
    left_rows = rows_at_most(left, left_at, km, span, deg)
    return cut_hot_blocks(l_keyed, r_keyed, keys, left_rows=left_rows, right_rows=right_rows, **cut)


def tasks(df: DataFrame) -> int:
    """Partitions for few bytes with much work: several for each core. A given number is not merged by size."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def in_lists(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, near): the rows of every key, dealt to lists of about LIST_ROWS."""
    columns = [c for c in rows.columns if c not in keys]
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / LIST_ROWS).alias("lists"))
    # not the hash by which a block was cut
    dealt = F.pmod(F.xxhash64(F.lit("list"), *columns), F.col("lists"))
    near = F.collect_list(F.struct(*columns)).alias("near")
    return rows.join(sizes, keys).groupBy(*keys, dealt.alias("list")).agg(near).drop("list")


def rows_at_most(left: DataFrame, left_at: tuple[str, str], km: float, span: TimeSpan | None, deg: float) -> DataFrame:
    """(cell, bucket, rows): an upper bound of the left rows that a block gets, without repeating the rows.

    Rows are counted by home cell and bucket, and each count is given to all blocks that a row of that home could
    reach.
    """
    homes = {"home": home_cell(*[F.col(c) for c in left_at], deg)}
    if span is not None:
        homes["home_bucket"] = floor_div(F.col(span.left), span.width)
    counts = left.select(*[v.alias(k) for k, v in homes.items()]).groupBy(*homes).agg(F.count(F.lit(1)).alias("rows"))
    lat, lon = cell_center(F.col("home"), deg)
    reach = cell_reach_km(F.col("home"), deg) + km
    spread = explode_cover(counts.withColumns({"at_lat": lat, "at_lon": lon, "at_km": reach}), "at_lat", "at_lon", F.col("at_km"), deg)
    keys = ["cell"]
    if span is not None:
        first = F.col("home_bucket") * span.width
        last = first + span.width - 1 + (span.hi - 1 if span.hi_open else span.hi)
        spread = spread.withColumn("bucket", F.explode(F.sequence(floor_div(first + span.lo, span.width), floor_div(last, span.width))))
        keys.append("bucket")
    return spread.groupBy(*keys).agg(F.sum("rows").alias("rows"))


def cut_hot_blocks(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    block_rows: int = BLOCK_ROWS,
    left_rows: DataFrame | None = None,
    right_rows: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cut every block with too many rows into a grid of (left part, right part) tiles.

    Each left row goes to one left part and is repeated for all right parts, and the other
    way round, so each pair still meets in exactly one tile. Block counts are partial sums; `left_rows` and `right_rows`
    (keys, rows) may bring them or bounds of them, since a block that is cut too finely still is right.
    Only blocks that need cutting are kept. They are written first: Spark then knows how few they
    are, and does not shuffle a side by the very key that is to be cut.
    """

    def sized(df: DataFrame, rows: DataFrame | None, name: str) -> DataFrame:
        rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")) if rows is None else rows
        return rows.select(*keys, F.ceil(F.col("rows") / block_rows).cast("int").alias(name))

    hot = (
        sized(left, left_rows, "l_parts")
        .join(sized(right, right_rows, "r_parts"), keys)
        .where((F.col("l_parts") > 1) | (F.col("r_parts") > 1))
    )
    hot = settle(hot, "hot-blocks")

    def parts(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(1))

    def tile(df: DataFrame, own: str, other: str, own_part: str, other_part: str) -> DataFrame:
        spread = F.abs(F.xxhash64(*[F.col(c) for c in df.columns]))
        return (
            df.withColumn("spread", spread)
            .join(hot, keys, "left")
            .withColumn(own_part, F.pmod(F.col("spread"), parts(own)).cast("int"))
            .withColumn(other_part, F.explode(F.sequence(F.lit(0), parts(other) - 1)))
            .drop("spread", "l_parts", "r_parts")
        )

    l_tiled = tile(left, "l_parts", "r_parts", "l_part", "r_part")
    r_tiled = tile(right, "r_parts", "l_parts", "r_part", "l_part")
    return l_tiled, r_tiled, keys + ["l_part", "r_part"]


def radius_join(left: DataFrame, right: DataFrame, km: float = RADIUS_KM) -> DataFrame:
    """(left_id, right_id, distance_km) for all pairs within `km`; the self pair is included.

    The pairs are the result, so it grows with the square of a dense region: `radius_count` counts
    them without making them.
    """
    a = left.select(
        F.col("event_id").alias("left_id"), F.col("latitude").alias("l_lat"), F.col("longitude").alias("l_lon")
    )
    b = right.select(
        F.col("event_id").alias("right_id"), F.col("latitude").alias("r_lat"), F.col("longitude").alias("r_lon")
    )
    # equal rows are told apart, or they would all be dealt to one list
    copies = b.groupBy(*b.columns).agg(F.count(F.lit(1)).alias("copies"))
    b = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")
    pairs = near_pairs(a, b, ("l_lat", "l_lon"), ("r_lat", "r_lon"), km, listed=True, distance="distance_km")
    return pairs.select("left_id", "right_id", "distance_km")


def window_neighbors(
    targets: DataFrame,
    catalog: DataFrame,
    days: int,
    min_mag: float = MIN_MAG_WINDOW,
    km: float = RADIUS_KM,
) -> DataFrame:
    """Pairs with t - days <= t_neighbor < t: closed below, open above, so ties and self are out.

    The pairs are the result; `window_features` aggregates them where they are found.
    """
    a = targets.select(
        F.col("event_id").alias("event_id"),
        F.col("event_us").alias("t_us"),
        F.col("latitude").alias("l_lat"),
        F.col("longitude").alias("l_lon"),
    )
    b = catalog.where(F.col("magnitude") >= min_mag).select(
        F.col("event_id").alias("neighbor_id"),
        F.col("event_us").alias("n_us"),
        F.col("magnitude").alias("neighbor_magnitude"),
        F.col("latitude").alias("r_lat"),
        F.col("longitude").alias("r_lon"),
    )
    span = TimeSpan("t_us", "n_us", -days * DAY_US, 0, hi_open=True)
    pairs = near_pairs(a, b, ("l_lat", "l_lon"), ("r_lat", "r_lon"), km, span)
    return pairs.select("event_id", "neighbor_id", (F.col("t_us") - F.col("n_us")).alias("age_us"), "neighbor_magnitude")

