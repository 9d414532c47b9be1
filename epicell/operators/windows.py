"""Neighbourhood window features.

One join serves all windows and all event families. Before the join, rows at the same
place and instant collapse into one weighted row on both sides (copies of an event never
meet each other). Both sides are dealt to blocks of cell and time, and a block is compared as arrays
(`block_sums`), so no pair is a row: it falls into the smallest window that holds it, mergeable statistics come out
per (target, window class), and the windows are accumulated from the at most four classes of a target.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, StructField, StructType

from epicell.constants import (
    DAY_US,
    M2_FIRST_YEAR,
    M2_WINDOWS_DAYS,
    MIN_MAG_ROLLING,
    MIN_MAG_WINDOW,
    RADIUS_KM,
    SECOND_US,
    WINDOWS_DAYS,
)
from epicell.functions.geo import km_to_chord, unit_xyz
from epicell.functions.seismic import (
    MOMENT_FACTOR,
    b_value_fixed_from_stats,
    b_value_from_stats,
    energy_term,
)
from epicell.functions.timeparse import year_of_us
from epicell.operators.block_sums import block_sums
from epicell.operators.neighbors import TimeSpan, in_blocks
from epicell.session import settle

# spread is summed around these values, which keeps the squares small
MAG_SHIFT = 5.0
DEPTH_SHIFT = 100.0

AT = ("at_lat", "at_lon", "at_us")
# time buckets are so many windows long: within a block only the window of a spot is looked at, so a longer bucket
# costs no comparisons, and fewer spots lie across two
BUCKET_SPANS = 4

MERGE = {
    "n": F.sum,
    "mag_sum": F.sum,
    "mag_sq": F.sum,
    "mag_max": F.max,
    "mag_min": F.min,
    "energy": F.sum,
    "depth_n": F.sum,
    "depth_sum": F.sum,
    "depth_sq": F.sum,
    "depth_max": F.max,
    "depth_min": F.min,
}
FULL_STATS = tuple(MERGE)
SHORT_STATS = ("n", "mag_sum", "mag_max", "mag_min", "energy")


def _row_stats() -> dict[str, Column]:
    mag, depth = F.col("magnitude"), F.col("depth")
    return {
        "n": F.lit(1).cast("bigint"),
        "mag_sum": mag - MAG_SHIFT,
        "mag_sq": (mag - MAG_SHIFT) * (mag - MAG_SHIFT),
        "mag_max": mag,
        "mag_min": mag,
        "energy": energy_term(mag),
        "depth_n": depth.isNotNull().cast("bigint"),
        "depth_sum": depth - DEPTH_SHIFT,
        "depth_sq": (depth - DEPTH_SHIFT) * (depth - DEPTH_SHIFT),
        "depth_max": depth,
        "depth_min": depth,
    }


def neighborhood_stats(
    targets: DataFrame,
    catalog: DataFrame,
    families: dict[str, tuple[Column, Sequence[str]]],
    windows: Sequence[int] = WINDOWS_DAYS,
    km: float = RADIUS_KM,
) -> DataFrame:
    """Mergeable statistics per place and instant of the targets, family and window.

    `families` maps a name to (row condition on the catalogue, statistics to keep). Output
    columns are `{family}_{stat}_{w}` and `{family}_last_us`; only places with a neighbour
    appear.
    """
    at = [F.col(c).alias(a) for c, a in zip(("latitude", "longitude", "event_us"), AT)]
    # both sides are read to count the blocks, and again for their rows
    spots = settle(targets.select(*at).distinct(), "spots")

    in_any = None
    for condition, _ in families.values():
        in_any = condition if in_any is None else in_any | condition
    rows = _row_stats()
    weighted = (
        catalog.where(in_any)
        .groupBy(
            F.col("latitude").alias("nb_lat"), F.col("longitude").alias("nb_lon"), F.col("event_us").alias("nb_us")
        )
        .agg(
            *[
                MERGE[s](F.when(condition, rows[s])).alias(f"{fam}_{s}")
                for fam, (condition, stats) in families.items()
                for s in stats
            ]
        )
    )

    weighted = settle(weighted, "weighted")
    by_class = _sums_by_class(spots, weighted, {fam: stats for fam, (_, stats) in families.items()}, sorted(windows), km)
    within = {w: F.col("window_class") <= w for w in windows}
    return by_class.groupBy(*AT).agg(
        *[
            MERGE[s](F.when(within[w], F.col(f"{fam}_{s}"))).alias(f"{fam}_{s}_{w}")
            for fam, (_, stats) in families.items()
            for s in stats
            for w in windows
        ],
        *[F.max(f"{fam}_last_us").alias(f"{fam}_last_us") for fam in families],
    )


def _sums_by_class(
    spots: DataFrame, weighted: DataFrame, families: dict[str, Sequence[str]], windows: Sequence[int], km: float
) -> DataFrame:
    """(spot, window_class, statistics): what the neighbours of a spot in one block add to the shortest window that holds them."""
    span = TimeSpan("at_us", "nb_us", -windows[-1] * DAY_US, 0, hi_open=True, spans=BUCKET_SPANS)
    left, right, keys = in_blocks(spots, weighted, AT[:2], ("nb_lat", "nb_lon"), km, span)
    # dealt without the vectors, which are made from the place where a row arrives
    l_xyz = dict(zip(("l_x", "l_y", "l_z"), unit_xyz(F.col(AT[0]), F.col(AT[1]))))
    r_xyz = dict(zip(("r_x", "r_y", "r_z"), unit_xyz(F.col("nb_lat"), F.col("nb_lon"))))
    left = left.repartition(*keys).withColumns(l_xyz)
    right = right.repartition(*keys).withColumns(r_xyz).drop("nb_lat", "nb_lon")

    names = {f"{fam}_{s}": MERGE[s] for fam, stats in families.items() for s in stats}
    last = {f"{fam}_last_us": f"{fam}_n" for fam in families}
    fields = [spots.schema[c] for c in AT] + [StructField("window_class", IntegerType())]
    fields += [StructField(c, weighted.schema[c].dataType) for c in names]
    fields += [StructField(c, weighted.schema["nb_us"].dataType) for c in last]
    schema = StructType(fields)
    sums = block_sums(
        km_to_chord(km) ** 2,
        AT,
        AT[2],
        "nb_us",
        [(w, w * DAY_US) for w in windows],
        *([c for c, merge in names.items() if merge is kind] for kind in (F.sum, F.max, F.min)),
        last,
        to_arrow_schema(schema),
    )
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(sums, schema)


def attach(targets: DataFrame, stats: DataFrame) -> DataFrame:
    """Left join back, so targets without neighbours keep their row."""
    on = [F.col(c) == F.col(a) for c, a in zip(("latitude", "longitude", "event_us"), AT)]
    return targets.join(stats, on, "left").drop(*AT)


class _Window:
    """The statistics of one family and window as finished feature expressions."""

    def __init__(self, family: str, w: int):
        self.days = w
        self.get = lambda s: F.col(f"{family}_{s}_{w}")
        self.n = F.coalesce(self.get("n"), F.lit(0).cast("bigint"))
        self.some = self.n > 0

    def mean_mag(self) -> Column:
        return F.when(self.some, self.get("mag_sum") / self.n + MAG_SHIFT)

    def mean_depth(self) -> Column:
        dn = self.get("depth_n")
        return F.when(dn > 0, self.get("depth_sum") / dn + DEPTH_SHIFT)

    @staticmethod
    def _spread(n: Column, total: Column, squares: Column, high: Column, low: Column) -> Column:
        """Population deviation; exactly zero when all values are equal."""
        mean = total / n
        variance = squares / n - mean * mean
        return F.when(high > low, F.sqrt(F.greatest(F.lit(0.0), variance))).otherwise(F.lit(0.0))

    def std_mag(self) -> Column:
        g = self.get
        return F.when(self.some, self._spread(self.n, g("mag_sum"), g("mag_sq"), g("mag_max"), g("mag_min")))

    def std_depth(self) -> Column:
        g = self.get
        spread = self._spread(g("depth_n"), g("depth_sum"), g("depth_sq"), g("depth_max"), g("depth_min"))
        return F.when(self.some, F.when(g("depth_n") > 1, spread).otherwise(F.lit(0.0)))

    def energy(self) -> Column:
        return F.coalesce(self.get("energy"), F.lit(0.0))

    def b_batch(self) -> Column:
        return b_value_from_stats(self.n, self.mean_mag(), self.get("mag_min"), self.get("mag_max"))

    def b_fixed(self) -> Column:
        return b_value_fixed_from_stats(self.n, self.mean_mag(), self.get("mag_max"))


def batch_columns(family: str, w: int) -> dict[str, Column]:
    """Features of one window with the batch rules for missing values."""
    win = _Window(family, w)
    return {
        f"count_{w}d": win.n,
        f"rate_{w}d": win.n / F.lit(float(w)),
        f"mag_max_{w}d": win.get("mag_max"),
        f"mag_mean_{w}d": win.mean_mag(),
        f"mag_std_{w}d": win.std_mag(),
        f"energy_{w}d": win.energy(),
        f"moment_{w}d": win.energy() * MOMENT_FACTOR,
        f"b_value_{w}d": win.b_batch(),
        f"depth_mean_{w}d": win.mean_depth(),
        f"depth_std_{w}d": win.std_depth(),
    }


def live_columns(family: str, w: int) -> dict[str, Column]:
    """Features of one window with the live rules: fixed completeness magnitude, deviation 0
    without neighbours, and one missing depth makes the depth statistics missing."""
    win = _Window(family, w)
    all_depths = win.get("depth_n") == win.n
    depth_spread = F.when(win.n > 1, F.when(all_depths, win.std_depth())).otherwise(F.lit(0.0))
    return {
        f"count_{w}d": win.n,
        f"rate_{w}d": win.n / F.lit(float(w)),
        f"energy_{w}d": win.energy(),
        f"moment_{w}d": win.energy() * MOMENT_FACTOR,
        f"b_value_{w}d": win.b_fixed(),
        f"mag_mean_{w}d": win.mean_mag(),
        f"mag_max_{w}d": win.get("mag_max"),
        f"mag_std_{w}d": F.coalesce(win.std_mag(), F.lit(0.0)),
        f"depth_mean_{w}d": F.when(all_depths, win.mean_depth()),
        f"depth_std_{w}d": depth_spread,
    }


def m2_columns(family: str, w: int, live: bool) -> dict[str, Column]:
    """Count, b-value and energy of the context rows; all missing before the context starts."""
    win = _Window(family, w)
    covered = year_of_us(F.col("event_us")) >= M2_FIRST_YEAR
    return {
        f"count_{w}d_m2": F.when(covered, win.n),
        f"b_value_{w}d_m2": F.when(covered, win.b_fixed() if live else win.b_batch()),
        f"energy_{w}d_m2": F.when(covered, win.energy()),
    }


def elapsed_column(family: str) -> Column:
    return (F.col("event_us") - F.col(f"{family}_last_us")) / F.lit(float(SECOND_US))


def _features(targets: DataFrame, stats: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return attach(targets, stats).select("event_id", *[c.alias(name) for name, c in columns.items()])


def m4_family() -> tuple[Column, Sequence[str]]:
    return F.col("magnitude") >= MIN_MAG_WINDOW, FULL_STATS


def context_family() -> tuple[Column, Sequence[str]]:
    return F.col("is_m2_ctx"), SHORT_STATS


def rolling_m2_family() -> tuple[Column, Sequence[str]]:
    return F.col("magnitude") >= MIN_MAG_ROLLING, SHORT_STATS


def window_features(targets: DataFrame, catalog: DataFrame, windows: Sequence[int] = WINDOWS_DAYS) -> DataFrame:
    """Batch windows over M>=4 neighbours, one row per target."""
    stats = neighborhood_stats(targets, catalog, {"m4": m4_family()}, windows)
    return _features(targets, stats, {k: v for w in windows for k, v in batch_columns("m4", w).items()})


def window_features_live(events: DataFrame, rolling: DataFrame, windows: Sequence[int] = WINDOWS_DAYS) -> DataFrame:
    stats = neighborhood_stats(events, rolling, {"m4": m4_family()}, windows)
    return _features(events, stats, {k: v for w in windows for k, v in live_columns("m4", w).items()})


def m2_window_features(targets: DataFrame, catalog: DataFrame, windows: Sequence[int] = M2_WINDOWS_DAYS) -> DataFrame:
    """Context-only windows; `catalog` carries `is_m2_ctx`."""
    stats = neighborhood_stats(targets, catalog, {"m2": context_family()}, windows)
    return _features(targets, stats, {k: v for w in windows for k, v in m2_columns("m2", w, live=False).items()})


def m2_window_features_live(events: DataFrame, rolling: DataFrame, windows: Sequence[int] = M2_WINDOWS_DAYS) -> DataFrame:
    stats = neighborhood_stats(events, rolling, {"m2": rolling_m2_family()}, windows)
    return _features(events, stats, {k: v for w in windows for k, v in m2_columns("m2", w, live=True).items()})
