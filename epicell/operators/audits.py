"""Data audits: distributions, null rates, cardinality, correlation, histograms, manifests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from epicell.constants import DAY_US, DAYS_PER_YEAR
from epicell.functions.encodings import grid_label
from epicell.functions.timeparse import year_of_us
from epicell.operators.order_stats import exact_percentiles
from epicell.operators.shape import numeric_columns

TARGET_MARKS = ("target", "label", "follow", "y_", "_7d", "_30d", "_365d")
TIME_MARKS = ("time", "date", "datetime", "event_")
BINARY_MAX_VALUES = 5


def _melt(row: DataFrame, entries: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """One-row frame to one row per entry; an entry lists one expression per output name."""
    structs = [F.struct(*[e.alias(n) for e, n in zip(entry, names)]) for entry in entries]
    return row.select(F.explode(F.array(*structs)).alias("e")).select("e.*")


def label_distribution(labels: DataFrame, horizons: Sequence[str] = ("7d", "30d", "365d")) -> DataFrame:
    sums = labels.agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"label_{h}").cast("bigint").alias(f"p_{h}") for h in horizons]
    )
    n = F.col("n")
    entries = [
        (F.lit(h), F.col(f"p_{h}"), n - F.col(f"p_{h}"), F.try_divide(F.col(f"p_{h}"), n) * 100.0) for h in horizons
    ]
    return _melt(sums, entries, ["horizon", "positives", "negatives", "positive_pct"])


def class_distribution(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share) per value of a column; the total is a sum over the few groups."""
    counts = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def positive_rate_by_split(df: DataFrame, targets: Sequence[str], split: str = "split") -> DataFrame:
    """(split, target, n, positive_rate); NULL labels do not count."""
    rates = df.groupBy(split).agg(
        *[F.count(t).alias(f"n_{t}") for t in targets], *[F.avg(F.col(t).cast("double")).alias(f"r_{t}") for t in targets]
    )
    structs = [
        F.struct(F.lit(t).alias("target"), F.col(f"n_{t}").alias("n"), F.col(f"r_{t}").alias("positive_rate"))
        for t in targets
    ]
    return rates.select(split, F.explode(F.array(*structs)).alias("e")).select(split, "e.*")


def decade_counts(df: DataFrame, us: str = "event_us") -> DataFrame:
    decade = (F.floor(year_of_us(F.col(us)) / 10) * 10).cast("int").alias("decade")
    return df.where(F.col(us).isNotNull()).groupBy(decade).agg(F.count(F.lit(1)).alias("n"))


def top_zones(df: DataFrame, deg: int = 5, k: int = 15) -> DataFrame:
    """The k busiest grid zones with mean magnitude and label; ties by south-west corner."""
    zone = lambda c: (F.floor(F.col(c) / deg) * deg).cast("int")
    zones = df.groupBy(zone("latitude").alias("lat_bin"), zone("longitude").alias("lon_bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("magnitude").alias("mean_mag")
    )
    top = zones.orderBy(F.desc("n"), "lat_bin", "lon_bin").limit(k)
    return top.withColumn("zone", grid_label(F.col("lat_bin"), F.col("lon_bin")))


def histogram(
    df: DataFrame, col: str, bins: int = 50, density: bool = False, clip_upper: float | None = None
) -> DataFrame:
    """(bin, low, high, n[, density]): equal widths between min and max, the last bin closed; empty bins shown."""
    value = F.col(col) if clip_upper is None else F.least(F.col(col), F.lit(clip_upper))
    values = df.where(F.col(col).isNotNull()).select(value.alias("x"))
    ends = values.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high")).alias("ends")).scalar()
    width = (F.col("ends.high") - F.col("ends.low")) / bins
    index = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("ends.low"), width)), F.lit(0)))
    counts = values.withColumn("ends", ends).groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).withColumn("ends", ends)
    out = frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("ends.low") + width * F.col("bin")).alias("low"),
        (F.col("ends.low") + width * (F.col("bin") + 1)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
    if not density:
        return out
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return out.withColumn("density", F.try_divide(F.col("n") / total, F.col("high") - F.col("low")))


def describe_numeric(df: DataFrame, col: str) -> DataFrame:
    """One row: n, nulls, mean, min, max, sample deviation and exact median."""
    facts = df.agg(
        F.count(col).alias("n"),
        F.count_if(F.col(col).isNull()).alias("nulls"),
        F.avg(col).alias("mean"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        F.stddev_samp(col).alias("std"),
    )
    return facts.withColumn("median", exact_percentiles(df, {col: 0.5}).select("percentile").scalar())


def _null_counts(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )


def null_rates(df: DataFrame, top: int | None = None, above: float | None = None) -> DataFrame:
    """(column, null_rate) in descending order; optionally the top rows or those above a share."""
    entries = [(F.lit(c), F.try_divide(F.col(f"n{i}"), F.col("rows"))) for i, c in enumerate(df.columns)]
    rates = _melt(_null_counts(df), entries, ["column", "null_rate"])
    if above is not None:
        rates = rates.where(F.col("null_rate") > above)
    rates = rates.orderBy(F.desc("null_rate"), "column")
    return rates if top is None else rates.limit(top)


# a task hands on its distinct values when it holds so many
HELD_VALUES = 200_000


def column_cardinality(df: DataFrame, lowest: int | None = None, approximate: bool = False) -> DataFrame:
    """(column, n_distinct, is_constant); NULL counts as one value.

    The exact count goes over the rows once: tasks collect the distinct values of each column, and (column, value) are
    made distinct and counted by column. The approximate one estimates from a sketch per column.
    """
    if approximate:
        counts = cardinality_sketches(df).select(
            "column", (F.hll_sketch_estimate("sketch") + F.col("has_null").cast("int")).alias("n_distinct")
        )
    else:
        found = distinct_values(df).distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
        names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
        # a table without rows has no values
        counts = names.join(found, "column", "left").select("column", F.coalesce("n_distinct", F.lit(0).cast("bigint")).alias("n_distinct"))
    out = counts.select("column", "n_distinct", (F.col("n_distinct") <= 1).alias("is_constant"))
    return out if lowest is None else out.orderBy("n_distinct", "column").limit(lowest)


def _plain(df: DataFrame) -> list[Column]:
    """The columns in types whose texts tell all values apart; both zeros are one value."""
    out = []
    for i, (c, kind) in enumerate(df.dtypes):
        value = F.col(f"`{c}`")
        if kind in ("double", "float"):
            value = value + F.lit(0.0).cast(kind)
        elif kind == "binary":
            value = F.hex(value)
        elif kind not in ("string", "bigint", "int", "smallint", "tinyint", "boolean", "date"):
            value = value.cast("string")
        out.append(value.alias(f"c{i}"))
    return out


def distinct_values(df: DataFrame) -> DataFrame:
    """(column, value as text, NULL for NULL): what each task has seen, each value about once a task."""
    names = df.columns
    schema = T.StructType([T.StructField("column", T.StringType()), T.StructField("value", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Array] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for i, values in held.items():
                texts = values.cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(texts), pa.string()), texts], schema=arrow)
            held.clear()

        for batch in batches:
            for i, values in enumerate(batch.columns):
                own = values.unique()
                held[i] = pa.concat_arrays([held[i], own]).unique() if i in held else own
            if sum(map(len, held.values())) > HELD_VALUES:
                yield from flush()
        yield from flush()

    return df.select(*_plain(df)).mapInArrow(run, schema)


def cardinality_sketches(df: DataFrame) -> DataFrame:
    """(column, sketch, has_null) from one pass. The sketches of several tables may be kept and merged with
    `hll_union_agg`."""
    values = df.select(*[c.cast("string") for c in _plain(df)])
    facts = values.agg(
        *[F.hll_sketch_agg(c).alias(f"s{i}") for i, c in enumerate(values.columns)],
        *[F.coalesce(F.bool_or(F.col(c).isNull()), F.lit(False)).alias(f"z{i}") for i, c in enumerate(values.columns)],
    )
    entries = [(F.lit(c), F.col(f"s{i}"), F.col(f"z{i}")) for i, c in enumerate(df.columns)]
    return _melt(facts, entries, ["column", "sketch", "has_null"])


def column_roles(df: DataFrame) -> DataFrame:
    """(column, type, is_target_like, is_time_like, is_numeric, is_binary_like).

    Binary-like: one to five distinct values, all 0 or 1. For a numeric or boolean column that
    means every value is 0 or 1, which one pass of minimum and maximum tests decides.
    """
    types = dict(df.dtypes)
    numeric = set(numeric_columns(df))
    testable = [c for c in df.columns if c in numeric or types[c] == "boolean"]

    def zero_one(c: str) -> Column:
        value = F.col(f"`{c}`").cast("double")
        return F.coalesce(F.bool_and(value.isin(0.0, 1.0)), F.lit(False))

    facts = df.agg(F.count(F.lit(1)).alias("rows"), *[zero_one(c).alias(f"b{i}") for i, c in enumerate(testable)])
    position = {c: i for i, c in enumerate(testable)}
    entries = [
        (
            F.lit(c),
            F.lit(types[c]),
            F.lit(any(m in c.lower() for m in TARGET_MARKS)),
            F.lit(any(m in c.lower() for m in TIME_MARKS)),
            F.lit(c in numeric),
            F.col(f"b{position[c]}") if c in position else F.lit(False),
        )
        for c in df.columns
    ]
    return _melt(facts, entries, ["column", "type", "is_target_like", "is_time_like", "is_numeric", "is_binary_like"])


PAIR_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
PAIR_ENDS = ["min_x", "max_x", "min_y", "max_y"]


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(a, b, n, sums and extremes) of column pairs over rows where both are present, one row a task and pair.

    Values are taken relative to the mean and the deviation of their column. The sums of all pairs are four
    matrix products of the values and of the mask of those present.
    """
    value = {c: F.col(f"`{c}`").cast("double") for c in cols}
    facts = df.agg(*[f(v) for v in value.values() for f in (F.avg, F.stddev_pop)]).first()
    center = np.array([facts[2 * i] or 0.0 for i in range(len(cols))])
    scale = np.array([facts[2 * i + 1] or 1.0 for i in range(len(cols))])
    schema = T.StructType(
        [T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in PAIR_SUMS + PAIR_ENDS]]
    )
    arrow = to_arrow_schema(schema)
    names, width = list(cols), len(cols)
    first, second = np.triu_indices(width, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, width, width))
        low, high = np.full((width, width), np.inf), np.full((width, width), -np.inf)
        for batch in batches:
            raw = np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns], axis=1)
            there = ~np.isnan(raw)
            x, m = np.where(there, (raw - center) / scale, 0.0), there.astype(np.float64)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            for j in range(width):  # extremes of all columns over the rows that have column j
                mine = raw[there[:, j]]
                if len(mine):
                    low[:, j] = np.fmin(low[:, j], np.fmin.reduce(mine, axis=0))
                    high[:, j] = np.fmax(high[:, j], np.fmax.reduce(mine, axis=0))
        count, sums, squares, products = total
        columns = [count[first, second], sums[first, second], sums[second, first], squares[first, second], squares[second, first]]
        columns += [products[first, second], low[first, second], high[first, second], low[second, first], high[second, first]]
        pairs = [pa.array([names[i] for i in side], pa.string()) for side in (first, second)]
        yield pa.RecordBatch.from_arrays([*pairs, *[pa.array(c) for c in columns]], schema=arrow)

    return df.select(*[v.alias(f"c{i}") for i, v in enumerate(value.values())]).mapInArrow(run, schema)


def high_corr_pairs(
    df: DataFrame, cols: Sequence[str] | None = None, thr: float = 0.95, k: int | None = None
) -> DataFrame:
    """(a, b, abs_corr) of column pairs with |Pearson| >= thr over rows where both are present."""
    cols = list(cols or numeric_columns(df))
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, abs_corr double")
    moments = pair_moments(df, cols).groupBy("a", "b").agg(
        *[F.sum(c).alias(c) for c in PAIR_SUMS],
        *[(F.min if c.startswith("min") else F.max)(c).alias(c) for c in PAIR_ENDS],
    )
    n = F.col("n")
    # a constant column has no correlation; its extremes tell exactly, its rounded deviation may not
    varies = (n > 0) & (F.col("max_x") > F.col("min_x")) & (F.col("max_y") > F.col("min_y"))
    spread_x, spread_y = (F.col(f"s{v}{v}") - F.col(f"s{v}") * F.try_divide(F.col(f"s{v}"), n) for v in "xy")
    common = F.col("sxy") - F.col("sx") * F.try_divide(F.col("sy"), n)
    value = F.try_divide(common, F.sqrt(F.greatest(spread_x, F.lit(0.0)) * F.greatest(spread_y, F.lit(0.0))))
    strong = moments.where(varies).select("a", "b", F.abs(value).alias("abs_corr")).where(F.col("abs_corr") >= thr)
    ordered = strong.orderBy(F.desc("abs_corr"), "a", "b")
    return ordered if k is None else ordered.limit(k)


def dataset_manifest(
    df: DataFrame, time_col: str, targets: Sequence[str], dropped: dict[str, Sequence[str]] | None = None, top: int = 20
) -> DataFrame:
    """One row of facts about a data set, from one aggregation."""
    others = [c for c in df.columns if c != time_col]
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(time_col).alias("time_min"),
        F.max(time_col).alias("time_max"),
        *[F.avg(F.col(t).cast("double")).alias(f"positive_rate_{t}") for t in targets],
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    rates = F.array(
        *[
            F.struct((-F.col(f"n{i}") / F.col("rows")).alias("neg"), F.lit(c).alias("column"))
            for i, c in enumerate(df.columns)
        ]
    )
    listed = F.transform(
        F.slice(F.array_sort(rates), 1, top), lambda e: F.concat(e["column"], F.format_string("=%.4f", F.abs(e["neg"])))
    )
    fixed = {
        "column_count": F.lit(len(df.columns)),
        "columns": F.lit(",".join([time_col, *others])),
        "top_null_rates": F.concat_ws(",", listed),
        **{f"dropped_{k}": F.lit(",".join(v)) for k, v in (dropped or {}).items()},
    }
    return facts.withColumns(fixed).drop(*[f"n{i}" for i in range(len(df.columns))])


def catalog_health(rolling: DataFrame, hist: DataFrame, now_us: int | None = None) -> DataFrame:
    """One row: size, distinct ids and time range of both catalogues, ok flags and the overall status."""
    live = rolling.agg(
        F.count(F.lit(1)).alias("rolling_events"),
        F.count_distinct("event_id").alias("rolling_unique_ids"),
        F.min("event_us").alias("rolling_min_us"),
        F.max("event_us").alias("rolling_max_us"),
    )
    past = hist.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.min("event_us").alias("low"), F.max("event_us").alias("high")
        ).alias("past")
    ).scalar()
    days = F.floor((F.col("past.high") - F.col("past.low")) / DAY_US)
    out = live.withColumn("past", past).select(
        "*",
        F.col("past.n").alias("historical_events"),
        F.col("past.low").alias("historical_min_us"),
        F.col("past.high").alias("historical_max_us"),
        F.round(F.greatest(F.lit(1.0), days / DAYS_PER_YEAR), 2).alias("historical_span_years"),
        (F.col("rolling_events") > 0).alias("rolling_ok"),
        (F.col("past.n") > 0).alias("historical_ok"),
    )
    if now_us is not None:
        out = out.withColumn("rolling_age_s", (F.lit(now_us) - F.col("rolling_max_us")) / 1e6)
    status = F.when(F.col("rolling_ok") & F.col("historical_ok"), "ok").otherwise("degraded")
    return out.withColumn("status", status).drop("past")


SCORING_STALE_S = 90 * 60
OUTCOMES_STALE_S = 48 * 3600


def freshness_alerts(run_log: DataFrame, now_us: int, scheduler_up: bool = True) -> DataFrame:
    """Latest run per job with its alerts. `run_log`: pipeline_name, finished_us, success.

    A job that never ran has no row; the scheduler state is repeated on each row.
    """
    latest = run_log.groupBy("pipeline_name").agg(
        F.max_by("success", "finished_us").alias("last_success"), F.max("finished_us").alias("finished_us")
    )
    limit_s = F.when(F.col("pipeline_name") == "scoring_pipeline", SCORING_STALE_S).when(
        F.col("pipeline_name") == "outcomes_pipeline", OUTCOMES_STALE_S
    )
    age = (F.lit(now_us) - F.col("finished_us")) / 1e6
    return latest.select(
        "pipeline_name",
        "finished_us",
        age.alias("age_s"),
        F.coalesce(age > limit_s, F.lit(False)).alias("stale"),
        (~F.col("last_success")).alias("failed"),
        F.lit(not scheduler_up).alias("scheduler_down"),
    )
