"""Neighbourhood windows, background rate, distributions and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, hav, r, rlog
from checks.cleaning import UNION_SQL, merged_catalog
from epicell.fixtures import with_views
from epicell.operators import audits, background, cleaning, splits, windows
from epicell.operators.followups import forward_labels

WC = with_views("catalog")
WW = with_views("wide")
DAY = 86_400_000_000
NEAR = f"abs(a.latitude - b.latitude) <= 1.8 AND {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 200"


def window_sql(w: int, live: bool) -> str:
    f = f"FILTER (b.event_us >= a.event_us - {w} * {DAY})"
    n = f"count(b.event_id) {f}"
    mag, dep = f"(b.magnitude) {f}", f"(b.depth) {f}"
    spread = f"CASE WHEN {n} > 1 AND max{mag} > min{mag} THEN stddev_pop{mag} WHEN {n} > 0 THEN 0 END"
    b_batch = f"CASE WHEN {n} >= 5 AND max{mag} > min{mag} THEN log10(exp(1)) / (avg{mag} - min{mag}) END"
    b_fixed = f"CASE WHEN {n} >= 5 AND max{mag} > 2 THEN 1 / ((avg{mag} - 2) * ln(10::DOUBLE)) END"
    d_std = f"CASE WHEN count{dep} > 1 AND max{dep} > min{dep} THEN stddev_pop{dep} WHEN {n} > 0 THEN 0 END"
    d_mean = f"avg{dep}"
    if live:
        spread = f"coalesce({spread}, 0)"
        d_mean = f"CASE WHEN count{dep} = {n} THEN avg{dep} END"
        d_std = f"CASE WHEN {n} <= 1 THEN 0 WHEN count{dep} = {n} THEN {d_std} END"
    energy = f"coalesce(sum(pow(10::DOUBLE, 1.5::DOUBLE * b.magnitude)) {f}, 0)"
    return f"""{n} AS count_{w}d, {r(f'{n} / {w}')} AS rate_{w}d, {r(f'max{mag}')} AS mag_max_{w}d, {r(f'avg{mag}')} AS mag_mean_{w}d, {r(spread)} AS mag_std_{w}d,
      {rlog(energy)} AS energy_{w}d, {rlog(f'{energy} * pow(10::DOUBLE, 9.1::DOUBLE)')} AS moment_{w}d, {r(b_fixed if live else b_batch)} AS b_value_{w}d,
      {r(d_mean)} AS depth_mean_{w}d, {r(d_std)} AS depth_std_{w}d"""


def windows_sql(live: bool) -> str:
    return (
        WC
        + f"SELECT a.event_id, {', '.join(window_sql(w, live) for w in (1, 7, 30, 90))} FROM catalog a LEFT JOIN catalog b"
        + f" ON b.magnitude >= 4 AND b.event_us < a.event_us AND b.event_us >= a.event_us - 90 * {DAY} AND {NEAR} WHERE a.magnitude >= 4 GROUP BY a.event_id"
    )


@check("window_features", windows_sql(live=False))
def _(t):
    return windows.window_features(t.catalog.where("magnitude >= 4"), t.catalog)


@check("window_features_live", windows_sql(live=True))
def _(t):
    return windows.window_features_live(t.catalog.where("magnitude >= 4"), t.catalog)


def m2_sql(w: int, live: bool) -> str:
    f = f"FILTER (b.event_us >= a.event_us - {w} * {DAY})"
    n, mag = f"count(b.event_id) {f}", f"(b.magnitude) {f}"
    b = f"CASE WHEN {n} >= 5 AND max{mag} > min{mag} THEN log10(exp(1)) / (avg{mag} - min{mag}) END"
    if live:
        b = f"CASE WHEN {n} >= 5 AND max{mag} > 2 THEN 1 / ((avg{mag} - 2) * ln(10::DOUBLE)) END"
    energy = f"coalesce(sum(pow(10::DOUBLE, 1.5::DOUBLE * b.magnitude)) {f}, 0)"
    in_time = "any_value(year(make_timestamp(a.event_us))) >= 2000"
    return f"""CASE WHEN {in_time} THEN {n} END AS count_{w}d_m2, CASE WHEN {in_time} THEN {r(b)} END AS b_value_{w}d_m2, CASE WHEN {in_time} THEN {rlog(energy)} END AS energy_{w}d_m2"""


@check(
    "m2_window_features",
    WC
    + UNION_SQL
    + f"SELECT a.event_id, {', '.join(m2_sql(w, False) for w in (7, 30, 90))} FROM merged a LEFT JOIN merged b"
    + f" ON b.is_m2_ctx AND b.event_us < a.event_us AND b.event_us >= a.event_us - 90 * {DAY} AND {NEAR} WHERE a.is_target GROUP BY a.event_id",
)
def _(t):
    both = merged_catalog(t)
    return windows.m2_window_features(both.where("is_target"), both)


@check(
    "m2_window_features_live",
    WC
    + f"SELECT a.event_id, {', '.join(m2_sql(w, True) for w in (7, 30, 90))} FROM catalog a LEFT JOIN catalog b"
    + f" ON b.magnitude >= 2 AND b.event_us < a.event_us AND b.event_us >= a.event_us - 90 * {DAY} AND {NEAR} WHERE a.magnitude >= 4 GROUP BY a.event_id",
)
def _(t):
    return windows.m2_window_features_live(t.catalog.where("magnitude >= 4"), t.catalog)


RADIUS_COUNT = f"""SELECT a.event_id, count(b.event_id) AS n_near FROM catalog a LEFT JOIN catalog b
      ON year(make_timestamp(b.event_us)) < 2010 AND b.magnitude >= 3 AND {NEAR} GROUP BY a.event_id"""


@check("radius_count", WC + RADIUS_COUNT)
def _(t):
    return background.radius_count(t.catalog, background.history(t.catalog))


def rate_sql(span: str, floor: str) -> str:
    rate = f"(n_near / {floor.format(span)})"
    return (
        WC
        + f", n AS ({RADIUS_COUNT}), s AS (SELECT {span}), f AS (SELECT *, event_id % 25 AS count_30d FROM catalog)"
        + f" SELECT event_id, {r(rate)} AS background_rate_yr, {r(f'greatest(0, least(200, count_30d / ({rate} * (30 / 365.25::DOUBLE) + 1e-9::DOUBLE)))')} AS normalized_rate_30d"
        + " FROM f JOIN n USING (event_id), s"
    )


SPAN = f"((max(event_us) - min(event_us)) // {DAY}) / 365.25::DOUBLE AS years FROM catalog WHERE year(make_timestamp(event_us)) < 2010"


def with_count(t):
    return t.catalog.withColumn("count_30d", F.col("event_id") % 25)


@check("background_rate", rate_sql(SPAN, "years"))
def _(t):
    return background.background_rate(with_count(t)).select("event_id", "background_rate_yr", "normalized_rate_30d")


@check("background_rate_live", rate_sql(SPAN + " AND magnitude >= 3", "greatest(1, years)"))
def _(t):
    return background.background_rate_live(with_count(t), t.catalog).select("event_id", "background_rate_yr", "normalized_rate_30d")


@check(
    "label_distribution",
    WC
    + f""", d AS (SELECT *, event_us // {DAY} AS dy FROM catalog),
    m AS (SELECT a.event_id, min(b.dy - a.dy) AS gap FROM d a LEFT JOIN d b
      ON b.dy > a.dy AND b.dy <= a.dy + 365 AND CAST(b.magnitude AS FLOAT) >= 5 AND {NEAR} GROUP BY a.event_id),
    h AS (SELECT unnest(['7d', '30d', '365d']) AS horizon, unnest([7, 30, 365]) AS days)
    SELECT horizon, count(*) FILTER (gap <= days) AS positives, count(*) - count(*) FILTER (gap <= days) AS negatives,
      {r('count(*) FILTER (gap <= days) / count(*) * 100')} AS positive_pct FROM m, h GROUP BY horizon""",
)
def _(t):
    return audits.label_distribution(forward_labels(t.catalog))


@check(
    "class_distribution",
    WC
    + f"""SELECT CAST("Dangerous" AS VARCHAR) AS value, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()')} AS share
      FROM (SELECT CASE WHEN magnitude >= 6 THEN 1 ELSE 0 END AS "Dangerous" FROM catalog WHERE depth IS NOT NULL AND lower("type") = 'earthquake') GROUP BY 1""",
)
def _(t):
    return audits.class_distribution(cleaning.clean_basic(t.catalog), "Dangerous")


@check(
    "positive_rate_by_split",
    with_views("scored")
    + f""", s AS (SELECT *, CASE WHEN make_timestamp(scored_us) <= TIMESTAMP '1997-12-31' THEN 'train' ELSE 'test' END AS split FROM scored)
      SELECT split, 'label_7d' AS target, count(label_7d) AS n, {r('avg(label_7d)')} AS positive_rate FROM s GROUP BY split
      UNION ALL SELECT split, 'label_30d', count(label_30d), {r('avg(label_30d)')} FROM s GROUP BY split""",
)
def _(t):
    s = t.scored.withColumn("split", F.when(F.col("scored_us") <= splits.midnight_us("1997-12-31"), "train").otherwise("test"))
    return audits.positive_rate_by_split(s, ["label_7d", "label_30d"])


@check("decade_counts", WC + "SELECT CAST(year(make_timestamp(event_us)) // 10 * 10 AS INT) AS decade, count(*) AS n FROM catalog GROUP BY 1")
def _(t):
    return audits.decade_counts(t.catalog)


@check(
    "top_zones",
    WC
    + f"""SELECT CAST(floor(latitude / 5) * 5 AS INT) AS lat_bin, CAST(floor(longitude / 5) * 5 AS INT) AS lon_bin, count(*) AS n, {r('avg(magnitude)')} AS mean_mag
      FROM catalog GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 15""",
)
def _(t):
    return audits.top_zones(t.catalog).drop("zone")


@check(
    "histogram",
    WC
    + f""", v AS (SELECT least(depth, 500::DOUBLE) AS x FROM catalog WHERE depth IS NOT NULL), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w, count(*) AS total FROM v),
      c AS (SELECT least(49, floor((x - lo) / w)) AS bin, count(*) AS n FROM v, e GROUP BY 1)
      SELECT CAST(g AS INT) AS bin, {r('lo + w * g')} AS low, {r('lo + w * (g + 1)')} AS high, coalesce(n, 0) AS n, {r('coalesce(n, 0) / total / w')} AS density
      FROM range(50) t(g), e LEFT JOIN c ON c.bin = g""".replace("FROM range(50) t(g), e LEFT JOIN c ON c.bin = g", "FROM (SELECT * FROM range(50) t(g), e) q LEFT JOIN c ON c.bin = q.g"),
)
def _(t):
    return audits.histogram(t.catalog, "depth", 50, density=True, clip_upper=500.0)


@check(
    "describe_numeric",
    WC
    + f"""SELECT count(depth) AS n, count(*) - count(depth) AS nulls, {r('avg(depth)')} AS mean, {r('min(depth)')} AS min, {r('max(depth)')} AS max,
      {r('stddev_samp(depth)')} AS std, {r('quantile_cont(depth, 0.5)')} AS median FROM catalog""",
)
def _(t):
    return audits.describe_numeric(t.catalog, "depth")


COLS = (
    "l_orderkey l_linenumber count_7d energy_7d rate_7d b_value_7d elapsed_since_last_s gap all_null constant_col"
    " not_constant_with_null text_col label_7d"
).split()


@check(
    "null_rates",
    WW
    + ", l AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {r(f'(count(*) - count({c})) / count(*)')} AS null_rate FROM wide" for c in COLS)
    + ') SELECT * FROM l',
)
def _(t):
    return audits.null_rates(t.wide)


@check(
    "column_cardinality",
    WW
    + ", l AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) + CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END AS n_distinct FROM wide" for c in COLS
    )
    + ") SELECT *, n_distinct <= 1 AS is_constant FROM l",
)
def _(t):
    return audits.column_cardinality(t.wide)


@check(
    "column_roles",
    WW
    + ", l AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {str(any(m in c for m in ('target', 'label', 'follow', 'y_', '_7d', '_30d', '_365d'))).lower()} AS is_target_like,"
        f" {str(any(m in c for m in ('time', 'date', 'datetime', 'event_'))).lower()} AS is_time_like, {str(c != 'text_col').lower()} AS is_numeric,"
        f" count({c}) > 0 AND count(DISTINCT {c}) <= 5 AND count(*) FILTER (CAST({c} AS VARCHAR) NOT IN ('0', '1', '0.0', '1.0')) = 0 AS is_binary_like FROM wide"
        for c in COLS
    )
    + ") SELECT * FROM l",
)
def _(t):
    return audits.column_roles(t.wide).drop("type")


PAIR_COLS = "l_orderkey l_linenumber count_7d energy_7d rate_7d b_value_7d elapsed_since_last_s gap constant_col label_7d".split()


@check(
    "high_corr_pairs",
    WW
    + ", l AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN max({a}) FILTER ({b} IS NOT NULL) > min({a}) FILTER ({b} IS NOT NULL)"
        f" AND max({b}) FILTER ({a} IS NOT NULL) > min({b}) FILTER ({a} IS NOT NULL) THEN abs(corr({a}, {b})) END AS c FROM wide"
        for i, a in enumerate(PAIR_COLS)
        for b in PAIR_COLS[i + 1 :]
        if "constant_col" not in (a, b)
    )
    + f") SELECT a, b, {r('c')} AS abs_corr FROM l WHERE c >= 0.3 ORDER BY c DESC",
)
def _(t):
    return audits.high_corr_pairs(t.wide, PAIR_COLS, thr=0.3)


@check(
    "catalog_health",
    WC
    + f""", ro AS (SELECT * FROM catalog WHERE event_us > 1700000000000000 - 92 * {DAY}), hi AS (SELECT * FROM catalog WHERE year(make_timestamp(event_us)) < 2010 AND magnitude >= 3)
      SELECT count(*) AS rolling_events, count(DISTINCT event_id) AS rolling_unique_ids, min(event_us) AS rolling_min_us, max(event_us) AS rolling_max_us,
      (SELECT count(*) FROM hi) AS historical_events, (SELECT min(event_us) FROM hi) AS historical_min_us, (SELECT max(event_us) FROM hi) AS historical_max_us,
      {r(f'(SELECT round(greatest(1, ((max(event_us) - min(event_us)) // {DAY}) / 365.25::DOUBLE), 2) FROM hi)')} AS historical_span_years,
      count(*) > 0 AS rolling_ok, (SELECT count(*) FROM hi) > 0 AS historical_ok, 'ok' AS status FROM ro""",
)
def _(t):
    rolling = t.catalog.where(F.col("event_us") > 1_700_000_000_000_000 - 92 * DAY)
    return audits.catalog_health(rolling, background.history(t.catalog))


@check(
    "freshness_alerts",
    with_views("runs")
    + f""", l AS (SELECT CASE WHEN run_id % 2 = 0 THEN 'scoring_pipeline' ELSE 'outcomes_pipeline' END AS pipeline_name, start_us * 1000 + run_id AS finished_us, run_id % 3 <> 0 AS success FROM runs),
      k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY pipeline_name ORDER BY finished_us DESC) = 1), n AS (SELECT max(finished_us) + 7200000000 AS now_us FROM l)
      SELECT pipeline_name, finished_us, {r('(now_us - finished_us) / 1000000')} AS age_s, (now_us - finished_us) / 1000000 > CASE WHEN pipeline_name = 'scoring_pipeline' THEN 5400 ELSE 172800 END AS stale,
      NOT success AS failed, false AS scheduler_down FROM k, n""".replace("start_us * 1000 + run_id", "start_us + run_id"),
)
def _(t):
    log = t.runs.select(
        F.when(F.col("run_id") % 2 == 0, "scoring_pipeline").otherwise("outcomes_pipeline").alias("pipeline_name"),
        (F.col("start_us") + F.col("run_id")).alias("finished_us"),
        (F.col("run_id") % 3 != 0).alias("success"),
    )
    now = log.agg(F.max("finished_us")).first()[0] + 7_200_000_000
    return audits.freshness_alerts(log, now)
