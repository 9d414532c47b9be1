"""Whole feature jobs, scoring and model training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import check, r
from checks.aggregates import DAY, NEAR, RADIUS_COUNT, m2_sql, window_sql
from checks.geo import CODES, LABELS, band_sql, scale_sql
from checks.joins import NEAREST_CENTROID, NEAREST_STATION, PLANE, SEG_DIST, SEGMENTS, SLIP_CASE, VERTEX_DIST
from epicell.fixtures import with_views
from epicell.operators import serving, splits
from epicell.operators.lines import polyline_segments
from epicell.plans import training
from epicell.plans.columns import TRAINED_COLUMNS
from epicell.plans.features import Geology, build_dataset, compute_features
from epicell.plans.scoring import calibrate, model_scorer, score_batch, select_trained
from epicell.session import settle

WC = with_views("catalog")


def geology(t) -> Geology:
    segments = polyline_segments(t.line_vertices)
    types = t.line_vertices.select("line_id", "slip_type").distinct()
    return Geology(t.line_vertices, segments, segments, types, t.stations)


LIVE_SQL = (
    with_views("catalog", "stations", "line_vertices")
    + SEGMENTS
    + PLANE
    + f""", wf AS (SELECT a.event_id, {', '.join(window_sql(w, True) for w in (1, 7, 30, 90))}, max(b.event_us) AS last_us,
        avg(b.magnitude) AS mean90, count(b.event_id) FILTER (b.event_us >= a.event_us - 7 * {DAY}) AS c7, count(b.event_id) AS c90,
        count(b.event_id) FILTER (b.event_us >= a.event_us - 30 * {DAY}) AS c30,
        coalesce(sum(pow(10::DOUBLE, 1.5::DOUBLE * b.magnitude)) FILTER (b.event_us >= a.event_us - 7 * {DAY}), 0) AS e7, coalesce(sum(pow(10::DOUBLE, 1.5::DOUBLE * b.magnitude)), 0) AS e90
        FROM catalog a LEFT JOIN catalog b ON b.magnitude >= 4 AND b.event_us < a.event_us AND b.event_us >= a.event_us - 90 * {DAY} AND {NEAR}
        WHERE a.magnitude >= 4 GROUP BY a.event_id),
      m2 AS (SELECT a.event_id, {', '.join(m2_sql(w, True) for w in (7, 30, 90))} FROM catalog a LEFT JOIN catalog b
        ON b.magnitude >= 2 AND b.event_us < a.event_us AND b.event_us >= a.event_us - 90 * {DAY} AND {NEAR} WHERE a.magnitude >= 4 GROUP BY a.event_id),
      bc AS ({RADIUS_COUNT}), sp AS (SELECT greatest(1, ((max(event_us) - min(event_us)) // {DAY}) / 365.25::DOUBLE) AS years FROM catalog WHERE year(make_timestamp(event_us)) < 2010 AND magnitude >= 3),
      bg AS (SELECT event_id, n_near / years AS rate FROM bc, sp),
      pv AS (SELECT e.event_id, min({VERTEX_DIST}) AS km FROM catalog e, line_vertices v GROUP BY e.event_id),
      sl AS (SELECT event_id, px, py, ax, ay, bx, bby, coalesce(greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (bby - ay)) / nullif(pow(bx - ax, 2) + pow(bby - ay, 2), 0))), 0) AS t FROM ev_m, seg_m),
      fd AS (SELECT event_id, min({SEG_DIST}) / 1000 AS km FROM sl GROUP BY event_id)"""
    + NEAREST_CENTROID.replace(" n AS (", " nc AS (")
    + NEAREST_STATION.replace(" n AS (", " ns AS (")
    + f"""SELECT c.event_id, {r('c.magnitude')} AS magnitude, {r('c.depth')} AS depth, {r('(c.event_us - last_us) / 1000000')} AS elapsed_since_last_s, {r('pv.km')} AS dist_to_plate_boundary_km,
      wf.* EXCLUDE (event_id, last_us, mean90, c7, c90, c30, e7, e90), m2.* EXCLUDE (event_id),
      {r('least(500, c7 / (c90 / 90 * 7 + 1e-9::DOUBLE))')} AS accel_count, {r('least(500, e7 / (e90 / 90 * 7 + 1e-9::DOUBLE))')} AS accel_energy, {r('coalesce(c.magnitude - mean90, 0)')} AS mag_excess,
      {r('fd.km')} AS dist_to_nearest_fault_km, {SLIP_CASE} AS fault_slip_type_enc,
      CASE WHEN d > 500 THEN 4 ELSE CASE trim(s.regime) WHEN 'NF' THEN 0 WHEN 'TF' THEN 1 WHEN 'SS' THEN 2 WHEN 'NS' THEN 3 WHEN 'TS' THEN 3 ELSE 4 END END AS stress_regime_enc,
      {r('CASE WHEN d > 500 THEN 0 ELSE sin(radians(s.azi)) END')} AS shmax_sin, {r('CASE WHEN d > 500 THEN 0 ELSE cos(radians(s.azi)) END')} AS shmax_cos, {r('d')} AS wsm_dist_km,
      {r('rate')} AS background_rate_yr, {r('least(200, c30 / (rate * (30 / 365.25::DOUBLE) + 1e-9::DOUBLE))')} AS normalized_rate_30d
      FROM catalog c JOIN wf USING (event_id) JOIN m2 USING (event_id) JOIN bg USING (event_id) JOIN pv USING (event_id) JOIN fd USING (event_id)
      JOIN nc USING (event_id) JOIN ty ON ty.line_id = nc.line_id JOIN ns USING (event_id)"""
)


@check("compute_features", LIVE_SQL)
def _(t):
    targets = t.catalog.where("magnitude >= 4")
    return compute_features(targets, t.catalog, t.catalog, geology(t))


@check(
    "score_batch",
    with_views("scored")
    + f""", k AS (SELECT prediction_id, {scale_sql('prob_7d', 0.6663)} AS p7, {scale_sql('prob_30d', 1.0357)} AS p30, CASE WHEN prediction_id % 3 = 0 THEN NULL ELSE prob_30d END AS p365 FROM scored)
      SELECT prediction_id, {r('round(p7, 4)')} AS prob_7d, {r('round(p30, 4)')} AS prob_30d, {r('round(p365, 4)')} AS prob_365d,
      {band_sql('p7', LABELS, "'⚪ Inconnu'")} AS risk_7d, {band_sql('p30', LABELS, "'⚪ Inconnu'")} AS risk_30d, {band_sql('p365', LABELS, "'⚪ Inconnu'")} AS risk_365d,
      {band_sql('p7', CODES, "'unknown'")} AS risk_7d_code, {band_sql('p30', CODES, "'unknown'")} AS risk_30d_code, {band_sql('p365', CODES, "'unknown'")} AS risk_365d_code,
      67 AS features_used FROM k""",
)
def _(t):
    raw = t.scored.select(
        "prediction_id",
        F.col("prob_7d").alias("raw_7d"),
        F.col("prob_30d").alias("raw_30d"),
        F.when(F.col("prediction_id") % 3 != 0, F.col("prob_30d")).alias("raw_365d"),
    )
    return calibrate(raw)


@check(
    "select_trained_columns",
    WC + f"SELECT event_id, {r('latitude')} AS latitude, {r('longitude')} AS longitude, {r('depth')} AS depth, {r('magnitude')} AS magnitude, {r('NULL')} AS gap FROM catalog",
)
def _(t):
    return select_trained(t.catalog).select("event_id", "latitude", "longitude", "depth", "magnitude", "gap")


_DATASETS: dict[tuple[str, str], DataFrame] = {}


def dataset(t) -> DataFrame:
    """The training set of a data folder; written once per session and shared by the training checks."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _DATASETS:
        targets = t.catalog.where("magnitude >= 4")
        context = t.catalog.where("magnitude < 4.3D AND event_us >= 946684800000000")
        built = build_dataset(targets, context, geology(t), labelled=t.catalog)
        _DATASETS[key] = settle(splits.split_temporal(built), "training-set")
    return _DATASETS[key]


# a join key is unique per (place rounded, day), so the row count is that of the keyed join
@check(
    "build_dataset",
    WC
    + f""", d AS (SELECT *, event_us // {DAY} AS dy FROM catalog),
      k AS (SELECT event_id, event_us FROM d WHERE magnitude >= 4
        QUALIFY row_number() OVER (PARTITION BY latitude, longitude, dy ORDER BY event_us, event_id) = 1),
      w AS (SELECT a.event_id, count(b.event_id) AS n FROM catalog a LEFT JOIN catalog b ON b.magnitude >= 4 AND b.event_us < a.event_us
        AND b.event_us >= a.event_us - 90 * {DAY} AND {NEAR} WHERE a.magnitude >= 4 GROUP BY a.event_id)
      SELECT k.event_id, k.event_us, n AS count_90d FROM k JOIN w USING (event_id)""",
)
def _(t):
    return dataset(t).select("event_id", "event_us", "count_90d")


@check("train_horizon_models")
def _(t):
    df = splits.split_by_year(dataset(t).drop("split"))
    return training.train_horizon_models(df)[1]


@check("train_compact")
def _(t):
    selected = [*serving.FORCE_KEEP, "elapsed_since_last_s"]
    return training.train_compact(dataset(t), "label_7d", selected)[1]


@check("feature_ablation")
def _(t):
    return training.feature_ablation(dataset(t), "label_30d")


@check("feature_importance")
def _(t):
    model, _ = training.train_compact(dataset(t), "label_7d", training.feature_names(dataset(t)))
    return training.feature_importance(model)


REGRESSION_FEATURES = ["latitude", "longitude", "depth", "mag_type_enc", "count_30d", "elapsed_since_last_s"]


@check("compare_regressors")
def _(t):
    df = splits.split_year_ranges(dataset(t).drop("split"))
    return training.compare_regressors(df, "magnitude", REGRESSION_FEATURES)


@check("compare_classifiers")
def _(t):
    df = splits.split_year_ranges(dataset(t).drop("split")).withColumn("dangerous", (F.col("magnitude") >= 6).cast("int"))
    return training.compare_classifiers(df, "dangerous", REGRESSION_FEATURES)


@check("hyperparameter_search")
def _(t):
    return training.hyperparameter_search(dataset(t), "label_7d")


@check("score_batch_model")
def _(t):
    df = dataset(t)
    models = training.fit_live_models(df, TRAINED_COLUMNS)
    return score_batch(df, model_scorer(models))


