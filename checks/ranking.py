"""Feeds, lookups, top-k, pending work, importance and run rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, r
from checks.geo import CODES, band_sql
from epicell.fixtures import with_views
from epicell.operators import serving

WC = with_views("catalog")
WS = with_views("scored")


@check(
    "latest_events",
    WC + f"SELECT event_id, event_us, {r('magnitude')} AS magnitude FROM catalog WHERE magnitude >= 4 ORDER BY event_us DESC, event_id LIMIT 250",
)
def _(t):
    return serving.latest_events(t.catalog.select("event_id", "event_us", "magnitude"), 250)


SERVED_SQL = """, sv AS (SELECT *, CAST(prediction_id % 180 - 90 AS DOUBLE) AS latitude, CAST(prediction_id % 360 - 180 AS DOUBLE) AS longitude,
   CASE WHEN prediction_id % 10 = 0 THEN NULL ELSE 33::DOUBLE END AS depth, 5::DOUBLE AS magnitude FROM scored)"""


def served(t):
    """Scored rows with place, and the labels a scorer would have written (none for some rows)."""
    p = F.col("prediction_id")
    rows = t.scored.withColumns(
        {
            "latitude": (p % 180 - 90).cast("double"),
            "longitude": (p % 360 - 180).cast("double"),
            "depth": F.when(p % 10 != 0, 33.0),
            "magnitude": F.lit(5.0),
            "prob_365d": F.lit(None).cast("double"),
        }
    )
    return serving.with_risk(rows).drop("risk_7d_code", "risk_30d_code", "risk_365d_code")


FEED_SQL = (
    WS
    + SERVED_SQL
    + f""", fd AS (SELECT * FROM sv WHERE event_id IS NOT NULL AND event_us IS NOT NULL AND scored_us IS NOT NULL ORDER BY scored_us DESC, prediction_id LIMIT 200),
    v AS (SELECT event_id, event_us, scored_us, {r('latitude')} AS latitude, {r('prob_7d')} AS prob_7d, {band_sql('prob_7d', CODES, 'NULL')} AS risk_7d_code,
      {band_sql('prob_30d', CODES, 'NULL')} AS risk_30d_code, depth IS NOT NULL AND prob_7d IS NOT NULL AS valid FROM fd)"""
)


@check("scored_feed", FEED_SQL + "SELECT * FROM v")
def _(t):
    feed = serving.scored_feed(served(t), 200)
    return feed.select("event_id", "event_us", "scored_us", "latitude", "prob_7d", "risk_7d_code", "risk_30d_code", "valid")


@check("scored_feed_meta", FEED_SQL + 'SELECT count(*) FILTER (valid) AS "count", 200 AS "limit", count(*) FILTER (NOT valid) AS rejected FROM v')
def _(t):
    return serving.feed_meta(serving.scored_feed(served(t), 200), 200)


@check(
    "recent_scored",
    WS + f"SELECT prediction_id, event_id, scored_us, {r('prob_7d')} AS prob_7d FROM scored WHERE prob_7d >= 0.6::DOUBLE ORDER BY scored_us DESC, prediction_id LIMIT 75",
)
def _(t):
    return serving.recent_scored(t.scored.select("prediction_id", "event_id", "scored_us", "prob_7d"), 75, 0.6)


@check(
    "lookup_event",
    WS + SERVED_SQL + f"SELECT event_id, event_us, scored_us, {r('prob_7d')} AS prob_7d, {band_sql('prob_7d', CODES, 'NULL')} AS risk_7d_code FROM sv WHERE event_id = 'ev7' ORDER BY scored_us DESC, prediction_id LIMIT 1",
)
def _(t):
    return serving.lookup_event(served(t), "ev7").select("event_id", "event_us", "scored_us", "prob_7d", "risk_7d_code")


@check(
    "unscored_events",
    WS + "SELECT DISTINCT event_id FROM scored WHERE event_id NOT IN (SELECT event_id FROM scored WHERE model_version = 'm1' AND prediction_id % 2 = 0)",
)
def _(t):
    log = t.scored.where("prediction_id % 2 = 0")
    return serving.unscored_events(t.scored.select("event_id").distinct(), log, "m1")


DAY = 86_400_000_000
NOW = 883_612_800_000_000  # 1998-01-01

OUTCOMES_SQL = f""", oc AS (SELECT prediction_id, event_id, event_us, event_us + 7 * {DAY} AS maturity_7d_us, event_us + 30 * {DAY} AS maturity_30d_us,
   CASE WHEN prediction_id % 3 = 0 THEN NULL ELSE label_7d = 1 END AS label_7d, CASE WHEN prediction_id % 5 = 0 THEN NULL ELSE label_30d = 1 END AS label_30d
   FROM scored WHERE event_us IS NOT NULL)"""


def outcomes(t):
    p = F.col("prediction_id")
    return t.scored.where("event_us IS NOT NULL").select(
        "prediction_id",
        "event_id",
        "event_us",
        (F.col("event_us") + 7 * DAY).alias("maturity_7d_us"),
        (F.col("event_us") + 30 * DAY).alias("maturity_30d_us"),
        F.when(p % 3 != 0, F.col("label_7d") == 1).alias("label_7d"),
        F.when(p % 5 != 0, F.col("label_30d") == 1).alias("label_30d"),
    )


@check(
    "pending_outcomes",
    WS
    + OUTCOMES_SQL
    + f"""SELECT prediction_id, event_id, maturity_7d_us, maturity_30d_us, label_7d, label_30d FROM oc
      WHERE (label_7d IS NULL AND maturity_7d_us <= {NOW}) OR (label_30d IS NULL AND maturity_30d_us <= {NOW})""",
)
def _(t):
    return serving.pending_outcomes(outcomes(t), NOW).drop("event_us")


@check(
    "join_predictions_outcomes",
    WS
    + OUTCOMES_SQL
    + f"""SELECT p.prediction_id, p.event_id, p.event_us AS event_us_pred, o.event_us AS event_us_out, {r('prob_7d')} AS prob_7d, o.label_7d, o.label_30d
      FROM scored p JOIN oc o ON p.prediction_id = o.prediction_id AND p.event_id = o.event_id""",
)
def _(t):
    log = t.scored.select("prediction_id", "event_id", "event_us", "prob_7d")
    return serving.join_predictions_outcomes(log, outcomes(t).drop("maturity_7d_us", "maturity_30d_us"))


SNAP_SQL = """, sn AS (SELECT prediction_id, CASE WHEN prediction_id % 2 = 0 THEN '7d' ELSE '30d' END AS horizon, scored_us AS evaluated_us, model_version, prob_30d AS roc_auc FROM scored)"""


def snapshots(t):
    return t.scored.select(
        "prediction_id",
        F.when(F.col("prediction_id") % 2 == 0, "7d").otherwise("30d").alias("horizon"),
        (F.col("scored_us") + F.col("prediction_id")).alias("evaluated_us"),
        "model_version",
        F.col("prob_30d").alias("roc_auc"),
    )


SNAP_OUT = f"SELECT prediction_id, horizon, evaluated_us + prediction_id AS evaluated_us, model_version, {r('roc_auc')} AS roc_auc FROM sn WHERE horizon = "


@check("eval_history", WS + SNAP_SQL + SNAP_OUT + "'30d' ORDER BY evaluated_us + prediction_id DESC LIMIT 20")
def _(t):
    return serving.eval_history(snapshots(t), "30d", 20)


@check("latest_eval", WS + SNAP_SQL + SNAP_OUT + "'7d' ORDER BY evaluated_us + prediction_id DESC LIMIT 1")
def _(t):
    return serving.latest_eval(snapshots(t), "7d")


WI = with_views("importance")
RANKED = """, rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY importance_gain DESC, feature) AS INT) AS rank FROM importance)"""


@check("importance_ranking", WI + RANKED + f"SELECT feature, target, {r('importance_gain')} AS importance_gain, importance_split, rank FROM rk WHERE rank <= 5")
def _(t):
    return serving.importance_ranking(t.importance, 5)


@check(
    "rank_by_horizon",
    WI
    + RANKED
    + """, w AS (SELECT feature, coalesce(max(rank) FILTER (target = 'label_7d'), 999) AS rank_label_7d, coalesce(max(rank) FILTER (target = 'label_30d'), 999) AS rank_label_30d,
        coalesce(max(rank) FILTER (target = 'label_365d'), 999) AS rank_label_365d FROM rk GROUP BY feature)
      SELECT *, least(rank_label_7d, rank_label_30d, rank_label_365d) AS min_rank FROM w WHERE least(rank_label_7d, rank_label_30d, rank_label_365d) <= 10""",
)
def _(t):
    return serving.rank_by_horizon(t.importance, ["label_7d", "label_30d", "label_365d"])


SELECTED = """, tp AS (SELECT * FROM rk WHERE rank <= 20),
   ag AS (SELECT feature, sum(importance_gain) AS total_gain, string_agg(target, ',' ORDER BY target) AS targets, avg(rank) AS avg_rank, count(*) AS n_targets FROM tp GROUP BY feature)"""


@check("feature_selection", WI + RANKED + SELECTED + f"SELECT feature, {r('total_gain')} AS total_gain, targets, {r('avg_rank')} AS avg_rank, n_targets FROM ag")
def _(t):
    ranked, _ = serving.feature_selection(t.importance)
    return ranked


@check(
    "feature_selection_names",
    WI + RANKED + SELECTED + "SELECT feature FROM ag WHERE feature NOT IN ('Brand#2') UNION SELECT unnest(['latitude', 'Brand#1'])",
)
def _(t):
    _, names = serving.feature_selection(t.importance, keep=["latitude", "Brand#1"], drop=["Brand#2"])
    return names


WR = with_views("runs")
KINDS = "('benchmark_train', 'best_params_retrain', 'feature_ablation', 'feature_selection_train')"


def latest_sql(kinds: str, keys: str) -> str:
    return (
        WR
        + f"""SELECT run_id, start_us, benchmark_id, run_kind, target, variant, {r('test_pr_auc')} AS test_pr_auc FROM runs
      WHERE benchmark_id = 'benchmark_v2' AND run_kind IN {kinds} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY start_us DESC, run_id DESC) = 1"""
    )


@check("latest_run_per_key", latest_sql(KINDS, "target, run_kind, variant"))
def _(t):
    kinds = ["benchmark_train", "best_params_retrain", "feature_ablation", "feature_selection_train"]
    return serving.latest_run_per_key(t.runs, kinds)


COMPACT = "('best_params_retrain', 'feature_selection_train', 'compact_best_params_retrain')"


@check("latest_run_per_target_kind", latest_sql(COMPACT, "target, run_kind"))
def _(t):
    kinds = ["best_params_retrain", "feature_selection_train", "compact_best_params_retrain"]
    return serving.latest_run_per_key(t.runs, kinds, keys=["target", "run_kind"])


@check("newest_runs", WR + f"SELECT run_id, start_us, benchmark_id, run_kind, target, variant, {r('test_pr_auc')} AS test_pr_auc FROM runs ORDER BY start_us DESC, run_id DESC LIMIT 20")
def _(t):
    return serving.newest_runs(t.runs, 20)


@check(
    "baseline_vs_challenger",
    WR
    + f""", nw AS (SELECT * FROM runs WHERE benchmark_id = 'benchmark_v2'),
      b AS (SELECT run_id AS baseline_run, test_pr_auc AS baseline_test_pr_auc FROM nw WHERE run_kind = 'baseline' ORDER BY start_us DESC, run_id DESC LIMIT 1),
      c AS (SELECT target, run_id AS challenger_run, test_pr_auc AS challenger_test_pr_auc FROM nw WHERE run_kind = 'benchmark_train' AND test_pr_auc IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY target ORDER BY start_us DESC, run_id DESC) = 1)
      SELECT target, baseline_run, {r('baseline_test_pr_auc')} AS baseline_test_pr_auc, challenger_run, {r('challenger_test_pr_auc')} AS challenger_test_pr_auc
      FROM (SELECT unnest(['label_7d', 'label_30d']) AS target, * FROM b) LEFT JOIN c USING (target)""",
)
def _(t):
    return serving.baseline_vs_challenger(t.runs, ["test_pr_auc"])
