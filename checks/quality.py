"""Metrics, threshold sweeps, baselines, evaluation snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, r
from epicell.fixtures import with_views
from epicell.operators import quality, serving, splits

WS = with_views("scored")

# scores ranked one by one: mean ranks for ties, and the step sum over distinct scores
METRICS = """, sc AS (SELECT {keys} prob AS s, y FROM {source} WHERE prob IS NOT NULL AND y IS NOT NULL),
   gp AS (SELECT {keys} s, sum(y) AS pos, count(*) - sum(y) AS neg FROM sc GROUP BY {keys} s),
   cu AS (SELECT *, sum(pos) OVER (PARTITION BY {part} ORDER BY s DESC) AS tp, sum(neg) OVER (PARTITION BY {part} ORDER BY s DESC) AS fp,
     sum(pos) OVER (PARTITION BY {part}) AS p, sum(neg) OVER (PARTITION BY {part}) AS n FROM gp),
   mt AS (SELECT {keys} CAST(any_value(p + n) AS BIGINT) AS sample_size, any_value(p) / any_value(p + n) AS positive_rate,
     CASE WHEN any_value(p) > 0 AND any_value(n) > 0 THEN sum(pos * (n - fp + neg / 2)) / (any_value(p)::DOUBLE * any_value(n)::DOUBLE) END AS roc_auc,
     CASE WHEN any_value(p) > 0 AND any_value(n) > 0 THEN sum(pos * (tp / (tp + fp))) / any_value(p) END AS pr_auc FROM cu GROUP BY {group}),
   br AS (SELECT {keys} avg(pow(s - y, 2)) AS brier_score FROM sc GROUP BY {group})"""


def metrics_sql(keys: list[str], source: str) -> str:
    cols = "".join(f"{k}, " for k in keys)
    return METRICS.format(keys=cols, source=source, part=", ".join(keys) or "1", group=", ".join(keys) or "ALL").replace("GROUP BY ALL", "")


ONE = ", src AS (SELECT prob_7d AS prob, label_7d AS y FROM scored)"


@check("roc_auc", WS + ONE + metrics_sql([], "src") + f"SELECT {r('roc_auc')} AS roc_auc FROM mt")
def _(t):
    return quality.roc_auc(t.scored, "prob_7d", "label_7d")


@check("average_precision", WS + ONE + metrics_sql([], "src") + f"SELECT {r('pr_auc')} AS pr_auc FROM mt")
def _(t):
    return quality.average_precision(t.scored, "prob_7d", "label_7d")


@check("brier_score", WS + ONE + f"SELECT {r('avg(pow(prob - y, 2))')} AS brier_score FROM src")
def _(t):
    return quality.brier_score(t.scored, "prob_7d", "label_7d")


GROUPED = ", src AS (SELECT coalesce(model_version, 'none') AS model_version, prob_7d AS prob, label_7d AS y FROM scored)"


@check(
    "metrics_guarded",
    WS
    + GROUPED
    + metrics_sql(["model_version"], "src")
    + f"""SELECT model_version, sample_size, {r('positive_rate')} AS positive_rate, {r('brier_score')} AS brier_score, {r('roc_auc')} AS roc_auc, {r('pr_auc')} AS pr_auc
      FROM mt JOIN br USING (model_version)""",
)
def _(t):
    s = t.scored.withColumn("model_version", F.coalesce("model_version", F.lit("none")))
    return quality.metrics_guarded(s, "prob_7d", "label_7d", ["model_version"])


@check(
    "eval_snapshots",
    WS
    + """, src AS (SELECT model_version, 'b' AS benchmark_id, 'f' AS feature_set_version, 'd' AS dataset_version, '7d' AS horizon, prob_7d AS prob, label_7d AS y, event_us FROM scored WHERE model_version IS NOT NULL
        UNION ALL SELECT model_version, 'b', 'f', 'd', '30d', prob_30d, label_30d, event_us FROM scored WHERE model_version IS NOT NULL)"""
    + metrics_sql(["model_version", "benchmark_id", "feature_set_version", "dataset_version", "horizon"], "src")
    + f""", wi AS (SELECT model_version, horizon, min(event_us) AS window_start_us, max(event_us) AS window_end_us FROM src WHERE prob IS NOT NULL AND y IS NOT NULL GROUP BY ALL)
      SELECT model_version, benchmark_id, feature_set_version, dataset_version, horizon, sample_size, {r('positive_rate')} AS positive_rate, {r('brier_score')} AS brier_score,
      {r('roc_auc')} AS roc_auc, {r('pr_auc')} AS pr_auc, window_start_us, window_end_us
      FROM mt JOIN br USING (model_version, benchmark_id, feature_set_version, dataset_version, horizon) JOIN wi USING (model_version, horizon) WHERE roc_auc IS NOT NULL""",
)
def _(t):
    fixed = {"benchmark_id": F.lit("b"), "feature_set_version": F.lit("f"), "dataset_version": F.lit("d")}
    log = t.scored.select("prediction_id", "event_id", "event_us", "prob_7d", "prob_30d", "model_version").withColumns(fixed)
    out = t.scored.select("prediction_id", "event_id", (F.col("label_7d") == 1).alias("label_7d"), (F.col("label_30d") == 1).alias("label_30d"))
    return serving.eval_snapshots(log, out)


PRED = ", pd AS (SELECT label_7d AS y, CASE WHEN prob_7d >= 0.5::DOUBLE THEN 1 ELSE 0 END AS p FROM scored WHERE prob_7d IS NOT NULL AND label_7d IS NOT NULL)"
MATRIX = """, cm AS (SELECT count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp FROM pd)"""


def predicted(t):
    return t.scored.where("prob_7d IS NOT NULL").withColumn("pred", (F.col("prob_7d") >= 0.5).cast("int"))


@check("confusion_matrix", WS + PRED + MATRIX + "SELECT * FROM cm")
def _(t):
    return quality.confusion_matrix(predicted(t), "label_7d", "pred")


@check(
    "classification_report",
    WS
    + PRED
    + MATRIX
    + f""", a AS (SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn + fp AS s0, tp + fn AS s1, tn + tp AS good FROM cm),
      b AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1, s0 + s1 AS s FROM a)
      SELECT '0' AS class_name, {r('p0')} AS "precision", {r('r0')} AS recall, {r('f0')} AS f1, s0 AS support FROM b UNION ALL SELECT '1', {r('p1')}, {r('r1')}, {r('f1')}, s1 FROM b
      UNION ALL SELECT 'accuracy', NULL, NULL, {r('good / s')}, s FROM b UNION ALL SELECT 'macro avg', {r('(p0 + p1) / 2')}, {r('(r0 + r1) / 2')}, {r('(f0 + f1) / 2')}, s FROM b
      UNION ALL SELECT 'weighted avg', {r('(p0 * s0 + p1 * s1) / s')}, {r('(r0 * s0 + r1 * s1) / s')}, {r('(f0 * s0 + f1 * s1) / s')}, s FROM b""",
)
def _(t):
    return quality.classification_report(predicted(t), "label_7d", "pred")


@check(
    "fbeta",
    WS
    + f"""SELECT prediction_id, {r('CASE WHEN prob_30d + label_30d = 0 THEN 0 ELSE 5 * prob_30d * label_30d / (4 * prob_30d + label_30d) END')} AS f2,
      {r('CASE WHEN prob_30d + label_30d = 0 THEN 0 ELSE 2 * prob_30d * label_30d / (prob_30d + label_30d) END')} AS f1 FROM scored""",
)
def _(t):
    p, q = F.col("prob_30d"), F.col("label_30d").cast("double")
    return t.scored.select("prediction_id", quality.fbeta(p, q, 2.0).alias("f2"), quality.fbeta(p, q, 1.0).alias("f1"))


SWEEP = """, pr AS (SELECT prob_7d AS s, label_7d AS y FROM scored WHERE prob_7d IS NOT NULL AND label_7d IS NOT NULL), th AS (SELECT i, {grid} AS t FROM range({n}) q(i)),
   sw AS (SELECT i, t, count(*) FILTER (s >= t AND y = 1) AS tp, count(*) FILTER (s >= t AND y = 0) AS fp, count(*) FILTER (y = 1) AS p FROM pr, th GROUP BY i, t),
   me AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pc, coalesce(tp / nullif(p, 0), 0) AS rc FROM sw)"""


@check(
    "threshold_sweep_f2",
    WS
    + SWEEP.format(grid="CASE WHEN i = 198 THEN 0.99::DOUBLE ELSE 0.01::DOUBLE + i * (0.98::DOUBLE / 198) END", n=199)
    + f""", f AS (SELECT *, CASE WHEN pc + rc = 0 THEN 0 ELSE 5 * pc * rc / (4 * pc + rc) END AS f2 FROM me)
      SELECT {r('t')} AS threshold, {r('f2')} AS f2 FROM f ORDER BY f.f2 DESC, i LIMIT 1""",
)
def _(t):
    return quality.threshold_sweep_f2(t.scored, "prob_7d", "label_7d")


@check(
    "threshold_sweep_f1",
    WS
    + SWEEP.format(grid="0.05::DOUBLE + i * 0.05::DOUBLE", n=10)
    + f""", f AS (SELECT i, round(t, 2) AS t, round(pc, 4) AS pc, round(rc, 4) AS rc, round(CASE WHEN pc + rc = 0 THEN 0 ELSE 2 * pc * rc / (pc + rc) END, 4) AS f1 FROM me)
      SELECT {r('t')} AS threshold, {r('pc')} AS "precision", {r('rc')} AS recall, {r('f1')} AS f1, i = (SELECT i FROM f ORDER BY f1 DESC, i LIMIT 1) AS is_best FROM f""",
)
def _(t):
    return quality.threshold_sweep_f1(t.scored, "prob_7d", "label_7d")


@check(
    "regression_metrics",
    WS
    + f"""SELECT {r('round(sqrt(avg(pow(prob_7d - prob_30d, 2))), 4)')} AS rmse, {r('round(avg(abs(prob_7d - prob_30d)), 4)')} AS mae,
      {r('round(1 - sum(pow(prob_7d - prob_30d, 2)) / (var_pop(prob_7d) * count(*)), 4)')} AS r2 FROM scored WHERE prob_7d IS NOT NULL""",
)
def _(t):
    return quality.regression_metrics(t.scored.where("prob_7d IS NOT NULL"), "prob_7d", "prob_30d")


@check(
    "class_weight",
    WS + f"SELECT count(*) FILTER (label_7d = 0) AS neg, count(*) FILTER (label_7d = 1) AS pos, {r('count(*) FILTER (label_7d = 0) / count(*) FILTER (label_7d = 1)')} AS weight FROM scored",
)
def _(t):
    return quality.class_weight(t.scored, "label_7d")


SPLIT_CASE = "CASE WHEN scored_us <= 852076800000000 THEN 'train' WHEN scored_us <= 915148800000000 THEN 'validation' ELSE 'test' END"


def split_scored(t):
    s = F.col("scored_us")
    kind = F.when(s <= splits.midnight_us("1997-01-01"), "train").when(s <= splits.midnight_us("1999-01-01"), "validation")
    return t.scored.withColumn("split", kind.otherwise("test"))


@check(
    "class_frequency_baseline",
    WS
    + f""", s AS (SELECT {SPLIT_CASE} AS split, unnest(['label_7d', 'label_30d']) AS target, unnest([label_7d, label_30d]) AS y FROM scored),
      q AS (SELECT target, avg(y) AS p FROM s WHERE split = 'train' GROUP BY target)
      SELECT target, split, count(y) AS sample_size, {r('any_value(p)')} AS train_positive_rate, {r('avg(y)')} AS pr_auc, {r('0.5')} AS roc_auc, {r('avg(pow(p - y, 2))')} AS brier_score
      FROM s JOIN q USING (target) WHERE split <> 'train' GROUP BY target, split""",
)
def _(t):
    return quality.class_frequency_baseline(split_scored(t), ["label_7d", "label_30d"])


@check(
    "model_delta",
    WS
    + ", src AS (SELECT model_version, prob_7d AS prob, label_7d AS y FROM scored WHERE model_version IN ('m0', 'm1', 'm2'))"
    + metrics_sql(["model_version"], "src")
    + metrics_sql(["model_version"], "src2").replace("sc AS", "sc2 AS").replace("FROM sc ", "FROM sc2 ").replace("gp AS", "gp2 AS").replace("FROM gp)", "FROM gp2)").replace("cu AS", "cu2 AS").replace("FROM cu ", "FROM cu2 ").replace("mt AS", "mt2 AS").replace("br AS", "br2 AS").replace("FROM src2", "FROM (SELECT model_version, prob_30d AS prob, label_7d AS y FROM scored WHERE model_version IN ('m0', 'm1', 'm2')) src2")
    + f"""SELECT model_version, {r('a.roc_auc')} AS roc_auc_base, {r('b.roc_auc')} AS roc_auc_new, {r('b.roc_auc - a.roc_auc')} AS roc_auc_delta,
      {r('a.pr_auc')} AS pr_auc_base, {r('b.pr_auc')} AS pr_auc_new, {r('b.pr_auc - a.pr_auc')} AS pr_auc_delta FROM mt a JOIN mt2 b USING (model_version)""",
)
def _(t):
    s = t.scored.where("model_version IN ('m0', 'm1', 'm2')")
    base = quality.ranking_metrics(s, "prob_7d", "label_7d", ["model_version"])
    new = quality.ranking_metrics(s, "prob_30d", "label_7d", ["model_version"])
    return quality.model_delta(base, new, ["model_version"], ["roc_auc", "pr_auc"])
