"""Reads on the served tables, delayed outcomes, run comparison, feature selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epicell.constants import DAY_US, MIN_MAG_WINDOW
from epicell.functions.scoring import risk_code, risk_label
from epicell.operators.followups import followup_exists
from epicell.operators.quality import ranking_metrics
from epicell.operators.shape import pick_last

PUBLIC_COLUMNS = (
    "event_id event_us latitude longitude depth magnitude prob_7d prob_30d prob_365d risk_7d risk_30d risk_365d"
    " scored_us model_version benchmark_id feature_set_version dataset_version"
).split()
PUBLIC_REQUIRED = (
    "event_id event_us latitude longitude depth magnitude prob_7d prob_30d risk_7d risk_30d scored_us".split()
)
FEED_REQUIRED = ["event_id", "event_us", "scored_us"]
HORIZON_CODES = ("7d", "30d", "365d")
VALID_HORIZONS = ("7d", "30d")
VERSION_KEYS = ["model_version", "benchmark_id", "feature_set_version", "dataset_version"]

FEED_LIMIT, FEED_MAX = 50, 200
RUN_LIST_LIMIT = 200


# ---- events and scores ------------------------------------------------------


def latest_events(df: DataFrame, n: int) -> DataFrame:
    """The n most recent M>=4 events; ties by event_id."""
    strong = df.where(F.col("magnitude") >= MIN_MAG_WINDOW)
    return strong.orderBy(F.desc("event_us"), "event_id").limit(n)


def public_rows(scored: DataFrame) -> DataFrame:
    """Public columns plus `valid` and the risk codes, filled from the probabilities when absent."""
    null = F.lit(None)
    shown = scored.select(*[F.col(c) if c in scored.columns else null.alias(c) for c in PUBLIC_COLUMNS], *[
        F.coalesce(
            F.col(f"risk_{h}_code") if f"risk_{h}_code" in scored.columns else null.cast("string"),
            risk_code(F.col(f"prob_{h}").cast("double") if f"prob_{h}" in scored.columns else null.cast("double"), False),
        ).alias(f"risk_{h}_code")
        for h in HORIZON_CODES
    ])
    complete = F.lit(True)
    for c in PUBLIC_REQUIRED:
        complete = complete & F.col(c).isNotNull()
    return shown.withColumn("valid", complete)


def scored_feed(scored: DataFrame, limit: int = FEED_LIMIT) -> DataFrame:
    """Newest scores first, at most `limit` (1 to 200), limited before validation. Rows that fail
    the schema stay, marked `valid` = false, so they can be counted."""
    if not 1 <= limit <= FEED_MAX:
        raise ValueError(f"limit must be 1 to {FEED_MAX}")
    rows = scored.dropna(subset=FEED_REQUIRED).orderBy(F.desc("scored_us"), *_tie(scored)).limit(limit)
    return public_rows(rows)


def _tie(df: DataFrame) -> list[Column]:
    return [F.col(c) for c in ("prediction_id", "event_id") if c in df.columns]


def feed_meta(feed: DataFrame, limit: int = FEED_LIMIT) -> DataFrame:
    return feed.agg(
        F.count_if("valid").alias("count"), F.lit(limit).alias("limit"), F.count_if(~F.col("valid")).alias("rejected")
    )


def recent_scored(scored: DataFrame, limit: int = 50, min_prob_7d: float | None = None) -> DataFrame:
    """Newest first; with a floor, rows without prob_7d are out."""
    rows = scored if min_prob_7d is None else scored.where(F.col("prob_7d") >= min_prob_7d)
    return rows.orderBy(F.desc("scored_us"), *_tie(scored)).limit(limit)


def lookup_event(scored: DataFrame, event_id: str) -> DataFrame:
    """The public row of one event: the key filter reaches the scan."""
    found = scored.where(F.col("event_id") == event_id)
    return public_rows(found.orderBy(F.desc("scored_us"), *_tie(scored)).limit(1)).drop("valid")


def unscored_events(events: DataFrame, log: DataFrame, model_version: str) -> DataFrame:
    """Events without a log row for this model version."""
    done = log.where(F.col("model_version") == model_version).select("event_id").distinct()
    return events.join(done, "event_id", "left_anti")


def with_risk(df: DataFrame, horizons: Sequence[str] = HORIZON_CODES) -> DataFrame:
    out = {}
    for h in horizons:
        out[f"risk_{h}"] = risk_label(F.col(f"prob_{h}"))
        out[f"risk_{h}_code"] = risk_code(F.col(f"prob_{h}"))
    return df.withColumns(out)


# ---- outcomes and evaluation ------------------------------------------------


def pending_outcomes(outcomes: DataFrame, now_us: int, limit: int | None = None) -> DataFrame:
    """Outcomes with an open label whose horizon has passed; with a `limit` those that matured first."""
    due = F.lit(False)
    for h in VALID_HORIZONS:
        due = due | (F.col(f"label_{h}").isNull() & (F.col(f"maturity_{h}_us") <= now_us))
    rows = outcomes.where(due)
    return rows if limit is None else rows.orderBy("maturity_7d_us", "prediction_id").limit(limit)


def resolve_outcomes(pending: DataFrame, catalog: DataFrame, now_us: int) -> DataFrame:
    """Open labels whose horizon has passed are filled from the catalogue; resolved ones stay."""
    out = pending
    for h in VALID_HORIZONS:
        days = int(h[:-1])
        open_now = F.col(f"label_{h}").isNull() & (F.col(f"maturity_{h}_us") <= now_us)
        asked = out.where(open_now).select(F.col("prediction_id").alias("event_id"), "event_us", "latitude", "longitude")
        hits = followup_exists(asked, catalog, days).select(F.col("event_id").alias("prediction_id"), "has_followup")
        out = out.join(hits, "prediction_id", "left")
        out = out.withColumn(
            f"evaluated_{h}_us", F.when(F.col("has_followup").isNotNull(), F.lit(now_us)).otherwise(F.col(f"evaluated_{h}_us"))
        )
        out = out.withColumn(f"label_{h}", F.coalesce(f"label_{h}", "has_followup")).drop("has_followup")
    return out


def open_outcomes(log: DataFrame) -> DataFrame:
    """Empty outcomes of logged predictions with their maturity instants."""
    return log.select(
        "prediction_id",
        "event_id",
        "event_us",
        "latitude",
        "longitude",
        *[
            c
            for h in VALID_HORIZONS
            for c in (
                (F.col("event_us") + int(h[:-1]) * DAY_US).alias(f"maturity_{h}_us"),
                F.lit(None).cast("boolean").alias(f"label_{h}"),
                F.lit(None).cast("bigint").alias(f"evaluated_{h}_us"),
            )
        ],
    )


def join_predictions_outcomes(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Inner join on (prediction_id, event_id); columns in both get _pred and _out."""
    keys = ["prediction_id", "event_id"]
    both = (set(log.columns) & set(outcomes.columns)) - set(keys)
    a = log.withColumnsRenamed({c: f"{c}_pred" for c in both})
    b = outcomes.withColumnsRenamed({c: f"{c}_out" for c in both})
    return a.join(b, keys)


def eval_snapshots(log: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row per horizon and version keys with both classes present.

    Rows need score and label; a NULL version key drops the row, as grouping does there.
    """
    joined = join_predictions_outcomes(log, outcomes)
    when = "event_us_pred" if "event_us_pred" in joined.columns else "event_us"
    sides = [
        F.struct(
            F.lit(h).alias("horizon"), F.col(f"prob_{h}").alias("score"), F.col(f"label_{h}").cast("int").alias("label")
        )
        for h in VALID_HORIZONS
    ]
    long = joined.select(*VERSION_KEYS, F.col(when).alias("event_us"), F.explode(F.array(*sides)).alias("h"))
    long = long.select(*VERSION_KEYS, "event_us", "h.*").dropna(subset=[*VERSION_KEYS, "score", "label"])
    keys = [*VERSION_KEYS, "horizon"]
    windows = long.groupBy(*keys).agg(
        F.min("event_us").alias("window_start_us"), F.max("event_us").alias("window_end_us")
    )
    metrics = ranking_metrics(long, "score", "label", keys).where(F.col("roc_auc").isNotNull())
    return metrics.join(windows, keys)


def eval_history(snapshots: DataFrame, horizon: str = "7d", limit: int = 20) -> DataFrame:
    if horizon not in VALID_HORIZONS:
        raise ValueError(f"horizon must be one of {VALID_HORIZONS}")
    tie = [c for c in VERSION_KEYS if c in snapshots.columns]
    return snapshots.where(F.col("horizon") == horizon).orderBy(F.desc("evaluated_us"), *tie).limit(limit)


def latest_eval(snapshots: DataFrame, horizon: str = "7d") -> DataFrame:
    return eval_history(snapshots, horizon, 1)


# ---- feature importance -----------------------------------------------------

# ---- fixed values: features always kept and always dropped by the selection ----
FORCE_KEEP = (
    "latitude longitude magnitude count_1d count_7d count_30d count_90d energy_1d energy_7d energy_30d energy_90d"
    " b_value_7d b_value_90d mag_mean_90d"
).split()
FORCE_DROP = ["background_rate_yr"]
# ---- end of fixed values ----

ABSENT_RANK = 999


def ranked_importance(imp: DataFrame, by: Sequence[str] = ("target",)) -> DataFrame:
    """Adds `rank` per group; rows are features, so a group is as small as the model is wide."""
    order = Window.partitionBy(*by).orderBy(F.desc("importance_gain"), "feature")
    return imp.withColumn("rank", F.row_number().over(order))


def importance_ranking(imp: DataFrame, k: int = 20) -> DataFrame:
    return ranked_importance(imp).where(F.col("rank") <= k)


def rank_by_horizon(imp: DataFrame, targets: Sequence[str], k: int = 10) -> DataFrame:
    """Union of the top k features of each target with their rank in every target."""
    ranks = ranked_importance(imp).groupBy("feature").agg(
        *[
            F.coalesce(F.max(F.when(F.col("target") == t, F.col("rank"))), F.lit(ABSENT_RANK)).alias(f"rank_{t}")
            for t in targets
        ]
    )
    columns = [F.col(f"rank_{t}") for t in targets]
    best = F.least(*columns) if len(columns) > 1 else columns[0]
    return ranks.withColumn("min_rank", best).where(F.col("min_rank") <= k).orderBy("min_rank", "feature")


def feature_selection(
    imp: DataFrame, n: int = 20, keep: Sequence[str] = FORCE_KEEP, drop: Sequence[str] = FORCE_DROP
) -> tuple[DataFrame, DataFrame]:
    """(ranked features, selected names). Selected = ranked without the drop list, with the keep list."""
    top = ranked_importance(imp).where(F.col("rank") <= n)
    ranked = top.groupBy("feature").agg(
        F.sum("importance_gain").alias("total_gain"),
        F.concat_ws(",", F.array_sort(F.collect_set("target"))).alias("targets"),
        F.avg("rank").alias("avg_rank"),
        F.count(F.lit(1)).alias("n_targets"),
    )
    ranked = ranked.orderBy(F.desc("n_targets"), F.desc("total_gain"), "avg_rank", "feature")
    spark = imp.sparkSession
    kept = spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keep])).alias("feature"))
    names = ranked.select("feature").where(~F.col("feature").isin(*drop)).union(kept).distinct().orderBy("feature")
    return ranked, names


# ---- run log ----------------------------------------------------------------


def newest_runs(runs: DataFrame, limit: int = RUN_LIST_LIMIT) -> DataFrame:
    """The newest runs; ties by the larger run_id."""
    return runs.orderBy(F.desc("start_us"), F.desc("run_id")).limit(limit)


def latest_run_per_key(
    runs: DataFrame, kinds: Sequence[str], keys: Sequence[str] = ("target", "run_kind", "variant"),
    benchmark_id: str = "benchmark_v2", targets: Sequence[str] = ("label_7d", "label_30d"),
) -> DataFrame:
    """Newest run per key, of all runs of the benchmark, kinds and targets."""
    wanted = runs.where(
        (F.col("benchmark_id") == benchmark_id) & F.col("run_kind").isin(*kinds) & F.col("target").isin(*targets)
    )
    return pick_last(wanted, list(keys), [F.col("start_us"), F.col("run_id")])


def baseline_vs_challenger(
    runs: DataFrame, metrics: Sequence[str], benchmark_id: str = "benchmark_v2",
    targets: Sequence[str] = ("label_7d", "label_30d"),
) -> DataFrame:
    """Newest baseline next to the newest complete challenger of each target; no baseline, no rows.

    A target without a complete challenger keeps its row.
    """
    listed = runs.where(F.col("benchmark_id") == benchmark_id)
    base = listed.where(F.col("run_kind") == "baseline").orderBy(F.desc("start_us"), F.desc("run_id")).limit(1)
    complete = listed.where((F.col("run_kind") == "benchmark_train") & F.col("target").isin(*targets))
    complete = complete.dropna(subset=list(metrics))
    best = pick_last(complete, ["target"], [F.col("start_us"), F.col("run_id")])
    asked = base.select(
        F.col("run_id").alias("baseline_run"),
        *[F.col(m).alias(f"baseline_{m}") for m in metrics],
        F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"),
    )
    shown = best.select("target", F.col("run_id").alias("challenger_run"), *[F.col(m).alias(f"challenger_{m}") for m in metrics])
    return asked.join(shown, "target", "left")
