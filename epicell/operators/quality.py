"""Model quality: tie-exact ranking metrics, matrices, threshold sweeps, baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicell.operators.order_stats import running_below


def ranking_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: sample_size, positive_rate, brier_score, roc_auc, pr_auc.

    Rows without score or label are ignored. Equal scores are merged first, ties count half in
    the ROC area, and the precision area is the step sum over distinct scores. With one class
    only the two areas are NULL.
    """
    by = list(by)
    y = F.col(label).cast("bigint")
    scored = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    s = F.col(score).cast("double")
    grouped = scored.groupBy(*by, s.alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    ranked = running_below(grouped, by, "score", ["pos", "neg"])
    p, n = F.sum("pos"), F.sum("neg")
    # from the written rows, so the scores are counted once
    totals = ranked.groupBy(*by).agg(
        p.alias("p_all"),
        n.alias("n_all"),
        # the squared error needs the score and the two counts of a score only
        F.sum(F.col("pos") * F.pow(F.col("score") - 1.0, 2) + F.col("neg") * F.pow(F.col("score"), 2)).alias("sq"),
    )
    totals = totals.withColumn("size", F.col("p_all") + F.col("n_all"))
    if by:
        rows = ranked.join(totals, by)
    else:
        one = totals.select(F.struct("p_all", "n_all", "sq", "size").alias("t")).scalar()
        rows = ranked.withColumn("t", one).select("*", "t.*").drop("t")
    tp = F.col("p_all") - F.col("pos_below")
    fp = F.col("n_all") - F.col("neg_below")
    step = F.col("pos") * (tp / (tp + fp))
    won = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)
    sums = rows.groupBy(*by).agg(
        F.first("size").alias("sample_size"),
        (F.first("p_all") / F.first("size")).alias("positive_rate"),
        (F.first("sq") / F.first("size")).alias("brier_score"),
        F.try_divide(F.sum(won), F.first("p_all").cast("double") * F.first("n_all")).alias("roc_auc"),
        F.when(F.first("n_all") > 0, F.try_divide(F.sum(step), F.first("p_all"))).alias("pr_auc"),
    )
    return sums


def roc_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, label, by).select(*by, "roc_auc")


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(df, score, label, by).select(*by, "pr_auc")


def brier_score(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared difference; needs no order, so it is one aggregation."""
    error = F.col(score) - F.col(label)
    return df.groupBy(*by).agg(F.avg(error * error).alias("brier_score"))


def metrics_guarded(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """All metrics; a single-class group keeps size, rate and Brier score and has no areas."""
    return ranking_metrics(df, score, label, by)


def confusion_matrix(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    y, p = F.col(label) == 1, F.col(predicted) == 1
    complete = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull())
    return complete.groupBy(*by).agg(
        F.count_if(~y & ~p).alias("tn"),
        F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"),
        F.count_if(y & p).alias("tp"),
    )


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def fbeta(precision: Column, recall: Column, beta: float) -> Column:
    """(1 + b2) P R / (b2 P + R), 0 when both are 0."""
    b2 = beta * beta
    return F.when(precision + recall == 0, F.lit(0.0)).otherwise(
        ratio((1 + b2) * precision * recall, b2 * precision + recall)
    )


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """(class_name, precision, recall, f1, support) for both classes, accuracy, macro and weighted means."""
    m = confusion_matrix(df, label, predicted)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    parts = {
        "p0": ratio(tn, tn + fn),
        "r0": ratio(tn, tn + fp),
        "p1": ratio(tp, tp + fp),
        "r1": ratio(tp, tp + fn),
    }
    m = m.withColumns(parts).withColumns({"s0": tn + fp, "s1": tp + fn, "size": tn + fp + fn + tp})
    m = m.withColumns(
        {f"f{k}": fbeta(F.col(f"p{k}"), F.col(f"r{k}"), 1.0) for k in (0, 1)} | {"accuracy": ratio(tn + tp, F.col("size"))}
    )

    def mean(x: str) -> Column:
        return (F.col(f"{x}0") + F.col(f"{x}1")) / 2

    def weighted(x: str) -> Column:
        return ratio(F.col(f"{x}0") * F.col("s0") + F.col(f"{x}1") * F.col("s1"), F.col("size"))

    none = F.lit(None).cast("double")
    lines = [
        ("0", F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        ("1", F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        ("accuracy", none, none, F.col("accuracy"), F.col("size")),
        ("macro avg", mean("p"), mean("r"), mean("f"), F.col("size")),
        ("weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("size")),
    ]
    names = ("precision", "recall", "f1", "support")
    structs = [F.struct(F.lit(k).alias("class_name"), *[v.alias(n) for v, n in zip(vs, names)]) for k, *vs in lines]
    return m.select(F.explode(F.array(*structs)).alias("e")).select("e.*")


# ---- fixed values: the two threshold grids ----
F2_THRESHOLDS = tuple(0.01 + i * (0.98 / 198) for i in range(198)) + (0.99,)
F1_THRESHOLDS = tuple(0.05 + i * 0.05 for i in range(10))
# ---- end of fixed values ----


def threshold_counts(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, tp, fp, p_all): counts of score >= threshold.

    Scores fall between two thresholds first; the running sum is over the thresholds only.
    """
    y = F.col(label).cast("bigint")
    grid = F.array(*[F.lit(t) for t in thresholds])
    scored = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    by_score = scored.groupBy(F.col(score).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    passed = F.size(F.filter(grid, lambda t: t <= F.col("score")))
    bins = by_score.groupBy(passed.alias("passed")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    steps = F.posexplode(grid)
    # at most one row per threshold on either side
    held = bins.select("pos", "neg", "passed", steps.alias("pos_no", "threshold"))
    met = F.col("passed") > F.col("pos_no")
    return held.groupBy("pos_no", "threshold").agg(
        F.coalesce(F.sum(F.when(met, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(met, F.col("neg"))), F.lit(0)).alias("fp"),
        F.sum("pos").alias("p_all"),
    )


def threshold_sweep_f2(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row (threshold, f2): the first threshold with the largest F2; 0.5 and 0 when none is positive."""
    counts = threshold_counts(df, score, label, F2_THRESHOLDS)
    f2 = fbeta(ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("p_all")), 2.0)
    best = counts.withColumn("f2", f2).agg(F.max(F.struct("f2", -F.col("pos_no"), "threshold")).alias("b"))
    positive = F.coalesce(F.col("b.f2") > 0, F.lit(False))
    return best.select(
        F.when(positive, F.col("b.threshold")).otherwise(F.lit(0.5)).alias("threshold"),
        F.when(positive, F.col("b.f2")).otherwise(F.lit(0.0)).alias("f2"),
    )


def threshold_sweep_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """Ten rows (threshold, precision, recall, f1, is_best), rounded to 4; best = first maximum of F1."""
    counts = threshold_counts(df, score, label, F1_THRESHOLDS)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("p_all"))
    rows = counts.select(
        "pos_no",
        F.round("threshold", 2).alias("threshold"),
        F.round(p, 4).alias("precision"),
        F.round(r, 4).alias("recall"),
        F.round(fbeta(p, r, 1.0), 4).alias("f1"),
    )
    best = rows.agg(F.max_by("pos_no", F.struct("f1", -F.col("pos_no"))).alias("pos_no")).scalar()
    return rows.withColumn("is_best", F.col("pos_no") == best).drop("pos_no")


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R2, rounded to 4."""
    y, error = F.col(actual), F.col(actual) - F.col(predicted)
    sums = df.groupBy(*by).agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(y).alias("spread")
    )
    return sums.select(
        *by,
        F.round(F.sqrt("mse"), 4).alias("rmse"),
        F.round("mae", 4).alias("mae"),
        F.round(1.0 - F.try_divide(F.col("mse"), F.col("spread")), 4).alias("r2"),
    )


def class_weight(df: DataFrame, label: str) -> DataFrame:
    """(neg, pos, weight): weight = neg / pos."""
    counts = df.agg(F.count_if(F.col(label) == 0).alias("neg"), F.count_if(F.col(label) == 1).alias("pos"))
    return counts.withColumn("weight", F.try_divide(F.col("neg"), F.col("pos")))


def class_frequency_baseline(df: DataFrame, targets: Sequence[str], split: str = "split") -> DataFrame:
    """Metrics of the constant score "train positive rate" on validation and test.

    For a constant score the ROC area is one half, the precision area is the positive rate,
    and the Brier score follows from the two rates, so one aggregation is enough.
    """
    facts = df.groupBy(split).agg(
        *[F.count(t).alias(f"n_{t}") for t in targets], *[F.avg(F.col(t).cast("double")).alias(f"r_{t}") for t in targets]
    )
    structs = [
        F.struct(F.lit(t).alias("target"), F.col(f"n_{t}").alias("sample_size"), F.col(f"r_{t}").alias("rate"))
        for t in targets
    ]
    long = facts.select(split, F.explode(F.array(*structs)).alias("e")).select(split, "e.*")
    train = long.where(F.col(split) == "train").select("target", F.col("rate").alias("train_positive_rate"))
    both = long.where(F.col(split).isin("validation", "test")).join(train, "target")
    q, p = F.col("rate"), F.col("train_positive_rate")
    mixed = (q > 0) & (q < 1)
    return both.select(
        "target",
        split,
        "sample_size",
        "train_positive_rate",
        q.alias("pr_auc"),
        F.when(mixed, F.lit(0.5)).alias("roc_auc"),
        (q * (1 - p) * (1 - p) + (1 - q) * p * p).alias("brier_score"),
    )


def model_delta(base: DataFrame, challenger: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metrics of two runs side by side with challenger minus base."""
    a = base.select(*keys, *[F.col(m).alias(f"{m}_base") for m in metrics])
    b = challenger.select(*keys, *[F.col(m).alias(f"{m}_new") for m in metrics])
    return a.join(b, list(keys)).withColumns({f"{m}_delta": F.col(f"{m}_new") - F.col(f"{m}_base") for m in metrics})
