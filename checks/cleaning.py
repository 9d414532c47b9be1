"""Cleaning, encoding by data, derived features, imputation, splits, catalogue union."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, r, rlog
from epicell.fixtures import with_views
from epicell.operators import cleaning, features, impute, splits

WC = with_views("catalog")
WW = with_views("wide")


@check("filter_event_type", WC + """SELECT event_id, "type" FROM catalog WHERE lower(trim("type")) = 'earthquake'""")
def _(t):
    return cleaning.filter_event_type(t.catalog).select("event_id", "type")


@check("filter_event_type_lower", WC + """SELECT event_id, "type" FROM catalog WHERE lower("type") = 'earthquake'""")
def _(t):
    return cleaning.filter_event_type(t.catalog, match="lower").select("event_id", "type")


@check("filter_event_type_exact", WC + """SELECT event_id, trim("type") AS "type" FROM catalog WHERE trim("type") = 'Earthquake'""")
def _(t):
    return cleaning.filter_event_type(t.catalog.withColumn("type", F.trim("type")), match="exact").select("event_id", "type")


@check(
    "validate_event_input",
    WC
    + """, v AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 95 + latitude ELSE latitude END AS la, CASE WHEN event_id % 11 = 0 THEN NULL ELSE longitude END AS lo,
        depth * 2 AS de, CASE WHEN event_id % 13 = 0 THEN -1 ELSE magnitude END AS ma FROM catalog),
      w AS (SELECT event_id, concat_ws(',', CASE WHEN la IS NULL OR la NOT BETWEEN -90 AND 90 THEN 'latitude' END,
        CASE WHEN lo IS NULL OR lo NOT BETWEEN -180 AND 180 THEN 'longitude' END, CASE WHEN de IS NULL OR de NOT BETWEEN 0 AND 800 THEN 'depth' END,
        CASE WHEN ma IS NULL OR ma NOT BETWEEN 0 AND 10 THEN 'magnitude' END) AS reason FROM v)
      SELECT event_id, reason, reason = '' AS valid FROM w""",
)
def _(t):
    spoilt = t.catalog.select(
        "event_id",
        F.when(F.col("event_id") % 7 == 0, F.col("latitude") + 95).otherwise(F.col("latitude")).alias("latitude"),
        F.when(F.col("event_id") % 11 != 0, F.col("longitude")).alias("longitude"),
        (F.col("depth") * 2).alias("depth"),
        F.when(F.col("event_id") % 13 == 0, -1.0).otherwise(F.col("magnitude")).alias("magnitude"),
    )
    return cleaning.validate_event_input(spoilt).select("event_id", "valid", "reason")


@check(
    "drop_sparse_columns",
    WW
    + f"""SELECT l_orderkey, l_linenumber, {r('count_7d')} AS count_7d, {rlog('energy_7d')} AS energy_7d, {r('rate_7d')} AS rate_7d, {r('b_value_7d')} AS b_value_7d,
      {r('elapsed_since_last_s')} AS elapsed_since_last_s, {r('gap')} AS gap, constant_col, text_col, label_7d FROM wide""",
)
def _(t):
    return cleaning.drop_sparse_columns(t.wide, 0.6)


@check(
    "clean_basic",
    WC
    + f"""SELECT event_us, {r('latitude')} AS latitude, {r('longitude')} AS longitude, {r('depth')} AS depth, {r('magnitude')} AS magnitude,
      CASE WHEN magnitude >= 6 THEN 1 ELSE 0 END AS "Dangerous" FROM catalog WHERE depth IS NOT NULL AND lower("type") = 'earthquake'""",
)
def _(t):
    return cleaning.clean_basic(t.catalog)


def dated_wide(t):
    when = F.format_string("20%02d-03-04 05:06:07", F.col("l_orderkey") % 25)
    text = F.when(F.col("l_orderkey") % 29 == 0, "no time").otherwise(when)
    return t.wide.withColumns({"datetime": text, "label_365d": F.lit(1), "label_30d": F.col("label_7d")})


@check(
    "apply_cleaning_rules",
    WW
    + f"""SELECT l_orderkey, l_linenumber, {r('count_7d')} AS count_7d, {rlog('energy_7d')} AS energy_7d, {r('b_value_7d')} AS b_value_7d,
      {r('elapsed_since_last_s')} AS elapsed_since_last_s, {r('gap')} AS gap, not_constant_with_null, label_7d, label_7d AS label_30d,
      printf('20%02d-03-04 05:06:07', l_orderkey % 25) AS datetime FROM wide WHERE l_orderkey % 29 <> 0""",
)
def _(t):
    out, _ = cleaning.apply_cleaning_rules(dated_wide(t), cleaning.CLEANING_RULES_V2)
    return out.withColumn("datetime", F.date_format("datetime", "yyyy-MM-dd HH:mm:ss"))


@check(
    "encode_first_seen",
    WC
    + """, v AS (SELECT *, coalesce(mag_type, 'unknown') AS mt FROM catalog),
      f AS (SELECT mt, min((event_us, event_id)) AS seen_at FROM v WHERE magnitude >= 4 GROUP BY mt),
      c AS (SELECT mt, row_number() OVER (ORDER BY seen_at) - 1 AS code FROM f)
      SELECT event_id, CAST(code AS INT) AS mag_type_enc FROM v LEFT JOIN c USING (mt)""",
)
def _(t):
    return features.encode_first_seen(t.catalog, among=F.col("magnitude") >= 4).select("event_id", "mag_type_enc")


@check("derive_year_month", WC + "SELECT event_id, CAST(year(make_timestamp(event_us)) AS INT) AS \"Year\", CAST(month(make_timestamp(event_us)) AS INT) AS \"Month\" FROM catalog")
def _(t):
    return cleaning.derive_year_month(t.catalog).select("event_id", "Year", "Month")


# a feature-like frame straight from the catalogue, so that these checks stand alone
FEATURES_SQL = """, f AS (SELECT event_id, magnitude, depth, CAST(event_id % 4 AS BIGINT) AS count_1d, CAST(event_id % 4 + event_id % 5 AS BIGINT) AS count_7d,
      CAST(event_id % 4 + event_id % 5 + event_id % 3 AS BIGINT) AS count_30d, CAST(event_id % 4 + event_id % 5 + event_id % 3 + event_id % 11 AS BIGINT) AS count_90d,
      (event_id % 4 + event_id % 5) / 7 AS rate_7d, (event_id % 4 + event_id % 5 + event_id % 3) / 30 AS rate_30d,
      (event_id % 5) * 1000.5::DOUBLE AS energy_7d, (event_id % 5 + event_id % 3) * 1000.5::DOUBLE AS energy_30d, (event_id % 5 + event_id % 3 + event_id % 7) * 1000.5::DOUBLE AS energy_90d,
      (event_id % 5) * 2000.5::DOUBLE AS moment_7d, (event_id % 5 + event_id % 3) * 2000.5::DOUBLE AS moment_30d,
      CASE WHEN event_id % 3 = 0 THEN NULL ELSE 0.5::DOUBLE + event_id % 10 / 10 END AS b_value_30d, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 0.7::DOUBLE + event_id % 7 / 10 END AS b_value_90d,
      CASE WHEN event_id % 3 = 0 THEN NULL ELSE depth / 2 END AS depth_mean_7d, depth / 3 AS depth_mean_30d, CASE WHEN event_id % 4 = 0 THEN NULL ELSE magnitude + 0.25::DOUBLE END AS mag_max_30d,
      CASE WHEN event_id % 5 = 0 THEN NULL ELSE magnitude - 0.5::DOUBLE END AS mag_mean_7d, CASE WHEN event_id % 4 = 0 THEN NULL ELSE magnitude + 0.125::DOUBLE END AS mag_mean_30d,
      CASE WHEN event_id % 6 = 0 THEN NULL ELSE magnitude - 0.25::DOUBLE END AS mag_mean_90d, (event_id % 13) / 2 AS background_rate_yr FROM catalog)"""


def feature_frame(t):
    e, m, d = F.col("event_id"), F.col("magnitude"), F.col("depth")
    n1, n7 = e % 4, e % 4 + e % 5
    n30 = n7 + e % 3
    skip = lambda k, v: F.when(e % k != 0, v)
    return t.catalog.select(
        "event_id",
        "magnitude",
        "depth",
        n1.alias("count_1d"),
        n7.alias("count_7d"),
        n30.alias("count_30d"),
        (n30 + e % 11).alias("count_90d"),
        (n7 / 7).alias("rate_7d"),
        (n30 / 30).alias("rate_30d"),
        ((e % 5) * 1000.5).alias("energy_7d"),
        ((e % 5 + e % 3) * 1000.5).alias("energy_30d"),
        ((e % 5 + e % 3 + e % 7) * 1000.5).alias("energy_90d"),
        ((e % 5) * 2000.5).alias("moment_7d"),
        ((e % 5 + e % 3) * 2000.5).alias("moment_30d"),
        skip(3, 0.5 + e % 10 / 10).alias("b_value_30d"),
        skip(4, 0.7 + e % 7 / 10).alias("b_value_90d"),
        skip(3, d / 2).alias("depth_mean_7d"),
        (d / 3).alias("depth_mean_30d"),
        skip(4, m + 0.25).alias("mag_max_30d"),
        skip(5, m - 0.5).alias("mag_mean_7d"),
        skip(4, m + 0.125).alias("mag_mean_30d"),
        skip(6, m - 0.25).alias("mag_mean_90d"),
        ((e % 13) / 2).alias("background_rate_yr"),
    )


EPS = "1e-9::DOUBLE"


def clipped(x: str, low: float, high: float) -> str:
    return r(f"CASE WHEN ({x}) IS NOT NULL THEN greatest({low}::DOUBLE, least({high}::DOUBLE, {x})) END")


@check(
    "ratio_features",
    WC
    + FEATURES_SQL
    + f"""SELECT event_id, {clipped(f'count_7d / (count_90d / 90 * 7 + {EPS})', 0, 500)} AS accel_count,
      {clipped(f'energy_7d / (energy_90d / 90 * 7 + {EPS})', 0, 500)} AS accel_energy, {r('magnitude - coalesce(mag_mean_90d, magnitude)')} AS mag_excess FROM f""",
)
def _(t):
    return features.ratio_features(feature_frame(t)).select("event_id", "accel_count", "accel_energy", "mag_excess")


@check(
    "thirty_day_features",
    WC
    + FEATURES_SQL
    + f"""SELECT event_id, {clipped(f'count_1d / (count_7d / 7 + {EPS})', 0, 100)} AS omori_proxy, {clipped(f'rate_7d / (rate_30d + {EPS})', 0, 200)} AS rate_7d_vs_30d,
      {clipped(f'energy_7d / (energy_30d / 30 * 7 + {EPS})', 0, 200)} AS energy_ratio, {clipped(f'moment_7d / (moment_30d / 30 * 7 + {EPS})', 0, 200)} AS moment_ratio,
      {clipped('coalesce(b_value_30d, b_value_90d, 1) - coalesce(b_value_90d, 1)', -1, 1)} AS b_trend_30d_90d,
      {clipped('coalesce(depth_mean_7d, depth) - coalesce(depth_mean_30d, depth)', -50, 50)} AS depth_migration,
      {clipped('magnitude - (coalesce(mag_max_30d, magnitude) - 1.2::DOUBLE)', -3, 3)} AS bath_proxy,
      {clipped('coalesce(mag_mean_7d, magnitude) - coalesce(mag_mean_30d, magnitude)', -2, 2)} AS mag_accel_7d_30d,
      {clipped(f'count_30d / (background_rate_yr * (30 / 365.25::DOUBLE) + {EPS})', 0, 500)} AS count_30d_norm FROM f""".replace("AS energy_ratio", "AS ratio_e").replace("AS moment_ratio", "AS ratio_m"),
)
def _(t):
    out = features.thirty_day_features(feature_frame(t))
    return out.select(
        "event_id",
        "omori_proxy",
        "rate_7d_vs_30d",
        F.col("energy_7d_vs_30d").alias("ratio_e"),
        F.col("moment_7d_vs_30d").alias("ratio_m"),
        "b_trend_30d_90d",
        "depth_migration",
        "bath_proxy",
        "mag_accel_7d_30d",
        "count_30d_norm",
    )


@check(
    "minmax_scale",
    WC
    + f"""SELECT event_id, {r('(magnitude - (SELECT min(magnitude) FROM catalog)) / ((SELECT max(magnitude) FROM catalog) - (SELECT min(magnitude) FROM catalog)) * 8 + 1')} AS size FROM catalog""",
)
def _(t):
    return cleaning.minmax_scale(t.catalog, "magnitude", 8.0, 1.0, "size").select("event_id", "size")


@check(
    "impute_by_prefix",
    WW
    + f"""SELECT l_orderkey, l_linenumber, {r('count_7d')} AS count_7d, {rlog('coalesce(energy_7d, 0)')} AS energy_7d, {r('rate_7d')} AS rate_7d,
      {r('coalesce(b_value_7d, 1)')} AS b_value_7d, {r('coalesce(elapsed_since_last_s, 10 * (SELECT quantile_cont(elapsed_since_last_s, 0.99) FROM wide))')} AS elapsed_since_last_s,
      {r('coalesce(gap, (SELECT quantile_cont(gap, 0.5) FROM wide))')} AS gap, {r('all_null')} AS all_null, constant_col, {r('coalesce(not_constant_with_null, 5)')} AS not_constant_with_null,
      text_col, label_7d FROM wide""",
)
def _(t):
    return impute.impute_by_prefix(t.wide)


@check(
    "impute_train_median",
    WW
    + f""", s AS (SELECT *, CASE l_orderkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM wide)
      SELECT l_orderkey, l_linenumber, split, {r("coalesce(b_value_7d, (SELECT quantile_cont(b_value_7d, 0.5) FROM s WHERE split = 'train'))")} AS b_value_7d,
      {r("coalesce(elapsed_since_last_s, (SELECT quantile_cont(elapsed_since_last_s, 0.5) FROM s WHERE split = 'train'))")} AS elapsed_since_last_s,
      {r("coalesce(gap, (SELECT quantile_cont(gap, 0.5) FROM s WHERE split = 'train'))")} AS gap FROM s""",
)
def _(t):
    kind = F.col("l_orderkey") % 3
    df = t.wide.select("l_orderkey", "l_linenumber", "energy_7d", "b_value_7d", "elapsed_since_last_s", "gap", "all_null")
    df = df.withColumn("split", F.when(kind == 0, "train").when(kind == 1, "validation").otherwise("test"))
    # energy_7d has no value in the train rows (l_orderkey % 3 = 0) and is dropped with all_null
    out, _ = impute.impute_train_median(df, ["energy_7d", "b_value_7d", "elapsed_since_last_s", "gap", "all_null"])
    return out


@check(
    "impute_mode",
    WC
    + """, m AS (SELECT mag_type FROM catalog WHERE mag_type IS NOT NULL GROUP BY mag_type ORDER BY count(*) DESC, mag_type LIMIT 1)
      SELECT event_id, coalesce(mag_type, (SELECT mag_type FROM m)) AS mag_type FROM catalog""",
)
def _(t):
    return impute.impute_mode(t.catalog, "mag_type").select("event_id", "mag_type")


YEAR = "year(make_timestamp(event_us))"


@check("split_by_year", WC + f"SELECT event_id, CASE WHEN {YEAR} < 2010 THEN 'train' ELSE 'test' END AS split FROM catalog")
def _(t):
    return splits.split_by_year(t.catalog).select("event_id", "split")


@check(
    "split_temporal",
    WC
    + """SELECT event_id, CASE WHEN make_timestamp(event_us) <= TIMESTAMP '2018-12-31' THEN 'train' WHEN make_timestamp(event_us) <= TIMESTAMP '2021-12-31' THEN 'validation' ELSE 'test' END AS split
      FROM catalog WHERE make_timestamp(event_us) <= TIMESTAMP '2026-12-31'""",
)
def _(t):
    return splits.split_temporal(t.catalog).select("event_id", "split")


@check(
    "split_year_ranges",
    WC
    + f"SELECT event_id, CASE WHEN {YEAR} <= 2018 THEN 'train' WHEN {YEAR} <= 2022 THEN 'validation' ELSE 'test' END AS split FROM catalog WHERE {YEAR} <= 2025",
)
def _(t):
    return splits.split_year_ranges(t.catalog).select("event_id", "split")


@check(
    "split_random",
    WC
    + """SELECT event_id, CASE WHEN CAST('0x' || substr(md5('42:' || event_id), 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS split
      FROM catalog""",
)
def _(t):
    return splits.split_random(t.catalog).select("event_id", "split")


# ---- catalogue union and keyed deduplication ----

UNION_SQL = """, tgt AS (SELECT *, true AS is_target, false AS is_m2_ctx FROM catalog WHERE magnitude >= 4),
   ctx AS (SELECT *, false AS is_target, true AS is_m2_ctx FROM catalog WHERE magnitude < 4.3::DOUBLE AND event_us >= 946684800000000),
   merged AS (SELECT * FROM (SELECT * FROM tgt UNION ALL SELECT * FROM ctx)
     QUALIFY row_number() OVER (PARTITION BY event_us, latitude, longitude ORDER BY CASE WHEN is_target THEN 0 ELSE 1 END, event_id) = 1)"""


def merged_catalog(t):
    context = t.catalog.where("magnitude < 4.3D AND event_us >= 946684800000000")
    return features.union_catalogs(t.catalog.where("magnitude >= 4"), context)


@check("union_catalogs", WC + UNION_SQL + f"SELECT event_id, event_us, {r('magnitude')} AS magnitude, is_target, is_m2_ctx FROM merged")
def _(t):
    return merged_catalog(t).select("event_id", "event_us", "magnitude", "is_target", "is_m2_ctx")


@check("union_chunks", WC + f"SELECT event_id, event_us, {r('magnitude')} AS magnitude, CASE WHEN event_id % 3 = 0 THEN {r('depth')} END AS depth FROM catalog")
def _(t):
    from epicell.sources.catalogs import union_chunks

    parts = [t.catalog.where(F.col("event_id") % 3 == k) for k in range(3)]
    cols = ["event_id", "event_us", "magnitude"]
    return union_chunks([parts[0].select(*cols, "depth"), parts[1].select(*cols), parts[2].select(*cols)])


@check(
    "dedup_keep_first",
    WC
    + f"""SELECT event_id, event_us, {r('latitude')} AS latitude, mag_type FROM catalog
      QUALIFY row_number() OVER (PARTITION BY latitude, mag_type ORDER BY CASE WHEN magnitude >= 4 THEN 0 ELSE 1 END, event_id) = 1""",
)
def _(t):
    df = t.catalog.select("event_id", "event_us", "latitude", "mag_type", "magnitude")
    return features.dedup_keep_first(df, ["latitude", "mag_type"], [F.col("magnitude") < 4, F.col("event_id")]).drop("magnitude")


@check(
    "dedup_keep_last",
    with_views("scored")
    + f"SELECT event_id, prediction_id, scored_us, {r('prob_7d')} AS prob_7d FROM scored QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY scored_us DESC, prediction_id DESC) = 1",
)
def _(t):
    df = t.scored.select("event_id", "prediction_id", "scored_us", "prob_7d")
    return features.dedup_keep_last(df, "event_id", [F.col("scored_us"), F.col("prediction_id")])


@check(
    "join_features_labels",
    WC
    + f""", k AS (SELECT *, round(latitude, 4) AS ka, round(longitude, 4) AS ko, CAST(make_timestamp(event_us) AS DATE) AS kd, CAST(event_id % 2 AS INT) AS label_7d FROM catalog),
      a AS (SELECT * FROM k WHERE magnitude >= 4 QUALIFY row_number() OVER (PARTITION BY ka, ko, kd ORDER BY event_us, event_id) = 1),
      b AS (SELECT * FROM k WHERE event_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY ka, ko, kd ORDER BY event_us, event_id) = 1)
      SELECT a.event_id, a.event_us, {r('a.latitude')} AS ref_lat, {r('a.longitude')} AS ref_lon, {r('a.magnitude')} AS magnitude, b.label_7d FROM a JOIN b USING (ka, ko, kd)""",
)
def _(t):
    base = t.catalog.select("event_id", "event_us", F.col("latitude").alias("ref_lat"), F.col("longitude").alias("ref_lon"), "magnitude")
    labels = base.where("event_id % 7 <> 0").withColumn("label_7d", (F.col("event_id") % 2).cast("int")).drop("magnitude")
    return features.join_features_labels(base.where("magnitude >= 4"), labels)
