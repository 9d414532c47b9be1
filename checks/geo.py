"""Scalar functions and expressions over a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import check, hav, r, rlog
from epicell.fixtures import with_views
from epicell.functions import encodings as enc
from epicell.functions import geo, scoring, seismic, sql, timeparse

WC = with_views("catalog")


@check("haversine_km", WC + f"SELECT event_id, {r(hav('latitude', 'longitude', '12.5::DOUBLE', '-179.5::DOUBLE'))} AS km FROM catalog")
def _(t):
    km = geo.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(12.5), F.lit(-179.5))
    return t.catalog.select("event_id", km.alias("km"))


@check(
    "unit_xyz",
    WC
    + f"""SELECT event_id, {r('cos(radians(latitude)) * cos(radians(longitude))')} AS x,
      {r('cos(radians(latitude)) * sin(radians(longitude))')} AS y, {r('sin(radians(latitude))')} AS z FROM catalog""",
)
def _(t):
    x, y, z = geo.unit_xyz(F.col("latitude"), F.col("longitude"))
    return t.catalog.select("event_id", x.alias("x"), y.alias("y"), z.alias("z"))


@check("chord_to_km", WC + f"SELECT event_id, {r('2 * 6371.0::DOUBLE * asin(greatest(0.0::DOUBLE, least(1.0::DOUBLE, magnitude / 4 / 2)))')} AS km FROM catalog")
def _(t):
    return t.catalog.select("event_id", geo.chord_to_km(F.col("magnitude") / 4).alias("km"))


@check(
    "web_mercator",
    WC
    + f"""SELECT event_id, {r('radians(longitude) * 6378137.0::DOUBLE / 1000')} AS x_km,
      {r('ln(tan(pi() / 4 + radians(latitude) / 2)) * 6378137.0::DOUBLE / 1000')} AS y_km FROM catalog""",
)
def _(t):
    x, y = geo.web_mercator(F.col("longitude"), F.col("latitude"))
    return t.catalog.select("event_id", (x / 1000).alias("x_km"), (y / 1000).alias("y_km"))


@check(
    "point_segment_dist_m",
    WC
    + f""", p AS (SELECT event_id, latitude AS px, longitude AS py, magnitude AS ax, CAST(event_id % 7 AS DOUBLE) AS ay,
       magnitude + event_id % 3 AS bx, CAST(event_id % 7 AS DOUBLE) AS bby FROM catalog),
     q AS (SELECT *, coalesce(greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (bby - ay)) / nullif(pow(bx - ax, 2) + pow(bby - ay, 2), 0))), 0) AS s FROM p)
     SELECT event_id, {r('sqrt(pow(px - (ax + s * (bx - ax)), 2) + pow(py - (ay + s * (bby - ay)), 2))')} AS d FROM q""",
)
def _(t):
    c = F.col
    same_y = (c("event_id") % 7).cast("double")
    d = geo.point_segment_dist_m(
        c("latitude"), c("longitude"), c("magnitude"), same_y, c("magnitude") + c("event_id") % 3, same_y
    )
    return t.catalog.select("event_id", d.alias("d"))


@check("seismic_energy", WC + f"SELECT mag_type, {rlog('sum(pow(10::DOUBLE, 1.5::DOUBLE * magnitude))')} AS energy FROM catalog GROUP BY mag_type")
def _(t):
    return t.catalog.groupBy("mag_type").agg(seismic.seismic_energy(F.col("magnitude")).alias("energy"))


@check("seismic_moment", WC + f"SELECT mag_type, {rlog('sum(pow(10::DOUBLE, 1.5::DOUBLE * magnitude + 9.1::DOUBLE))')} AS moment FROM catalog GROUP BY mag_type")
def _(t):
    return t.catalog.groupBy("mag_type").agg(seismic.seismic_moment(F.col("magnitude")).alias("moment"))


@check(
    "b_value_mle_batch",
    WC
    + f"""SELECT event_id % 3000 AS g, {r('CASE WHEN count(magnitude) >= 5 AND max(magnitude) > min(magnitude) THEN log10(exp(1)) / (avg(magnitude) - min(magnitude)) END')} AS b
      FROM catalog GROUP BY 1""",
)
def _(t):
    return t.catalog.groupBy((F.col("event_id") % 3000).alias("g")).agg(seismic.b_value_mle_batch(F.col("magnitude")).alias("b"))


@check(
    "b_value_mle_fixed",
    WC
    + f"""SELECT event_id % 3000 AS g, {r('CASE WHEN count(*) FILTER (magnitude >= 2) >= 5 AND max(magnitude) > 2 THEN 1 / ((avg(magnitude) FILTER (magnitude >= 2) - 2) * ln(10::DOUBLE)) END')} AS b
      FROM catalog GROUP BY 1""",
)
def _(t):
    return t.catalog.groupBy((F.col("event_id") % 3000).alias("g")).agg(seismic.b_value_mle_fixed(F.col("magnitude")).alias("b"))


@check(
    "season",
    WC
    + """SELECT event_id, CASE WHEN month(make_timestamp(event_us)) IN (12, 1, 2) THEN 'Hiver' WHEN month(make_timestamp(event_us)) <= 5 THEN 'Printemps'
      WHEN month(make_timestamp(event_us)) <= 8 THEN 'Été' ELSE 'Automne' END AS season FROM catalog""",
)
def _(t):
    return t.catalog.select("event_id", enc.season(F.timestamp_micros("event_us")).alias("season"))


DEPTH_SQL = "CASE WHEN depth < 70 THEN 'superficiel' WHEN depth <= 300 THEN 'intermédiaire' ELSE 'profond' END"


@check("depth_category", WC + f"SELECT event_id, {DEPTH_SQL} AS depth_category FROM catalog")
def _(t):
    return t.catalog.select("event_id", enc.depth_category(F.col("depth")).alias("depth_category"))


@check(
    "encode_depth_ordinal",
    WC + "SELECT event_id, CASE WHEN depth < 70 THEN 0 WHEN depth <= 300 THEN 1 ELSE 2 END AS depth_category_enc FROM catalog",
)
def _(t):
    return t.catalog.select("event_id", enc.encode_depth_ordinal(enc.depth_category(F.col("depth"))).alias("depth_category_enc"))


@check(
    "one_hot",
    WC
    + """SELECT event_id, CASE WHEN mag_type = 'click' THEN 1 ELSE 0 END AS mt_click, CASE WHEN mag_type = 'view' THEN 1 ELSE 0 END AS mt_view,
      CASE WHEN mag_type = 'error' THEN 1 ELSE 0 END AS mt_error FROM catalog""",
)
def _(t):
    return enc.one_hot(t.catalog, "mag_type", "mt", ["click", "view", "error"]).select("event_id", "mt_click", "mt_view", "mt_error")


@check(
    "encode_slip",
    with_views("line_vertices")
    + """SELECT seq, CASE lower(trim(slip_type)) WHEN 'normal' THEN 1 WHEN 'reverse' THEN 2 WHEN 'thrust' THEN 2 WHEN 'blind thrust' THEN 2
      WHEN 'strike-slip' THEN 3 WHEN 'sinistral' THEN 3 WHEN 'dextral' THEN 3 WHEN 'oblique' THEN 4 ELSE 0 END AS slip FROM line_vertices""",
)
def _(t):
    column = enc.slip_column(t.line_vertices.columns)
    return t.line_vertices.select("seq", enc.encode_slip(F.col(column)).alias("slip"))


@check(
    "encode_regime",
    with_views("stations")
    + """SELECT station_id, CASE trim(regime) WHEN 'NF' THEN 0 WHEN 'TF' THEN 1 WHEN 'SS' THEN 2 WHEN 'NS' THEN 3 WHEN 'TS' THEN 3 ELSE 4 END AS regime_enc FROM stations""",
)
def _(t):
    return t.stations.select("station_id", enc.encode_regime(F.col("regime")).alias("regime_enc"))


@check(
    "encode_quality",
    with_views("stations")
    + "SELECT station_id, CASE quality WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 2 WHEN 'D' THEN 1 ELSE 0 END AS quality_enc FROM stations",
)
def _(t):
    return t.stations.select("station_id", enc.encode_quality(F.col("quality")).alias("quality_enc"))


@check("azimuth_sin_cos", with_views("stations") + f"SELECT station_id, {r('sin(radians(azi))')} AS azi_sin, {r('cos(radians(azi))')} AS azi_cos FROM stations")
def _(t):
    s, c = enc.azimuth_sin_cos(F.col("azi"))
    return t.stations.select("station_id", s.alias("azi_sin"), c.alias("azi_cos"))


@check(
    "grid_label",
    WC
    + """, z AS (SELECT event_id, CAST(floor(latitude / 5) * 5 AS INT) AS a, CAST(floor(longitude / 5) * 5 AS INT) AS o FROM catalog)
    SELECT event_id, CASE WHEN a = 0 AND o = 125 THEN 'Sulawesi, Indonésie' WHEN a = 35 AND o = 140 THEN 'Honshu, Japon'
      WHEN a = -25 AND o = -180 THEN 'Tonga' WHEN a = -20 AND o = -180 THEN 'Fidji-Tonga' WHEN a = -10 AND o = 150 THEN 'Papouasie-Nvl-Guinée'
      WHEN a = 5 AND o = 125 THEN 'Mindanao, Philippines' WHEN a = 35 AND o = 70 THEN 'Hindu Kush, Afghanistan' WHEN a = -25 AND o = -70 THEN 'Atacama, Chili'
      WHEN a = -35 AND o = -180 THEN 'Kermadec, NZ' WHEN a = -15 AND o = 165 THEN 'Vanuatu' WHEN a = -10 AND o = 125 THEN 'Timor, Indonésie'
      WHEN a = -20 AND o = -175 THEN 'Tonga Sud' WHEN a = -35 AND o = -75 THEN 'Biobío, Chili' WHEN a = 20 AND o = 120 THEN 'Taïwan'
      WHEN a = -20 AND o = 165 THEN 'Nouvelle-Calédonie'
      ELSE abs(a) || '°' || CASE WHEN a >= 0 THEN 'N' ELSE 'S' END || ' / ' || abs(o) || '°' || CASE WHEN o >= 0 THEN 'E' ELSE 'W' END END AS zone FROM z""",
)
def _(t):
    corner = lambda c: (F.floor(F.col(c) / 5) * 5).cast("int")
    return t.catalog.select("event_id", enc.grid_label(corner("latitude"), corner("longitude")).alias("zone"))


def scale_sql(p: str, temperature: float) -> str:
    q = f"greatest(1e-7::DOUBLE, least(1 - 1e-7::DOUBLE, {p}))"
    return f"CASE WHEN {p} IS NOT NULL THEN 1 / (1 + exp(-ln({q} / (1 - {q})) / {temperature}::DOUBLE)) END"


@check(
    "temperature_scale",
    with_views("scored")
    + f"SELECT prediction_id, {r(scale_sql('prob_7d', 0.6663))} AS p7, {r(scale_sql('prob_30d', 1.0357))} AS p30 FROM scored",
)
def _(t):
    return t.scored.select(
        "prediction_id",
        scoring.temperature_scale(F.col("prob_7d"), 0.6663).alias("p7"),
        scoring.temperature_scale(F.col("prob_30d"), 1.0357).alias("p30"),
    )


def band_sql(p: str, names: tuple, null: str) -> str:
    a, b, c, d, e = names
    return (
        f"CASE WHEN {p} IS NULL THEN {null} WHEN {p} < 0.20::DOUBLE THEN '{a}' WHEN {p} < 0.35::DOUBLE THEN '{b}'"
        f" WHEN {p} < 0.50::DOUBLE THEN '{c}' WHEN {p} < 0.70::DOUBLE THEN '{d}' ELSE '{e}' END"
    )


CODES = ("very_low", "low", "moderate", "high", "very_high")
LABELS = ("🟢 Très faible", "🟡 Faible", "🟡 Modéré", "🟠 Élevé", "🔴 Très élevé")


@check(
    "risk_band",
    with_views("scored")
    + f"""SELECT prediction_id, {band_sql('prob_7d', LABELS, "'⚪ Inconnu'")} AS risk_7d, {band_sql('prob_7d', CODES, "'unknown'")} AS risk_7d_code,
      {band_sql('prob_7d', CODES, 'NULL')} AS public_code FROM scored""",
)
def _(t):
    p = F.col("prob_7d")
    return t.scored.select(
        "prediction_id",
        scoring.risk_label(p).alias("risk_7d"),
        scoring.risk_code(p).alias("risk_7d_code"),
        scoring.risk_code(p, null_is_unknown=False).alias("public_code"),
    )


@check(
    "parse_event_time",
    WC
    + """SELECT event_id, CASE event_id % 6 WHEN 3 THEN NULL WHEN 4 THEN 1700000000000000 WHEN 5 THEN event_us // 86400000000 * 86400000000
      WHEN 1 THEN event_us // 1000000 * 1000000 - 7200000000 WHEN 2 THEN event_us // 1000000 * 1000000 ELSE event_us // 1000 * 1000 END AS parsed_us FROM catalog""",
)
def _(t):
    ts = F.timestamp_micros("event_us")
    kind = F.col("event_id") % 6
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 3, F.lit("not a time"))
        .when(kind == 5, F.date_format(ts, "yyyy-MM-dd"))
    )
    parsed = timeparse.parse_event_time(text, when_missing=F.timestamp_micros(F.lit(1_700_000_000_000_000)))
    return t.catalog.select("event_id", F.unix_micros(parsed).alias("parsed_us"))


@check(
    "sql_functions",
    WC
    + f"""SELECT event_id, {r(hav('latitude', 'longitude', '0.0::DOUBLE', '0.0::DOUBLE'))} AS km, {r('2 * 6371.0::DOUBLE * asin(0.25::DOUBLE)')} AS chord_km,
      {r('radians(longitude) * 6378137.0::DOUBLE / 1000')} AS x_km, {r('ln(tan(pi() / 4 + radians(latitude) / 2)) * 6378137.0::DOUBLE / 1000')} AS y_km,
      {rlog('pow(10::DOUBLE, 1.5::DOUBLE * magnitude)')} AS energy, {r(scale_sql('(magnitude / 10)', 0.6663))} AS p,
      {band_sql('(magnitude / 10)', CODES, "'unknown'")} AS code FROM catalog""",
)
def _(t):
    sql.register(t.spark)
    return t.spark.sql(
        """SELECT event_id, haversine_km(latitude, longitude, 0D, 0D) AS km, chord_to_km(0.5D) AS chord_km, mercator_x(longitude) / 1000 AS x_km,
        mercator_y(latitude) / 1000 AS y_km, energy_term(magnitude) AS energy, temperature_scale(magnitude / 10, 0.6663D) AS p,
        risk_code(magnitude / 10) AS code FROM {catalog}""",
        catalog=t.catalog,
    )


