"""Fixed values of the domain. They must match the published system for equal results."""

EARTH_KM = 6371.0
MERCATOR_M = 6378137.0

RADIUS_KM = 200.0
WINDOWS_DAYS = (1, 7, 30, 90)
M2_WINDOWS_DAYS = (7, 30, 90)
HORIZONS_DAYS = (7, 30, 365)

MIN_MAG_WINDOW = 4.0
MIN_MAG_ROLLING = 2.0
MIN_MAG_HISTORY = 3.0
MIN_MAG_FOLLOWUP = 5.0
MIN_MAG_DANGEROUS = 6.0

HISTORY_YEAR = 2010
M2_FIRST_YEAR = 2000
ROLLING_DAYS = 92
STATION_MAX_KM = 500.0
COAST_KM = 100.0
DEFAULT_DEPTH_KM = 33.0

EPS = 1e-9
DAYS_PER_YEAR = 365.25

SECOND_US = 1_000_000
DAY_US = 86_400 * SECOND_US

TEMPERATURES = {"7d": 0.6663, "30d": 1.0357}

SERVING_DEFAULTS = {
    "model_version": "mlp_v1__full__keras",
    "benchmark_id": "benchmark_v2",
    "feature_set_version": "mlp_full_v1",
    "dataset_version": "dataset_v5_dedup",
    "mlflow_run_id": "",
}
