"""Fixed values of the data model."""

#: Columns of a wide quantile table, and the quantile numbers of a long one.
N_QUANTILES = 101
QCOLS = [f"q{p:03d}" for p in range(N_QUANTILES)]
#: Heights (m) that are published, and native heights of the gridded models.
TARGET_HEIGHTS = [30, 40, 50, 60, 80, 100]
WTK_HEIGHTS = [10, 40, 60, 80, 100, 120, 140, 160, 200]
GWA_HEIGHTS = [10, 50, 100, 150]
#: One knot in m/s; mean earth radius in km; Web Mercator radius in m; radius (m) of the projection sphere.
KNOT_MS = 0.514444
EARTH_KM = 6371.0088
MERCATOR_M = 6378137.0
SPHERE_M = 6370997.0
#: Shear exponent of neutral air.
NEUTRAL_SHEAR = 1.0 / 7.0
#: Gridded models, in the order of the long training table.
MODELS = ["era5", "hrrr", "wtk", "wtk_led_conus", "wtk_led_climate"]
#: Accepted names of the logical columns, first match wins.
ALIASES = {
    "station_id": ["station_id", "site_id", "station", "id"],
    "name": ["name", "station_name", "site_name", "station name"],
    "datetime": ["datetime", "time", "timestamp"],
    "ws_observed": ["ws_observed", "ws", "speed", "wind_speed"],
    "height_m": ["height_m", "height", "z"],
    "lat": ["lat", "latitude"],
    "lon": ["lon", "lng", "longitude"],
    "elev_m": ["elev_m", "elevation_m", "elevation_meters", "elevation", "elev"],
    "windsite_type": ["windsite_type", "site_type", "type"],
    "dataset": ["dataset", "source", "model", "product"],
}
