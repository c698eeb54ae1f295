"""Fixed values of the method: thresholds, season, prices, legends."""

# Fixed values, as published with the method.
SEASON_START, SEASON_END, WINDOW_DAYS = "06-15", "09-30", 10
CLIMATE_START, CLIMATE_END, CLIMATE_DAYS = "06-01", "09-30", 122
CORE_FROM = "07-25"
VV_DROP_DB, VV_WATER_DB = -3.0, -15.0
SIEVE_PIXELS = 10
EVENT_FRACTION = 0.02
ALERT_KM2 = 25.0
MAX_BACKLOG = 8
BRIDGE_DAYS = 4
DURATION_EDGES = (1, 3, 7, 14)
DURATION_LOSS = (0.10, 0.35, 0.70, 1.00)
RECURRENCE_EDGES = (1, 2, 4)
PADDY_T_PER_HA, PADDY_INR_PER_T = 6.5, 23_200.0
DB_NULL = -32768
EARTH_RADIUS = 6378137.0
PLAIN_UNITS = ("crore_inr", "count")
HA_PER = {"ha": 1.0, "lakh_ha": 1e5, "mha": 1e6}
METRES_PER_FOOT = 0.3048
CUSEC_TO_BCM_DAY = 0.028316846592 * 86400 / 1e9
