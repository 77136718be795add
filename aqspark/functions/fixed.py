"""Values that results depend on. Nothing here is computed."""

# ---------------------------------------------------------------------------
# Feature order, bands, calendars, places and search terms.
# ---------------------------------------------------------------------------

FEATURES = [
    "lat", "lon",
    "pm25",
    "pm25_lag1", "pm25_lag3", "pm25_lag6", "pm25_lag12",
    "pm25_lag24", "pm25_lag48", "pm25_lag72",
    "pm25_rmean24", "pm25_rmax24", "pm25_rmin24", "pm25_rstd24",
    "pm25_trend6h",
    "aqi_category",
    "pm10", "no2", "so2", "o3", "co",
    "temperature_2m", "relative_humidity_2m", "dew_point_2m",
    "surface_pressure", "precipitation",
    "wind_speed", "wind_u", "wind_v",
    "cloud_cover", "shortwave_radiation", "boundary_layer_height",
    "fire_count", "frp_sum", "frp_mean", "frp_max",
    "bright_ti4_mean", "bright_ti5_mean",
    "rush_hour", "is_weekday", "is_holiday", "traffic_index",
    "day_of_week_sin", "day_of_week_cos",
    "hour_sin", "hour_cos", "month_sin", "month_cos",
    "is_monsoon", "is_winter", "is_harvest_season",
    "is_diwali_period", "is_holi_period",
    "news_dust_storm", "news_industrial_event", "news_crop_burning",
    "news_calamity", "news_fireworks", "news_smog_alert",
]

LAGS = [1, 3, 6, 12, 24, 48, 72]
HORIZONS = 24
LOOKBACK = 72
TARGETS = [f"target_{h}h" for h in range(1, HORIZONS + 1)]

COPOLLUTANTS = ["pm10", "no2", "so2", "o3", "co"]

WEATHER = [
    "temperature_2m", "relative_humidity_2m", "dew_point_2m",
    "surface_pressure", "precipitation",
    "wind_speed_10m", "wind_direction_10m",
    "cloud_cover", "shortwave_radiation", "boundary_layer_height",
]

FIRE_MEASURES = [
    "fire_count", "frp_sum", "frp_mean", "frp_max",
    "bright_ti4_mean", "bright_ti5_mean",
]

NEWS_SIGNALS = [
    "news_dust_storm", "news_industrial_event", "news_crop_burning",
    "news_calamity", "news_fireworks", "news_smog_alert",
]

# Signals shown in a forecast document.
SHOWN_SIGNALS = NEWS_SIGNALS + [
    "is_harvest_season", "is_diwali_period", "is_holi_period", "is_monsoon",
]

# (from, below, label, code, colour)
AQI_BANDS = [
    (0.0, 30.0, "Good", 0, "[GREEN]"),
    (30.0, 60.0, "Satisfactory", 1, "[YELLOW]"),
    (60.0, 90.0, "Moderate", 2, "[ORANGE]"),
    (90.0, 120.0, "Poor", 3, "[RED]"),
    (120.0, 250.0, "Very Poor", 4, "[PURPLE]"),
    (250.0, 9999.0, "Severe", 5, "[MAROON]"),
]

RUSH_HOURS = [7, 8, 9, 10, 17, 18, 19, 20]

HOLIDAYS = [
    "2022-01-26", "2022-03-18", "2022-04-14", "2022-04-15",
    "2022-05-03", "2022-07-10", "2022-08-15", "2022-10-02",
    "2022-10-05", "2022-10-24", "2022-11-08", "2022-12-25",
    "2023-01-26", "2023-03-08", "2023-04-14", "2023-04-22",
    "2023-06-29", "2023-08-15", "2023-10-02", "2023-10-24",
    "2023-11-12", "2023-11-13", "2023-11-27", "2023-12-25",
    "2024-01-26", "2024-03-25", "2024-03-29", "2024-04-10",
    "2024-04-14", "2024-06-17", "2024-08-15", "2024-10-02",
    "2024-10-12", "2024-11-01", "2024-11-15", "2024-12-25",
    "2025-01-26", "2025-03-14", "2025-03-25", "2025-04-14",
    "2025-04-18", "2025-06-07", "2025-08-15", "2025-10-02",
    "2025-10-20", "2025-10-21", "2025-11-05", "2025-12-25",
    "2026-01-26", "2026-03-04", "2026-03-14", "2026-04-03",
    "2026-04-14", "2026-08-15", "2026-10-02", "2026-10-09",
    "2026-10-28", "2026-12-25",
]

DIWALI = ["2022-10-24", "2023-11-12", "2024-11-01", "2025-10-20", "2026-11-08"]
HOLI = ["2022-03-18", "2023-03-08", "2024-03-25", "2025-03-14", "2026-03-04"]

LOCAL_ZONE = "Asia/Kolkata"

# Reference places for labelling, in order of preference: (city, state, lat, lon)
CITIES = [
    ("Delhi", "Delhi", 28.613, 77.209),
    ("Mumbai", "Maharashtra", 19.076, 72.878),
    ("Kolkata", "West Bengal", 22.572, 88.364),
    ("Chennai", "Tamil Nadu", 13.083, 80.270),
    ("Bengaluru", "Karnataka", 12.972, 77.594),
    ("Hyderabad", "Telangana", 17.385, 78.487),
    ("Ahmedabad", "Gujarat", 23.023, 72.572),
    ("Lucknow", "Uttar Pradesh", 26.847, 80.947),
    ("Kanpur", "Uttar Pradesh", 26.449, 80.331),
    ("Patna", "Bihar", 25.594, 85.137),
    ("Jaipur", "Rajasthan", 26.913, 75.787),
    ("Amritsar", "Punjab", 31.634, 74.872),
    ("Ludhiana", "Punjab", 30.901, 75.857),
    ("Chandigarh", "Chandigarh", 30.733, 76.779),
    ("Gurugram", "Haryana", 28.459, 77.029),
    ("Faridabad", "Haryana", 28.408, 77.317),
    ("Bhopal", "Madhya Pradesh", 23.259, 77.412),
    ("Indore", "Madhya Pradesh", 22.719, 75.857),
    ("Pune", "Maharashtra", 18.521, 73.857),
    ("Nagpur", "Maharashtra", 21.146, 79.089),
    ("Bhubaneswar", "Odisha", 20.296, 85.825),
    ("Raipur", "Chhattisgarh", 21.251, 81.630),
    ("Ranchi", "Jharkhand", 23.344, 85.309),
    ("Dhanbad", "Jharkhand", 23.799, 86.433),
    ("Visakhapatnam", "Andhra Pradesh", 17.686, 83.218),
    ("Vijayawada", "Andhra Pradesh", 16.506, 80.648),
    ("Thiruvananthapuram", "Kerala", 8.526, 76.933),
    ("Kochi", "Kerala", 9.931, 76.268),
    ("Kozhikode", "Kerala", 11.259, 75.781),
    ("Guwahati", "Assam", 26.144, 91.736),
    ("Dehradun", "Uttarakhand", 30.316, 78.032),
    ("Varanasi", "Uttar Pradesh", 25.317, 82.974),
    ("Agra", "Uttar Pradesh", 27.176, 78.008),
    ("Ghaziabad", "Uttar Pradesh", 28.670, 77.432),
    ("Noida", "Uttar Pradesh", 28.535, 77.391),
    ("Meerut", "Uttar Pradesh", 28.989, 77.709),
    ("Jodhpur", "Rajasthan", 26.295, 73.024),
    ("Udaipur", "Rajasthan", 24.585, 73.712),
    ("Surat", "Gujarat", 21.170, 72.831),
    ("Vadodara", "Gujarat", 22.308, 73.182),
    ("Rajkot", "Gujarat", 22.303, 70.802),
    ("Coimbatore", "Tamil Nadu", 11.017, 76.955),
    ("Madurai", "Tamil Nadu", 9.919, 78.119),
    ("Mangaluru", "Karnataka", 12.914, 74.856),
    ("Mysuru", "Karnataka", 12.295, 76.639),
    ("Hubli", "Karnataka", 15.364, 75.124),
    ("Shimla", "Himachal Pradesh", 31.104, 77.173),
    ("Srinagar", "J&K", 34.073, 74.797),
    ("Jammu", "J&K", 32.727, 74.858),
    ("Panaji", "Goa", 15.499, 73.826),
    ("Imphal", "Manipur", 24.819, 93.937),
    ("Shillong", "Meghalaya", 25.578, 91.883),
    ("Agartala", "Tripura", 23.831, 91.286),
]

# Stations added for cities that discovery did not find:
# (station, state, lat, lon, city)
FALLBACK_STATIONS = [
    ("delhi_ito", "Delhi", 28.630, 77.240, "Delhi"),
    ("mumbai_bandra", "Maharashtra", 19.054, 72.840, "Mumbai"),
    ("kolkata_victoria", "West Bengal", 22.545, 88.342, "Kolkata"),
    ("chennai_alandur", "Tamil Nadu", 13.001, 80.208, "Chennai"),
    ("bengaluru_btm", "Karnataka", 12.912, 77.609, "Bengaluru"),
    ("hyderabad_bollaram", "Telangana", 17.530, 78.380, "Hyderabad"),
    ("ahmedabad_ctm", "Gujarat", 23.041, 72.590, "Ahmedabad"),
    ("lucknow_talkatora", "Uttar Pradesh", 26.870, 80.870, "Lucknow"),
    ("kanpur_nehru", "Uttar Pradesh", 26.460, 80.310, "Kanpur"),
    ("patna_igsc", "Bihar", 25.612, 85.162, "Patna"),
    ("jaipur_mansarovar", "Rajasthan", 26.855, 75.800, "Jaipur"),
    ("amritsar_golden", "Punjab", 31.630, 74.870, "Amritsar"),
    ("ludhiana_civil", "Punjab", 30.907, 75.857, "Ludhiana"),
    ("gurugram_vikas", "Haryana", 28.450, 77.030, "Gurugram"),
    ("faridabad_sector", "Haryana", 28.410, 77.310, "Faridabad"),
    ("bhopal_ttt", "Madhya Pradesh", 23.259, 77.412, "Bhopal"),
    ("indore_polo", "Madhya Pradesh", 22.717, 75.857, "Indore"),
    ("bhubaneswar_camp", "Odisha", 20.296, 85.824, "Bhubaneswar"),
    ("raipur_telibanda", "Chhattisgarh", 21.248, 81.634, "Raipur"),
    ("ranchi_morabadi", "Jharkhand", 23.370, 85.342, "Ranchi"),
    ("visakhapatnam_gvm", "Andhra Pradesh", 17.720, 83.300, "Visakhapatnam"),
    ("kochi_ernakulam", "Kerala", 9.990, 76.280, "Kochi"),
    ("guwahati_pan", "Assam", 26.146, 91.736, "Guwahati"),
    ("chandigarh_sec", "Chandigarh", 30.733, 76.779, "Chandigarh"),
    ("dehradun_isbt", "Uttarakhand", 30.326, 78.046, "Dehradun"),
    ("srinagar_barzulla", "J&K", 34.086, 74.805, "Srinagar"),
    ("pune_katraj", "Maharashtra", 18.445, 73.857, "Pune"),
    ("agra_sanjay", "Uttar Pradesh", 27.180, 78.001, "Agra"),
    ("varanasi_ardn", "Uttar Pradesh", 25.335, 83.007, "Varanasi"),
    ("nagpur_civil", "Maharashtra", 21.148, 79.082, "Nagpur"),
]

# Cities whose station counts are reported even when there are none.
WATCHED_CITIES = [
    "Delhi", "Mumbai", "Kolkata", "Chennai", "Bengaluru", "Hyderabad",
    "Ahmedabad", "Lucknow", "Patna", "Jaipur", "Amritsar", "Chandigarh",
    "Bhopal", "Pune", "Nagpur",
]

SIGNAL_TERMS = {
    "news_dust_storm": ["dust storm", "sandstorm", "andhi", "dust haze India"],
    "news_industrial_event": [
        "factory fire", "industrial blast", "chemical explosion India"],
    "news_crop_burning": [
        "stubble burning", "parali", "crop burning", "farm fire Punjab Haryana"],
    "news_calamity": ["cyclone", "earthquake", "flood pollution India air quality"],
    "news_fireworks": [
        "Diwali crackers", "New Year fireworks", "firecracker ban India"],
    "news_smog_alert": [
        "smog alert", "pollution emergency", "GRAP", "red alert air quality India"],
}

CITY_TERMS = {
    "Delhi": ["Delhi", "NCR", "Gurgaon", "Noida"],
    "Mumbai": ["Mumbai", "Maharashtra"],
    "Kolkata": ["Kolkata", "West Bengal"],
    "Chennai": ["Chennai", "Tamil Nadu"],
    "Bengaluru": ["Bengaluru", "Bangalore", "Karnataka"],
    "Hyderabad": ["Hyderabad", "Telangana"],
    "Ahmedabad": ["Ahmedabad", "Gujarat"],
    "Lucknow": ["Lucknow", "Uttar Pradesh", "UP"],
    "Patna": ["Patna", "Bihar"],
    "Jaipur": ["Jaipur", "Rajasthan"],
    "Amritsar": ["Amritsar", "Ludhiana", "Punjab"],
    "Chandigarh": ["Chandigarh", "Punjab", "Haryana"],
    "Bhopal": ["Bhopal", "Madhya Pradesh"],
    "Bhubaneswar": ["Bhubaneswar", "Odisha"],
    "Raipur": ["Raipur", "Chhattisgarh"],
    "Ranchi": ["Ranchi", "Jharkhand"],
    "Visakhapatnam": ["Visakhapatnam", "Vizag", "Andhra Pradesh"],
    "Kochi": ["Kochi", "Kerala"],
    "Guwahati": ["Guwahati", "Assam"],
    "Dehradun": ["Dehradun", "Uttarakhand"],
}

# News latitude of a city: northern ones, and all others.
NORTHERN_CITIES = [
    "Delhi", "Lucknow", "Amritsar", "Chandigarh", "Patna", "Jaipur", "Dehradun"]
NORTHERN_LAT = 28.0
SOUTHERN_LAT = 18.0

# Sensor id ranges known to deliver hourly data, and two exceptions.
SENSOR_RANGES = [(2_000_000, 12_100_000), (12_200_000, 16_800_000)]
SENSOR_EXCEPTIONS = [5_077_640, 5_077_812]

# Column names that archive files use for the same thing, first match wins.
TIME_ALIASES = ["date", "datetime", "Date", "utc", "date_utc", "dateTimeFrom"]
VALUE_ALIASES = ["value", "Value", "average"]
PARAMETER_ALIASES = ["parameter", "parameterId", "Parameter"]

# (lat from, lat to, lon from, lon to): wide search box, tighter screening box
WIDE_BOX = (5.0, 40.0, 65.0, 100.0)
INNER_BOX = (6.5, 37.5, 67.0, 97.5)

EARTH_KM = 6371.0
MAX_READING = 1500.0
FIRE_RADIUS_KM = 300.0
CITY_RADIUS_KM = 80.0
MIN_READINGS = 200
MIN_FEATURE_ROWS = 100
MIN_LIVE_READINGS = 12
