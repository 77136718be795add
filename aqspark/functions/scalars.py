"""Column expressions: air quality, wind, geography, time and rounding."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from aqspark.functions import fixed


def as_col(c):
    return F.col(c) if isinstance(c, str) else c


# --- air quality ---------------------------------------------------------------

def _banded(value, pick, outside):
    value = as_col(value)
    chain = F
    for band in fixed.AQI_BANDS:
        chain = chain.when((value >= band[0]) & (value < band[1]), F.lit(band[pick]))
    return chain.otherwise(F.lit(outside))


def aqi_label(value) -> Column:
    """Band name; everything outside the bands is Severe."""
    return _banded(value, 2, "Severe")


def aqi_code(value) -> Column:
    """Band number; everything outside the bands is 5."""
    return _banded(value, 3, 5)


def aqi_color(value) -> Column:
    return _banded(value, 4, "[MAROON]")


def aqi_category(value) -> Column:
    """Band number as a feature; everything outside the bands is 0."""
    return _banded(value, 3, 0)


# --- wind and humidity -----------------------------------------------------------

def wind_speed(speed) -> Column:
    return F.coalesce(as_col(speed), F.lit(0.0))


def wind_u(speed, direction) -> Column:
    angle = F.radians(F.coalesce(as_col(direction), F.lit(0.0)))
    return wind_speed(speed) * F.cos(angle)


def wind_v(speed, direction) -> Column:
    angle = F.radians(F.coalesce(as_col(direction), F.lit(0.0)))
    return wind_speed(speed) * F.sin(angle)


def dew_point(temperature, humidity) -> Column:
    """Dew point in °C after Magnus; null in, null out."""
    t = as_col(temperature)
    # ln of a non-positive number is null in Spark, as wanted for bad humidity
    wet = F.ln(as_col(humidity) / F.lit(100.0) + F.lit(1e-9))
    gamma = F.lit(17.27) * t / (F.lit(237.3) + t) + wet
    return F.lit(237.3) * gamma / (F.lit(17.27) - gamma)


# --- geography -------------------------------------------------------------------

def haversine_km(lat1, lon1, lat2, lon2, cosines=None) -> Column:
    """Great-circle distance. ``cosines`` of the two latitudes may be given, if they are at hand."""
    lat1, lon1, lat2, lon2 = map(as_col, (lat1, lon1, lat2, lon2))
    cos1, cos2 = map(as_col, cosines) if cosines else (F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + cos1 * cos2 * half_lon * half_lon
    return F.lit(2 * fixed.EARTH_KM) * F.asin(F.sqrt(clamp(chord, 0.0, 1.0)))


def half_degree(x) -> Column:
    """Nearest half degree, ties to the even half."""
    return F.bround(as_col(x) * 2) / 2


# --- time ------------------------------------------------------------------------

def floor_hour(ts) -> Column:
    return F.date_trunc("hour", as_col(ts))


def to_local(ts) -> Column:
    return F.from_utc_timestamp(as_col(ts), fixed.LOCAL_ZONE)


def acquired_at(day, hhmm) -> Column:
    """Date text and an HHMM number that lost its leading zeros → timestamp."""
    clock = F.lpad(as_col(hhmm).cast("string"), 4, "0")
    return F.try_to_timestamp(F.concat_ws(" ", as_col(day).cast("string"), clock),
                              F.lit("yyyy-MM-dd HHmm"))


def iso_day(text) -> Column:
    """Day of an ISO date-time text, null when it is not one."""
    return F.try_to_date(F.substring(as_col(text), 1, 10), "yyyy-MM-dd")


def iso_year(text) -> Column:
    return F.year(iso_day(text))


# --- numbers -----------------------------------------------------------------------

def clamp(x, low, high) -> Column:
    """Bound to [low, high]; unlike bare least/greatest a null stays null."""
    x = as_col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def round_to(x, digits) -> Column:
    """Round half to even."""
    return F.bround(as_col(x), digits)


def round_half_up(x, digits) -> Column:
    """What ``round`` returns, without making a decimal of every value.

    Off the ties the nearest whole number of the scaled value is certain, and its quotient is the double nearest to
    that decimal; only values near a tie, huge ones, nulls and NaN go through ``round``.
    """
    x = as_col(x).cast("double")
    scaled_up = x * F.lit(10.0 ** digits)
    whole = F.rint(scaled_up)
    # below 1e12 a scaled value is wrong by less than a thousandth
    certain = (F.abs(scaled_up) < 1e12) & (F.abs(scaled_up - whole) < 0.49)
    return F.when(certain, whole / F.lit(10.0 ** digits)).otherwise(F.round(x, digits))


def cyclic(x, period) -> tuple[Column, Column]:
    angle = as_col(x) * F.lit(2 * math.pi) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def scaled(x, center, scale) -> Column:
    return (as_col(x) - as_col(center)) / as_col(scale)


def unscaled(x, center, scale) -> Column:
    return as_col(x) * as_col(scale) + as_col(center)


# --- forecasts -----------------------------------------------------------------------

def clip_forecast(x) -> Column:
    return clamp(x, 0.0, fixed.MAX_READING)


def nominal_confidence(step) -> Column:
    """Fixed ramp over the steps 0..23, not a measured confidence."""
    return round_to(F.lit(0.90) - as_col(step) / F.lit(float(fixed.HORIZONS)) * F.lit(0.30), 2)


def delta(forecast, current) -> Column:
    return round_to(as_col(forecast) - as_col(current), 1)


def trend_arrow(change) -> Column:
    change = as_col(change)
    return F.when(change > 0, "↑").when(change < 0, "↓").otherwise("→")


def horizon_weights(kind="exp", decay=0.04, n=fixed.HORIZONS) -> list[float]:
    """Normalised decaying weights for the steps 1..n.

    ``exp``: exp(-decay·k); ``power``: decay^k, both for k = 0..n-1.
    """
    raw = [math.exp(-decay * k) if kind == "exp" else decay ** k for k in range(n)]
    return [w / sum(raw) for w in raw]
