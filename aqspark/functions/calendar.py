"""Calendar features. All but the cyclic month read the local wall clock."""

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.functions.scalars import as_col, cyclic, to_local


def any_of(conditions) -> Column:
    conditions = list(conditions)
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def flag(condition) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def in_event(local, days, before, after) -> Column:
    """True from midnight ``before`` days ahead to midnight ``after`` days past an event.

    ``days`` is a short fixed list, so the range join is a chain of literals.
    """
    local = as_col(local)

    def around(day):
        centre = datetime.strptime(day, "%Y-%m-%d")
        return local.between(F.lit(centre - timedelta(days=before)).cast("timestamp"),
                             F.lit(centre + timedelta(days=after)).cast("timestamp"))
    return any_of(around(d) for d in days)


def diwali(local) -> Column:
    return in_event(local, fixed.DIWALI, 3, 2)


def holi(local) -> Column:
    return in_event(local, fixed.HOLI, 1, 1)


def rush_hour(local) -> Column:
    return flag(F.hour(as_col(local)).isin(fixed.RUSH_HOURS))


def is_weekday(local) -> Column:
    return flag(F.weekday(as_col(local)) < 5)


def is_holiday(local) -> Column:
    return flag(F.date_format(as_col(local), "yyyy-MM-dd").isin(fixed.HOLIDAYS))


def traffic(ts) -> dict[str, Column]:
    local = to_local(ts)
    rush, weekday, holiday = rush_hour(local), is_weekday(local), is_holiday(local)
    dow_sin, dow_cos = cyclic(F.weekday(local), 7)
    return {
        "rush_hour": rush,
        "is_weekday": weekday,
        "is_holiday": holiday,
        "traffic_index": (rush * weekday * (1 - holiday)).cast("double"),
        "day_of_week_sin": dow_sin,
        "day_of_week_cos": dow_cos,
    }


def clock(ts) -> dict[str, Column]:
    """Hour of the local day, but month of the UTC date."""
    hour_sin, hour_cos = cyclic(F.hour(to_local(ts)), 24)
    month_sin, month_cos = cyclic(F.month(as_col(ts)), 12)
    return {"hour_sin": hour_sin, "hour_cos": hour_cos,
            "month_sin": month_sin, "month_cos": month_cos}


def seasons(ts, lat) -> dict[str, Column]:
    local = to_local(ts)
    month = F.month(local)
    harvest = month.isin(10, 11) | ((as_col(lat) <= 25) & month.isin(1, 2))
    return {
        "is_monsoon": flag(month.isin(6, 7, 8, 9)),
        "is_winter": flag(month.isin(12, 1, 2)),
        "is_harvest_season": flag(harvest),
        "is_diwali_period": flag(diwali(local)),
        "is_holi_period": flag(holi(local)),
    }


def calendar_news(ts, lat) -> dict[str, Column]:
    """Expected strength of each news signal, from date and latitude alone."""
    local = to_local(ts)
    month, day, hour = F.month(local), F.dayofmonth(local), F.hour(local)
    north = as_col(lat) > 25

    def strength(condition, value):
        return F.when(condition, F.lit(value)).otherwise(F.lit(0.0))

    new_year = (((month == 12) & (day == 31) & (hour >= 20))
                | ((month == 1) & (day == 1) & (hour <= 2)))
    burning = ((month == 10) & (day >= 15)) | (month == 11)
    cold = month.isin(11, 12, 1, 2)
    return {
        "news_dust_storm": strength(month.between(4, 6) & hour.between(12, 20), 0.3),
        "news_industrial_event": F.lit(0.05),
        "news_crop_burning": strength(north & burning, 0.8),
        "news_calamity": strength(month.between(6, 9), 0.1),
        "news_fireworks": strength(diwali(local) | new_year, 1.0),
        "news_smog_alert": F.when(cold & north, 0.4).when(cold, 0.1).otherwise(0.0),
    }
