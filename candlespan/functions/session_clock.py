"""The exchange session: minutes since the open, expected share of volume, partial bars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlespan.config import EXCHANGE_TZ, SESSION_CLOSE_MINUTE, SESSION_OPEN_MINUTE, VOLUME_PROFILE


def local_time(utc: Column) -> Column:
    """A UTC timestamp on the exchange's clock."""
    return F.from_utc_timestamp(utc, EXCHANGE_TZ)


def minutes_into_session(local: Column) -> Column:
    at = F.hour(local) * 60 + F.minute(local)
    return F.greatest(F.lit(0), F.least(F.lit(SESSION_CLOSE_MINUTE - SESSION_OPEN_MINUTE), at - SESSION_OPEN_MINUTE))


def volume_fraction(minutes: Column) -> Column:
    """Expected share of the day's volume by then, linear between the profile's points."""
    out = None
    for (m0, f0), (m1, f1) in zip(VOLUME_PROFILE, VOLUME_PROFILE[1:]):
        value = f0 + (minutes - m0) / (m1 - m0) * (f1 - f0)
        out = F.when(minutes <= m1, value) if out is None else out.when(minutes <= m1, value)
    return out.otherwise(1.0)


def projected_volume(volume: Column, fraction: Column, least: float = 0.5) -> Column:
    """Full-day estimate of a partial volume; left alone while too little of the session has passed."""
    return F.when(fraction >= least, volume / fraction).otherwise(volume.cast("double"))


def is_partial(bar_date: Column, local: Column) -> Column:
    """A bar of the clock's own day before the close."""
    return (bar_date == F.to_date(local)) & (F.hour(local) * 60 + F.minute(local) < SESSION_CLOSE_MINUTE)
