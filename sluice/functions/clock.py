"""The application's clock: wall time in the zone named by ``APP_TIMEZONE``."""

from __future__ import annotations

import datetime as dt
import os
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The zone when none is named, and its offset when the machine knows no zones.
DEFAULT_ZONE, DEFAULT_OFFSET = "Asia/Shanghai", "+08:00"
TEXT = "%Y-%m-%d %H:%M:%S"


def zone_name() -> str:
    """A zone that Python and Spark know."""
    name = os.environ.get("APP_TIMEZONE") or DEFAULT_ZONE
    try:
        ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return DEFAULT_OFFSET
    return name


def now() -> dt.datetime:
    name = zone_name()
    zone = dt.datetime.strptime(name, "%z").tzinfo if name == DEFAULT_OFFSET else ZoneInfo(name)
    return dt.datetime.now(zone).replace(tzinfo=None)


def now_text(at: dt.datetime | None = None) -> str:
    return (at or now()).strftime(TEXT)


def now_col() -> Column:
    """The same as a column: a timestamp without zone."""
    return F.convert_timezone(F.current_timezone(), F.lit(zone_name()), F.current_timestamp().cast("timestamp_ntz"))
