"""LOG-8: next run time of a recurrence rule, as one Column expression.

Rules are rows (mode, amount, unit, time, weekday, day, month, start_at,
end_at, last_run_at) and a base time per row; the result is
``YYYY-MM-DD HH:MM:SS`` or "" (past the end, or a ``once`` rule already run).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.dates import parse_cascade

# Interval units in seconds (unknown unit -> minutes), and the
# default time of day of calendar rules.
UNIT_SECONDS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
DEFAULT_TIME = "09:00:00"


def _ts(c: Column) -> Column:
    return parse_cascade(c).cast("timestamp_ntz")


def _add_seconds(ts: Column, secs: Column) -> Column:
    return F.timestamp_add("SECOND", secs.cast("long"), ts)


def _add_days(ts: Column, days: Column) -> Column:
    return F.timestamp_add("DAY", days.cast("int"), ts)


def _at(y: Column, m: Column, d: Column, hh: Column, mm: Column, ss: Column) -> Column:
    last = F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))
    return F.try_make_timestamp_ntz(y, m, F.least(d, last), hh, mm, ss.cast("decimal(16,6)"))


def _int(c: Column, default: int) -> Column:
    v = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(v == "", F.lit(default)).otherwise(v.try_cast("int"))


def next_run(
    mode: Column, base: Column, *, amount: Column | None = None, unit: Column | None = None,
    time: Column | None = None, weekday: Column | None = None, day: Column | None = None,
    month: Column | None = None, start_at: Column | None = None, end_at: Column | None = None,
    last_run_at: Column | None = None,
) -> Column:
    def opt(c: Column | None, default=None) -> Column:
        return F.lit(default) if c is None else c

    amount, unit, time, weekday, day, month = (opt(c) for c in (amount, unit, time, weekday, day, month))
    start_at, end_at, last_run_at = (opt(c, "") for c in (start_at, end_at, last_run_at))
    base = base.cast("timestamp_ntz")
    start, end, last = _ts(start_at), _ts(end_at), _ts(last_run_at)
    b = F.when(start.isNotNull() & (base < start), start).otherwise(base)
    m = F.coalesce(F.when(mode.cast("string") != "", mode.cast("string")), F.lit("once"))

    # once
    once = F.when(last.isNull(), F.coalesce(start, b))
    # interval
    amt = F.greatest(F.coalesce(F.when(_int(amount, 1) == 0, F.lit(1)).otherwise(_int(amount, 1)), F.lit(1)), F.lit(1))
    unit_s = F.lit(60)
    for name, secs in UNIT_SECONDS.items():
        unit_s = F.when(F.coalesce(unit.cast("string"), F.lit("minutes")) == name, F.lit(secs)).otherwise(unit_s)
    secs = amt.cast("long") * unit_s
    c0 = F.when(last.isNotNull(), _add_seconds(last, secs)).when(start.isNotNull(), start).otherwise(_add_seconds(b, secs))
    gap = F.unix_micros(b.cast("timestamp")) - F.unix_micros(c0.cast("timestamp"))
    steps = F.when(c0 < b, F.floor(gap / F.lit(1_000_000) / secs) + 1).otherwise(F.lit(0))
    interval = _add_seconds(c0, steps * secs)
    # calendar rules
    t = F.coalesce(F.when(time.cast("string") != "", time.cast("string")), F.lit(DEFAULT_TIME))
    parts = F.regexp_extract_all(t, F.lit("(\\d+)"), 1)
    hh = F.coalesce(F.try_element_at(parts, F.lit(1)).cast("int"), F.lit(0))
    mi = F.coalesce(F.try_element_at(parts, F.lit(2)).cast("int"), F.lit(0))
    ss = F.coalesce(F.try_element_at(parts, F.lit(3)).cast("int"), F.lit(0))
    y, mo = F.year(b), F.month(b)
    today = _at(y, mo, F.dayofmonth(b), hh, mi, ss)
    daily = F.when(today <= b, _add_days(today, F.lit(1))).otherwise(today)
    wd = F.least(F.greatest(_int(weekday, 1), F.lit(1)), F.lit(7)) - 1
    dow = F.pmod(F.dayofweek(b) + 5, F.lit(7))
    wk = _add_days(today, F.pmod(wd - dow, F.lit(7)))
    weekly = F.when(wk <= b, _add_days(wk, F.lit(7))).otherwise(wk)
    dd = F.least(F.greatest(_int(day, 1), F.lit(1)), F.lit(31))
    this_month = _at(y, mo, dd, hh, mi, ss)
    nxt = F.add_months(F.make_date(y, mo, F.lit(1)), 1)
    monthly = F.when(this_month <= b, _at(F.year(nxt), F.month(nxt), dd, hh, mi, ss)).otherwise(this_month)
    mm = F.least(F.greatest(_int(month, 1), F.lit(1)), F.lit(12))
    this_year = _at(y, mm, dd, hh, mi, ss)
    yearly = F.when(this_year <= b, _at(y + 1, mm, dd, hh, mi, ss)).otherwise(this_year)

    cand = (
        F.when(m == "once", once).when(m == "interval", interval).when(m == "daily", daily)
        .when(m == "weekly", weekly).when(m == "monthly", monthly).when(m == "yearly", yearly)
        .otherwise(b)
    )
    text = F.date_format(cand, "yyyy-MM-dd HH:mm:ss")
    return (
        F.when(end.isNotNull() & (b > end), F.lit(""))
        .when(cand.isNull(), F.lit(""))
        .when(end.isNotNull() & (cand > end), F.lit(""))
        .otherwise(text)
    )
