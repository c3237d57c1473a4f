"""Calendar column functions (F1-F10, F21).  All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c, fmt: str = "yyyy-MM-dd") -> Column:
    """``%Y-%m-%d`` → ``yyyy-MM-dd``; ``%Y%m%d`` → ``yyyyMMdd``;
    ``' - %b %d, %Y'`` → ``' - 'MMM dd, yyyy``."""
    return F.to_date(F.try_to_timestamp(_c(c), F.lit(fmt)))


def time_features(c="Date") -> list[Column]:
    """month, day of month, weekday (Monday = 0)."""
    d = _c(c)
    return [F.month(d).alias("month"), F.dayofmonth(d).alias("day"), F.weekday(d).alias("day_in_week")]


def to_day(c) -> Column:
    """truncate a timestamp to its date."""
    return F.to_date(_c(c))


def at_time(c, hour: int, minute: int = 0) -> Column:
    """date + fixed wall time, as a timestamp (session zone UTC)."""
    d = _c(c)
    return F.make_timestamp(F.year(d), F.month(d), F.dayofmonth(d), F.lit(hour), F.lit(minute), F.lit(0))


def eastern_to_utc(c) -> Column:
    """local US/Eastern wall time → UTC (DST aware)."""
    return F.to_utc_timestamp(_c(c), "US/Eastern")


def next_day(c, n: int = 1) -> Column:
    """add calendar days."""
    return F.date_add(_c(c), n)


def roll_weekend(c) -> Column:
    """Saturday/Sunday → next Monday."""
    d = _c(c)
    wd = F.weekday(d)
    return F.when(wd >= 5, F.date_add(d, (F.lit(7) - wd).cast("int"))).otherwise(d)


def trading_date(c) -> Column:
    """F8: no run on weekday 4, 5 (null); Sunday dated back 2 days to
    Friday; any other day keeps its own date."""
    d = _c(c)
    wd = F.weekday(d)
    return (F.when(wd.isin(4, 5), F.lit(None).cast("date"))
             .when(wd == 6, F.date_sub(d, 2)).otherwise(d))


def relative_date(c, as_of: Column) -> Column:
    """text after its first 3 characters: ``N hour(s)/minute(s)/
    second(s) ago`` → as_of − N as a date; otherwise a date in
    ``MMM dd, yyyy``; any parse failure → as_of's date; a relative text
    with another unit → null."""
    s = F.substr(_c(c), F.lit(4))
    rel = F.regexp_extract(s, r"^(\d+) (hour|minute|second)s? ago$", 0)
    n = F.regexp_extract(s, r"^(\d+) ", 1)
    unit = F.regexp_extract(s, r"^\d+ ([a-z]+?)s? ago$", 1)
    secs = (F.when(unit == "hour", n.cast("long") * 3600)
             .when(unit == "minute", n.cast("long") * 60)
             .when(unit == "second", n.cast("long")))
    rel_date = F.to_date(F.timestamp_seconds(F.unix_timestamp(as_of) - secs))
    absolute = F.to_date(F.try_to_timestamp(s, F.lit("MMM dd, yyyy")))
    is_rel = F.length(F.regexp_extract(s, r"^\d+ [a-z]+ ago$", 0)) > 0
    return (F.when(is_rel & (F.length(rel) > 0), rel_date)
             .when(is_rel, F.lit(None).cast("date"))
             .otherwise(F.coalesce(absolute, F.to_date(as_of))))


def format_day(c, fmt: str = "yyyy-MM-dd") -> Column:
    """F10."""
    return F.date_format(_c(c), fmt)


def date_spine(start, stop) -> Column:
    """every calendar date between two dates (explode the result)."""
    return F.explode(F.sequence(_c(start), _c(stop), F.expr("INTERVAL 1 DAY")))
