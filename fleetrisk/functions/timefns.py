"""Time expressions on naive (TIMESTAMP_NTZ) timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DAY_END_HOUR, DAY_START_HOUR

# Text layouts beside ISO, tried in order; month first, as a day over 12 shows itself.
MONTH_FIRST = ["MM/dd/yyyy HH:mm:ss", "MM-dd-yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy"]
DAY_FIRST = ["dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy"]
YEAR_FIRST = ["yyyy/MM/dd HH:mm:ss"]


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def hour_bucket(ts: Column | str) -> Column:
    """AG1: floor a timestamp to its hour, staying NTZ."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return ntz(F.date_trunc("hour", ts))


def parse_text_timestamp(c: Column, day_first: bool = False) -> Column:
    """SRC4 (text): ISO dates with or without time, fraction (to the microsecond) and zone (to UTC), then slashed and
    dashed layouts, month first unless ``day_first`` or the first number can't be a month. NULL when nothing fits."""
    s = F.trim(c.cast("string"))
    iso = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}($|[T ])"), s.try_cast("timestamp"))
    layouts = [*YEAR_FIRST, *(DAY_FIRST + MONTH_FIRST if day_first else MONTH_FIRST + DAY_FIRST)]
    return ntz(F.coalesce(iso, *[F.try_to_timestamp(s, F.lit(f)) for f in layouts]))


def parse_epoch_millis(c: Column) -> Column:
    """SRC4 (epoch): integral milliseconds since 1970; NULL when not a number."""
    ms = F.trim(c.cast("string")).try_cast("double").try_cast("bigint")
    return ntz(F.timestamp_millis(ms))


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """FN2: Monday = 0 ... Sunday = 6."""
    return F.weekday(ts)


def is_daytime(hour: Column) -> Column:
    """FN3: 1 when 6 <= hour <= 18 (both ends inclusive)."""
    return hour.between(DAY_START_HOUR, DAY_END_HOUR).cast("int")


def hours_between(later: Column, earlier: Column) -> Column:
    """Elapsed hours as double, exact to the microsecond."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(3_600_000_000.0)
