"""Time expressions.  The session time zone is expected to be UTC."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import as_column

MICROS = {
    "second": 1_000_000,
    "minute": 60 * 1_000_000,
    "hour": 3_600 * 1_000_000,
    "day": 86_400 * 1_000_000,
}


def epoch_us(c) -> Column:
    """Microseconds since 1970, for timestamps with or without a zone."""
    return F.unix_micros(as_column(c).cast("timestamp"))


def div(a: Column, b) -> Column:
    """Whole-number division that stays exact beyond 2**53."""
    return F.call_function("div", a, F.lit(b) if not isinstance(b, Column) else b)


def round_us(us: Column, unit: str) -> Column:
    """Round microseconds to a unit; halves go to the even multiple."""
    size = MICROS[unit]
    rest = F.pmod(us, F.lit(size))
    whole = div(us - rest, size)
    up = (rest * 2 > size) | ((rest * 2 == size) & (F.pmod(whole, F.lit(2)) == 1))
    return (whole + up.cast("long")) * size


def round_time(c, unit: str) -> Column:
    """Timestamp rounded to a unit, halves to even (``date_trunc`` floors)."""
    return F.timestamp_micros(round_us(epoch_us(c), unit))


def floor_time(c, unit: str) -> Column:
    us = epoch_us(c)
    return F.timestamp_micros(us - F.pmod(us, F.lit(MICROS[unit])))


def parse_post_time(c) -> Column:
    """Parse ``Wed Oct 10 20:19:24 +0000 2018``; ISO text is accepted too.

    The weekday is cut off because Spark does not parse day names.  Text in
    neither form gives NULL.
    """
    text = as_column(c)
    dated = F.try_to_timestamp(F.substring(text, 5, 64), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.coalesce(dated, F.try_to_timestamp(text))


def format_post_time(c) -> Column:
    return F.date_format(as_column(c).cast("timestamp"), "EEE MMM dd HH:mm:ss Z yyyy")


def gap_seconds(later, earlier) -> Column:
    """``later - earlier`` in seconds, with the fraction."""
    return (epoch_us(later) - epoch_us(earlier)) / F.lit(1_000_000.0)


def seconds_to_us(seconds: float) -> int:
    return int(round(seconds * 1_000_000))
