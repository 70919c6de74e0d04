"""Time expressions; times are BIGINT microseconds since the epoch, null where unknown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:[.,](\d+))?\s*([Zz]|[+-]\d{2}(?::?\d{2})?)?$"
#: Microseconds of 1990-01-01 and 2100-01-01, and of the epoch since 1601.
LO, HI, FILETIME = 631_152_000_000_000, 4_102_444_800_000_000, 11_644_473_600_000_000
SKEW = 2_000_000


def parse_iso(c: Column) -> Column:
    """P10 for text: ISO 8601, a missing offset being UTC, the fraction cut to microseconds."""
    s = F.trim(c)
    part = lambda k: F.regexp_extract(s, _ISO, k)
    clock = F.concat_ws(" ", part(1), part(2))
    leap = part(2).endswith(":60")
    base = F.when(leap, F.regexp_replace(clock, ":60$", ":59")).otherwise(clock)
    micros = F.unix_micros(F.try_to_timestamp(F.concat(base, F.lit("Z")), F.lit("yyyy-MM-dd HH:mm:ssX"))) + F.when(leap, 1_000_000).otherwise(0)
    fraction = F.rpad(F.substring(part(3), 1, 6), 6, "0").cast("long")
    zone = F.regexp_replace(part(4), ":", "")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    minutes = F.coalesce(F.substring(zone, 2, 2).try_cast("long"), F.lit(0)) * 60 + F.coalesce(F.substring(zone, 4, 2).try_cast("long"), F.lit(0))
    return F.when(s.rlike(_ISO), micros + F.coalesce(fraction, F.lit(0)) - sign * minutes * 60_000_000)


def parse_time(c: Column, numeric: bool) -> Column:
    """P10: ISO text, or, where a source types its values (``numeric``), a number of milliseconds."""
    out = parse_iso(c)
    if numeric:
        out = F.coalesce(out, F.when(F.trim(c).rlike(r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"), F.round(c.try_cast("double") * 1000).cast("long")))
    return out


def time_of(c: Column) -> Column:
    """P10 or a number in s, ms, us, ns or FILETIME ticks, the first that lies between 1990 and 2100."""
    n = F.when(F.trim(c).rlike(r"^-?\d+(\.\d+)?$"), F.trim(c).try_cast("decimal(38,6)"))
    within = lambda x: F.when((x >= LO) & (x < HI), F.round(x).cast("long"))
    number = F.when(n > 0, F.coalesce(within(n * 1_000_000), within(n * 1000), within(n), within(n / 1000), within(n / 10 - FILETIME)))
    return F.coalesce(parse_iso(c), number)


def relative(t: Column, origin: Column) -> Column:
    """+1d 02:03:04 from ``origin``, whole seconds cut toward zero."""
    gap = t - origin
    total = F.abs(gap)
    s = F.floor(total / 1_000_000).cast("long")
    days = F.floor(s / 86400).cast("long")
    text = F.format_string("%02d:%02d:%02d", (F.floor(s / 3600) % 24).cast("long"), (F.floor(s / 60) % 60).cast("long"), s % 60)
    return F.when(gap.isNotNull(), F.concat(F.when((gap < 0) & (s > 0), "-").otherwise("+"), F.when(days > 0, F.concat(days.cast("string"), F.lit("d "))).otherwise(""), text))


def iso(t: Column) -> Column:
    """ISO 8601 in UTC with microseconds."""
    rest = F.pmod(t, F.lit(1_000_000))
    return F.when(t.isNotNull(), F.concat(F.date_format(F.timestamp_seconds(((t - rest) / 1_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), F.lpad(rest.cast("string"), 6, "0"), F.lit("Z")))
