"""Sampling slots, durations and local calendar fields as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: seconds from 0001-01-01, where the slot grid begins, to 1970-01-01.
GRID_ORIGIN_S = 62_135_596_800


def slot(ts: Column, interval_s: Column | int) -> Column:
    """Number of the sampling slot that holds ``ts``, exact in whole microseconds."""
    step = (F.lit(interval_s) if isinstance(interval_s, int) else interval_s).cast("long") * 1_000_000
    at = F.unix_micros(ts) + GRID_ORIGIN_S * 1_000_000
    # A multiple of a million loses no bit as a double here.
    return ((at - F.pmod(at, step)) / step).cast("long")


def slot_start(number: Column, interval_s: Column | int) -> Column:
    step = (F.lit(interval_s) if isinstance(interval_s, int) else interval_s).cast("long")
    return F.timestamp_seconds(number * step - GRID_ORIGIN_S)


def seconds_between(later: Column, earlier: Column) -> Column:
    """Difference in seconds, with its fraction."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1_000_000


#: Seconds of the units that a duration can name.
UNIT_S = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


def parse_duration(text: Column) -> Column:
    """Seconds of '30d', '1h30m', '45s', '1.5h' or '0'; null for anything else. Days stand alone and are whole."""
    body = F.regexp_replace(text, "^[+-]", "")
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    number = F.regexp_extract_all(body, F.lit(r"([0-9]*\.?[0-9]*)(h|ms|us|µs|ns|m|s)"), F.lit(1))
    unit = F.regexp_extract_all(body, F.lit(r"([0-9]*\.?[0-9]*)(h|ms|us|µs|ns|m|s)"), F.lit(2))
    scale = F.create_map(*[F.lit(x) for pair in (UNIT_S | {"µs": 1e-6}).items() for x in pair])
    parts = F.zip_with(number, unit, lambda n, u: n.try_cast("double") * F.element_at(scale, u))
    whole = body.rlike(r"^(([0-9]+(\.[0-9]*)?|\.[0-9]+)(h|ms|us|µs|ns|m|s))+$")
    return (
        F.when(text.rlike(r"^[+-]?[0-9]+d$"), F.regexp_replace(text, "d$", "").try_cast("long").cast("double") * 86400)
        .when(body == "0", F.lit(0.0))
        .when(whole, sign * F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))
    )


def format_duration(seconds: Column) -> Column:
    """The shortest of whole days, hours, minutes or seconds that says it."""
    whole = seconds.cast("long")
    by = lambda n, unit: F.when(F.pmod(whole, F.lit(n)) == 0, F.concat((whole / n).cast("long").cast("string"), F.lit(unit)))
    return F.when(whole == 0, F.lit("0s")).otherwise(F.coalesce(by(86400, "d"), by(3600, "h"), by(60, "m"), F.concat(whole.cast("string"), F.lit("s"))))


def local(ts: Column, timezone: Column | str) -> Column:
    """The wall clock of a zone at an instant, as a timestamp without a zone."""
    zone = F.lit(timezone) if isinstance(timezone, str) else timezone
    return F.convert_timezone(F.lit("UTC"), zone, ts.cast("timestamp_ntz"))
