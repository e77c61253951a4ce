"""Column expressions; all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..messages import SKY_NOTE, TIDE_NOTE, ZONE_NOTE

#: Digits kept of coordinates and of fields when a result is truncated.
COORD_DIGITS, FIELD_DIGITS = 5, 3


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(x: Column | str) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c(x)), c(x))


def half_even(x: Column | str, digits: int) -> Column:
    """Rounds the widened value as Python does: ties go to the even digit."""
    return F.bround(c(x).cast("double"), digits)


def hundredths(x: Column) -> Column:
    """A double rounded to two digits by its exact binary value, ties to even, as Python does; bround goes by the decimal text, and takes 2.675 for a tie.

    200 x is 128 x + 64 x + 8 x, each exact; two-sums keep what the additions lose, so the side of the tie (an odd whole number) is exact. Values of 2**43 and more have
    no digits to round at that precision."""
    v = F.abs(x)
    a, b, e = v * 128, v * 64, v * 8
    s = a + b
    lost1 = (a - (s - (s - a))) + (b - (s - a))
    t = s + e
    lost = lost1 + (s - (t - (t - s))) + (e - (t - s))
    low = F.floor(t / 2)  # whole hundredths below, or one too many if the sum was rounded up
    low = F.when((t - low * 2) + lost < 0, low - 1).otherwise(low)
    side = (t - (low * 2 + 1)) + lost
    up = (side > 0) | ((side == 0) & (low % 2 == 1))
    return F.when(v < 2.0**43, F.signum(x) * (F.when(up, low + 1).otherwise(low) / F.lit(100.0))).otherwise(x)


def parsed_date(x: Column | str) -> Column:
    """A date of exactly the form YYYY-MM-DD, else null."""
    return F.when(c(x).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c(x), "yyyy-MM-dd"))


def days_inclusive(a: Column, b: Column) -> Column:
    """An array of dates; empty if reversed."""
    return F.when(a <= b, F.sequence(F.least(a, b), b)).otherwise(F.array().cast("array<date>"))


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def fallback_date(asked: Column, earliest: Column, latest: Column) -> Column:
    return F.when(days_apart(asked, earliest) <= days_apart(latest, asked), earliest).otherwise(latest)


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def comma_list(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(c(x), ","), lambda v: F.trim(v)), lambda v: v != "")


def available_range(x: Column | str) -> Column:
    """The last two dates in a text as an ordered array; null if there are fewer."""
    dates = F.regexp_extract_all(c(x), F.lit(r"(\d{4}-\d{2}-\d{2})"), 1)
    return F.when(F.size(dates) >= 2, F.array_sort(F.slice(dates, -2, 2)))


def detail(x: Column | str) -> Column:
    """The detail of a JSON error text, or the text itself."""
    return F.coalesce(F.get_json_object(c(x), "$.detail"), c(x))


def celsius(x: Column | str, units: Column | str) -> Column:
    return F.when(F.lower(F.trim(c(units))).isin("k", "kelvin"), c(x).cast("double") - 273.15).otherwise(c(x).cast("double")).cast("float")


def granule_date(path: Column | str) -> Column:
    """The day in the fourteen-digit part of a granule's file name, else null."""
    name = F.element_at(F.split(F.regexp_replace(c(path), "/+$", ""), "/"), -1)
    return F.try_to_date(F.substring(F.regexp_extract(name, "(?:^|-)([0-9]{14})(?:-|$)", 1), 1, 8), "yyyyMMdd")


def stride_estimate(lon0: Column, lat0: Column, lon1: Column, lat1: Column, degrees: float, limit: int) -> Column:
    n = lambda a, b: F.greatest(F.lit(1), F.floor(F.abs(b - a) / F.lit(degrees)) + 1)
    total = n(lon0, lon1) * n(lat0, lat1)
    return F.when(total <= limit, F.lit(1)).otherwise(F.ceil(F.sqrt(total / F.lit(limit)))).cast("long")


def fitting_stride(first: Column, nx: Column, ny: Column, limit: int, attempts: int) -> Column:
    """The first of ``first``, twice it, ... that leaves at most ``limit`` cells; null if none of the attempts does."""
    left = lambda n, s: F.floor((n - 1) / s) + 1
    tries = [first * (1 << k) for k in range(attempts)]
    return F.coalesce(*(F.when(left(nx, s) * left(ny, s) <= limit, s) for s in tries))


def timestamp(x: Column | str) -> Column:
    """An ISO time with an offset or Z as an instant; null if it can't be read."""
    return F.try_to_timestamp(F.trim(c(x)))


def local_date(x: Column | str) -> Column:
    """The date in the text's own offset."""
    return F.when(timestamp(x).isNotNull(), F.try_to_date(F.substring(F.trim(c(x)), 1, 10), "yyyy-MM-dd"))


def duration(seconds: Column) -> Column:
    """HH:MM:SS without a sign; hours aren't bounded."""
    s = F.abs(seconds).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def numeric_offset(x: Column | str) -> Column:
    """Minutes of +HH:MM, +H or +H.fraction; null for other texts and for a day or more."""
    raw = F.trim(c(x))
    pattern = r"^([+-]?)([0-9]+)(?::([0-9]{1,2})|(\.[0-9]*))?$"
    part = lambda k: F.regexp_extract(raw, pattern, k)
    fraction = F.bround(F.concat(F.lit("0"), part(4)).try_cast("double") * 60, 0).cast("long")
    minutes = part(2).try_cast("long") * 60 + F.when(part(3) != "", part(3).try_cast("long")).when(part(4) != "", F.coalesce(fraction, F.lit(0))).otherwise(0)
    return F.when(raw.rlike(pattern) & (minutes < 1440), F.when(part(1) == "-", -minutes).otherwise(minutes))


def offset_text(minutes: Column) -> Column:
    m = F.abs(minutes)
    text = F.format_string("%s%02d:%02d", F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+")), F.floor(m / 60), m % 60)
    return F.when(minutes.isNotNull(), text)


def offset_at_noon(zone: Column, day: Column) -> Column:
    """Minutes that a zone is ahead of UTC at noon of a local day."""
    noon = (day.cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")).cast("timestamp_ntz")
    return F.timestamp_diff("MINUTE", F.convert_timezone(zone, F.lit("UTC"), noon), noon)


def height(height_cm: Column, fallback: Column) -> Column:
    """Centimetres to two digits; null if the text is no number."""
    return hundredths(F.coalesce(height_cm, fallback).try_cast("double"))


def tide_messages(sky_status: Column, zone_note: Column) -> Column:
    parts = [F.when(zone_note, F.lit(ZONE_NOTE)), F.when(F.coalesce(sky_status, F.lit("")) != "", F.lit(SKY_NOTE)), F.lit(TIDE_NOTE)]
    return F.array_compact(F.array(*parts))


