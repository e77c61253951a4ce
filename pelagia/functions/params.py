"""Request parameters on the driver: strict validation, in one place for all plans."""

from __future__ import annotations

import datetime as dt
import math
import re
from zoneinfo import ZoneInfo

from .. import messages as say
from ..errors import BadRequest, ToolError

_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}\Z")
#: Modes that change a result's form.
MODES = ("truncate",)


def calendar_date(text: str) -> dt.date | None:
    """A date of the form YYYY-MM-DD, None if it isn't one. Impossible days, such as 2025-99-99, are none."""
    if not _DATE.match(text):
        return None
    try:
        return dt.date.fromisoformat(text)
    except ValueError:
        return None


def request_date(text: str | None) -> dt.date | None:
    """None passes; all else must be a date."""
    if text is None:
        return None
    if (found := calendar_date(text)) is None:
        raise BadRequest(say.BAD_DATE)
    return found


def tool_date(text: str) -> dt.date:
    if (found := calendar_date(text)) is None:
        raise ToolError(say.TOOL_BAD_DATE.format(text=text))
    return found


def comma_list(text: str) -> list[str]:
    return [x for x in (p.strip() for p in text.split(",")) if x]


def request_fields(append: str | None, allowed: tuple[str, ...]) -> list[str]:
    """Fields of a comma list, repeats and order as given. Without a list the first allowed field; a list without names gives no field."""
    if not append:
        return [allowed[0]]
    asked = comma_list(append)
    if bad := [x for x in asked if x not in allowed]:
        raise BadRequest(say.BAD_FIELDS.format(bad=",".join(bad), allowed=",".join(allowed)))
    return asked


def request_modes(mode: str | None) -> set[str]:
    asked = [x.lower() for x in comma_list(mode or "")]
    if bad := [x for x in asked if x not in MODES]:
        raise BadRequest(say.BAD_MODES.format(bad=",".join(bad), allowed=",".join(MODES)))
    return set(asked)


def tool_fields(fields: list[str] | None, allowed: tuple[str, ...]) -> list[str]:
    """Each field once, in the order given; the first allowed one if none is asked for."""
    asked = list(dict.fromkeys(fields or [allowed[0]]))
    for x in asked:
        if x not in allowed:
            raise ToolError(say.TOOL_BAD_FIELD.format(field=x, allowed=sorted(allowed)))
    return asked


def tool_method(method: str) -> bool:
    """Whether a nearest day may stand in."""
    if method not in ("exact", "nearest"):
        raise ToolError(say.TOOL_BAD_METHOD.format(method=method))
    return method == "nearest"


def finite(*values: float) -> None:
    """NaN would be taken for the upper edge by a clamp, so it is refused."""
    if any(math.isnan(v) for v in values):
        raise BadRequest("Coordinates must be numbers.")


def tool_point(lon: float, lat: float) -> None:
    if not -180 <= lon <= 180:
        raise ToolError(say.LON_OUT.format(lon=lon))
    if not -90 <= lat <= 90:
        raise ToolError(say.LAT_OUT.format(lat=lat))


def tool_bbox(bbox: list[float] | tuple[float, ...]) -> tuple[float, float, float, float]:
    """Corners in ascending order; each must lie on the globe, and the box must have an area."""
    if len(bbox) != 4:
        raise ToolError(say.BOX_SHAPE)
    lon0, lat0, lon1, lat1 = map(float, bbox)
    tool_point(lon0, lat0)
    tool_point(lon1, lat1)
    (lon0, lon1), (lat0, lat1) = sorted((lon0, lon1)), sorted((lat0, lat1))
    if lon0 == lon1 or lat0 == lat1:
        raise ToolError(say.BOX_AREA)
    return lon0, lat0, lon1, lat1


def point_dates(start: dt.date | None, end: dt.date | None, earliest: dt.date, latest: dt.date, max_days: int) -> list[dt.date]:
    """The calendar days of a point request: none given is the latest day, one given is that day; a reversed range is turned, then clamped to what there is, then cut
    to ``max_days`` from its first day. Empty if the range lies outside."""
    a, b = start or end or latest, end or start or latest
    a, b = max(min(a, b), earliest), min(max(a, b), latest)
    b = min(b, a + dt.timedelta(days=max_days - 1))
    return [a + dt.timedelta(days=k) for k in range((b - a).days + 1)]


def stride_estimate(lon0: float, lat0: float, lon1: float, lat1: float, degrees: float, limit: int) -> int:
    """The smallest stride at which a box of nominal cells is within the limit, but for rounding."""
    nx, ny = (max(1, math.floor(abs(b - a) / degrees) + 1) for a, b in ((lon0, lon1), (lat0, lat1)))
    return 1 if nx * ny <= limit else math.ceil(math.sqrt(nx * ny / limit))


def fitting_stride(first: int, nx: int, ny: int, limit: int, attempts: int) -> int:
    """``first`` doubled until the cells that are left are within the limit."""
    for k in range(attempts):
        s = first << k
        if ((nx - 1) // s + 1) * ((ny - 1) // s + 1) <= limit:
            return s
    raise ToolError(say.RETRIES_SPENT)


def fallback_date(asked: dt.date, earliest: dt.date, latest: dt.date) -> dt.date:
    """The bound that is nearer to ``asked``; the earlier one if both are as near."""
    return earliest if abs((asked - earliest).days) <= abs((latest - asked).days) else latest


def iso_datetime(text: str) -> dt.datetime:
    try:
        return dt.datetime.fromisoformat(re.sub(r"[zZ]\Z", "+00:00", text.strip()))
    except ValueError as e:
        raise ToolError(say.BAD_TIME.format(text=text)) from e


def offset_text(delta: dt.timedelta) -> str:
    minutes = int(delta.total_seconds() / 60)
    return f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


def timezone(text: str | None) -> tuple[dt.tzinfo, str | None, bool]:
    """The zone, its name if one was given, and whether the text was Z, which stands for none chosen."""
    if not text or not text.strip():
        raise ToolError(say.ZONE_REQUIRED)
    raw = text.strip()
    if raw.upper() == "Z":
        return dt.timezone.utc, None, True
    if raw.upper() in ("UTC", "GMT"):
        return dt.timezone.utc, raw, False
    if "/" in raw or raw.isalpha():
        try:
            return ZoneInfo(raw), raw, False
        except Exception as e:
            raise ToolError(say.ZONE_UNKNOWN.format(raw=raw)) from e
    m = re.fullmatch(r"([+-]?)([0-9]+)(?::([0-9]{1,2})|(\.[0-9]*))?", raw)
    minutes = int(m[2]) * 60 + (int(m[3]) if m[3] else round(float("0" + m[4]) * 60) if m[4] else 0) if m else 24 * 60
    if minutes >= 24 * 60:
        raise ToolError(say.ZONE_INVALID.format(raw=raw))
    return dt.timezone(dt.timedelta(minutes=-minutes if m[1] == "-" else minutes)), None, False


def offset_on(zone: dt.tzinfo, day: dt.date) -> str:
    """The zone's offset at noon of the day, away from the hours when clocks change."""
    return offset_text(dt.datetime.combine(day, dt.time(12), zone).utcoffset() or dt.timedelta())
