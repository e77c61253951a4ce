"""Texts that callers of a field service and its tools rely on, word for word, and the constants that go with them."""

from __future__ import annotations

# --- fixed values: answers of the field service -------------------------------------------------------------------------------------------------
BAD_DATE = "Invalid date format. Use YYYY-MM-DD."
BAD_FIELDS = "Unsupported field(s): {bad}. Allowed: {allowed}"
BAD_MODES = "Unsupported mode(s): {bad}. Allowed: {allowed}"
SAMPLE_IN_POINT = "Parameter 'sample' is only supported in BBox mode."
SAMPLE_TOO_SMALL = "Parameter 'sample' must be >= 1."
TOO_MANY_POINTS = "Too many points ({cells:,}). Increase 'sample' or shrink bbox (limit {limit:,})."
NO_DATA_IN_PERIOD = "Data not exist for requested period; available date range is {earliest}/{latest}."
BOX_DAY_MISSING = "BBOX query only allows single-day data. Requested {day} is unavailable; available range is {earliest}/{latest}."
NO_GROUPS_IN_SPAN = "No existing daily groups in the requested span."
NO_DATES = "No available dates."
# --- fixed values: answers of the tools ---------------------------------------------------------------------------------------------------------
TOOL_BAD_DATE = "Invalid date (expected YYYY-MM-DD): {text}"
TOOL_BAD_FIELD = "Unsupported field '{field}'. Allowed: {allowed}"
TOOL_BAD_METHOD = "Unsupported method '{method}'. Allowed: ['exact', 'nearest']."
LON_OUT = "Longitude {lon} out of bounds [-180, 180]."
LAT_OUT = "Latitude {lat} out of bounds [-90, 90]."
COORDS_OUT = "Longitude/latitude out of bounds."
BOX_SHAPE = "bbox must contain exactly four numbers: [lon0, lat0, lon1, lat1]."
BOX_AREA = "bbox must cover a non-zero area."
RETRIES_SPENT = "Too many points"
TOO_FAR = "No data for {asked}; nearest available date {other} is {away} days away (tolerance {most} days)."
ALSO_UNAVAILABLE = "No data for {asked}; nearest available date {other} is also unavailable."
NO_POINT = "No data returned for requested point/date."
BAD_VALUES = "{field} values contains invalid values."
BAD_TIME = "Invalid query_time format: {text}"
ZONE_REQUIRED = "timezone (tz) required (use IANA name or numeric offset)"
ZONE_UNKNOWN = "Unknown timezone '{raw}'."
ZONE_INVALID = "Invalid timezone '{raw}'."
TIDE_BAD_JSON = "Invalid JSON from tide backend"
TIDE_EMPTY = "Tide backend returned no data."
BAD_ENV = "Invalid {kind} value for {name}: {raw}"
# --- fixed values: messages of a tide answer, in their order ------------------------------------------------------------------------------------
ZONE_NOTE = "Timezone not provided; times shown are in UTC (+00:00). Convert to your local time if needed."
SKY_NOTE = "Sun/Moon data unavailable at this time (USNO service error). Tide extrema are provided below."
TIDE_NOTE = "Note: Tide heights are relative to NTDE 1983–2001 MSL and provided for reference only."
# --- fixed values: the pipeline -----------------------------------------------------------------------------------------------------------------
NO_DAYS = "No date groups found"
BAD_START = "Invalid START_DATE: {text}"
BAD_END = "Invalid END_DATE: {text}"
BAD_ORDER = "START_DATE must be <= END_DATE"
