"""SQL for DuckDB that gives what the queries give, written from the rules and not from the queries."""

from __future__ import annotations

from .messages import SKY_NOTE as SKY
from .messages import TIDE_NOTE as NOTE
from .messages import ZONE_NOTE as ZONE

CUBE = """axis as (select distinct user_id from events),
     alldays as (select distinct cast(ts as date) as date from events where extract(day from ts) % 7 <> 0),
     obs as (select cast(ts as date) as date, user_id, cast(max(value) as float) as sst, cast(max(value) - min(value) as float) as sst_anomaly,
                    cast(cast(sum(case when event_type = 'error' then 1 else 0 end) as double) / count(*) as float) as sea_ice
             from events group by 1, 2),
     cube as (select d.date, cast(a.user_id // 5 as int) as lat_idx, cast(a.user_id % 5 as int) as lon_idx,
                     cast((2000 + a.user_id // 5) / cast(100 as double) as float) as lat, cast((12000 + a.user_id % 5) / cast(100 as double) as float) as lon,
                     o.sst, o.sst_anomaly, o.sea_ice
              from alldays d cross join axis a left join obs o on o.date = d.date and o.user_id = a.user_id)"""
DAY = "date '2024-01-10'"
TOP = "(select max(lat_idx) from cube)"


def cells(fields: str, where: str) -> str:
    picked = ", ".join(f"cast({f} as double) as {f}" for f in fields.split())
    return f"with {CUBE} select cast(lon as double) as lon, cast(lat as double) as lat, date, {picked} from cube where {where}"


def rounded(fields: str, where: str) -> str:
    picked = ", ".join(f"round_even(cast({f} as double), 3) as {f}" for f in fields.split())
    return f"with {CUBE} select round_even(cast(lon as double), 5) as lon, round_even(cast(lat as double), 5) as lat, date, {picked} from cube where {where}"


POINTS = "pts as (select c_custkey, cast((119995 + c_custkey % 60) / cast(1000 as double) as double) as lon, cast((19990 + c_custkey % 400) / cast(1000 as double) as double) as lat from customer)"
EXTREMA = "ext as (select user_id, cast(ts as date) as local_date, ts, case event_type when 'purchase' then 'HIGH' else 'LOW' end as phen, value as height_cm from events where event_type in ('purchase', 'error'))"
STATES = f"""with {EXTREMA},
q as (select event_id, user_id, cast(ts as date) as local_date, ts from events where event_type = 'click'),
p as (select q.event_id, max(e.ts) as ts from q join ext e on e.user_id = q.user_id and e.local_date = q.local_date and e.ts <= q.ts group by 1),
n as (select q.event_id, min(e.ts) as ts from q join ext e on e.user_id = q.user_id and e.local_date = q.local_date and e.ts > q.ts group by 1),
b as (select q.event_id, q.ts as t0, p.ts as pts, n.ts as nts, (select max((x.phen, x.height_cm)) from ext x where x.user_id = q.user_id and x.ts = p.ts) as pe,
             (select min((x.phen, x.height_cm)) from ext x where x.user_id = q.user_id and x.ts = n.ts) as ne
      from q join p on p.event_id = q.event_id join n on n.event_id = q.event_id)"""
HMS = "printf('%02d:%02d:%02d', cast({s} as bigint) // 3600, cast({s} as bigint) // 60 % 60, cast({s} as bigint) % 60)"
BOXES = "(values (1, 119.0, 20.0, 123.0, 26.0), (2, -180.0, -90.0, 180.0, 90.0), (3, 120.0, 20.0, 120.0, 21.0), (4, 130.0, 30.0, 120.0, 20.0), (5, 100.0, 0.0, 160.0, 60.0)) t(box_id, lon0, lat0, lon1, lat1)"
PARITY = f"""with {CUBE}, o as (select *, case when (lat_idx * 5 + lon_idx) % 11 = 0 then cast(cast(sst as double) + lon_idx * 0.5::double as float) else sst end as sst2 from cube),
x as (select 'sst' as field, lat_idx, lon_idx, date, abs(cast(sst as double) - cast(sst2 as double)) as diff from o where sst is not null
      union all select 'sst_anomaly', lat_idx, lon_idx, date, 0.0::double from o where sst_anomaly is not null union all select 'sea_ice', lat_idx, lon_idx, date, 0.0::double from o where sea_ice is not null)"""

#: What a store has that was ingested from granules in Kelvin, as 32-bit values.
KEL = f"{CUBE}, kel as (select date, lat_idx, lon_idx, lat, lon, cast(cast(cast(cast(sst as double) + 273.15::double as float) as double) - 273.15::double as float) as sst, sst_anomaly, sea_ice from cube)"
STORED_BOX = f"with {KEL} select cast(lon as double) as lon, cast(lat as double) as lat, date, cast(sst as double) as sst, cast(sst_anomaly as double) as sst_anomaly from kel where date = {DAY} and lon_idx <= 3 and lat_idx <= least(5, (select max(lat_idx) from kel))"

ORACLE_SQL: dict[str, str] = {
    "catalog_bounds": f"with {CUBE} select min(date) as earliest, max(date) as latest from cube",
    "index_fill": f"with {CUBE} select min(date) as earliest, max(date) as latest from cube",
    "catalog_days": f"with {CUBE} select distinct date from cube",
    "catalog_gaps": f"with {CUBE} select cast(g as date) as date from (select unnest(generate_series((select min(date) from cube)::timestamp, (select max(date) from cube)::timestamp, interval 1 day)) as g) where cast(g as date) not in (select date from cube)",
    "axis_bounds": f"with {CUBE} select min(lon) as lon_min, max(lon) as lon_max, min(lat) as lat_min, max(lat) as lat_max from cube",
    "index_merge": f"with {CUBE}, b as (select min(date) as e, max(date) as l from cube) select v.day, least(b.e, v.day) as earliest, greatest(b.l, v.day) as latest from b, (values (date '2023-12-30'), (date '2024-01-15'), (date '2024-02-02')) v(day)",
    "nearest_index_bulk": f"""with {CUBE}, {POINTS}, lons as (select distinct lon_idx, lon from cube), lats as (select distinct lat_idx, lat from cube),
a as (select c_custkey, (select lon_idx from lons order by abs(lons.lon - cast(pts.lon as float)), lon_idx limit 1) as lon_idx, (select lat_idx from lats order by abs(lats.lat - cast(pts.lat as float)), lat_idx limit 1) as lat_idx from pts)
select c_custkey, lon_idx, lat_idx from a""",
    "clamp_points": f"with {CUBE}, {POINTS}, b as (select min(lon)::double as x0, max(lon)::double as x1, min(lat)::double as y0, max(lat)::double as y1 from cube) select c_custkey, greatest(x0, least(x1, lon)) as lon, greatest(y0, least(y1, lat)) as lat from pts, b",
    "point_latest": cells("sst", "lon_idx = 2 and lat_idx = 1 and date = (select max(date) from cube)"),
    "point_range": cells("sst", "lon_idx = 2 and lat_idx = 1 and date between date '2024-01-05' and date '2024-01-16'"),
    "point_range_reversed": cells("sst", "lon_idx = 2 and lat_idx = 1 and date between date '2024-01-05' and date '2024-01-16'"),
    "point_range_capped": cells("sst", "lon_idx = 2 and lat_idx = 1 and date <= (select min(date) + 9 from cube)"),
    "point_all_fields": cells("sst sst_anomaly sea_ice", f"lon_idx = 0 and lat_idx = least({TOP}, 500) and date = {DAY}"),
    "point_truncate": rounded("sst sst_anomaly sea_ice", "lon_idx = 3 and lat_idx = 2"),
    "bbox_day": cells("sst sst_anomaly", f"date = {DAY} and lon_idx between 1 and 3 and lat_idx between 0 and 2"),
    "bbox_reversed_corners": cells("sst sst_anomaly", f"date = {DAY} and lon_idx between 1 and 3 and lat_idx between 0 and 2"),
    "bbox_stride": cells("sst sea_ice", f"date = {DAY} and lon_idx % 2 = 0 and lat_idx in (0, 2)"),
    "bbox_clamped": cells("sst", f"date = {DAY}"),
    "bbox_line": cells("sst", f"date = {DAY} and lon_idx = 2 and lat_idx <= 2"),
    "bbox_truncate": rounded("sst sst_anomaly sea_ice", f"date = {DAY} and lat_idx <= 2"),
    "bbox_cardinality": f"with {CUBE} select count(*) as served, cast(6 as bigint) as planned from cube where date = {DAY} and lon_idx % 2 = 0 and lat_idx in (0, 2)",
    "bbox_mean_day": f"with {CUBE} select {DAY} as date, cast(1 as bigint) as sample, round(avg(cast(sst as double)), 6) as sst, round(avg(cast(sst_anomaly as double)), 6) as sst_anomaly from cube where date = {DAY} and lat_idx <= 2",
    "bbox_mean_strided": f"with {CUBE} select {DAY} as date, cast(2 as bigint) as sample, round(avg(cast(sst as double)), 6) as sst from cube where date = {DAY} and lat_idx <= 2 and lat_idx % 2 = 0 and lon_idx % 2 = 0",
    "bbox_mean_all_null": "select cast(null as double) as sst",
    "bbox_mean_by_day": f"with {CUBE} select date, round(avg(cast(sst as double)), 6) as sst, count(sst) as cells from cube where lat_idx <= 2 group by date",
    "bbox_percentile_anomaly": f"with {CUBE} select round(quantile_cont(cast(sst_anomaly as double), 0.9), 6) as p90 from cube where date = {DAY} and lat_idx <= 2",
    "mean_fallback": f"with {CUBE}, l as (select max(date) as d from cube) select d as date, date '2024-02-02' as requested_date, 'nearest' as method, round(avg(cast(sst as double)), 6) as sst from cube, l where date = d and lat_idx <= 2 group by d",
    "point_tool": f"with {CUBE} select 120.021::double as lon, 20.009::double as lat, date, cast(sst as double) as sst, cast(sst_anomaly as double) as sst_anomaly, date '2023-12-28' as requested_date, 'nearest' as method from cube where lon_idx = 2 and lat_idx = 1 and date = (select min(date) from cube)",
    "stride_estimate": f"with b as (select box_id, greatest(1, floor(abs(lon1::double - lon0::double) / 0.01::double) + 1) * greatest(1, floor(abs(lat1::double - lat0::double) / 0.01::double) + 1) as n from {BOXES}) select box_id, cast(case when n <= 1000000 then 1 else ceil(sqrt(n / 1000000)) end as bigint) as stride from b",
    "stride_retry": """with b as (select nx::bigint as nx, ny::bigint as ny from (values (1000, 1000), (1001, 1000), (6001, 6001), (34850, 2324)) t(nx, ny)),
e as (select *, cast(case when nx * ny <= 1000000 then 1 else ceil(sqrt(nx * ny / 1000000::double)) end as bigint) as estimate from b)
select nx, ny, estimate, (select min(estimate * m) from (values (1), (2), (4), (8)) t(m) where ((nx - 1) // (estimate * m) + 1) * ((ny - 1) // (estimate * m) + 1) <= 1000000) as stride from e""",
    "nearest_date_fallback": f"""with {CUBE}, b as (select min(date) as e, max(date) as l from cube), a as (select cast(g as date) as asked from (select unnest(generate_series(timestamp '2023-12-20', timestamp '2024-02-10', interval 1 day)) as g)),
f as (select asked, case when abs(asked - e) <= abs(l - asked) then e else l end as fallback from a, b)
select asked, fallback, abs(fallback - asked) as away, abs(fallback - asked) <= 7 and fallback <> asked as usable from f""",
    "field_list_parse": "with v as (select k, list_filter(list_transform(string_split(s, ','), lambda x: trim(x)), lambda x: x <> '') as l from (values (1, 'sst'), (2, ' sst , sst_anomaly '), (3, ' , '), (4, 'sst,sst,,sea_ice'), (5, '')) t(k, s)) select k, array_to_string(l, '|') as fields, cast(len(l) as bigint) as n from v",
    "available_range_parse": r"with v as (select k, regexp_extract_all(s, '\d{4}-\d{2}-\d{2}') as l from (values (1, 'Data not exist; available range is 2024-01-01/2024-01-30.'), (2, 'Requested 2025-05-05; range 2024-02-02/2024-01-01'), (3, 'none'), (4, 'only 2024-01-01')) t(k, s)) select k, case when len(l) >= 2 then least(l[-2], l[-1]) end as earliest, case when len(l) >= 2 then greatest(l[-2], l[-1]) end as latest from v",
    "kelvin_to_celsius": f"with {CUBE} select date, lat_idx, lon_idx, cast(cast(cast(cast(sst as double) + 273.15::double as float) as double) - 273.15::double as float) as sst, sst_anomaly, sea_ice from cube",
    "granule_date_parse": "select * from (values (0, date '2024-01-05'), (1, null), (2, null), (3, null), (4, null)) t(k, date)",
    "backfill_pending": f"with {CUBE} select cast(g as date) as date from (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-02-05', interval 1 day)) as g) where cast(g as date) not in (select date from cube)",
    "backfill_existing": f"with {CUBE} select distinct date from cube where date between date '2024-01-05' and date '2024-01-16'",
    "retention_candidates": "select concat('granule-', o_orderkey) as path from orders where cast(o_orderdate as date) < date '1995-12-02'",
    "verify_parity": f"{PARITY} select field, count(*) as compared, round(max(diff), 4) as max_diff, count(*) filter (diff > 1e-5) as mismatches from x group by field",
    "verify_top_mismatches": f"{PARITY} select field, rank, round(diff, 4) as diff from (select field, diff, row_number() over (partition by field order by diff desc, date, lat_idx, lon_idx) as rank from x where diff > 1e-5) where rank <= 5",
    "tide_highs_lows": f"with {EXTREMA} select user_id, local_date, ts, phen, round_even(height_cm, 2) as height_cm from ext",
    "tide_state": f"{STATES} select event_id, case when pe[1] = 'LOW' then 'rising' else 'falling' end as state_now, pe[2] as last_height, ne[2] as next_height from b where pe[1] <> ne[1]",
    "tide_countdown": f"{STATES} select event_id, {HMS.format(s='(epoch_us(t0) - epoch_us(pts)) // 1000000')} as since_extreme, {HMS.format(s='(epoch_us(nts) - epoch_us(t0)) // 1000000')} as until_extreme from b where pe[1] <> ne[1]",
    "sun_first_events": "select user_id, cast(ts as date) as local_date, min(case when event_type = 'signup' then ts end) as rise, min(case when event_type = 'view' then ts end) as set from events group by 1, 2",
    "tz_offset_at_noon": "select zone, day, minutes::bigint as minutes, utc_offset from (values ('Asia/Taipei', date '2024-01-15', 480, '+08:00'), ('Asia/Taipei', date '2024-07-15', 480, '+08:00'), ('America/New_York', date '2024-01-15', -300, '-05:00'), ('America/New_York', date '2024-07-15', -240, '-04:00'), ('Europe/London', date '2024-01-15', 0, '+00:00'), ('Europe/London', date '2024-07-15', 60, '+01:00'), ('Australia/Adelaide', date '2024-01-15', 630, '+10:30'), ('Australia/Adelaide', date '2024-07-15', 570, '+09:30'), ('UTC', date '2024-01-15', 0, '+00:00'), ('UTC', date '2024-07-15', 0, '+00:00')) t(zone, day, minutes, utc_offset)",
    "tz_numeric_parse": "select k, minutes::bigint as minutes, utc_offset from (values (0, 480, '+08:00'), (1, 480, '+08:00'), (2, -330, '-05:30'), (3, 345, '+05:45'), (4, -30, '-00:30'), (5, null, null), (6, null, null), (7, null, null), (8, 1439, '+23:59'), (9, null, null)) t(k, minutes, utc_offset)",
    "tide_messages": f"select k, n::bigint as n, messages from (values (1, 1, '{NOTE}'), (2, 2, '{SKY} | {NOTE}'), (3, 2, '{ZONE} | {NOTE}'), (4, 3, '{ZONE} | {SKY} | {NOTE}')) t(k, n, messages)",
    "tide_document": "select date '2024-08-19' as date, '+10:00' as timezone, 'Australia/Brisbane' as tz_name, 2::bigint as highs, 1::bigint as lows, '2024-08-19T06:27:00+10:00' as sun_rise, '2024-08-19T23:14:00+10:00' as moon_transit, 'Waxing Gibbous' as phase, 'falling' as state_now, '02:47:55' as since_extreme, '03:05:50' as until_extreme",
    "tile_layout": f"with {CUBE} select lat_idx, lon_idx, sst from cube where date = {DAY}",
    "bench_mean_by_day": "with c as (select cast(l_shipdate as date) as date, cast(l_partkey % 64 as int) as lat_idx, cast(l_suppkey % 64 as int) as lon_idx, cast(max(l_quantity) as float) as sst from lineitem group by 1, 2, 3) select date, round(avg(cast(sst as double)), 6) as sst, count(*) as cells from c where lat_idx between 8 and 40 and lon_idx between 4 and 50 group by date",
    "stored_cells": f"with {KEL} select date, lat_idx, lon_idx, sst, sst_anomaly, sea_ice from kel",
    "stored_box": STORED_BOX,
    "stored_point": f"with {KEL} select cast(lon as double) as lon, cast(lat as double) as lat, date, cast(sst as double) as sst from kel where lon_idx = 2 and lat_idx = 1 and date between date '2024-01-05' and date '2024-01-16'",
    "stored_mean": f"with {KEL} select date, round(avg(cast(sst_anomaly as double)), 6) as sst_anomaly from kel where date = {DAY} and lat_idx <= 2 group by date",
    "stored_days": f"with {CUBE} select distinct date from cube",
    "stored_index": f"with {CUBE}, b as (select min(date) as e, max(date) as l from cube) select cast(k as int) as k, e as earliest, case k when 2 then date '2024-03-01' else l end as latest from b, (values (1), (2), (3)) t(k)",
    "stored_attributes": "select name, units, 'lat,lon' as dims, 'fixtures' as source from (values ('sst', 'degrees Celsius'), ('sst_anomaly', 'degrees Celsius'), ('sea_ice', 'fraction, 0 to 1'), ('lon', 'degrees east'), ('lat', 'degrees north')) t(name, units)",
    "ingest_verdict": f"with {CUBE}, n as (select count(distinct date) as days, count(sst) as a, count(sst_anomaly) as b, count(sea_ice) as c from cube) select field, compared, 0::bigint as mismatches, 'PASS' as said, 'PASS' as all, days from (select 'sst' as field, a as compared, days from n union all select 'sst_anomaly', b, days from n union all select 'sea_ice', c, days from n)",
    "ingest_again": f"with {CUBE} select date, lat_idx, lon_idx, case when date <= date '2024-01-10' then sst_anomaly else cast(sst_anomaly + 1 as float) end as sst_anomaly, case when date <= date '2024-01-10' then sea_ice end as sea_ice from cube",
    "ingest_stream": f"with {CUBE} select date, count(*) as cells, count(sst) as values from cube group by date",
    "daily_runs": "select * from (values (0, 'PASS'), (1, 'EXISTS'), (2, 'LOCKED'), (3, 'True False'), (4, 'BadRequest')) t(k, said)",
    "zarr_cells": f"with {KEL} select date, lat_idx, lon_idx, sst, sst_anomaly, sea_ice from kel where date between date '2024-01-08' and date '2024-01-10'",
    "zarr_box": STORED_BOX,
    "json_round_trip": rounded("sst sea_ice", f"date = {DAY} and lat_idx <= 2"),
    "refusals": f"""with {CUBE}, b as (select min(date) as e, max(date) as l from cube), t(k, kind, status, message) as (values
  (0, 'BadRequest', 400, 'Invalid date format. Use YYYY-MM-DD.'), (1, 'BadRequest', 400, 'Invalid date format. Use YYYY-MM-DD.'),
  (2, 'BadRequest', 400, 'Unsupported field(s): salt. Allowed: sst,sst_anomaly,sea_ice'), (3, 'BadRequest', 400, 'Unsupported mode(s): raw. Allowed: truncate'),
  (4, 'BadRequest', 400, 'Parameter ''sample'' is only supported in BBox mode.'), (5, 'BadRequest', 400, 'Parameter ''sample'' must be >= 1.'),
  (6, 'BadRequest', 400, 'Too many points (15). Increase ''sample'' or shrink bbox (limit 3).'), (7, 'Unavailable', 503, 'No available dates.'),
  (8, 'ToolError', 422, 'Longitude 181.0 out of bounds [-180, 180].'), (9, 'ToolError', 422, 'Latitude 91.0 out of bounds [-90, 90].'), (10, 'ToolError', 422, 'Invalid date (expected YYYY-MM-DD): today'),
  (11, 'ToolError', 422, 'Unsupported field ''sea_ice''. Allowed: [''sst'', ''sst_anomaly'']'), (12, 'ToolError', 422, 'Unsupported method ''closest''. Allowed: [''exact'', ''nearest''].'),
  (13, 'ToolError', 422, 'bbox must cover a non-zero area.'), (14, 'ToolError', 422, 'bbox must contain exactly four numbers: [lon0, lat0, lon1, lat1].'),
  (15, 'NotFound', 404, 'No data for 2025-01-01; nearest available date <l> is <n> days away (tolerance 7 days).'), (16, 'BadRequest', 400, 'Coordinates must be numbers.'),
  (17, 'BadRequest', 400, 'START_DATE must be <= END_DATE'), (18, '', 200, ''))
select k, kind, status, replace(replace(message, '<l>', cast(l as varchar)), '<n>', cast(date '2025-01-01' - l as varchar)) as message from t, b""",
    "box_mean_of_infinite_values": "select * from (values (0, true), (1, false)) t(k, fine)",
    "zone_inputs": """select * from (values (0, '+08:00', null, false, null), (1, '+08:00', null, false, null), (2, '-05:30', null, false, null), (3, '+08:00', 'Asia/Taipei', false, null), (4, '+01:00', 'Europe/London', false, null),
  (5, '+00:00', 'utc', false, null), (6, '+00:00', null, true, null), (7, null, null, null, 'Invalid timezone ''+0800''.'), (8, null, null, null, 'Unknown timezone ''Nope/Zone''.'), (9, null, null, null, 'Invalid timezone ''24''.'),
  (10, null, null, null, 'timezone (tz) required (use IANA name or numeric offset)')) t(k, utc_offset, name, unchosen, message)""",
    "settings": "select * from (values ('point_limit', '5'), ('degrees_per_cell', '0.25'), ('max_days', '31'), ('nearest_days', '7'), ('tile', '1024'), ('error', '422 Invalid int value for PELAGIA_MAX_DAYS: many')) t(name, value)",
    "fetch_retries": "select k, tries, paused::double as paused, text, kind, status from (values (0, 3, 2.25, 'fine', '', 200), (1, 3, 2.25, null, 'ToolError', 422), (2, 1, 0, null, 'NotFound', 404), (3, 1, 0, null, 'ToolError', 400), (4, 1, 0, 'fine', '', 200)) t(k, tries, paused, text, kind, status)",
}
