"""Tide documents and states, row by row with array functions; no shuffle.

``day_of`` reads a document; ``bracket`` is the as-of search both ways; ``states`` answers many instants against a table of extrema.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import duration, height, local_date, tide_messages, timestamp

EVENT = "struct<phen:string,time:string>"
SCHEMA = (
    "meta struct<lon:double,lat:double,timezone:string,reference:string,status:string,tide_status:string>, "
    "days array<struct<local_date:string,moonphase:struct<closestphase:struct<time:string,phase:string>,curphase:string,fracillum:string>,"
    f"moon:array<{EVENT}>,sun:array<{EVENT}>,tide:array<struct<phen:string,time:string,height:string,height_cm:string>>>>"
)
#: Sky phenomena in lower case, and what they are called in a summary.
PHENOMENA = {"rise": "rise", "set": "set", "upper transit": "transit", "begin civil twilight": "begin_civil_twilight", "end civil twilight": "end_civil_twilight"}


def chosen_day(days: Column, date: Column) -> Column:
    """The day whose date, in its own offset, is ``date``; else the first."""
    return F.coalesce(F.get(F.filter(days, lambda d: local_date(d["local_date"]) == date), F.lit(0)), F.get(days, F.lit(0)))


def tide_entries(day: Column) -> Column:
    """time, height_cm and phen of each entry, in order."""
    entry = lambda e: F.struct(e["time"].alias("time"), height(e["height_cm"], e["height"]).alias("height_cm"), e["phen"].alias("phen"))
    return F.transform(F.coalesce(day["tide"], F.array().cast("array<struct<phen:string,time:string,height:string,height_cm:string>>")), entry)


def of_kind(entries: Column, kind: str) -> Column:
    return F.transform(F.filter(entries, lambda e: e["phen"] == kind), lambda e: F.struct(e["time"].alias("time"), e["height_cm"].alias("height_cm")))


def sky(events: Column) -> Column:
    """The first time of each phenomenon; null if there are no events."""
    first = lambda name: F.get(F.filter(events, lambda e: F.lower(e["phen"]) == name), F.lit(0))["time"]
    return F.when(F.size(events) > 0, F.struct(*(first(k).alias(v) for k, v in PHENOMENA.items())))


def bracket(events: Column, at: Column) -> Column:
    """Of (ts, pos, phen, time, height_cm) structs the last one at or before ``at`` and the first one after it; ties in time go by position."""
    return F.struct(F.array_max(F.filter(events, lambda e: e["ts"] <= at)).alias("last"), F.array_min(F.filter(events, lambda e: e["ts"] > at)).alias("next"))


def state(last: Column, next_: Column, at: Column) -> Column:
    """The tide's state between two extrema of different kinds, else null."""
    name = F.when((last["phen"] == "LOW") & (next_["phen"] == "HIGH"), "rising").when((last["phen"] == "HIGH") & (next_["phen"] == "LOW"), "falling")
    extreme = lambda e: F.struct(e["phen"].alias("type"), e["time"].alias("time"), e["height_cm"].alias("height_cm"))
    span = lambda a, b: duration(F.timestamp_diff("SECOND", a, b))
    return F.when(name.isNotNull(), F.struct(name.alias("state_now"), span(last["ts"], at).alias("since_extreme"), span(at, next_["ts"]).alias("until_extreme"), extreme(last).alias("last_extreme"), extreme(next_).alias("next_extreme")))


def forecast(documents: DataFrame, document: str = "document") -> DataFrame:
    """Answers for rows with lon, lat, date, query_time (ISO with an offset, or null), query_date (its local date), offset, tz_name, zone_note and a JSON document.

    Columns: region, date, timezone, tz_name, reference, sun, moon, moonphase, tide, messages, backend; parts that are absent are null. A document without
    days gives a null date."""
    p = documents.withColumn("p", F.from_json(document, SCHEMA)).withColumn("day", chosen_day(F.col("p.days"), F.col("date")))
    p = p.withColumn("used", F.coalesce(local_date("day.local_date"), "date")).withColumn("entries", tide_entries(F.col("day"))).withColumn("at", timestamp("query_time"))
    timed = F.filter(
        F.transform(F.col("entries"), lambda e, i: F.struct(timestamp(e["time"]).alias("ts"), i.alias("pos"), e["phen"].alias("phen"), e["time"].alias("time"), e["height_cm"].alias("height_cm"))), lambda e: e["ts"].isNotNull()
    )
    p = p.withColumn("b", bracket(timed, F.col("at")))
    now = F.when(F.col("query_date") == F.col("used"), state(F.col("b.last"), F.col("b.next"), F.col("at")))
    moonphase = F.when(F.col("day.moonphase").isNotNull(), F.struct(F.col("day.moonphase.curphase").alias("current"), F.col("day.moonphase.fracillum").alias("illumination"), F.struct(F.col("day.moonphase.closestphase.time").alias("time"), F.col("day.moonphase.closestphase.phase").alias("phase")).alias("closest")))
    status = F.coalesce("p.meta.status", F.lit(""))
    return p.select(
        F.array("lon", "lat").alias("region"),
        F.when(F.size("p.days") > 0, F.col("used")).alias("date"),
        F.coalesce(F.nullif("p.meta.timezone", F.lit("")), "offset").alias("timezone"),
        "tz_name",
        F.col("p.meta.reference").alias("reference"),
        sky(F.col("day.sun")).alias("sun"),
        sky(F.col("day.moon")).alias("moon"),
        moonphase.alias("moonphase"),
        F.struct(of_kind(F.col("entries"), "HIGH").alias("highs"), of_kind(F.col("entries"), "LOW").alias("lows"), now.alias("state")).alias("tide"),
        tide_messages(status, F.col("zone_note")).alias("messages"),
        F.struct(status.alias("usno_status"), F.coalesce("p.meta.tide_status", F.lit("OK")).alias("tide_api_status")).alias("backend"),
    )


def states(queries: DataFrame, extrema: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """``queries`` with the state at their instant: the extrema of a station and day (some a day) are one array, joined by key, and bracketed in the row.

    extrema: keys, ts, phen and height_cm. Queries without a bracket, or between extrema of one kind, get null."""
    e = extrema.groupBy(*keys).agg(F.collect_list(F.struct(F.col("ts").alias("ts"), F.lit(0).alias("pos"), "phen", F.col("ts").cast("string").alias("time"), "height_cm")).alias("events"))
    found = queries.join(e, keys, "left").withColumn("b", bracket(F.col("events"), F.col(ts)))
    return found.withColumn("state", state(F.col("b.last"), F.col("b.next"), F.col(ts))).drop("events", "b")
