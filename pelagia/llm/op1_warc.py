"""WARC archives and their capture index.

Captures are written as WARC records by Spark's own text writer, whatever the file system: a record's bytes are a row, and the line feed that the writer adds ends the
record. Reading takes the lines of a file in order and puts records together by their Content-Length, so any payload comes back byte for byte; digests
are computed anew and compared.

Each file is written in the order of its URL keys and times, so it is a sorted run of captures. The index merges the runs: captures are range-partitioned by key
and time, and in each range the slices of the runs go through a loser tree. From the merged order alone come each capture's place in the whole index and in the
history of its URL key, and the capture before it.

Scale: payloads are shuffled once, to find equal ones by their digest (counts are joined by digest, which adaptive execution can split); the index moves
a few short columns. A range holds about ``RANGE`` captures, whose slices wait as Arrow batches; only the head of each run is in Python. A range ends in the middle of a key if
the key is hot, since time and id are part of the order; what a history has before a range is then summed over the ranges, a row each. An archive is one
gzip stream, so a record's offset counts the bytes of the unpacked file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, new_path, partitions, staged, table

LEAST, RANGE, HEAD = 100, 1 << 20, 256
START = "2024-01-01T00:00:00Z"


def url_key(url):
    """A sortable key: the host's labels reversed, without www, a port or a scheme, then path and query; lower-case, without a fragment. Empty for null."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@|^www\d*\.|:\d*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))


def classified(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = LEAST) -> DataFrame:
    """id, url, payload, bytes, digest, first (the smallest id of several equal payloads of at least ``least`` bytes; null for others)."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    # payloads that occur more than once, staged: then both sides of the join are plain exchanges, and a hot payload can be split
    first = rows.filter(F.col("bytes") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    return rows.join(staged(first, "payloads"), "digest", "left")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, start: str = START) -> None:
    """WARC 1.1 files, gzipped, in ``path``: a record for each row, response or revisit.

    Of rows with equal payloads of ``least`` bytes at least, the one with the smallest id is the response and the others revisit it; smaller ones are all responses. A
    repeated row with that smallest id is a response too; a null id is never the smallest unless there is no other, and then all are responses. Null payloads are
    empty; a null url gives a record without a target. The date is ``start`` and as many seconds
    as the id, by the century."""
    rows = classified(pages, id_col, url_col, payload_col, least)
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, "payload"))
    date = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(3_155_760_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = rows.withColumn("revisit", revisit).withColumn("block", block).withColumn("date", date).withColumn("key", url_key(F.col("url")))
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    field = lambda key, value: F.coalesce(F.concat(F.lit(f"{key}: "), value, F.lit("\r\n")), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        field("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", F.concat(F.lit("<urn:capture:"), name, F.lit(">"))),
        field("WARC-Date", F.col("date")),
        field("WARC-Target-URI", F.regexp_replace(F.col("url"), r"[\x00-\x20\x7f]", "%20")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("WARC-Refers-To", F.when(F.col("revisit"), F.concat(F.lit("<urn:capture:"), F.col("first").cast("string"), F.lit(">")))),
        field("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"),
        F.lit("\r\n\r\n"),
    )
    sorted_run = rows.sortWithinPartitions("key", "date", "id")
    sorted_run.select(F.concat(head, F.col("block"), F.lit("\r\n\r")).alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row for each record: file, at (its place in the file), offset and length (of its bytes in the unpacked file), id, url, date, type, refers_to, digest, bytes and payload (null for revisits, and without
    ``payloads``: then they are only measured and compared with their digests).

    Raises if a record is cut short or its payload differs from its digest. An empty folder gives an empty result. Archives are gzipped, so Spark doesn't split them; a plain one
    must be smaller than the least split."""
    least_split = int(spark._jsparkSession.sessionState().conf().filesOpenCostInBytes())
    plain = spark.read.format("binaryFile").load(path).select("path", "length").filter(~F.col("path").endswith(".gz") & (F.col("length") > least_split)).first()
    if plain:
        raise ValueError(f"{plain['path']}: an archive of over {least_split} bytes must be gzipped")
    names = ["file", "at", "offset", "length", "id", "url", "date", "type", "refers_to", "digest", "bytes", "payload"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    number = lambda x: int(x) if (x := (x or "").rpartition(":")[2].rstrip(">")).lstrip("-").isdigit() else None

    def record(file: str, at: int, offset: int, length: int, head: dict[str, str], block: bytes) -> tuple:
        if not block.endswith(b"\r\n\r"):
            raise ValueError(f"{file}: a record that begins at {at} doesn't end as it should")
        payload = block[:-3].partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else None
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"{file}: the payload of the record at {at} differs from its digest")
        return file, at, offset, length, number(head.get("warc-record-id")), head.get("warc-target-uri"), head.get("warc-date"), head["warc-type"], number(head.get("warc-refers-to")), digest, None if payload is None else len(payload), payload if payloads else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at, offset, place, head, lines, held, want, out, size = None, 0, 0, 0, {}, [], 0, None, [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(names), types, strict=True)], names=names)
        for b in batches:
            for f, line in zip(b.column("file").to_pylist(), b.column("line").to_pylist(), strict=True):
                if f != file:
                    if want is not None or head:
                        raise ValueError(f"{file}: the last record is cut short")
                    file, at, offset, place = f, 0, 0, 0  # place: of the line
                place += len(line) + 1
                if want is None:  # in a header
                    key, _, value = line.decode("utf-8", "replace").rstrip("\r").partition(":")
                    if line == b"\r":
                        lines, held, want = [], 0, int(head["content-length"]) + 3
                    else:
                        head[key.strip().lower()] = value.strip()
                    continue
                lines.append(line)
                held += len(line) + 1
                if held > want:
                    if held != want + 1:
                        raise ValueError(f"{file}: the record at {at} is longer than it says")
                    out.append(record(file, at, offset, place - offset, head, b"\n".join(lines)))
                    at, offset, head, want = at + 1, place, {}, None
                    size += held
                    if size > 1 << 22 or len(out) > 4096:
                        yield flush()
                        out, size = [], 0
        if want is not None or head:
            raise ValueError(f"{file}: the last record is cut short")
        yield flush()

    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return map_arrow(lines, run, "file string, at bigint, offset bigint, length bigint, id bigint, url string, date string, type string, refers_to bigint, digest string, bytes bigint, payload binary")


class LoserTree:
    """Merges sorted iterators: each inner node holds the loser of its match, so the next item costs one path from a leaf to the root."""

    def __init__(self, runs: list[Iterator], key):
        self.runs, self.key, self.n = runs, key, len(runs)
        self.items = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, self.n)
        for leaf in range(self.n):
            self._play(leaf, True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.items[a], self.items[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        x, y = self.key(x), self.key(y)
        return x < y or (x == y and a < b)

    def _play(self, winner: int, first: bool = False) -> None:
        at = (winner + self.n) // 2
        while at:
            other = self.losers[at]
            if other < 0:  # the first match waits for its opponent
                if first:
                    self.losers[at] = winner
                    return
            elif self._before(other, winner):
                self.losers[at], winner = winner, other
            at //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.n and self.items[w := self.losers[0]] is not None:
            yield self.items[w]
            self.items[w] = next(self.runs[w], None)
            self._play(w)


#: The columns of the index that come from the records; after them: part (range), local (place in the range), n (number in the key's history, in the range) and before (the id of the
#: capture before it in the range).
COLUMNS = "key string, date string, id bigint, url string, type string, refers_to bigint, digest string, bytes bigint, file string, at bigint, offset bigint, length bigint"
_TYPES = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}


def merged_runs(captures: DataFrame, ranges: int) -> DataFrame:
    """COLUMNS, part, local, n and before: captures in one global order of key, date, id, file and place, the order of part and local. Each file is a sorted run."""
    cols = [c.split()[0] for c in COLUMNS.split(", ")]
    schema = f"{COLUMNS}, part int, local bigint, n bigint, before bigint"
    names, types = [c.split()[0] for c in schema.split(", ")], [_TYPES[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[pa.RecordBatch]] = {}
        for b in batches:  # sorted by run, then in the run's own order
            files = b.column("file").to_pylist()
            start = 0
            for i in range(1, len(files) + 1):
                if i == len(files) or files[i] != files[start]:
                    runs.setdefault(files[start], []).append(b.slice(start, i - start))
                    start = i
        rows = lambda parts: (r for p in parts for k in range(0, p.num_rows, HEAD) for r in zip(*(c.to_pylist() for c in p.slice(k, HEAD).columns), strict=True))
        tree = LoserTree([rows(p) for _, p in sorted(runs.items())], key=lambda r: (r[0], r[1], r[2] is not None, r[2] or 0, r[8], r[9]))
        out: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        part, key, n, before = TaskContext.get().partitionId(), None, 0, None
        for local, r in enumerate(tree):
            if r[0] != key:
                key, n, before = r[0], 0, None
            n += 1
            out.append((*r, part, local, n, before))
            before = r[2]
            if len(out) == 4096:
                yield batch()
                out.clear()
        if out:
            yield batch()

    rows = captures.withColumn("key", url_key(F.col("url"))).select(*cols)
    slices = rows.repartitionByRange(ranges, "key", "date", "id", "file", "at").sortWithinPartitions("file", "at")
    return map_arrow(slices, run, schema)


def merged_index(captures: DataFrame) -> DataFrame:
    """The index: COLUMNS, position (place in the global order, from 0), capture (number in the history of the URL key, from 1) and previous (the id of the capture before it in
    that history, null for the first). ``captures`` is staged. Null urls have one key of their own."""
    ranges = max(partitions(captures.sparkSession), -(-captures.count() // RANGE))
    merged = staged(merged_runs(captures, ranges), "merged")
    # a row for each range
    edge = lambda c, f: f(F.struct("local", c)).getField(c).alias(c)
    first, last = merged.groupBy("part").agg(edge("key", F.min)), merged.groupBy("part").agg(F.count(F.lit(1)).alias("c"), *(edge(c, F.max) for c in ("key", "n", "id")))
    last = staged(last.select("part", "c", F.col("key").alias("last_key"), "n", "id").join(first, "part"), "edges")
    base = last.select("part", (F.sum("c").over(Window.orderBy("part")) - F.col("c")).alias("base"))
    # what the ranges before have of the key that a range begins with
    ends = last.select(F.col("last_key").alias("key"), "part", "n", F.struct("id").alias("end"), F.lit(0).alias("asks"))
    asks = last.select("key", "part", F.lit(0).cast("long").alias("n"), F.lit(None).cast("struct<id: bigint>").alias("end"), F.lit(1).alias("asks"))
    past = Window.partitionBy("key").orderBy("part", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    known = ends.unionByName(asks).withColumn("more", F.coalesce(F.sum("n").over(past), F.lit(0))).withColumn("end", F.last("end", ignorenulls=True).over(past))
    known = known.filter("asks = 1").select("part", F.col("key").alias("first_key"), "more", F.col("end.id").alias("earlier"))
    offsets = staged(base.join(known, "part"), "offsets")
    rows = merged.join(offsets, "part")
    continued = F.col("key") == F.col("first_key")
    return rows.select(
        *(c.split()[0] for c in COLUMNS.split(", ")),
        (F.col("base") + F.col("local")).alias("position"),
        (F.col("n") + F.when(continued, F.col("more")).otherwise(0)).alias("capture"),
        F.when(F.col("n") > 1, F.col("before")).when(continued, F.col("earlier")).alias("previous"),
    )


def resolved(captures: DataFrame) -> DataFrame:
    """Captures with the payload's bytes of revisits taken from the response they refer to."""
    response = captures.filter("type = 'response'").select(F.col("id").alias("refers_to"), "digest", F.col("bytes").alias("full")).distinct()
    done = captures.filter("type <> 'revisit'")
    again = captures.filter("type = 'revisit'").join(response, ["refers_to", "digest"], "left").withColumn("bytes", F.col("full")).select(*captures.columns)
    return done.unionByName(again)


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the contract's columns: position, capture and previous_page, from the merged index."""
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    records = staged(read_archives(spark, path, payloads=False).drop("payload"), "captures")  # the range sort reads its input twice
    done = resolved(merged_index(records))
    return done.select(
        F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "position", "capture", F.col("previous").alias("previous_page")
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, regexp_replace(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://', '') AS rest FROM pages),
k AS (
  SELECT *, array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(rest, '^([^/?#]*)', 1), '^[^@]*@|^www\d*\.|:\d*$', '', 'g'), '.')), ',')
            || ')' || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS url_key FROM p),
d AS (SELECT page_id, url_key, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM k),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN f.first IS NOT NULL AND d.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id <> f.first THEN f.first END AS refers_to,
       CAST(row_number() OVER (ORDER BY d.url_key, d.page_id) - 1 AS BIGINT) AS position,
       CAST(row_number() OVER (PARTITION BY d.url_key ORDER BY d.page_id) AS BIGINT) AS capture,
       lag(d.page_id) OVER (PARTITION BY d.url_key ORDER BY d.page_id) AS previous_page
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
"""
