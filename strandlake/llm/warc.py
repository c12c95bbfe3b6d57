"""WARC captures: resolution of not-modified revisits, and record files.

A capture is a row ``(record_id, kind, url, at, etag, last_modified, headers, payload_digest, payload_length)``; kind is
``response`` for a full response and ``revisit`` for a server that said "not modified".

Resolution is an as-of join by canonical URL: a revisit belongs to the latest full response of
that URL captured earlier (of equal times the one with the larger id; a response of the same
instant isn't earlier).  Its validators must then agree: the entity tags if both records have
one (weak comparison), else the modification dates if both have one.  A revisit whose
validators differ, or that has none in common, is reported as such and not merged.  A resolved
record takes the response's headers, except those that a not-modified answer may renew
(``PERMITTED``), which come from the revisit where it has them.

The as-of join sorts narrow rows only (no payload).  A URL's captures are cut by time into
slices of ``SLICE``, so that a hot URL is many groups: inside a slice a window carries the last
response forward, and the last response of every slice is carried on over the slices, a table
with one row per URL and slice.

Defined results: a null URL matches nothing, a null time is before all others (so that such a
revisit is unresolved, and such a response is earlier than any dated revisit); repeated records
are resolved each; an empty table gives an empty result.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "set-cookie", "vary", "warning")
SLICE = "day"
#: Query parameters that name a campaign or a referrer, not a page.
TRACKING = "utm_[a-z_]*|gclid|fbclid|ref"


def canonical_url(url: Column) -> Column:
    """Scheme and www. dropped, host in lower case without default port, no fragment, no tracking
    parameters, the other parameters sorted, no trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, "^[^?]*[?](.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merge_headers(old: Column, new: Column) -> Column:
    """The response's headers, with those permitted to be renewed from the revisit; both map<string,string>."""
    old, new = F.coalesce(old, F.create_map().cast("map<string,string>")), F.coalesce(new, F.create_map().cast("map<string,string>"))
    renewed = F.map_filter(new, lambda k, v: F.lower(k).isin(*PERMITTED))
    names = F.transform(F.map_keys(renewed), lambda k: F.lower(k))
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(names, F.lower(k))), renewed)


def resolve(captures: DataFrame) -> DataFrame:
    """Every revisit with ``resolved_id``, ``status`` and, if resolved, merged ``headers`` and the payload's digest.

    status: ``resolved``, ``validator_mismatch``, ``no_validator`` or ``no_response``.
    """
    c = captures.withColumn("key", canonical_url(F.col("url"))).withColumn("slot", F.date_trunc(SLICE, "at"))
    full = F.when(F.col("kind") == "response", F.struct(F.col("at").alias("t"), F.col("record_id").alias("id")))
    # revisits come before responses of the same instant, which aren't earlier
    order = [F.col("at").asc_nulls_first(), (F.col("kind") == "response").asc(), F.col("record_id")]
    inside = Window.partitionBy("key", "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    narrow = c.select("record_id", "kind", "key", "slot", "at", full.alias("full"))
    seen = narrow.withColumn("last", F.max("full").over(inside))
    ends = narrow.groupBy("key", "slot").agg(F.max("full").alias("end"))
    before = Window.partitionBy("key").orderBy(F.col("slot").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("carried", F.max("end").over(before)).where("carried is not null").select(F.col("key").alias("_key"), F.col("slot").alias("_slot"), "carried")
    found = seen.where("kind = 'revisit'").join(ends, (F.col("key") == F.col("_key")) & F.col("slot").eqNullSafe(F.col("_slot")), "left")
    found = found.select("record_id", F.when(F.col("key").isNotNull(), F.coalesce("last", "carried"))["id"].alias("response_id")).distinct()
    revisits = c.where("kind = 'revisit'").drop("slot").join(found, "record_id")
    old = captures.where("kind = 'response'").select(
        F.col("record_id").alias("response_id"), F.col("etag").alias("old_etag"), F.col("last_modified").alias("old_modified"), F.col("headers").alias("old_headers"),
        F.col("payload_digest").alias("old_digest"), F.col("payload_length").alias("old_length"),
    ).dropDuplicates(["response_id"])
    j = revisits.join(old, "response_id", "left")
    tags = F.col("etag").isNotNull() & F.col("old_etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("old_modified").isNotNull()
    same = F.when(tags, _weak(F.col("etag")) == _weak(F.col("old_etag"))).when(dates, F.col("last_modified") == F.col("old_modified"))
    status = F.when(F.col("response_id").isNull(), "no_response").when(same.isNull(), "no_validator").when(same, "resolved").otherwise("validator_mismatch")
    j = j.withColumn("status", status)
    ok = F.col("status") == "resolved"
    return j.select(
        "record_id", "url", F.col("key").alias("canonical_url"), "at", "response_id", "status",
        F.when(ok, F.col("response_id")).alias("resolved_id"), F.when(ok, merge_headers(F.col("old_headers"), F.col("headers"))).alias("headers"),
        F.when(ok, F.col("old_digest")).alias("payload_digest"), F.when(ok, F.col("old_length")).alias("payload_length"),
    )


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """Two captures of every page: a full response, and a revisit 36 hours later with the page's own tag.

    Capture times follow the page ids, a minute apart, so that pages whose URLs have one canonical
    form interleave: a revisit may meet a later page's response, and then its tag differs.
    """
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 60)
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    base = pages.select("page_id", "url", at.alias("at"), tag.alias("etag"), F.md5(F.coalesce("html", F.lit(""))).alias("digest"), F.length(F.coalesce("html", F.lit(""))).cast("long").alias("n"))
    full = base.select(
        (2 * F.col("page_id")).alias("record_id"), F.lit("response").alias("kind"), "url", "at", "etag", F.lit(None).cast("timestamp").alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.lit("ETag"), F.col("etag")).alias("headers"),
        F.col("digest").alias("payload_digest"), F.col("n").alias("payload_length"),
    )
    later = F.col("at") + F.expr("INTERVAL 36 HOURS")
    again = base.select(
        (2 * F.col("page_id") + 1).alias("record_id"), F.lit("revisit").alias("kind"), "url", later.alias("at"), F.concat(F.lit("W/"), "etag").alias("etag"), F.lit(None).cast("timestamp").alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("none"), F.lit("Date"), F.date_format(later, "yyyy-MM-dd HH:mm:ss")).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"), F.lit(None).cast("long").alias("payload_length"),
    )
    return full.unionByName(again)


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve(captures_of_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    h = F.col("headers")
    return out.select("record_id", "canonical_url", "response_id", "status", "resolved_id", "payload_digest", "payload_length", h["Content-Type"].alias("content_type"), h["Date"].alias("date"), h["ETag"].alias("etag"))


OP9_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
u AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare,
        to_timestamp(1704067200 + page_id * 60) AT TIME ZONE 'UTC' AS ts FROM p),
v AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*[?](.*)$', 1), '&'),
          lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z_]*|gclid|fbclid|ref)(?:=|$)'))) AS params FROM u),
c AS (SELECT page_id, ts, '"' || substr(md5(html), 1, 16) || '"' AS tag, html,
        regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www[.]', '')
        || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
        || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canon FROM v),
j AS (SELECT r.page_id, r.canon, r.tag, r.ts + INTERVAL 36 HOUR AS later, f.page_id AS found, f.tag AS old_tag, f.html AS html
      FROM c r ASOF LEFT JOIN c f ON r.canon = f.canon AND r.ts + INTERVAL 36 HOUR > f.ts)
SELECT 2 * page_id + 1 AS record_id, canon AS canonical_url, 2 * found AS response_id,
  CASE WHEN found IS NULL THEN 'no_response' WHEN tag = old_tag THEN 'resolved' ELSE 'validator_mismatch' END AS status,
  CASE WHEN tag = old_tag THEN 2 * found END AS resolved_id,
  CASE WHEN tag = old_tag THEN md5(html) END AS payload_digest,
  CASE WHEN tag = old_tag THEN CAST(length(html) AS BIGINT) END AS payload_length,
  CASE WHEN tag = old_tag THEN 'text/html' END AS content_type,
  CASE WHEN tag = old_tag THEN strftime(later, '%Y-%m-%d %H:%M:%S') END AS date,
  CASE WHEN tag = old_tag THEN old_tag END AS etag
FROM j
"""


# Record files ------------------------------------------------------------------------------

RECORD = "record_id string, kind string, url string, date string, headers map<string,string>, payload binary"


def _record(r: dict) -> bytes:
    head = [("WARC-Type", r["kind"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Target-URI", r["url"]), ("WARC-Date", r["date"]), *sorted((r["headers"] or {}).items())]
    payload = r["payload"] or b""
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode() for k, v in head if v is not None and "\n" not in v and "\r" not in v]
    return gzip.compress(b"\r\n".join([*lines, b"Content-Length: %d" % len(payload), b"", payload]) + b"\r\n\r\n", mtime=0)


def write_records(records: DataFrame) -> DataFrame:
    """A row ``(record_id, member)`` per record: one gzip member each, so that files are members put together.

    Header fields with line breaks are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [dict(zip(b.schema.names, (c[i].as_py() for c in b.columns))) for i in range(b.num_rows)]
            made = [_record(r | {"headers": dict(r["headers"] or {})}) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["record_id", "member"])

    return records.select("record_id", "kind", "url", "date", "headers", "payload").mapInArrow(run, "record_id string, member binary")


def parse_records(raw: bytes) -> Iterator[dict]:
    """The records of a file, gzipped by member or plain."""
    stream = io.BytesIO(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip()] = value.strip()
        payload = stream.read(int(fields.pop("Content-Length", "0")))
        own = {k: fields.pop(n, None) for k, n in (("kind", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("url", "WARC-Target-URI"), ("date", "WARC-Date"))}
        yield own | {"headers": fields, "payload": payload}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("date", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
        for b in batches:
            for raw in b.column(0).to_pylist():
                for r in parse_records(raw):
                    yield pa.RecordBatch.from_pylist([r | {"headers": list(r["headers"].items())}], kind)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)
