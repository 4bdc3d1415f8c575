"""WARC archives: write captures, read records back, and assemble each capture's transaction."""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise, table

REVISIT_FROM_BYTES = 1000
#: A hot payload's copies are joined with its response in this many parts.
SALTS = 32
END = "\r\n"
#: Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ANCHORS = ("response", "revisit", "resource")

RECORD_SCHEMA = """record_id string, record_type string, target_uri string, concurrent_to array<string>,
    refers_to string, fields string, payload_bytes long, payload_digest string, payload binary"""


def _uuid(*parts) -> F.Column:
    """A record identifier made from a digest of ``parts``: a retried task writes the same one."""
    d = F.sha2(F.concat_ws("\x01", *parts), 256)
    cuts = [F.substring(d, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cuts))


def plan_records(pages: DataFrame, revisit_from: int = REVISIT_FROM_BYTES) -> DataFrame:
    """Decide for each page whether its record is a response or a revisit, and give identifiers.

    Of equal payloads of at least ``revisit_from`` bytes the largest page_id is the response. A null
    html is an empty payload. Rows that repeat a page_id each get a record; those that equal the
    response's row are responses too. Columns other than page_id, url and html are ignored.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    key = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("null:"), F.xxhash64("url", "html").cast("string")))
    keyed = pages.select(F.col("page_id").cast("long"), "url", "html", key.alias("page_key"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    slim = keyed.where(F.col("bytes") >= revisit_from).select("page_key", "page_id", "digest")
    first = slim.groupBy("digest").agg(F.max("page_id").alias("origin"), F.count("*").alias("copies")).where("copies > 1 and origin is not null")
    first = first.select("digest", "origin", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    slim = slim.select("*", F.pmod(F.xxhash64("page_key"), F.lit(SALTS)).cast("int").alias("salt"))
    origin = slim.join(first, ["digest", "salt"]).select("page_key", "digest", "origin").distinct()
    out = keyed.join(origin, ["page_key", "digest"], "left")
    nth = F.expr("row_number() over (partition by page_key, digest order by url)")
    out = out.select("*", nth.alias("nth")).withColumn("revisit", F.coalesce(F.col("origin") != F.col("page_id"), F.col("origin").isNotNull()))
    # The response's own row is the first with its page_key and digest; its identifier needs no position.
    own = _uuid(F.lit("response"), F.coalesce("origin", F.col("page_key")).cast("string"), F.col("digest"), F.when(F.col("origin").isNull(), F.col("nth")).otherwise(0).cast("string"))
    return out.select(
        "page_id", "page_key", "url", "html", "digest", "bytes", "revisit",
        F.when(F.col("revisit"), own).alias("refers_to"),
        F.when(F.col("origin").isNull(), own)
        .when(F.col("revisit"), _uuid(F.lit("revisit"), F.col("page_key"), F.col("digest"), F.col("nth").cast("string")))
        .otherwise(F.when(F.col("nth") == 1, own).otherwise(_uuid(F.lit("again"), F.col("page_key"), F.col("digest"), F.col("nth").cast("string"))))
        .alias("record_id"),
        F.col("nth").cast("string").alias("nth"),
    )


def _record(kind, record_id, uri, mime, block, *more) -> F.Column:
    lines = [F.lit(VERSION), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: <"), record_id, F.lit(">"))]
    lines += [F.lit("WARC-Date: 1970-01-01T00:00:00Z"), F.concat(F.lit("WARC-Target-URI: "), uri), *more, F.lit(f"Content-Type: {mime}")]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(F.encode(block, "UTF-8")).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END * 2), block)


def write_warc(planned: DataFrame, path: str, records_per_file: int = 1500) -> None:
    """Write a request, a response or revisit, and a metadata record for each planned page.

    Spark's text writer ends each record with the blank lines the standard asks for, so every part
    is a gzip-compressed WARC file of at most ``records_per_file`` records.
    """
    uri = F.regexp_replace("url", r"[\x00-\x20]", "%20")  # null: the line is left out
    link = F.concat(F.lit("WARC-Concurrent-To: <"), F.col("record_id"), F.lit(">"))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=UTF-8{END}Content-Length: "), F.col("bytes").cast("string"), F.lit(END * 2))
    kind = F.when(F.col("revisit"), "revisit").otherwise("response")
    refers = F.when(F.col("revisit"), F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: <"), F.col("refers_to"), F.lit(">")))
    response = _record(kind, F.col("record_id"), uri, "application/http; msgtype=response",
                       F.when(F.col("revisit"), head).otherwise(F.concat(head, F.coalesce("html", F.lit("")))),
                       F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")), refers)
    ask = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{END}Accept: text/html{END * 2}"))
    request = _record(F.lit("request"), _uuid(F.lit("request"), "record_id"), uri, "application/http; msgtype=request", ask, link)
    about = F.concat_ws(END, F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.lit("via: crawl"))
    meta = _record(F.lit("metadata"), _uuid(F.lit("metadata"), "record_id"), uri, "application/warc-fields", about, link)
    out = planned.select(F.explode(F.array(request, response, meta)).alias("value"))
    out.write.option("lineSep", END * 2).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(data: bytes, with_payload: bool) -> Iterator[dict]:
    """The records of one archive, compressed as a whole, record by record or not at all."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        named = [(k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:])]
        one = dict(named)
        start = stop + 4
        at = start + int(one["content-length"])
        if at > len(data):
            raise ValueError("the last record is cut off")
        block, kind = data[start:at], one.get("warc-type")
        http = one.get("content-type", "").startswith("application/http")
        body = block.partition(b"\r\n\r\n")[2] if http else block
        stored = kind in ("response", "resource")
        yield {
            "record_id": one.get("warc-record-id", "").strip("<>"), "record_type": kind, "target_uri": one.get("warc-target-uri"),
            "concurrent_to": [v.strip("<>") for k, v in named if k == "warc-concurrent-to"], "refers_to": one["warc-refers-to"].strip("<>") if "warc-refers-to" in one else None,
            "fields": None if stored else block.decode("utf-8", "replace"),
            "payload_bytes": len(body) if stored else None, "payload_digest": hashlib.sha1(body).hexdigest() if stored else None, "payload": body if stored and with_payload else None,
        }


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``; digests are computed from what was read."""

    def parse(batches):
        for frame in batches:
            for data in frame["content"]:
                rows = list(parse_records(data, with_payload))
                if rows:
                    yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(parse, RECORD_SCHEMA)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, requests, metadata.

    A response, revisit or resource record anchors a capture. Requests and metadata belong to the
    anchors they name in WARC-Concurrent-To, or that name them. Records of other types take no part.
    A record whose target is missing comes back under the name of that target with a null response;
    one without any link, under its own identifier.
    """
    body = F.struct("record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload")
    anchors = records.where(F.col("record_type").isin(*ANCHORS))
    others = records.where(F.col("record_type").isin("request", "metadata"))
    side = F.struct("record_id", "target_uri", "fields")
    named = others.select(F.explode_outer("concurrent_to").alias("capture_id"), "record_id", "record_type", side.alias("side"))
    back = anchors.select(F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id"))
    known = others.select("record_id", "record_type", side.alias("side")).join(back, "record_id").select("capture_id", "record_type", "side")
    loose = named.where("capture_id is null").join(back, "record_id", "left_anti").select(F.col("record_id").alias("capture_id"), "record_type", "side")
    links = named.where("capture_id is not null").select("capture_id", "record_type", "side").union(known).union(loose)
    both = anchors.select(F.col("record_id").alias("capture_id"), body.alias("response"), F.lit(None).cast("string").alias("record_type"), F.lit(None).cast("struct<record_id:string,target_uri:string,fields:string>").alias("side"))
    both = both.unionByName(links, allowMissingColumns=True)
    gathered = lambda kind: F.array_sort(F.collect_set(F.when(F.col("record_type") == kind, F.col("side"))))
    return both.groupBy("capture_id").agg(F.first("response", ignorenulls=True).alias("response"), gathered("request").alias("requests"), gathered("metadata").alias("metadata"))


def page_captures(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` as archives under ``path``, read them, and describe each page's record.

    A revisit whose response isn't in the archives stays, with null for what the response would tell.
    A null html is an empty payload, a null page_id stays null; rows that repeat a page each come back;
    no pages give no rows. A long html makes one long record, which a task holds whole.
    """
    spark = pages.sparkSession
    write_warc(plan_records(pages), path)
    # Of a metadata record's fields only the page's identifier is asked for, so only that moves.
    found = F.regexp_extract("fields", r"pageId: (-?\d+)", 1)
    named = F.when((F.col("record_type") == "metadata") & (found != ""), found)
    slim = read_warc(spark, path, with_payload=False).withColumns({"fields": named, "target_uri": F.lit(None).cast("string")})
    captures = assemble_transactions(materialise(slim, "warc-records"))  # parsed once
    rows = captures.select(
        F.col("metadata")[0]["fields"].cast("long").alias("page_id"), "capture_id", F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to").alias("target"), F.col("response.payload_bytes").alias("own_bytes"), F.col("response.payload_digest").alias("own_digest"),
        F.size("requests").cast("long").alias("n_requests"),
    )
    rows = materialise(rows, "warc-captures")
    stored = rows.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"), "own_bytes", "own_digest")
    again = rows.where("record_type = 'revisit'").drop("own_bytes", "own_digest")
    # Only responses that are revisited, in SALTS parts each, so that a hot one's revisits spread.
    stored = stored.join(again.select("target").distinct(), "target", "left_semi").select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    again = again.withColumn("salt", F.pmod(F.xxhash64("capture_id"), F.lit(SALTS)).cast("int")).join(stored, ["target", "salt"], "left")
    first = rows.where("record_type = 'response'").select("page_id", "record_type", F.lit(None).cast("long").alias("refers_to"), "own_bytes", "own_digest", "n_requests")
    out = first.unionByName(again.select(*first.columns))
    return out.select("page_id", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", "refers_to", "n_requests")


def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of every row of pages, as page_captures defines it."""
    return page_captures(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
q as (select page_id, octet_length(body)::bigint as payload_bytes, sha1(body) as payload_digest from p),
m as (select *, max(page_id) over (partition by payload_digest) as top from q)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 1000 and page_id <> top then top end as refers_to,
       1::bigint as n_requests
from m
"""
