"""WARC: records from files, and not-modified revisits resolved to the latest earlier full response.

Resolution is an as-of join by canonical URL: the response with the greatest (time, sequence) below the revisit's. Records are
dealt by range over (URL, time, sequence), so that a URL that holds a third of all rows is spread over many partitions. In
each partition a window carries the last response of a URL; what a partition needs from those before it is one row, the
last response before its first record, found from one row for each partition. The search carries headers, never payloads;
these are joined to what was found.

Validators: if both sides have an ETag, they must be equal (weak marks aside); otherwise, if both have Last-Modified, these;
otherwise the match is unverified. Merged headers are the response's, with those of the revisit put over them that a 304 may
change (PERMITTED).

Defined cases: null URL or time: no response is found and none is given. Equal times: the sequence decides. Repeated records:
each is resolved for itself; records that agree in time and sequence don't see each other. Header names compare in lower case. Other columns
are handed through in one struct, whatever their names; the added columns replace any of the same name. Empty tables give empty ones.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import materialize, table

#: Header fields that a 304 response updates.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "vary")
ADDED = ("resolved_seq", "revisit_status", "merged_headers", "resolved_payload")


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, default port, leading www., tracking parameters and trailing slash; the host in lower case."""
    rest = F.regexp_replace(F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://([^#]*)", 1), r"^([^/?]*?):(80|443)(?=[/?]|$)", "$1")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"(?s)\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_")))
    return F.when(url.isNull() | (host == ""), F.lit(None)).otherwise(F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(F.lit(""))))


def resolve_revisits(records: DataFrame, key: str = "url_key", time: str = "ts", seq: str = "seq", kind: str = "kind", headers: str = "headers", payload: str = "payload", partitions: int | None = None) -> DataFrame:
    """Add resolved_seq, revisit_status, merged_headers and resolved_payload to records.

    kind: `response` or `revisit`; headers: map with lower-case names. Responses resolve to themselves (status null). The status of a
    revisit is resolved, unverified, validator_mismatch or no_response; only the first two give headers and payload.
    Payloads take no part in the search: they are joined to the revisits that are resolved, by key, time and sequence.
    """
    spark = records.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = [c for c in records.columns if c not in ADDED]
    usable = F.col(key).isNotNull() & F.col(time).isNotNull()
    # own columns, apart from those that are handed through
    flat = records.select(
        F.struct(*[records[c] for c in names]).alias("given"),
        F.when(usable, F.col(key)).alias("k"),
        F.col(time).alias("t"),
        F.col(seq).alias("s"),
        F.col(kind).alias("kind"),
        F.col(headers).alias("h"),
        F.col(payload).alias("p"),
    )
    given = F.when(F.col("k").isNotNull() & (F.col("kind") == "response"), F.struct("k", "t", "s", "h"))
    dealt = materialize(flat.withColumn("r", given).repartitionByRange(n, "k", "t", "s").withColumn("part", F.spark_partition_id()))
    order = F.struct(F.col("r.k"), F.col("r.t"), F.col("r.s"))
    last = dealt.where("r is not null").groupBy("part").agg(F.max_by("r", order).alias("last"))
    every = spark.range(n).select(F.col("id").cast("int").alias("part")).join(last, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition, without payloads
    carried = every.select("part", F.last("last", ignorenulls=True).over(before).alias("c"))
    inside = Window.partitionBy("part", "k").orderBy("rank").rangeBetween(Window.unboundedPreceding, -1)
    ranked = dealt.drop("p").withColumn("rank", F.dense_rank().over(Window.partitionBy("part", "k").orderBy("t", "s")))
    found = ranked.withColumn("in", F.last("r", ignorenulls=True).over(inside)).join(F.broadcast(carried), "part", "left")
    outside = F.when((F.col("c.k") == F.col("k")) & ((F.col("c.t") < F.col("t")) | (F.col("c.s") < F.col("s"))), F.col("c"))
    found = found.withColumn("f", F.when(F.col("k").isNotNull() & (F.col("kind") == "revisit"), F.coalesce("in", outside)))
    weak = lambda m: F.regexp_replace(F.element_at(m, "etag"), "^W/", "")
    etag = weak(F.col("h")) == weak(F.col("f.h"))
    modified = F.element_at(F.col("h"), "last-modified") == F.element_at(F.col("f.h"), "last-modified")
    agreed = F.coalesce(etag, modified)
    status = F.when(~F.coalesce(F.col("kind") == "revisit", F.lit(False)), F.lit(None)).when(F.col("f").isNull(), "no_response").when(agreed.isNull(), "unverified").when(agreed, "resolved").otherwise("validator_mismatch")
    empty = F.expr("cast(map() as map<string,string>)")
    over = F.map_filter(F.coalesce("h", empty), lambda k, v: k.isin(*PERMITTED))
    base = F.map_filter(F.coalesce(F.col("f.h"), empty), lambda k, v: ~F.array_contains(F.map_keys(over), k))
    own, good = F.coalesce(F.col("kind") == "response", F.lit(False)), F.coalesce(F.col("status").isin("resolved", "unverified"), F.lit(False))
    merged = F.when(own, F.col("h")).when(good, F.map_concat(base, over))
    at = F.when(good, F.struct(F.col("f.k"), F.col("f.t"), F.col("f.s")))
    judged = materialize(found.withColumn("status", status).select("given", own.alias("own"), F.when(own, F.col("s")).when(good, F.col("f.s")).alias("seq"), "status", merged.alias("merged"), at.alias("at")))
    # of responses that agree in key, time and sequence, the greatest payload
    held = dealt.where("r is not null").groupBy("k", "t", "s").agg(F.max("p").alias("p"))
    revisits = judged.where("at is not null").join(held, (F.col("at.k") == F.col("k")) & (F.col("at.t") == F.col("t")) & (F.col("at.s").eqNullSafe(F.col("s"))), "left")
    mine = F.when(F.col("own"), F.col("given").getField(payload)).alias("p")
    whole = judged.where("at is null").select("given", "seq", "status", "merged", mine).unionByName(revisits.select("given", "seq", "status", "merged", "p"))
    return whole.select(*[F.col("given").getField(c).alias(c) for c in names], F.col("seq").alias("resolved_seq"), F.col("status").alias("revisit_status"), F.col("merged").alias("merged_headers"), F.col("p").alias("resolved_payload"))


def members(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """The gzip members of a file, or all of it if it isn't gzipped; where a member is cut or broken, what could be read of it
    and what went wrong, and on with the next one that begins after it."""
    at = 0
    if data[:2] != GZIP[:2]:
        yield data, None
        return
    while 0 <= at < len(data):
        unzip, out, wrong = zlib.decompressobj(31), b"", None
        try:
            out = unzip.decompress(data[at:] if at else data)
            if not unzip.eof:
                wrong = "gzip member is cut short"
        except zlib.error as e:
            wrong = f"gzip member is broken: {e}"
        yield out, wrong
        if wrong:
            at = data.find(GZIP, at + 1)
        else:
            at = data.find(GZIP, len(data) - len(unzip.unused_data)) if unzip.unused_data else -1


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of a WARC file's bytes, gzipped or not. A record that can't be read is a row with `error`; reading goes on at the
    next line that begins a record."""
    seq = 0
    for part, wrong in members(data):
        for row in _records(part):
            yield {"seq": seq, **row}
            seq += 1
        if wrong:
            yield {"seq": seq, **_BROKEN, "error": wrong}
            seq += 1


GZIP = b"\x1f\x8b\x08"
_BROKEN = {"kind": None, "url": None, "date": None, "headers": None, "payload": None}


def _records(data: bytes) -> Iterator[dict]:
    at = 0
    while at < len(data):
        while data[at : at + 1] in (b"\r", b"\n", b" ", b"\t"):
            at += 1
        if at >= len(data):
            return
        wrong, body, head = None, b"", {}
        if not data.startswith(b"WARC/", at):
            wrong = "no record begins here"
        else:
            f = io.BytesIO(memoryview(data)[at : at + MOST_HEAD])
            f.readline()
            head = _header_lines(f)
            begin = at + f.tell()
            length = head.get("content-length", "")
            if not length.isascii() or not length.isdigit():
                wrong = "record without a length"
            elif begin + int(length) > len(data):
                wrong = "record is cut short"
            else:
                body, end = data[begin : begin + int(length)], begin + int(length)
        if wrong:
            yield {**_BROKEN, "kind": head.get("warc-type"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "error": wrong}
            found = data.find(b"\nWARC/", at + 1)
            if found < 0:
                return
            at = found + 1
            continue
        at = end
        http: dict[str, str] = {}
        if head.get("content-type", "").startswith("application/http"):
            b = io.BytesIO(body)
            b.readline()
            http = _header_lines(b)
            body = b.read()
        yield {"kind": head.get("warc-type"), "url": head.get("warc-target-uri"), "date": head.get("warc-date"), "headers": http, "payload": body, "error": None}


#: Bytes in which a record's own header must end.
MOST_HEAD = 1 << 20


def _header_lines(f: io.BytesIO) -> dict[str, str]:
    out: dict[str, str] = {}
    while line := f.readline().strip():
        name, _, value = line.partition(b":")
        out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files under a path: file, seq, kind, url, url_key, ts, headers, payload, error. A file is read by one
    task, record by record; it must fit in a binary value (2 GB)."""
    schema = "file string, seq long, kind string, url string, date string, headers map<string,string>, payload binary, error string"
    names = ["file", "seq", "kind", "url", "date", "headers", "payload", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows, held = [], 0
                for r in parse_warc(bytes(content)):
                    rows.append({"file": name, **r})
                    held += len(r["payload"] or b"")
                    if held >= 1 << 22 or len(rows) >= 1000:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    made = files.mapInPandas(run, schema)
    return made.select("file", "seq", "kind", "url", canonical_url(F.col("url")).alias("url_key"), F.try_to_timestamp("date").alias("ts"), "headers", "payload", "error")


def captures(pages: DataFrame) -> DataFrame:
    """The pages as a series of captures: a resource is a host with the first part of the path, a page the capture at its id's minute.

    Two in three captures are full responses; the ETag changes with some of them, and some revisits bring another one.
    """
    url = F.col("url")
    key = F.regexp_extract(canonical_url(url), r"^([^/?]*(?:/[^/?]*)?)", 1)
    c = F.crc32(F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    kind = F.when(c % 3 == 0, "revisit").otherwise("response")
    etag = F.concat(F.lit('W/"'), F.when(c % 7 == 0, "v2").otherwise("v1"), F.lit('"'))
    headers = F.map_concat(F.create_map(F.lit("date"), F.col("page_id").cast("string"), F.lit("server"), F.concat(F.lit("s"), (c % 4).cast("string"))), F.when(c % 5 == 0, F.expr("cast(map() as map<string,string>)")).otherwise(F.create_map(F.lit("etag"), etag)))
    return pages.select("page_id", F.when(key != "", key).alias("url_key"), F.timestamp_seconds(F.col("page_id") * 60).alias("ts"), F.col("page_id").alias("seq"), kind.alias("kind"), headers.alias("headers"), F.when(kind == "response", F.md5(F.coalesce(F.col("html"), F.lit("")))).alias("payload"))


def op7_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_revisits(captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("merged_headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("page_id", "url_key", "kind", F.col("resolved_seq").alias("resolved_page_id"), "revisit_status", flat.alias("merged_headers"), F.col("resolved_payload").alias("payload_md5"))
