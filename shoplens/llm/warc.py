"""WARC archives: writing captures, reading records, and assembling transactions from them."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.llm.common import landed, numbered, packed
from shoplens.llm.components import connected

VERSION = "WARC/1.1"
END = "\r\n\r\n"
#: Payloads below this size are stored again rather than referred to.
MIN_REVISIT_BYTES = 100
#: Uncompressed bytes of an archive file; a reader task holds one file at a time.
FILE_BYTES = 16 << 20
RECORD_OVERHEAD = 1500
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEADS = ("response", "revisit")

RECORD_SCHEMA = (
    "record_id string, type string, concurrent_to array<string>, target_uri string, refers_to string, "
    "stated_digest string, fields map<string,string>, payload_bytes long, payload_digest string, payload binary"
)


def _urn(kind: str, *parts: Column) -> Column:
    """A record id from what makes the record unique, so that a repeated task writes the same id."""
    known = [F.coalesce(part.cast("string"), F.lit("\x00")) for part in parts]
    digest = F.md5(F.concat_ws("\x1f", F.lit(kind), *known))
    cut = [digest.substr(start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def with_roles(pages: DataFrame) -> DataFrame:
    """One narrow row per capture: ``key`` (of equal rows), ``copies`` of them, ``record_id``, ``type`` and ``refers_to_id``.

    Equal rows are numbered, so that each is a capture with a record id of its own. Of captures with
    equal payloads of at least ``MIN_REVISIT_BYTES`` the one with the smallest page id (null last, then
    smallest record id) is the response and the others revisit it.
    """
    slim = _captured(pages).groupBy("key", "page_id", "digest", "payload_bytes")
    slim = landed(slim.agg(F.count(F.lit(1)).alias("copies")), "warc-slim")
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    each = slim.select("*", copy.alias("copy")).withColumn("record_id", _urn("response", F.col("key"), F.col("copy")))
    first = each.groupBy("digest").agg(F.min(F.struct(F.isnull("page_id"), "page_id", "record_id")).alias("first"))
    first = first.select("digest", F.col("first.record_id").alias("first_id"))
    again = (F.col("payload_bytes") >= MIN_REVISIT_BYTES) & (F.col("first_id") != F.col("record_id"))
    return each.join(first, "digest").select(
        "key",
        "copies",
        "record_id",
        "payload_bytes",
        F.when(again, "revisit").otherwise("response").alias("type"),
        F.when(again, F.col("first_id")).alias("refers_to_id"),
    )


def _captured(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    known = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("page_id", "url")]
    return (
        pages.select("page_id", "url", html.alias("html"))
        .withColumn("payload_bytes", F.octet_length("html").cast("long"))
        .withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
        .withColumn("key", F.md5(F.concat_ws("\x1f", *known, "digest").cast("binary")))
    )


def _record(kind: str | Column, record_id: Column, content_type: str, block: Column, **headers: Column) -> Column:
    """One record without its closing blank lines; a null header is left out."""
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z"),
        *[F.concat(F.lit(f"WARC-{name.replace('_', '-')}: "), value) for name, value in headers.items()],
        F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes gzipped WARC files with a request, a response or revisit, and a metadata record per page.

    ``pages`` has page_id, url and html (null: empty payload, no target header; other columns are
    ignored). Line breaks in a url are percent-encoded. Spark's own text sink writes the records,
    closed by the two line breaks that the format asks for, so any file system and any retry is
    safe. Files hold about ``FILE_BYTES``, whatever the input's size; the html moves once. Every row
    is a capture: the html of fully repeated rows moves as one row and is multiplied where it is written.
    """
    roles = landed(with_roles(pages), "warc-roles")
    volume = roles.agg(F.sum("payload_bytes"), F.count(F.lit(1)), F.max("copies")).first()
    files = max(1, -(-((volume[0] or 0) + RECORD_OVERHEAD * volume[1]) // FILE_BYTES))
    captured, roles = _captured(pages), roles.drop("payload_bytes")
    single = roles.filter("copies = 1").repartition(files, "key")
    rows = captured.repartition(files, "key").join(single, "key")
    if (volume[2] or 0) > 1:
        many = roles.filter("copies > 1")
        once = captured.join(many.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
        rows = rows.unionByName(once.join(many, "key"))

    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    digest = F.concat(F.lit("sha256:"), F.col("digest"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END),
    )
    target = F.regexp_extract(uri, r"^[a-z]+://[^/]*(/[^#]*)", 1)
    ask = F.concat(
        F.lit("GET "),
        F.when(F.length(target) > 0, target).otherwise("/"),
        F.lit(" HTTP/1.1\r\nHost: "),
        F.regexp_extract(F.coalesce(uri, F.lit("")), r"^[a-z]+://([^/]*)", 1),
        F.lit(END),
    )
    same = F.col("record_id")
    request = _record(
        "request",
        _urn("request", same),
        "application/http;msgtype=request",
        F.coalesce(ask, F.lit(f"GET / HTTP/1.1{END}")),
        Target_URI=uri,
        Concurrent_To=same,
    )
    body = F.when(F.col("type") == "response", F.col("html")).otherwise("")
    head = _record(
        F.col("type"),
        same,
        "application/http;msgtype=response",
        F.concat(http, body),
        Target_URI=uri,
        Payload_Digest=digest,
        Refers_To=F.col("refers_to_id"),
        Profile=F.when(F.col("type") == "revisit", F.lit(REVISIT_PROFILE)),
    )
    about = F.concat(F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record(
        "metadata", _urn("metadata", same), "application/warc-fields", about, Target_URI=uri, Concurrent_To=same
    )
    lines = rows.select(F.concat(request, F.lit(END), head, F.lit(END), metadata).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").text(path)


def _headers(block: bytes) -> list[tuple[str, str]]:
    pairs = (line.partition(b":") for line in block.split(b"\r\n")[1:])
    return [(name.decode().strip().lower(), value.decode().strip()) for name, _, value in pairs if name.strip()]


def records_of(data: bytes) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers and block of each record of an archive, by the stated lengths only."""
    end = END.encode()
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = data.index(end, at)
        headers = _headers(data[at:head])
        start = head + len(end)
        stop = start + int(dict(headers)["content-length"])
        if data[stop : stop + len(end)] != end:
            raise ValueError(f"the record at byte {at} does not end where it says")
        yield headers, data[start:stop]
        at = stop + len(end)


def _unzipped(content: bytes) -> bytes:
    out = []
    while content:
        member = zlib.decompressobj(wbits=zlib.MAX_WBITS | 16)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data
    return b"".join(out)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the gzipped archives under ``path``; ``payload`` is null unless asked for.

    Sizes and digests are taken from the bytes that were read, not from the headers. A damaged
    file fails the job and names the byte.
    """

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for headers, block in records_of(_unzipped(content)):
                    named = dict(headers)
                    kind = named["warc-type"]
                    fields, payload = {}, None
                    if kind in (*HEADS, "request"):
                        http, _, payload = block.partition(END.encode())
                        fields = dict(_headers(http))
                    elif named.get("content-type") == "application/warc-fields":
                        fields = dict(_headers(b"\r\n" + block))
                    rows.append(
                        (
                            named["warc-record-id"],
                            kind,
                            [value for name, value in headers if name == "warc-concurrent-to"],
                            named.get("warc-target-uri"),
                            named.get("warc-refers-to"),
                            named.get("warc-payload-digest"),
                            fields,
                            None if payload is None else len(payload),
                            None if payload is None else hashlib.sha256(payload).hexdigest(),
                            payload if payloads else None,
                        )
                    )
                yield pd.DataFrame(rows, columns=[part.split()[0] for part in RECORD_SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parsed, RECORD_SCHEMA)


def _captures_of(others: DataFrame, known: DataFrame) -> DataFrame:
    """(``other_id``, ``capture``) of records that lead to captures through concurrent-to ids, over any number of steps.

    Records that name a capture belong to it. Records that only name each other form groups, and
    those of a group that name no capture belong to all that others of it name.
    """
    direct = others.join(known, F.col("near") == F.col("capture")).select("other_id", "capture").distinct()
    direct = landed(direct, "warc-direct")
    ids = others.select(F.col("other_id").alias("_to")).distinct()
    steps = others.join(ids, F.col("near") == F.col("_to")).select("other_id", F.col("_to").alias("near")).distinct()
    steps = landed(steps, "warc-steps")
    ends = steps.select(F.explode(F.array("other_id", "near")).alias("other_id")).distinct()
    numbers = landed(numbered(ends, ["other_id"]), "warc-numbers")
    links = steps.join(numbers, "other_id").select("near", F.col("rank").alias("a"))
    links = links.join(numbers, F.col("near") == F.col("other_id")).select("a", F.col("rank").alias("b"))
    roots = connected(links).toDF("rank", "root")
    members = numbers.join(roots, "rank", "left").select("other_id", F.coalesce("root", "rank").alias("root"))
    members = landed(members, "warc-members")
    named = members.join(direct, "other_id").select("root", "capture").distinct()
    far = members.join(direct.select("other_id").distinct(), "other_id", "left_anti").join(named, "root")
    return direct.unionByName(far.select("other_id", "capture"))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id``, ``response``, ``requests``, ``request``, ``metadata``, ``page_id``, ``original``.

    Requests and all other records find their response or revisit through their concurrent-to ids,
    directly or over other such records. Requests and the other records (``metadata``) are all
    kept, sorted by id; ``request`` is the first one. A record that leads to no capture is a row of its own
    without a response. A record that occurs twice counts once. ``original`` is the response that a
    revisit refers to. No records, no rows. The records are read several times: land them first.
    """
    records = records.select("record_id", F.col("type"), "concurrent_to", "refers_to", packed(records))
    is_head = F.col("type").isin(*HEADS)
    heads = records.filter(is_head).groupBy("record_id").agg(F.first("row").alias("response"))
    others = records.filter(~is_head).select("record_id", "type", "concurrent_to", _plain("row"), _named_page("row.fields"))
    others = landed(others.withColumnRenamed("record_id", "other_id").dropDuplicates(["other_id"]), "warc-others")
    near = others.select("other_id", F.explode("concurrent_to").alias("near"))
    found = landed(_captures_of(near, heads.select(F.col("record_id").alias("capture"))), "warc-found")
    request = F.struct("other_id", "record")
    each = others.join(found, "other_id", "left")
    # Without a capture the record's own id names the row, which no capture has.
    linked = each.groupBy(F.coalesce("capture", "other_id").alias("_id"), F.isnull("capture").alias("alone")).agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "request", request))).alias("_requests"),
        F.array_sort(F.collect_list(F.when(F.col("type") != "request", request))).alias("_metadata"),
        F.min("page").alias("page_id"),
    )
    nested = heads.join(linked.filter("not alone"), F.col("record_id") == F.col("_id"), "left")
    orphans = linked.filter("alone").withColumn("record_id", F.col("_id"))
    nested = nested.unionByName(orphans, allowMissingColumns=True).select(
        "record_id",
        "response",
        F.coalesce(F.transform("_requests", lambda m: m["record"]), F.array()).alias("requests"),
        F.get("_requests", F.lit(0))["record"].alias("request"),
        F.coalesce(F.transform("_metadata", lambda m: m["record"]), F.array()).alias("metadata"),
        "page_id",
    )
    nested = landed(nested, "warc-captures")
    originals = nested.filter(F.col("response.type") == "response").select(
        F.col("record_id").alias("_id"), F.struct("page_id", "response").alias("original")
    )
    return nested.join(originals, F.col("response.refers_to") == F.col("_id"), "left").drop("_id")


def _named_page(fields: str) -> Column:
    named = F.get(F.map_values(F.map_filter(fields, _page_id)), F.lit(0))
    return F.when(F.col("type") == "metadata", named).try_cast("long").alias("page")


def _page_id(name: Column, _: Column) -> Column:
    return name == "page-id"


def _plain(row: str) -> Column:
    """The comparable part of a record: all but its field map, which becomes sorted pairs."""
    fields = F.array_sort(F.map_entries(f"{row}.fields")).alias("fields")
    return F.struct(f"{row}.record_id", f"{row}.type", f"{row}.target_uri", fields).alias("record")
