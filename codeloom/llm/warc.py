"""WARC archives: one gzip member per record, written by tasks into the shared folder, read back in sequence.

Writing: every task streams its pages into one archive file (rolled at ``roll_bytes``) with a name of its
own, and only the names of tasks that succeeded reach the manifest table; a task that is run again leaves an
unreferenced file at worst. Reading: one task per archive, incremental zlib decompression member by member,
content-length framing, block and payload digests verified; memory is one record.

Defined results: a null html is an empty payload; among records of equal payload (SHA-1 and length) of at least
``min_bytes`` bytes the largest page_id is the response and others revisit it; rows that share the largest page_id
are all responses; a null page_id never revisits or is revisited; a null url is written as ``urn:page:<id>``; an
empty table gives no archive; columns beside page_id, url, html are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import fresh_path, opened, saved, table

CRLF = b"\r\n"
READ = 1 << 20
#: Bytes of the table of revisits that is broadcast, at most, and of one of its rows (two numbers and 40 digits).
BROADCAST_BYTES, REVISIT_BYTES = 32 << 20, 128
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit keeps the HTTP head, with the full payload's length, and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else page_id
    uri = (url or f"urn:page:{name}").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF) + made.flush()


def members(stream, size: int = READ) -> Iterator[bytes]:
    """The content of one gzip member after another, decompressed as bytes arrive."""
    held = b""
    while True:
        held = held or stream.read(size)
        if not held:
            return
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not held and not (held := stream.read(size)):
                raise ValueError("archive ends within a gzip member")
            parts.append(inflate.decompress(held))
            held = inflate.unused_data if inflate.eof else b""
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and block of a record; the block has exactly content-length bytes."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:20]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    block, rest = data[end + 4:end + 4 + n], data[end + 4 + n:]
    if len(block) != n or rest != CRLF + CRLF:
        raise ValueError(f"record {fields.get('warc-record-id')}: its block has not {n} bytes")
    return fields, block


def read_record(data: bytes) -> dict:
    """Row of RECORD_SCHEMA, with the payload under ``payload`` (None for revisits); raises where a digest differs."""
    fields, block = parse(data)
    if (want := fields.get("warc-block-digest")) and want != f"sha1:{digest(block)}":
        raise ValueError(f"record {fields.get('warc-record-id')}: block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(CRLF) if x.lower().startswith(b"content-length:"))
    want, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    if kind == "response" and (len(payload) != length or digest(payload) != want):
        raise ValueError(f"record {fields.get('warc-record-id')}: payload digest differs")
    number = lambda x: None if x is None or x == "<urn:page:null>" else int(x.removeprefix("<urn:page:").rstrip(">"))
    return {"page_id": number(fields["warc-record-id"]), "url": fields["warc-target-uri"], "record_type": kind,
            "refers_to": number(fields.get("warc-refers-to")), "payload_bytes": length, "payload_digest": want,
            "payload": payload if kind == "response" else None}


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the page that holds an equal payload, null for responses.

    Digests are computed in the JVM and pre-aggregated per payload, so a payload that a third of the pages share
    is one row per task in the shuffle. Revisits are sent to the pages where they have at most BROADCAST_BYTES; beyond that html is joined by
    the unique page_id, not by payload. Pages without an id take no part in the join.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", F.sha1(body).alias("sha_"), F.octet_length(body).alias("n_"))
    shared = (keyed.where((F.col("n_") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha_", "n_")
              .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("c_")).where("c_ > 1").drop("c_"))
    revisits = saved(keyed.join(shared, ["sha_", "n_"]).where("page_id <> refers_to").select("page_id", "sha_", "refers_to").distinct(), "revisits")
    rows = pages.select("page_id", "url", "html", F.sha1(body).alias("sha_"))
    few = revisits.count() * REVISIT_BYTES <= BROADCAST_BYTES
    named = rows.where("page_id is not null").join(F.broadcast(revisits) if few else revisits, ["page_id", "sha_"], "left")
    return named.select("page_id", "url", "html", "refers_to").unionByName(rows.where("page_id is null").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to")))


def write_archives(records: DataFrame, folder: str, roll_bytes: int = 1 << 30) -> DataFrame:
    """Writes records (page_id, url, html, refers_to) as .warc.gz below folder; the saved manifest (path, n_records, bytes)."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        out, path, n, size, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, refers in zip(batch.page_id, batch.url, batch.html, batch.refers_to, strict=True):
                if out is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = opened(path, "w")
                data = record(None if pd.isna(page_id) else int(page_id), url, (html or "").encode(), None if pd.isna(refers) else int(refers))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    done.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pd.DataFrame(done, columns=["path", "n_records", "bytes"])

    return saved(records.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", "refers_to")
                 .mapInPandas(write, "path string, n_records long, bytes long"), "warc-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Reads the archives of a manifest, one task each; one row per record (RECORD_SCHEMA, and payload binary on demand)."""
    schema = RECORD_SCHEMA + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def frame(rows: list[dict]) -> pd.DataFrame:
        # whole numbers beside nulls: never by way of floats
        return pd.DataFrame({n: pd.array([r[n] for r in rows], dtype="Int64") if n in ("page_id", "refers_to") else pd.Series([r[n] for r in rows]) for n in names})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.path:
                rows, held = [], 0
                with opened(path, "r") as stream:
                    for data in members(stream):
                        rows.append(read_record(data))
                        held += len(data) if with_payload else 200
                        if held > 8 << 20:
                            yield frame(rows)
                            rows, held = [], 0
                yield frame(rows)

    n = manifest.count()
    return manifest.select("path").repartition(max(1, min(n, 10_000))).mapInPandas(read, schema)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    manifest = write_archives(plan_records(pages, min_bytes), fresh_path(spark, "warc"))
    return read_archives(spark, manifest)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages"), 0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a SHA-1 by its hexadecimal digits: 160 bits, five at a time.
ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as n, sha1(h) as x from p),
bits as (select *, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(x, i, 1))]), '') as b from d),
coded as (select page_id, n, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(5), lambda j: case when substr(b, 5 * k + j + 1, 1) = '1' then [16, 8, 4, 2, 1][j + 1] else 0 end))::int, 1)), '') as s from bits),
best as (select s, n, max(page_id) as top from coded group by s, n)
select page_id, cast(n as bigint) as payload_bytes, s as payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from coded join best using (s, n)"""
