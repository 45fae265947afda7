"""WARC archives written and read through an index.

``write_archives`` writes one gzip member per record and returns the index: file, offset, length, url and digest of
every record. ``read_records`` takes selected index rows, sorts them by file and offset, joins ranges that lie close
together, and reads those byte ranges only. Of records with equal payloads, the one with the largest page_id is a
response and the others are revisits of it; payloads shorter than min_bytes are always responses.

A writing task puts its records into files of its own under names that no other attempt uses, so a task that runs
again leaves the index right: only files of the attempt that succeeded are named in it.

Defined results: null html is an empty payload; a null url is written as an empty one; a page without page_id is
always a response and nothing refers to it; repeated rows are all written, and those with the largest page_id of their
payload are all responses. An empty table writes no file and reads no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, pick, scratch_root, tidy

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
#: A file is closed beyond this many bytes; ranges with a gap of up to GAP bytes are read at once, up to SPAN bytes.
FILE_BYTES, GAP, SPAN = 256 << 20, 64 << 10, 8 << 20
#: A task reads about so much.
TASK_BYTES = 64 << 20


def open_file(path: str, mode: str):
    """A file of the shared store: local paths directly, other schemes by pyarrow."""
    scheme = urlparse(path).scheme
    if scheme in ("", "file"):
        return open(unquote(urlparse(path).path) if scheme else path, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_output_stream(inner) if "w" in mode else store.open_input_file(inner)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has no payload; its length is kept in a header of ours."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace('%', '%25').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple:
    """RECORD of one gzip member; fails if the payload of a response does not have its digest."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    ident = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = None
    if kind == "response":
        payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        if digest_of(payload) != digest or len(payload) != int(fields["X-Payload-Length"]):
            raise ValueError(f"record {fields['WARC-Record-ID']}: payload does not match its digest")
    url = fields["WARC-Target-URI"].replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return ident(fields["WARC-Record-ID"]), url, int(fields["X-Payload-Length"]), digest, kind, ident(fields.get("WARC-Refers-To")), payload


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes .warc.gz files below folder, in the shared store, and returns their INDEX, itself a table there."""
    spark = pages.sparkSession
    if urlparse(folder).scheme in ("", "file"):
        os.makedirs(unquote(urlparse(folder).path), exist_ok=True)
    p = pick(pages, page_id="long", url="string", html="string").withColumn("body", F.encode(F.coalesce("html", F.lit("")), "UTF-8"))
    p = p.select("page_id", "url", "body", F.sha1("body").alias("sha"))
    # which page answers: decided on digests alone; the pages meet the verdicts by page_id and digest, never by digest
    ids = p.where("page_id is not null").where(F.octet_length("body") >= min_bytes).groupBy("page_id", "sha").agg(F.lit(1).alias("one"))
    with Scratch(spark, "warc-digests") as scratch:
        ids = scratch.keep(ids.select("page_id", "sha"), "ids")
        top = scratch.keep(ids.groupBy("sha").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1").select("sha", "top"), "top")
        revisits = ids.join(top, "sha").where("page_id < top")
        p = p.join(revisits, ["page_id", "sha"], "left").select("page_id", "url", "body", F.col("top").alias("refers_to"), "sha")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name, out, at = "", None, 0
            schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64())])
            try:
                for b in batches:
                    rows = []
                    for page_id, url, body, ref, sha in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        if out is None:
                            name, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                            out = open_file(name, "wb")
                        digest = base64.b32encode(bytes.fromhex(sha)).decode()
                        member = record(page_id, url, body, digest, ref)
                        out.write(member)
                        rows.append((name, at, len(member), page_id, url, digest, len(body), "response" if ref is None else "revisit", ref))
                        at += len(member)
                        if at >= FILE_BYTES:
                            out.close()
                            out = None
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)
            finally:
                if out is not None:
                    out.close()

        path = f"{folder}/index"
        p.mapInArrow(tidy(work), INDEX).write.parquet(path)  # once: the records and their index belong together
        scratch.remove()
    return spark.read.schema(INDEX).parquet(path)


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """RECORD of every selected index row. Rows go to tasks by file and stretch of SPAN bytes, and the tasks are as many
    as the bytes to read ask for, TASK_BYTES each, but at least as many as there are cores or stretches."""

    def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, found = rows.sort_values("offset"), []
        with open_file(key[0], "rb") as f:
            start, end, group = 0, -1, []

            def flush() -> None:
                if group:
                    f.seek(start)
                    data = f.read(end - start)
                    found.extend(parse(data[o - start : o - start + n]) for o, n in group)
                    group.clear()

            for o, n in zip(rows["offset"], rows["length"], strict=True):
                if group and o - end > GAP:
                    flush()
                if not group:
                    start = int(o)
                group.append((int(o), int(n)))
                end = int(o + n)
            flush()
        out = pd.DataFrame(found, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
        out[["page_id", "refers_to"]] = out[["page_id", "refers_to"]].astype("Int64")
        return out if payloads else out.assign(payload=None)

    ranges = index.select("file", "offset", "length", F.floor(F.col("offset") / SPAN).alias("stretch"))
    stretches, total = ranges.agg(F.count_distinct("file", "stretch"), F.coalesce(F.sum("length"), F.lit(0))).first()
    cores = index.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(stretches, 4 * cores), -(-total // TASK_BYTES))
    # by a stated number, which adaptive execution does not merge as it would so few and small rows
    return ranges.repartition(tasks, "file", "stretch").groupBy("file", "stretch").applyInPandas(work, RECORD)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every page, as read from the archives."""
    with Scratch(pages.sparkSession, "warc") as scratch:
        index = write_archives(pages, scratch.path, min_bytes)
        return scratch.finish(read_records(index, payloads=False).drop("payload"))


__all__ = ["archive_round_trip", "read_records", "scratch_root", "write_archives"]
