"""WARC archives: an index first, then coalesced reads of byte ranges.

Each task writes its pages into archive files of its own in the shared folder, one
gzip member per record, and returns the index of what it wrote: file, offset, length,
URL and digest of each record. The index is materialised at once, so that records are
written once and a retried task's leftovers are never referred to. Reading
takes selected index rows, deals them out by file and block of offsets, sorts
them, and coalesces neighbouring ranges into single reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import fresh_dir, small_batches, stage

BLOCK_BYTES, GAP_BYTES, READ_BYTES, FILE_BYTES = 8 << 20, 64 << 10, 8 << 20, 1 << 30
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(uri: str):
    """(file system, path): local paths and file: URIs, or any store that pyarrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_id(value: str) -> int | None:
    body = value.removeprefix("<urn:page:").removesuffix(">")
    return None if body == "null" else int(body)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: tuple | None) -> bytes:
    """One WARC/1.1 record; revisit_of is None or (page_id of the response,). A revisit has no payload."""
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit_of else 'response'}", f"WARC-Record-ID: {record_id(page_id)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Bytes: {len(payload)}"]
    if revisit_of:
        lines += [f"WARC-Refers-To: {record_id(revisit_of[0])}", f"WARC-Profile: {PROFILE}"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record of another length than stated")
    return headers, rest[:n]


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


INDEX = "file string, `offset` long, `length` long, url string, digest string, page_id long, record_type string"


def write_warc(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per page below folder (a URI that all executors reach); returns the index, materialised.

    pages needs page_id, url and html; other columns, whatever their names, are not read.
    Null html is an empty payload; a null url has no target URI, and characters in it that a header can't hold are
    percent-encoded. Of payloads equal in at least min_revisit_bytes bytes, the one of the
    largest page_id (null is smallest; of equal rows, one) is a response and the others revisit it. An
    empty table gives an empty index.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce("html", F.lit(""))
    plain = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    # staged, so that a row keeps its mark: of equal rows, wherever they are, one is the response
    plain = stage(plain.withColumn("row", F.monotonically_increasing_id()), "warc-pages")
    best = plain.groupBy("sha").agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))).alias("i"), "page_id", "row")).alias("top"), F.count("*").alias("c"))
    known = best.filter("c > 1").select(F.col("sha").alias("s"), F.col("top.page_id").alias("first_id"), F.col("top.row").alias("first_row"))
    joined = plain.join(stage(known, "warc-known"), F.col("sha") == F.col("s"), "left")
    ready = joined.select("page_id", "url", "html", "s", "first_id", (F.col("row") == F.col("first_row")).alias("chosen"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path, sink, at = None, None, None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, text, s, first, chosen in zip(batch["page_id"].astype("Int64"), batch["url"], batch["html"], batch["s"], batch["first_id"].astype("Int64"), batch["chosen"], strict=True):
                    page_id, first = (None if pd.isna(x) else int(x) for x in (page_id, first))
                    payload = text.encode("utf-8", "surrogatepass")
                    digest = base32_sha1(payload)
                    lead = s is None or len(payload) < min_revisit_bytes or bool(chosen)
                    data = _gzip(build_record(page_id, url, payload, digest, None if lead else (first,)))
                    if sink is None or at + len(data) > file_bytes:
                        if sink is not None:
                            sink.close()
                        store, base = _file_system(folder)
                        store.create_dir(base, recursive=True)
                        path, at = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                        sink = store.open_output_stream(path, compression=None)
                    sink.write(data)
                    rows.append((path.rsplit("/", 1)[1], at, len(data), url, digest, page_id, "response" if lead else "revisit"))
                    at += len(data)
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "offset", "length", "url", "digest", "page_id", "record_type"]).astype({"page_id": "Int64"})
        finally:
            if sink is not None:
                sink.close()

    return stage(ready.mapInPandas(run, INDEX), "warc-index")


def read_warc(index: DataFrame, folder: str, gap_bytes: int = GAP_BYTES, read_bytes: int = READ_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Read the records of (a selection of) the index: page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    Rows are dealt out by file and block of offsets; in a task, ranges closer than gap_bytes are read
    at once, up to read_bytes. A payload of another digest than its header's is an error.
    Null page_ids and URLs come back as null, an empty payload as an empty one, a revisit's as null; a record longer than read_bytes is read alone;
    a row that the index holds twice is read twice, one that it leaves out isn't read; other columns of the index, whatever their names, are not
    read; an empty index gives none.
    """
    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = index.select("file", "offset", "length").withColumn("block", F.floor(F.col("offset") / block_bytes)).repartition(parts, "file", "block").sortWithinPartitions("file", "offset")
    columns = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]

    def read(source, ranges: list[tuple[int, int]]) -> Iterator[tuple]:
        start = ranges[0][0]
        source.seek(start)
        data = source.read(ranges[-1][0] + ranges[-1][1] - start)
        for offset, length in ranges:
            headers, payload = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
            kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
            if kind == "response" and base32_sha1(payload) != digest:
                raise ValueError(f"damaged record at {offset}")
            refers = _page_id(headers["WARC-Refers-To"]) if kind == "revisit" else None
            yield _page_id(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, digest, int(headers["X-Payload-Bytes"]), refers, payload.decode("utf-8", "surrogatepass") if kind == "response" else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _file_system(folder)
        name, source = None, None
        for batch in batches:
            rows, ranges = [], []
            for file, offset, length in zip(batch["file"], batch["offset"].tolist(), batch["length"].tolist(), strict=True):
                if ranges and (file != name or offset - sum(ranges[-1]) > gap_bytes or offset + length - ranges[0][0] > read_bytes):
                    rows += read(source, ranges)
                    ranges = []
                if file != name:
                    if source is not None:
                        source.close()
                    name, source = file, store.open_input_file(f"{base}/{file}")
                ranges.append((offset, length))
            if ranges:
                rows += read(source, ranges)
            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
        if source is not None:
            source.close()

    return dealt.mapInPandas(run, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload string")


def query(spark, sf_dir: str) -> DataFrame:
    from refloom.llm.common import read

    folder = fresh_dir(spark, "warc")
    index = write_warc(read(spark, sf_dir, "pages"), folder)
    return read_warc(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _oracle_base32() -> str:
    """SQL that spells a SHA-1 in base32: five hex digits are four letters."""
    parts = []
    for i in range(8):
        value = f"CAST('0x' || substr(sha, {5 * i + 1}, 5) AS INT)"
        parts += [f"substr('{_BASE32}', (({value} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0)]
    return " || ".join(parts)


ORACLE = f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
q AS (SELECT *, row_number() OVER (PARTITION BY sha ORDER BY page_id DESC NULLS LAST) AS k, first(page_id) OVER (PARTITION BY sha ORDER BY page_id DESC NULLS LAST) AS top FROM p)
SELECT page_id, payload_bytes, {_oracle_base32()} AS payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN top END AS refers_to
FROM q
"""
