"""WARC archives, index first.

Writing tasks put pages into archives, one gzip member per record, and hand back an index row for
each: archive, offset, length, URL, payload digest. Readers select rows of the index, sort their byte ranges,
ask for near ranges in one request and cut the records out. A task that runs twice writes another
archive file; only the files that the stored index names are ever read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch, bytes_of, row_key, slices, text_or_empty

LEAST_REVISIT = 100  # bytes; smaller payloads are always stored
ARCHIVE_BYTES = 256 << 20  # a task begins another archive beyond it
GAP = 64 << 10  # ranges nearer than this are read together
READ = 8 << 20  # bytes asked for at once, but for a longer record
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def _file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def revisits(pages: DataFrame) -> DataFrame:
    """(k1, k2, refers_to) of the pages whose payload an earlier response has.

    Payloads are equal by SHA-256 and have at least LEAST_REVISIT bytes; the smallest page_id is the
    response, null page_ids come last.
    """
    html = text_or_empty("html")
    rows = pages.where(F.octet_length(html) >= LEAST_REVISIT).select(
        *row_key("page_id", "html"), F.struct(F.col("page_id").isNull().alias("no_id"), F.col("page_id").alias("id")).alias("order"),
        F.sha2(html, 256).alias("digest"),
    )
    first = rows.groupBy("digest").agg(F.min("order").alias("first"), F.max("order").alias("last")).where("first <> last")
    later = rows.join(first, "digest").where(~F.col("order").eqNullSafe(F.col("first")))
    return later.select("k1", "k2", F.col("first.id").alias("refers_to")).distinct()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit of ``refers_to`` without it."""
    revisit = refers_to is not None
    name = lambda x: f"<urn:page:{'none' if x is None else x}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', '%20', url or 'urn:unknown')}", f"WARC-Date: {DATE}",
        *([f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """WARC headers and the payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length and content disagree")
    return headers, block.partition(b"\r\n\r\n")[2]


INDEX = "archive string, offset long, length long, page_id long, url string, payload_digest string, record_type string"


def _writer(path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _file_system(path)
        system.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                for part in slices(batch, "html"):
                    rows = []
                    pages, urls, refers = (part.column(n).to_pylist() for n in ("page_id", "url", "refers_to"))
                    for page, url, refer, payload in zip(pages, urls, refers, bytes_of(part.column("html"))):
                        if out is None or at >= ARCHIVE_BYTES:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = system.open_output_stream(f"{folder}/{name}", compression=None)
                        digest = hashlib.sha256(payload).hexdigest()
                        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = pack.compress(record(page, url, payload, digest, refer)) + pack.flush()
                        out.write(member)
                        rows.append((name, at, len(member), page, url, digest, "response" if refer is None else "revisit"))
                        at += len(member)
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return write


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives under ``path``; the rows of their index.

    The archives exist once the index is evaluated: store it before use. Null html is an empty payload.
    A page whose payload a smaller page_id has becomes a revisit; rows that repeat page_id and html are all
    responses, as neither comes first.
    """
    keyed = pages.select("page_id", "url", "html", *row_key("page_id", "html"))
    rows = keyed.join(revisits(pages), ["k1", "k2"], "left").select("page_id", "url", "html", "refers_to")
    return rows.mapInArrow(_writer(path), INDEX)


RECORD = "page_id long, url string, record_type string, refers_to long, payload string, payload_digest string"


def _read_ranges(path: str):
    """Records of index rows that come sorted by archive and offset."""

    def cut(group: list[dict], source) -> Iterator[dict]:
        start, end = group[0]["offset"], group[-1]["offset"] + group[-1]["length"]
        data = source.read_at(end - start, start)
        for row in group:
            at = row["offset"] - start
            headers, payload = parse(zlib.decompress(data[at : at + row["length"]], 31))
            if headers["WARC-Payload-Digest"] != f"sha256:{row['payload_digest']}":
                raise ValueError("index and archive disagree")
            revisit = headers["WARC-Type"] == "revisit"
            if not revisit and hashlib.sha256(payload).hexdigest() != row["payload_digest"]:
                raise ValueError("payload and digest disagree")
            refers = headers.get("WARC-Refers-To", "<urn:page:none>")[len("<urn:page:") : -1]
            yield {
                "page_id": row["page_id"], "url": row["url"], "record_type": headers["WARC-Type"], "payload_digest": row["payload_digest"],
                "refers_to": None if refers == "none" else int(refers), "payload": None if revisit else payload.decode(),
            }

    def groups(rows: Iterator[dict]) -> Iterator[list[dict]]:
        group: list[dict] = []
        for row in rows:
            if group:
                end = group[-1]["offset"] + group[-1]["length"]
                far = row["archive"] != group[0]["archive"] or row["offset"] > end + GAP
                if far or row["offset"] + row["length"] - group[0]["offset"] > READ:
                    yield group
                    group = []
            group.append(row)
        if group:
            yield group

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _file_system(path)
        source, name = None, None
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("payload", pa.string()), ("payload_digest", pa.string()),
        ])
        for group in groups(row for batch in batches for row in batch.to_pylist()):
            if group[0]["archive"] != name:
                name = group[0]["archive"]
                source = system.open_input_file(f"{folder}/{name}")
            yield pa.RecordBatch.from_pylist(list(cut(group, source)), schema=schema)

    return read


def read_records(index: DataFrame, path: str) -> DataFrame:
    """Records of the selected index rows: page_id, url, record_type, refers_to, payload, payload_digest.

    A revisit has no payload of its own. Every record is checked against the digest of the index.
    """
    wanted = index.select(*(x.split()[0] for x in INDEX.split(", ")))
    return wanted.repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(_read_ranges(path), RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all ``pages``, read all archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A revisit's payload_bytes come from the response that it refers to. Columns beside page_id, url
    and html are not read; an empty table gives an empty result.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    index = scratch.keep(write_archives(pages, f"{scratch.path}/archives"))
    records = scratch.keep(
        read_records(index, f"{scratch.path}/archives").select(
            "page_id", "url", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("own_bytes")
        )
    )
    sizes = records.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("digest")).agg(F.max("own_bytes").alias("their_bytes"))
    joined = records.join(sizes, (F.col("payload_digest") == F.col("digest")) & (F.col("record_type") == "revisit"), "left")
    return joined.select("page_id", F.coalesce("own_bytes", "their_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "url")
