"""WARC archives with an index; every record is a gzip member of its own, so that ranges can be read alone.

Writing notes for each record its file, offset, length, URL and digest; reading
goes by that index: the byte ranges of the selected records are sorted, ranges
that lie close together are read at once, and the records are cut out of what
was read. Archives lie in a folder that driver and executors share, reached
through the file system that its URI names.

A task writes a file under a name of its own and the index holds the names of
the tasks that succeeded, so a repeated task leaves no half-written record
behind that anyone reads.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import map_batches, settle, shared_folder, table

#: Payloads below this are never deduplicated.
LEAST_REVISIT = 1000
#: Gap between two ranges that one read may bridge, bytes that it reads at most, and bytes of a file that one task reads.
GAP, READ, SHARE = 1 << 16, 1 << 23, 1 << 26
_END = b"\r\n"
#: Effort of compression, 1 to 9.
LEVEL = 4
INDEX = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"


def _payload_key() -> tuple[Column, Column]:
    html = F.coalesce("html", F.lit("")).cast("binary")
    return F.octet_length(html).alias("size"), F.sha1(html).alias("digest")


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, size, digest, refers_to: payloads that a row with a larger page_id has too. The payloads themselves are not shuffled."""
    digests = pages.select("page_id", *_payload_key()).where((F.col("size") >= least) & F.col("page_id").isNotNull())
    last = digests.groupBy("digest", "size").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return digests.join(last, ["digest", "size"]).where("page_id < refers_to").select("page_id", "size", "digest", "refers_to").distinct()


def _record(page_id, url: str | None, payload: bytes, refers_to) -> tuple[bytes, str]:
    digest = hashlib.sha1(payload)
    block = b"" if refers_to is not None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    uri = "".join(f"%{ord(c):02X}" if c in "\r\n" else c for c in url or "")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest.digest()).decode()}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields[4:4] = [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + _END
    return gzip.compress(head + block + _END + _END, LEVEL, mtime=0), digest.hexdigest()


def write_archive(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record for every row; returns the index, checkpointed.

    A null html is an empty payload, a null url an empty one. Rows without
    page_id are responses without an id. Rows that share a page_id are each
    written, and a revisit goes by its own payload. An empty table gives no files
    and an empty index.
    """
    key = ["page_id", "size", "digest"]
    joined = pages.select("page_id", "url", "html", *_payload_key()).join(revisits(pages, least), key, "left").select("page_id", "url", "html", "refers_to")

    def make():
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
        state = {"at": 0, "out": None}

        def step(batch):
            rows = {c: batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to")}
            html = batch.column("html").cast(pa.binary())
            out = {k: [] for k in ("record_type", "payload_digest", "payload_bytes", "offset", "length")}
            # each batch is closed as a file of its own, so that its index rows never run ahead of the bytes
            file = f"{name[:-8]}-{state['at']}.warc.gz"
            state["at"] += 1
            at = 0
            with system.open_output_stream(file, compression=None) as sink:
                for k in range(batch.num_rows):
                    payload = html[k].as_py() or b""
                    record, digest = _record(rows["page_id"][k], rows["url"][k], payload, rows["refers_to"][k])
                    sink.write(record)
                    for c, v in zip(out, ("response" if rows["refers_to"][k] is None else "revisit", digest, len(payload), at, len(record)), strict=True):
                        out[c].append(v)
                    at += len(record)
            yield {c: batch.column(c) for c in ("page_id", "url", "refers_to")} | {k: pa.array(v, pa.string() if k in ("record_type", "payload_digest") else pa.int64()) for k, v in out.items()} | {"file": pa.array([file] * batch.num_rows)}

        return step

    return settle(map_batches(joined, INDEX, make))


def parse_record(raw: bytes) -> dict:
    head, _, rest = gzip.decompress(raw).partition(_END + _END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] == "response":
        payload = block.partition(_END + _END)[2]
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields["WARC-Payload-Digest"].partition(":")[2]:
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
        fields["payload"] = payload
    return fields


def coalesced(ranges: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> list[tuple[int, int, list[int]]]:
    """(start, stop, members) of sorted (offset, length) ranges, those at most `gap` apart joined into reads of at most `most` bytes."""
    out: list[tuple[int, int, list[int]]] = []
    for k, (offset, length) in enumerate(ranges):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(out[-1][1], offset + length), out[-1][2] + [k])
        else:
            out.append((offset, offset + length, [k]))
    return out


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_records(selected: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records that index rows (file, offset, length) select: page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload.

    payload is null for a revisit; with payload=False it is checked but not returned.
    """
    dealt = selected.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / SHARE)).sortWithinPartitions("file", "offset")

    def make():
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)

        def step(batch):
            names = batch.column("file").to_pylist()
            ranges = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True))
            first = 0
            while first < len(names):
                last = first
                while last < len(names) and names[last] == names[first]:
                    last += 1
                with system.open_input_file(names[first]) as source:
                    for start, stop, members in coalesced(ranges[first:last]):
                        data = source.read_at(stop - start, start)
                        found = [parse_record(data[o - start : o - start + n]) for o, n in (ranges[first + k] for k in members)]
                        yield {
                            "page_id": pa.array([_number(x["WARC-Record-ID"]) for x in found], pa.int64()), "url": pa.array([x["WARC-Target-URI"] for x in found], pa.string()), "record_type": pa.array([x["WARC-Type"] for x in found], pa.string()),
                            "refers_to": pa.array([_number(x.get("WARC-Refers-To")) for x in found], pa.int64()), "payload_digest": pa.array([base64.b32decode(x["WARC-Payload-Digest"].partition(":")[2]).hex() for x in found], pa.string()),
                            "payload_bytes": pa.array([int(x["X-Payload-Length"]) for x in found], pa.int64()), "payload": pa.array([x.get("payload") if payload else None for x in found], pa.binary()),
                        }
                first = last

        return step

    return map_batches(dealt, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary", make)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = write_archive(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
