"""WARC archives, index first: offset, length, URL and digest of every record, then range reads of selected records.

Each task writes one archive of records compressed one by one, and returns their index rows, so that a lost or repeated
task leaves at most an archive that no index names. Of records with equal payloads of at least ``revisit_from`` bytes,
that with the largest page_id is a response and the others are revisits of it. Readers sort the index rows by archive
and offset, join neighbouring ranges into one read, and take the records out of it.

A null html is an empty payload, a null url leaves the header out. Rows that repeat the page_id of a response and its
payload are responses too; a null page_id is smaller than any other, and where all of a group are null each row is a
response. Line breaks in a url are written percent-encoded and stay so. Other columns are not stored. An empty table
makes no archive and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import cut

INDEX = (
    "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, "
    "file string, offset long, length long"
)
RECORD = "page_id long, url string, record_type string, refers_to long, digest string, payload_bytes long, payload binary"
REVISIT_FROM = 1000
#: More duplicated payloads than this are looked up by shuffle instead of broadcast: 20 MB or so.
BROADCAST_ROWS = 200_000
#: Ranges at most this far apart are read at once, up to so many bytes.
GAP, READ = 1 << 16, 1 << 23
_URN = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if path.startswith("file:/"):
        path = "file:///" + path[5:].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


#: Bytes of archives that one task reads back.
SHARE = 64 << 20


def payload(html: Column) -> Column:
    return F.encode(F.coalesce(html, F.lit("")), "UTF-8")


def record(page_id: int | None, url: str | None, refers_to: int | None, digest: str, size: int, body: bytes | None,
           date: str) -> bytes:
    """One WARC record; ``body`` None makes a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    coded = base64.b32encode(bytes.fromhex(digest)).decode()
    lines = ["WARC/1.1", "WARC-Type: " + ("revisit" if body is None else "response")]
    lines.append(f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>")
    lines.append(f"WARC-Date: {date}")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{coded}")
    if body is None:
        lines += [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    block = http + (body or b"")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; for a revisit, digest and length of the payload it refers to, and no payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    ids = [fields.get(name, "").strip("<>").removeprefix(_URN) for name in ("WARC-Record-ID", "WARC-Refers-To")]
    response = fields["WARC-Type"] == "response"
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if response and (hashlib.sha1(body).hexdigest() != digest or len(body) != size):
        raise ValueError(f"the payload of record {ids[0]} is damaged")
    return {
        "page_id": int(ids[0]) if ids[0] else None, "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"], "refers_to": int(ids[1]) if ids[1] else None, "digest": digest,
        "payload_bytes": size, "payload": body if response else None,
    }


def write(pages: DataFrame, folder: str, revisit_from: int = REVISIT_FROM, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Archives of ``pages`` (page_id, url, html) in ``folder``; their index, stored in ``folder``/index."""
    rows = pages.select(F.col("page_id").cast("long"), "url", payload(F.col("html")).alias("body"))
    rows = rows.withColumns({"digest": F.sha1("body"), "size": F.octet_length("body").cast("long")})
    same = rows.where(F.col("size") >= revisit_from).groupBy(F.col("digest").alias("of_digest"), F.col("size").alias("of_size"))
    same = cut(same.agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n"))
    same = F.broadcast(same) if same.count() <= BROADCAST_ROWS else same
    joined = rows.join(same, (F.col("digest") == F.col("of_digest")) & (F.col("size") == F.col("of_size")), "left")
    first = F.col("holder").isNull() | F.col("page_id").eqNullSafe(F.col("holder"))
    joined = joined.select("page_id", "url", "body", "digest", "size", F.when(~first, F.col("holder")).alias("refers_to"))

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
        out, offset = None, 0
        for batch in batches:
            made = []
            for page_id, url, body, digest, size, refers_to in zip(*(column.to_pylist() for column in batch.columns)):
                raw = record(page_id, url, refers_to, digest, size, None if refers_to is not None else body, date)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                packed = packer.compress(raw) + packer.flush()
                if out is None:
                    files.create_dir(base, recursive=True)
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                out.write(packed)
                kind = "response" if refers_to is None else "revisit"
                made.append((page_id, url, kind, refers_to, digest, size, name, offset, len(packed)))
                offset += len(packed)
            yield _batch(made, INDEX)
        if out is not None:
            out.close()

    joined.mapInArrow(archived, INDEX).write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    arrays = [pa.array(column, kinds[kind]) for column, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def ranges(places: list[tuple[str, int, int]], gap: int = GAP, most: int = READ) -> Iterator[list[tuple[str, int, int]]]:
    """Sorted places (file, offset, length) in groups that one read covers."""
    group: list[tuple[str, int, int]] = []
    for place in places:
        if group:
            file, offset, length = group[-1]
            far = place[1] > offset + length + gap or place[1] + place[2] - group[0][1] > most
            if file != place[0] or far:
                yield group
                group = []
        group.append(place)
    if group:
        yield group


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records that rows of an index name: ``RECORD``, with payloads of responses.

    They are dealt along the archives, to a task for each ``SHARE`` bytes of them and to each core at least.
    """
    places = index.select("file", "offset", "length")
    size = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(-(-size // SHARE), min(index.sparkSession.sparkContext.defaultParallelism, -(-size // GAP)), 1)
    places = places.repartitionByRange(int(tasks), "file", "offset")

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(folder)
        for batch in batches:
            wanted = list(zip(*(column.to_pylist() for column in batch.columns)))
            for group in ranges(wanted):
                start = group[0][1]
                with files.open_input_file(f"{base}/{group[0][0]}") as source:
                    block = source.read_at(group[-1][1] + group[-1][2] - start, start)
                found = []
                for _, offset, length in group:
                    fields = parse(zlib.decompress(block[offset - start:offset - start + length], 31))
                    found.append(tuple(fields.values()))
                yield _batch(found, RECORD)

    return places.sortWithinPartitions("file", "offset").mapInArrow(fetched, RECORD)
