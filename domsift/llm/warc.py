"""Deterministic sharded WARC writer, and the reader that takes it back.

Records are range-sorted by id into shards of about ``shard_bytes`` of payload.
The cuts come from a histogram of payload bytes over the id range, so they are
the same in every run. A task writes its shards' records as one gzip member each
and starts a new file once ``roll_bytes`` are compressed. Every header is made
anew: record ids by hashing, lengths and SHA-1 digests from the payload.

Files are first written under names of their own task attempt; the driver gets
one line a file, moves the files that belong to a finished task to their final
names and then puts the manifest in place. An archive without a manifest is not
there; a lost executor's leftovers stay below ``_attempts`` and are never read.

Defined results
    * null html: empty payload; null url: no target header; a null id sorts
      first and is left out of the header;
    * records of equal payloads of ``min_revisit`` bytes or more: those of the
      largest id are responses, the others revisit it (repeats of one row with
      the largest id are all responses; a null id always revisits);
    * records of equal id are ordered by url, then digest; an empty table gives
      an archive of no files; columns other than the three named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domsift.llm.common import written

MIN_REVISIT = 1000
ROLL_BYTES = 16 << 20
SHARD_BYTES = 64 << 20
CELLS = 4096
#: What the reader hands to the decompressor at a time.
READ_BYTES = 1 << 14
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("5d0d6d0c-52b5-4a2c-9d55-0f6b7a1e1c11")


def _base32(digest_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record_id(page_id: int | None, digest_hex: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest_hex}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, n_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; ``payload`` is not looked at in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
        ("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())),
        ("WARC-Payload-Digest", _base32(digest)),
        ("X-Payload-Length", n_bytes),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", page_id))
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", refers_to)]
    head = "".join(f"{name}: {value}\r\n" for name, value in headers)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    """A gzip member with no time stamp in it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def plan_records(df: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to); payload is null in revisits."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = df.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("digest")
    )
    repeated = written(
        rows.where(F.col("payload_bytes") >= min_revisit)
        .groupBy("digest")
        .agg(F.max("page_id").alias("_response"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("digest", "_response"),
        "repeated",
    )
    joined = rows.join(repeated, "digest", "left")
    revisit = F.col("_response").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("_response"), F.lit(False))
    return joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "payload_bytes",
        "digest",
        F.when(revisit, F.col("_response")).alias("refers_to"),
    )


def _shards(df: DataFrame, shard_bytes: int):
    """Number of shards and the column that tells a row's shard: contiguous id ranges."""
    low, high = df.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return 1, F.lit(0)
    width = (float(high) - float(low) + 1.0) / CELLS
    place = F.floor((F.col("page_id").cast("double") - float(low)) / width).cast("int")
    cell = F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), F.coalesce(place, F.lit(0))))
    heights = dict(df.groupBy(cell.alias("c")).agg(F.sum(F.octet_length(F.coalesce("html", F.lit(""))) + 500).alias("b")).collect())
    shard_of, shard, filled = [], 0, 0
    for c in range(CELLS):
        if filled and filled + heights.get(c, 0) > shard_bytes:
            shard, filled = shard + 1, 0
        filled += heights.get(c, 0)
        shard_of.append(shard)
    return shard + 1, F.element_at(F.lit(shard_of), cell + 1)


def write(
    df: DataFrame, path: str, min_revisit: int = MIN_REVISIT, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES
) -> dict:
    """Writes (page_id, url, html) below ``path``, a folder all machines reach; returns the manifest."""
    shards, shard = _shards(df, shard_bytes)
    records = plan_records(df, min_revisit).withColumn("shard", shard)
    ordered = records.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "page_id", "url", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        attempt = f"{root}/_attempts/{uuid.uuid4().hex}"
        store.create_dir(attempt, recursive=True)
        buffer, state = io.BytesIO(), {"shard": None, "roll": 0, "n": 0, "first": None, "last": None}

        def close() -> pa.RecordBatch:
            data = buffer.getvalue()
            name = f"shard-{state['shard']:06d}-{state['roll']:05d}.warc.gz"
            with store.open_output_stream(f"{attempt}/{name}", compression=None) as out:
                out.write(data)
            line = {
                "name": name,
                "written": f"{attempt}/{name}",
                "bytes": len(data),
                "sha256": hashlib.sha256(data).hexdigest(),
                "records": state["n"],
                "first_id": state["first"],
                "last_id": state["last"],
            }
            buffer.seek(0)
            buffer.truncate()
            state.update(roll=state["roll"] + 1, n=0, first=None)
            return pa.RecordBatch.from_pylist([line], schema=_MANIFEST)

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, n_bytes, digest, refers_to, its_shard = (c[i].as_py() for c in batch.columns)
                if its_shard != state["shard"]:
                    if state["n"]:
                        yield close()
                    state.update(shard=its_shard, roll=0)
                buffer.write(_member(record(page_id, url, payload or b"", n_bytes, digest, refers_to)))
                state.update(n=state["n"] + 1, first=page_id if state["first"] is None else state["first"], last=page_id)
                if buffer.tell() >= roll_bytes:
                    yield close()
        if state["n"]:
            yield close()

    lines = ordered.select("page_id", "url", "payload", "payload_bytes", "digest", "refers_to", "shard").mapInArrow(
        run, "name string, written string, bytes long, sha256 string, records long, first_id long, last_id long"
    )
    files = sorted((r.asDict() for r in lines.collect()), key=lambda r: r["name"])  # one line a file of roll_bytes
    return _commit(path, files)


_MANIFEST = pa.schema(
    [
        ("name", pa.string()),
        ("written", pa.string()),
        ("bytes", pa.int64()),
        ("sha256", pa.string()),
        ("records", pa.int64()),
        ("first_id", pa.int64()),
        ("last_id", pa.int64()),
    ]
)


def _commit(path: str, files: list[dict]) -> dict:
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    for f in files:
        store.move(f.pop("written"), f"{root}/{f['name']}")
    manifest = {"files": files, "records": sum(f["records"] for f in files)}
    with store.open_output_stream(f"{root}/_manifest.json.tmp") as out:
        out.write(json.dumps(manifest, indent=1, sort_keys=True).encode())
    store.move(f"{root}/_manifest.json.tmp", f"{root}/_manifest.json")
    return manifest


def parse(data: bytes, step: int = READ_BYTES) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of one archive file, a gzip member at a time.

    A member is fed ``step`` bytes at a time, so what it leaves for the next one
    is no more than that, however long the file.
    """
    view, at, left = memoryview(data), 0, b""
    while left or at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if not left:
                if at >= len(view):
                    raise ValueError("archive ends inside a record")
                left, at = view[at : at + step], at + step
            parts.append(member.decompress(left))
            left = member.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a committed archive.

    Lengths and digests of responses are taken from the payload and must agree
    with the headers.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    store, root = fs.FileSystem.from_uri(path)
    with store.open_input_stream(f"{root}/_manifest.json") as f:
        manifest = json.loads(f.read())
    if not manifest["files"]:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out = []
                for headers, block in parse(content.as_py()):
                    size, digest = int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"]
                    revisit = headers["WARC-Type"] == "revisit"
                    if not revisit:
                        payload = block.partition(b"\r\n\r\n")[2]
                        found = _base32(hashlib.sha1(payload).hexdigest())
                        if (len(payload), found) != (size, digest):
                            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
                    page_id, refers_to = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                    out.append(
                        (
                            int(page_id) if page_id is not None else None,
                            size,
                            base64.b32decode(digest.removeprefix("sha1:")).hex(),
                            headers["WARC-Type"],
                            int(refers_to) if refers_to is not None else None,
                        )
                    )
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                )

    return files.mapInArrow(run, schema)
