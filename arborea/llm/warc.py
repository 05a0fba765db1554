"""A deterministic sharded WARC writer, and the reader of its archives.

Writing: records are range-sorted by page and digest, so a shard is a contiguous range of pages. Within a shard a file is
closed once its compressed size passes a limit. Headers and digests are made anew from the payload; nothing
depends on the clock or on chance, so a task that runs again writes the same bytes. A file is written under a temporary
name and renamed when it is whole; the manifest, written by Spark's own commit, names the files that count.

Of payloads that are equal and have at least ``REVISIT`` bytes, the record of the largest page_id is the response, the
others revisit it. Equality is that of SHA-256; the archive's own payload digest is SHA-1, as the format has it.

Reading: the files that the manifest names, one row a file, record by record; block and payload digests are
verified, and revisits are resolved to their response by record id.

Defined cases: a null html is an empty payload; a null url becomes ``urn:page:<page_id>``; control characters, blanks and
non-ASCII in a url are percent-encoded; a null page_id comes before every other; of repeated rows with one page_id and
payload the first is the response; payloads of any length are written whole, one record in memory at a time; other columns,
whatever their names, are not looked at; an empty table gives archives without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Scratch, text_bytes, bounded_batches

#: Bytes from which equal payloads are revisits; compressed bytes of a file; bytes of text in a shard; zlib level.
REVISIT, ROLL, SHARD_BYTES, LEVEL = 1000, 8_000_000, 16_000_000, 6
#: Groups of equal payloads (48 bytes each) up to which they are broadcast, so that payloads are shuffled once; beyond, twice.
BROADCAST_GROUPS = 200_000
DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_NAMESPACE = uuid.UUID("6f1b1f0c-5f0b-5d4c-9a4e-2b6d6c1f7a10")


def _fs(uri: str):
    """File system and path of a folder that Spark names by a URI or a plain path."""
    if not re.match(r"[a-z0-9]+:", uri):
        return arrow_fs.LocalFileSystem(), uri
    return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def sha1_text(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}:{digest.hex()}')}>"


def safe_uri(url: str | None, page_id) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return re.sub(rb"[^\x21-\x7e]", lambda m: b"%%%02X" % m[0][0], url.encode("utf-8", "surrogatepass")).decode("ascii")


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member without a time stamp."""
    lines = [("WARC-Type", kind), ("WARC-Date", DATE), *headers, ("WARC-Block-Digest", sha1_text(block)), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("ascii") + b"\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


def page_record(page_id, url, payload: bytes, sha256: bytes, refers_to=None, revisit: bool = False) -> bytes:
    http = _HTTP % len(payload)
    headers = [("WARC-Record-ID", record_id(page_id, sha256 + bytes([revisit]))), ("WARC-Target-URI", safe_uri(url, page_id)), ("WARC-Payload-Digest", sha1_text(payload)), ("Content-Type", "application/http; msgtype=response"), ("X-Page-ID", "" if page_id is None else str(page_id))]
    if revisit:
        headers += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, sha256 + b"\0"))]
        return record("revisit", headers, http)
    return record("response", headers, http + payload)


def settle(where, temp: str, final: str, size: int) -> None:
    """Gives a whole file its name. An earlier attempt of the task may have done so already: its bytes are the same."""
    there = where.get_file_info(final)
    if there.type == arrow_fs.FileType.File and there.size == size:
        where.delete_file(temp)
        return
    if there.type == arrow_fs.FileType.File:  # of another run into this folder
        where.delete_file(final)
    where.move(temp, final)


_MANIFEST = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])


def _write(folder: str):
    def run(batches):
        where, root = _fs(folder)
        shard, number, out, last = TaskContext.get().partitionId(), 0, None, None

        def begin():
            name = f"pages-{shard:06d}-{number:04d}.warc.gz"
            temp = f"{root}/.{name}.{uuid.uuid4().hex}"
            sink = where.open_output_stream(temp)
            info = record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, name)}>"), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            sink.write(info)
            return [name, temp, sink, 0, len(info), hashlib.sha256(info)]

        def end(o):
            o[2].close()
            settle(where, o[1], f"{root}/{o[0]}", o[4])
            return pa.RecordBatch.from_pydict({"file": [o[0]], "records": [o[3]], "bytes": [o[4]], "sha256": [o[5].hexdigest()]}, schema=_MANIFEST)

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "payload", "sha256", "keep_id", "n"))
            for page_id, url, payload, sha, keep, n in (tuple(x.as_py() for x in r) for r in zip(*columns)):
                again = last == (page_id, sha)  # a repeated row lies next to the first
                last = (page_id, sha)
                revisit = (n or 1) > 1 and (keep != page_id or again)
                raw = page_record(page_id, url, payload, sha, keep, revisit)
                out = out or begin()
                out[2].write(raw)
                out[5].update(raw)
                out[3], out[4] = out[3] + 1, out[4] + len(raw)
                if out[4] >= ROLL:
                    yield end(out)
                    out, number = None, number + 1
        if out:
            yield end(out)

    return run


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives and their manifest into ``folder``; returns the manifest: file, records, bytes, sha256."""
    spark = pages.sparkSession
    bounded_batches(pages)
    where, root = _fs(folder)
    where.create_dir(root, recursive=True)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    groups = src.filter(F.octet_length("payload") >= REVISIT).groupBy("sha256").agg(F.max("page_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1")
    groups = Scratch(spark, "warc-groups").write(groups, "groups")
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    shards = max(1, -(-text_bytes(pages, html) // SHARD_BYTES))
    dealt = src.join(groups, "sha256", "left").repartitionByRange(shards, "page_id", "sha256").sortWithinPartitions("page_id", "sha256")
    manifest = dealt.mapInArrow(_write(folder), "file string, records long, bytes long, sha256 string")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def members(raw: bytes):
    """The gzip members of a file, each unpacked whole."""
    view, at = memoryview(raw), 0
    while at < len(raw):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            part = view[at : at + 65536]
            if not len(part):
                raise ValueError("the archive ends within a record")
            parts.append(inflate.decompress(part))
            at += len(part) - len(inflate.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the block's digest and length are verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("ascii").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or sha1_text(block) != headers["WARC-Block-Digest"]:
        raise ValueError("the record is damaged")
    return headers, block


_RECORDS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("uri", pa.string()), ("payload", pa.binary())])


def _read(with_payload: bool):
    schema = _RECORDS if with_payload else pa.schema(list(_RECORDS)[:-1])

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for raw in members(content.as_py()):
                    headers, block = parse(raw)
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and sha1_text(payload) != headers["WARC-Payload-Digest"]:
                        raise ValueError("a payload is damaged")
                    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    rows.append((headers["WARC-Record-ID"], int(headers["X-Page-ID"]) if headers["X-Page-ID"] else None, kind, headers.get("WARC-Refers-To"), digest, None if payload is None else len(payload), headers["WARC-Target-URI"], payload)[: len(schema)])
                    held += len(raw)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run, "record_id string, page_id long, record_type string, refers string, payload_digest string, payload_bytes long, uri string" + ", payload binary" * with_payload


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """Every page record of the files in the manifest; payload and payload_bytes are null for revisits."""
    manifest = spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    named = files.withColumn("file", F.substring_index("path", "/", -1)).join(manifest.select("file"), "file", "left_semi")
    run, schema = _read(with_payload)
    return named.select("content").mapInArrow(run, schema)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, as read back from the archives."""
    scratch = Scratch(pages.sparkSession, "warc")
    write_archives(pages, scratch.path("archives"))
    found = scratch.write(read_archives(pages.sparkSession, scratch.path("archives"), with_payload=False), "records")
    answers = found.filter("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full"))
    asked = found.filter("record_type = 'revisit'").select("refers").distinct()
    return found.join(answers.join(asked, "refers"), "refers", "left").select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS keep_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep_id THEN NULL ELSE keep_id END AS refers_to FROM k
"""
