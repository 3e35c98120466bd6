"""WARC archives by a deterministic sharded writer, and their reader.

Records are dealt to shards by ranges of their id, digest and url, cut where the
bytes before reach a shard's size; each shard rolls to a new file at a compressed size. Both
depend on the records alone, so a rerun writes the same bytes. Tasks write under
temporary names and report what they wrote; the reports of successful attempts
form the manifest, from which files are renamed and which is written last.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetloom.llm.common import Batches, small_batches, text_of
from assetloom.session import cut_lineage

LEAST_PAYLOAD = 100  # bytes from which equal payloads are stored once
SHARD_BYTES, MOST_SHARDS = 1 << 26, 1 << 16  # bytes of a shard; more of them where there would be more shards
HEAD_BYTES = 700  # of a record without its payload, about
FILES_PER_TASK = 64  # renamed by one task
FILE_BYTES = 1 << 24  # compressed bytes at which a file is closed
DATE = "2024-02-01T00:00:00Z"  # a parameter, so that reruns agree
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID(int=0)
_CHUNK = 1 << 20

_MANIFEST = "shard long, roll long, temporary string, name string, records long, bytes long, sha256 string"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id} {digest}')}>"


def _one_line(value: str) -> str:
    """Blanks and control characters, which a header value may not hold everywhere, in percent coding."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(
    page_id: int | None, url: str | None, payload: bytes, n: int, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One WARC record: an HTTP response, or a revisit that holds only its headers (``payload`` is not read then)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _rows(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, n, digest)``: a null page is empty."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_of("html").alias("html"))
    return rows.withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})


def references(light: DataFrame, least_payload: int) -> DataFrame:
    """``(d, least)``: digests met more than once, and the smallest id of their rows.

    Counts are folded before the shuffle; most digests occur once and go no further.
    """
    found = light.where(F.col("n") >= least_payload).groupBy(F.col("digest").alias("d"))
    found = found.agg(F.count(F.lit(1)).alias("times"), F.min("page_id").alias("least")).where("times > 1")
    return cut_lineage(found.select("d", "least"), "warc-repeated")


def _key() -> Column:
    """Page id (none first), digest, hash of the url and a number among equal rows, as text that sorts like them.

    A missing or much repeated id is so cut by its digests and urls, and rows
    alike in all of these, which are alike in the archive, by their numbers.
    """
    biased = F.col("page_id").bitwiseXOR(F.lit(-(2**63)).cast("long"))
    digits = lambda n, width: F.lpad(F.hex(n), width, "0")
    return F.concat(
        F.when(F.col("page_id").isNull(), "0").otherwise(F.concat(F.lit("1"), digits(biased, 16))),
        F.lit("-"),
        F.substring("digest", 1, 16),
        digits(F.xxhash64("url"), 16),
        digits(F.pmod(F.monotonically_increasing_id(), F.lit(256)), 2),
    )


def shard_starts(light: DataFrame, shard_bytes: int | None) -> list[str]:
    """The key of each shard's first record after the first shard, from running sums of bytes in key order.

    Sums are taken within range slices and shifted by the slices before. One
    key per shard reaches the driver, for ``MOST_SHARDS`` at most.
    """
    keys = light.groupBy("key").agg(F.sum(F.col("n") + HEAD_BYTES).alias("n"))
    sliced = cut_lineage(keys.repartitionByRange("key").withColumn("slice", F.spark_partition_id()), "warc-slices")
    if shard_bytes is None:
        total = sliced.agg(F.sum("n")).first()[0] or 0
        shard_bytes = max(SHARD_BYTES, -(-total // MOST_SHARDS))
    before = Window.partitionBy("one").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sliced.groupBy("slice").agg(F.sum("n").alias("total")).withColumn("one", F.lit(1))
    shift = sums.select("slice", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("slice").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0))).join(shift, "slice")
    shard = F.floor((F.col("ahead") + F.col("shift")) / shard_bytes)
    starts = placed.groupBy(shard.alias("shard")).agg(F.min("key").alias("first")).where("shard > 0")
    return sorted(starts.select("first").toArrow().column(0).to_pylist())


def _shard_of(starts: list[str]):
    """The shard of a record's key."""
    first = np.array(starts, "U")

    @F.pandas_udf("long")
    def shard(key):
        return pd.Series(np.searchsorted(first, key.to_numpy().astype("U"), "right"))

    return shard("key")


class _Roll:
    """One file being written under a temporary name."""

    def __init__(self, fs, folder: str, shard: int, roll: int, attempt: str) -> None:
        self.shard, self.roll, self.records, self.bytes = shard, roll, 0, 0
        self.name = f"shard-{shard:06d}-{roll:05d}.warc.gz"
        self.temporary = f"_temporary-files/{attempt}-{self.name}"
        self.out, self.sha = fs.open_output_stream(f"{folder}/{self.temporary}"), hashlib.sha256()

    def add(self, plain: bytes) -> None:
        packed = gzip.compress(plain, 6, mtime=0)  # a member of its own for each record
        self.out.write(packed)
        self.sha.update(packed)
        self.records, self.bytes = self.records + 1, self.bytes + len(packed)

    def close(self) -> tuple:
        self.out.close()
        return (self.shard, self.roll, self.temporary, self.name, self.records, self.bytes, self.sha.hexdigest())


def write_archive(
    pages: DataFrame,
    folder: str,
    shard_bytes: int | None = None,
    file_bytes: int = FILE_BYTES,
    least_payload: int = LEAST_PAYLOAD,
    date: str = DATE,
) -> DataFrame:
    """Write every row as a record below ``folder`` and return the manifest.

    Of equal payloads of ``least_payload`` bytes or more, the one with the
    smallest id is stored and the others are revisits that refer to it. Repeated
    rows of that id are all stored; a row without an id refers to one with an id.
    Within a shard, records are in order of id, then digest, url; rows without an
    id come first. Shards hold ``shard_bytes``, or ``SHARD_BYTES`` and more where
    there would be over ``MOST_SHARDS`` of them. ``folder`` is reached from all executors
    by any file system that Arrow knows. A lost task is run again under another
    temporary name. An empty table gives an archive without files.
    """
    spark, rows = pages.sparkSession, _rows(pages).withColumn("key", _key())
    light = cut_lineage(rows.select("page_id", "n", "digest", "key"), "warc-digests")
    again, starts = references(light, least_payload), shard_starts(light, shard_bytes)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    met = rows.join(again, (F.col("digest") == F.col("d")) & (F.col("n") >= least_payload), "left")
    # Payloads of revisits stay behind: a large group of copies moves one body.
    body = F.when(refers.isNull(), F.col("html")).alias("html")
    records = met.select(_shard_of(starts).alias("shard"), "page_id", "url", body, "n", "digest", refers.alias("refers_to"))

    def write(batches: Batches) -> Batches:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(f"{base}/_temporary-files", recursive=True)
        attempt, now, done = uuid.uuid4().hex, None, []
        for batch in small_batches(batches):
            for shard, page_id, url, page, n, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.shard != shard or now.bytes >= file_bytes:
                    roll = now.roll + 1 if now is not None and now.shard == shard else 0
                    if now is not None:
                        done.append(now.close())
                    now = _Roll(fs, base, shard, roll, attempt)
                now.add(record(page_id, url, (page or "").encode(), n, digest, refers, date))
        if now is not None:
            done.append(now.close())
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        columns = zip(*done, strict=True) if done else [[]] * len(kinds)
        names = ["shard", "roll", "temporary", "name", "records", "bytes", "sha256"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    # A task writes one shard: as much as a shard holds, however many there are.
    dealt = records.repartitionById(len(starts) + 1, F.col("shard").cast("int"))
    dealt = dealt.sortWithinPartitions("page_id", "digest", "url")
    wrote = dealt.mapInArrow(write, _MANIFEST)
    # Only what successful attempts report is part of the written table.
    manifest = cut_lineage(wrote, "warc-manifest")

    def rename(batches: Batches) -> Batches:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source, target = f"{base}/{row['temporary']}", f"{base}/{row['name']}"
                if fs.get_file_info(source).type == pyarrow.fs.FileType.File:
                    fs.move(source, target)
                elif fs.get_file_info(target).size != row["bytes"]:
                    raise OSError(f"{row['name']} was not committed")
            yield batch

    # Numbered, as adaptive execution would leave so few bytes to one task.
    tasks = -(-manifest.count() // FILES_PER_TASK) or 1
    committed = manifest.repartition(tasks, "name").mapInArrow(rename, _MANIFEST).drop("temporary")
    committed.write.json(f"{folder}/_manifest")
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{base}/_temporary-files").type == pyarrow.fs.FileType.Directory:
        fs.delete_dir(f"{base}/_temporary-files")  # what failed attempts left
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    schema = "shard long, roll long, name string, records long, bytes long, sha256 string"
    return spark.read.schema(schema).json(f"{folder}/_manifest")


def _members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one at a time."""
    inflate, parts, held = zlib.decompressobj(31), [], b""
    while True:
        data = held or stream.read(_CHUNK)
        held = b""
        if not data:
            break
        parts.append(inflate.decompress(data))
        if inflate.eof:
            yield b"".join(parts)
            held, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []
    if parts:
        raise EOFError("the archive ends inside a record")


def parse(plain: bytes) -> dict:
    """Headers and block of one record; its lengths and digests are checked."""
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    http, _, payload = block.partition(b"\r\n\r\n")
    own = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    number = lambda name: int(fields[name]) if name in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"damaged payload {fields.get('WARC-Record-ID')}")
    return {
        "page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": int(own["Content-Length"]),
        "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"),
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


_RECORDS = {
    "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary(),
}


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archive, checked; a file is streamed, one record at a time.

    ``payload`` is null for revisits, whose payload is that of ``refers_to``;
    ``url`` has blanks, control characters and percent signs in percent coding.
    """

    def work(batches: Batches) -> Batches:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{name}") as stream:
                    held, size = [], 0
                    for plain in _members(stream):
                        held.append(parse(plain))
                        size += len(plain)
                        if size >= 4 << 20:
                            yield _batch(held)
                            held, size = [], 0
                    yield _batch(held)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    files = read_manifest(spark, folder).select("name")
    # As many tasks as files: a file is one task's work, however small its row of the manifest.
    return files.repartition(max(1, files.count()), "name").mapInArrow(work, schema)


def _batch(held: list[dict]) -> pa.RecordBatch:
    arrays = [pa.array([h[n] for h in held], k) for n, k in _RECORDS.items()]
    return pa.RecordBatch.from_arrays(arrays, list(_RECORDS))
