"""Record folders of one JSON file per asset, as a Spark data source.

Each write task puts its files into a folder of its own beside the others, and
commits by renaming it: one rename per task, whatever the number of assets.
What failed or repeated attempts leave is never seen and goes with the commit.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from assetloom.sources.hub import CORRUPT, HUB_LINES, HubScan, record_lines, split_records

FORMAT = "asset_records"
# Files that one task reads, and bytes of text it hands over at once.
FILES_PER_TASK, BATCH_BYTES = 4096, 8 << 20
# Longest file name, in bytes, before a digest stands for its end.
LONGEST_NAME = 180

_PENDING = "_pending"


def file_name(name: str) -> str:
    """The file of an asset: its name with what a path cannot hold escaped; of a long one the head and a digest."""
    plain = quote(name, safe=" ()+,;=@[]{}~")
    if len(plain) > LONGEST_NAME:
        plain = f"{plain[: LONGEST_NAME - 33]}-{hashlib.md5(name.encode()).hexdigest()}"
    return f"{plain}.json"


def _opened(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    return fs, base.rstrip("/")


@dataclass
class _Files(InputPartition):
    paths: list[str]


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: int


class _Reader(DataSourceReader):
    """Files are listed once and dealt in runs; a task hands their texts over in bounded batches."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        fs, base = _opened(self.folder)
        found = fs.get_file_info(pyarrow.fs.FileSelector(base, recursive=True, allow_not_found=True))
        hidden = lambda path: any(part.startswith(("_", ".")) for part in path[len(base) :].split("/") if part)
        paths = sorted(f.path for f in found if f.is_file and f.path.endswith(".json") and not hidden(f.path))
        return [_Files(paths[i : i + FILES_PER_TASK]) for i in range(0, len(paths), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _opened(self.folder)
        paths, texts, held = [], [], 0
        for path in partition.paths:
            with fs.open_input_stream(path) as f:
                text = f.read().decode("utf-8", "replace")
            paths.append(path)
            texts.append(text)
            held += len(text)
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts)], ["name", "value"])
                paths, texts, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["name", "value"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite, self.job = folder, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = _opened(self.folder)
        own, files = f"{_PENDING}-{self.job}/{uuid.uuid4().hex}", 0
        fs.create_dir(f"{base}/{own}", recursive=True)
        for batch in iterator:
            for name, value in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_output_stream(f"{base}/{own}/{file_name(name)}") as f:
                    f.write(value.encode())
                files += 1
        return _Written(own, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = _opened(self.folder)
        older = [f for f in fs.get_file_info(pyarrow.fs.FileSelector(base)) if not f.base_name.startswith(_PENDING)] if self.overwrite else []
        for task, message in enumerate(messages):
            if message is not None and message.files:
                fs.move(f"{base}/{message.folder}", f"{base}/records-{self.job}-{task:06d}")
        for f in older:
            fs.delete_dir(f.path) if f.type == pyarrow.fs.FileType.Directory else fs.delete_file(f.path)
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Whatever lies in the job's pending folder is of failed or repeated attempts."""
        fs, base = _opened(self.folder)
        if fs.get_file_info(f"{base}/{_PENDING}-{self.job}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{base}/{_PENDING}-{self.job}")


class RecordFiles(DataSource):
    """``name`` and ``value``: a path and its text when read, an asset and its record when written."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def write_record_files(records: DataFrame, folder: str, overwrite: bool = True) -> None:
    """One file per record below ``folder``, in place of those of an earlier export or beside them.

    Names are unique, as in an export. Spark deals the records to tasks; a
    record with a large code costs its own file only.
    """
    records.sparkSession.dataSource.register(RecordFiles)
    lines = records.select("name", record_lines(records).alias("value"))
    lines.write.format(FORMAT).mode("overwrite" if overwrite else "append").save(folder)


def read_record_files(spark: SparkSession, folder: str) -> HubScan:
    """The records of such a folder; what is no record is named with the reason."""
    spark.dataSource.register(RecordFiles)
    raw = spark.read.format(FORMAT).load(folder)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return split_records(raw.select(F.from_json("value", HUB_LINES, options).alias("r"), F.col("name").alias("file_path")).select("r.*", "file_path"))
