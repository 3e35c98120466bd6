"""Session defaults and the shared working folder used to cut long lineages."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Only settings that differ from Spark's defaults.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join may need one more exchange above it; splitting still wins.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Sessions of a hot user are folded before the shuffle.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


_local_folders: dict[str, str] = {}
_scope: ContextVar[str | None] = ContextVar("work_scope", default=None)


def build_session(app_name: str = "assetloom", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder is made only for local masters without the setting; a
    cluster without it is a configuration error, not something to paper over.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="assetloom-")
    return _local_folders[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the folder of the current ``work_scope``, else below the shared folder."""
    return f"{_scope.get() or shared_folder(spark) + '/assetloom'}/{label}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


@contextmanager
def work_scope(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside go to one folder, which is deleted at the end.

    Use results inside, or write them elsewhere: they read from these tables.
    """
    folder = f"{shared_folder(spark)}/assetloom/job-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        delete_path(spark, folder)


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


# Shuffle files go with the query that made them; written tables are packed more tightly.
_SPARING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


@contextmanager
def sparing_disk(spark: SparkSession) -> Iterator[None]:
    """Queries run and streams started inside take less disk.

    Otherwise shuffle files stay until the driver collects its garbage. Do not
    run one DataFrame twice inside: its shuffles would have to be made again.
    """
    before = {key: spark.conf.get(key, None) for key in _SPARING}
    for key, value in _SPARING.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@contextmanager
def written(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``df`` as ``cut_lineage`` gives it, deleted at the end."""
    path = work_path(df.sparkSession, label)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        delete_path(df.sparkSession, path)


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Later jobs start from files that outlive lost executors, and the scan has
    real size statistics, so the planner's broadcast decision is size-checked.
    """
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The written rounds of an iteration, one folder each below a common one."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.path, self.number, self.schema = spark, work_path(spark, label), 0, None

    def add(self, df: DataFrame, counted: str = "true") -> tuple[DataFrame, int]:
        """Write the next round; give it back with the number of ``counted`` rows the write saw."""
        seen = Observation()
        target = f"{self.path}/round={self.number}"
        df.observe(seen, F.count_if(F.expr(counted)).alias("rows")).write.parquet(target)
        self.number, self.schema = self.number + 1, df.schema
        return self.spark.read.schema(df.schema).parquet(target), seen.get["rows"]

    def before(self, number: int) -> DataFrame:
        """The rounds before ``number``; later folders are not read."""
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/round={i}" for i in range(number)])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).drop("round")
