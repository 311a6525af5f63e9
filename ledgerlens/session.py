"""Session conventions and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

# Adaptive execution picks partition counts and splits skewed joins at run time, so
# there are no machine-specific numbers here. The method limit is the size up to which
# the Java virtual machine compiles a method; larger stages run faster without fusing.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

CHECKPOINT_DIR = "spark.checkpoint.dir"


def local_session(
    cores: int | str = "*", app: str = "ledgerlens", hive: bool = False, **conf: str
) -> SparkSession:
    """Session for tests and the bench; clusters bring their own through spark-submit.

    ``hive`` keeps tables in a Hive metastore, where Spark was built with it.
    """
    quiet = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**DEFAULTS, **quiet, **conf}.items():
        builder = builder.config(key, value)
    if hive:
        builder = builder.enableHiveSupport()
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder name under the shared checkpoint folder of the cluster.

    Only on one machine, and where no such folder is configured (tests), a temporary one is
    set for the rest of the session; on a cluster that is an error. Frames that read work
    tables are lazy, so the tables stay until that folder is expired, except for those made
    inside :func:`work_space`.
    """
    context = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ledgerlens-")
        context.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/ledgerlens/{label}-{uuid.uuid4().hex}"
    for made in _OPEN_SPACES:
        made.append(path)
    return path


_OPEN_SPACES: list[list[str]] = []


@contextmanager
def work_space(spark: SparkSession) -> Iterator[None]:
    """Removes the work folders that were made inside, for jobs that write their result."""
    made: list[str] = []
    _OPEN_SPACES.append(made)
    try:
        yield
    finally:
        _OPEN_SPACES.remove(made)
        for path in made:
            remove_folder(spark, path)


def remove_folder(spark: SparkSession, path: str) -> None:
    files, place = _located(spark, path)
    files.delete(place, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    files, place = _located(spark, path)
    return files.exists(place)


def claim_file(spark: SparkSession, path: str) -> bool:
    """Makes an empty file; False if somebody else has made it, however close in time.

    Shared file systems refuse to create a file over another one. On the local one Hadoop
    looks before it creates, so the system call that does both is used there.
    """
    files, place = _located(spark, path)
    if files.getScheme() == "file":
        local = Path(place.toUri().getPath())
        local.parent.mkdir(parents=True, exist_ok=True)
        try:
            local.open("x").close()
        except FileExistsError:
            return False
        return True
    try:
        files.create(place, False).close()
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _located(spark: SparkSession, path: str) -> tuple:
    """File system and path as Hadoop knows them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def cut_lineage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Unlike a checkpoint the table stays columnar, so every later use reads only the
    columns it needs, and a lost executor costs a re-read instead of a re-computation.
    """
    spark = df.sparkSession
    path = work_folder(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
