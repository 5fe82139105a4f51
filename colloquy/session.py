"""Session set-up that every entry point shares."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: SparkContexts (by application id) that already received the package.
_shipped: set[str] = set()
_own_folders: set[str] = set()
PACKAGE = Path(__file__).resolve().parent


def build_session(app: str = "colloquy", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators rely on: UTC, AQE and Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship_package(spark: SparkSession | None = None) -> None:
    """Send this package to the executors' Python workers, once per application; the active session's without another.

    Functions that run on executors are pickled by reference; ``addPyFile``
    makes the package importable there whatever the worker's own path is.
    Whatever makes a Python function for executors calls this.
    """
    sc = (spark or SparkSession.active()).sparkContext
    if sc.applicationId in _shipped:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, str(path.relative_to(PACKAGE.parent)))
    folder = tempfile.mkdtemp(prefix="colloquy-ship-")
    target = os.path.join(folder, "colloquy_package.zip")
    Path(target).write_bytes(buffer.getvalue())
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def batch_function(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function from Arrow arrays to an Arrow array as one from columns to a column; the package goes to the workers with it."""

    def wrap(run: Callable) -> Callable[..., Column]:
        def apply(*columns: Column) -> Column:
            ship_package()
            return F.arrow_udf(run, returns)(*columns)

        return apply

    return wrap


def map_batches(rows: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with the package on the workers."""
    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the setting is absent a temporary folder is taken and set for the
    context, but only if everything runs on one machine: on a cluster that is an
    error, as other machines would not see the folder.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="colloquy-checkpoint-"))
        found = sc.getCheckpointDir()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """``(file system, path)`` of the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of this application that goes when the application ends."""
    own = f"{shared_dir(spark)}/colloquy-{spark.sparkContext.applicationId}"
    if own not in _own_folders:
        files, where = _hadoop(spark, own)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _own_folders.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    files, where = _hadoop(spark, path)
    return files.exists(where)


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """``(name, size, time)`` of the files below a path."""
    files, where = _hadoop(spark, path)
    told, todo = [], [where]
    while todo:
        for status in files.listStatus(todo.pop()):
            if status.isDirectory():
                todo.append(status.getPath())
            else:
                told.append((status.getPath().getName(), status.getLen(), status.getModificationTime()))
    return told


def files_fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of names, sizes and times of a table's files, which tells whether it was written anew."""
    return hashlib.sha256(repr(sorted(_files(spark, path))).encode()).hexdigest()


#: Bytes for each core below which a table is dealt out before costly work on its rows.
FEW_BYTES = 32 << 20


def dealt_out(spark: SparkSession, rows: DataFrame, path: str) -> DataFrame:
    """The rows of a table, dealt out anew if it is small for the cores there are: it may have too few row groups for them. A large one is never shuffled."""
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if sum(n for _, n, _ in _files(spark, path)) < cores * FEW_BYTES else rows


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what was written below a path, if it is there."""
    files, where = _hadoop(spark, path)
    files.delete(where, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the path goes to Spark's reader as it is."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
