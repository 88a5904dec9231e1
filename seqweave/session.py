"""Session helpers: the shared folder, written intermediate tables, shipping the package to workers."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The share of the driver's memory that its heap may take up before garbage is collected at the next written table.
HEAP_SHARE = 0.4

_own_dir: str | None = None
_shipped: set[str] = set()


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqweave")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and all of it runs in one process (``local[...]``, tests) a folder of this process is
    used, removed at exit. A cluster that names none is an error: no folder of one machine could be read by the others.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _own_dir
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="seqweave-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


class Written:
    """A table written to the shared folder; ``df`` reads it, ``drop`` removes the files once nothing reads them."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)
        _scopes[-1].append(self)

    def drop(self) -> None:
        for s in _scopes:
            if self in s:
                s.remove(self)
        remove(self.spark, self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of the file system it is on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: The written tables that still stand, by open scope; the first holds those that no scope will remove.
_scopes: list[list[Written]] = [[]]


@contextmanager
def tables() -> Iterator[list[Written]]:
    """Tables written inside are dropped at its end, but those put into the list it gives, which the scope around it takes over.

    An operator keeps what its result reads; whoever runs a query to its end encloses it to leave nothing behind.
    """
    kept: list[Written] = []
    _scopes.append([])
    try:
        yield kept
    finally:
        own = _scopes.pop()
        _scopes[-1].extend(w for w in kept if w in own)
        for w in own:
            if w not in kept:
                w.drop()


@atexit.register
def sweep() -> None:
    """Removes every table that still stands: at the end of the session at the latest, or once all results were consumed."""
    for w in [w for s in _scopes for w in s]:
        try:
            w.drop()
        except Exception:  # the session has ended before; its cluster's folder goes with it
            break


def write_table(df: DataFrame, label: str) -> Written:
    """Cuts the lineage: writes ``df`` once, to files that outlive any executor. Nobody else reads them, so no success mark is left."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    relieve(df.sparkSession)
    return Written(df.sparkSession, path, df.schema)


def written(df: DataFrame, label: str) -> Written:
    """The written table that ``df`` reads as it stands, otherwise ``df`` written now."""
    return next((w for s in _scopes for w in s if w.df is df), None) or write_table(df, label)


def release(spark: SparkSession) -> None:
    """Lets the driver notice that nothing refers to earlier shuffles any more, so that their files go before the query ends."""
    gc.collect()
    spark._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """As :func:`release`, once the driver's heap has grown beyond HEAP_SHARE: left alone it grows to its limit with the garbage
    of plans and tasks of a long run, which collecting gives back to the system."""
    runtime = spark._jvm.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        release(spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Makes the package importable in the executors' Python workers."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="seqweave-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "seqweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("seqweave", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
