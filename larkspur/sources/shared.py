"""Tables of a run: inputs by name, and intermediate results in the cluster's shared folder.

Intermediate tables replace cached lineage: they are written once through Spark's commit protocol into the
folder named by ``spark.checkpoint.dir`` and read again, so a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder (single-machine runs and tests).
DEFAULT_SHARED = "/tmp/checkpoints"
#: Bytes of a batch between Spark and a Python worker: each holds a few at a time.
BATCH = 8 << 20
#: The folder of this process below ``larkspur`` in the shared folder.
RUN = f"run-{uuid.uuid4().hex[:12]}"
_used: dict[str, Any] = {}  # runs' folders and the gateway that deletes them


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The input table ``name`` of ``sf_dir``, through Spark's reader."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this run, as a URI; sets a local one where the session has none.

    A local folder is shared only on one machine, so a session with other machines must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {master} share")
        found = f"file://{DEFAULT_SHARED}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def bounded(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers to BATCH bytes, unless the application names a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, BATCH)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table or folder in the shared folder. What is not removed before goes with the process."""
    run = f"{shared_dir(spark)}/larkspur/{RUN}"
    if not _used:
        atexit.register(cleanup)
    _used.setdefault(run, spark.sparkContext._gateway)
    return f"{run}/{name}-{uuid.uuid4().hex[:12]}"


def cleanup() -> None:
    """Delete all tables and folders of this process in the shared folder; at exit it happens by itself."""
    for run, gateway in list(_used.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone
            path = gateway.jvm.org.apache.hadoop.fs.Path(run)
            path.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
        if run.startswith("file://"):
            shutil.rmtree(run.removeprefix("file://"), ignore_errors=True)
        _used.pop(run)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return it as read from there."""
    spark = df.sparkSession
    bounded(spark)
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/larkspur/" in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def per_worker(key: Any, build: Callable[[], Any]) -> Any:
    """``build()``, made once in each Python worker process and kept there from one use to the next."""
    kept = sys.modules.setdefault("_larkspur_kept", types.ModuleType("_larkspur_kept")).__dict__
    if key not in kept:
        kept[key] = build()
    return kept[key]


def ship(spark: SparkSession, name: str, value: Any) -> Callable[[], Any]:
    """A function that gives ``value`` in every Python worker: broadcast once, loaded once by each worker.

    The value may be of this package's classes, which workers cannot import. A worker keeps the newest value of a name.
    """
    from pyspark import cloudpickle

    sent, mark = spark.sparkContext.broadcast(cloudpickle.dumps(value)), uuid.uuid4().hex

    def get() -> Any:
        slot = per_worker(("shipped", name), dict)
        if slot.get("mark") != mark:
            slot.update(mark=mark, value=cloudpickle.loads(sent.value))
        return slot["value"]

    return get
