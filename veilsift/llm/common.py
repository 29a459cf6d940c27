"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^ \t-\r]+"

#: Rows of a lookup table up to which it is broadcast; beyond, Spark shuffles both sides.
BROADCAST_ROWS = 100_000


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name below the cluster's shared checkpoint folder; without one, in local mode only, one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{base.rstrip('/')}/veilsift-{uuid.uuid4().hex}"
    for folders in _temporary[-1:]:
        folders.append(path)
    return path


#: Folders made within each open `temporary` block.
_temporary: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Scratch folders made within are deleted at the end: write what is to stay with durable() of an enclosing block."""
    _temporary.append([])
    try:
        yield
    finally:
        for folder in _temporary.pop():
            _delete(spark, folder)


def durable(df: DataFrame, path: str | None = None) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts the lineage and outlives lost executors."""
    path = path or scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def remove_scratch(df: DataFrame) -> None:
    """Delete the files behind a durable() frame that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/veilsift-" in folder:
            _delete(df.sparkSession, folder)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that have ended: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: by path in local mode, by an archive that Spark sends elsewhere."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parents[2]
    if context.master.partition("[")[0] == "local":
        env = context.environment
        if str(root) not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root), env.get("PYTHONPATH", "")]))
    elif not any(f.startswith("veilsift-code-") for f in context._python_includes):
        archive = Path(tempfile.mkdtemp()) / f"veilsift-code-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted((root / "veilsift").rglob("*.py")):
                z.write(file, file.relative_to(root))
        context.addPyFile(str(archive))


def integer_ids(docs: DataFrame) -> None:
    """Refuse a doc_id that is not of an integer type."""
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, IntegralType):
        raise TypeError(f"doc_id must be of an integer type, not {kind.simpleString()}")


def settle(spark: SparkSession) -> None:
    """Let executors return the heap that ended jobs have freed, which their JVMs keep while Python workers need memory.

    One short task a core asks the JVM it runs in for a full collection; an executor that gets none keeps its heap.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def give_back() -> None:
    """Return a worker's freed memory to the system: Spark keeps idle workers for a while."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, also where body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Words of a text (null: 0) as a long."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lookup(small: DataFrame, rows: int | None = None) -> DataFrame:
    """small, marked for broadcast if its counted rows are few; else left to a shuffled join."""
    n = small.count() if rows is None else rows
    return F.broadcast(small) if n <= BROADCAST_ROWS else small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
