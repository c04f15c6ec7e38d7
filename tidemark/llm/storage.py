"""Shared scratch storage and table access.

Intermediate results that must survive a lost executor go to the folder the
session names in ``spark.checkpoint.dir``. Only where that setting is absent
(local tests) does :func:`shared_root` choose a folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: While a table is written. Shuffle files of a query go when it has ended: what it wrote is in the shared folder.
#: Rows are read and go to Python in small batches, as whole texts and sets are long. The driver keeps the plan of each query as a
#: text, and writes it anew whenever a part of it has ended: of plans with a hundred operators, only the beginning.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.parquet.columnarReaderBatchSize": "1024", "spark.sql.maxPlanStringLength": "2000"}


def shared_root(spark: SparkSession) -> str:
    """Folder shared by the driver and all executors.

    Raises ``ValueError`` on a cluster without ``spark.checkpoint.dir``: a
    machine-local folder would not be seen by the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/tidemark-scratch"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_root(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def settings(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    try:
        for k, v in _SETTINGS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lean(run):
    """``run`` for ``mapInArrow``; when its rows have passed, the worker gives back what Arrow holds of them.

    Workers wait for the next task with all they once took, beside tasks that do not use Python.
    """

    def passed(batches):
        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return passed


def give_back(spark: SparkSession) -> str | None:
    """The driver's JVM gives back the native memory that it has freed; its report, None of a JVM that cannot.

    What compilers and readers of a query took would else stay with the process, in an arena of each thread.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kinds, args = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = jvm.java.lang.Class.forName(name)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # By the interface's method: the server's own class is not open to calls.
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
    try:
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return None


def write(df: DataFrame, path: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to ``path`` as Parquet and read it back; its shuffle files are removed."""
    with settings(df.sparkSession):
        df.write.parquet(path, compression=compression)
    give_back(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, tag: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting its lineage.

    The folder outlives the call, as a result may be read at any time, and is
    removed when the driver ends. Tables needed for a while go to a ``Scratch``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    atexit.register(_remove_late, spark, path)
    return write(df, path, compression)


def _remove_late(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        remove(spark, path)


class Scratch:
    """Tables of one run, under a folder of the shared storage that is removed when the run ends.

    ``with Scratch(spark, "tag") as space:`` then ``space.keep(df, name)`` writes and
    reads back, ``space.drop(kept)`` removes a table that is not needed any more.
    The settings for writing hold for all queries meanwhile.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.paths = spark, scratch_path(spark, tag), {}

    def __enter__(self) -> Scratch:
        self.held = settings(self.spark)
        self.held.__enter__()
        return self

    def __exit__(self, *_) -> None:
        self.held.__exit__(None, None, None)
        remove(self.spark, self.root)

    def keep(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        out = write(df, path, compression)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.paths[id(t)][0])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
