"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(master)
        .appName("hopline")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one in local mode where it is unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="hopline-")
        atexit.register(shutil.rmtree, root, True)
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that were not started in its folder; once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_hopline_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="hopline-code-")  # Spark serves it from here to executors that come later
    atexit.register(shutil.rmtree, folder, True)
    sc.addPyFile(shutil.make_archive(f"{folder}/hopline_code", "zip", package.parent, package.name))
    sc._hopline_shipped = True


def materialize(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in a folder for each value of ``by`` if given, and read it back.

    Cuts the lineage in a way that survives lost executors, and lets several consumers read one result.
    """
    path = f"{shared_dir(df.sparkSession)}/hopline/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(by) if by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._hopline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_hopline_path", None)
    if path:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def tidy_driver(spark: SparkSession) -> None:
    """Return memory that the driver's JVM does not use to the system.

    The heap keeps the size that garbage of past plans once needed until a full collection, and the C allocator keeps what was freed in each thread's arena.
    Where the JVM has no command for the latter, only the heap is collected.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.java.lang.System.gc()
    of = jvm.java.lang.Class.forName
    try:  # through the interface, as the server's own class is not open to reflection
        invoke = next(m for m in of("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except (Py4JError, StopIteration):
        pass
