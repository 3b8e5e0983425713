"""Session helpers: building a local session, shipping this package, shared tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


#: Most bytes of rows that go to a Python worker at once.
ARROW_BYTES = 8 << 20


def local_session(cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("filigree")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", conf.pop("driver_memory", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's sources to the executors (once per Spark context).

    Executors share no folder with the driver, so Python functions that refer to
    package modules need the package served by the driver.
    """
    context = spark.sparkContext
    # A batch of Arrow rows is held by the JVM and by a worker at once: 64 MB of text by default.
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    if getattr(context, "_filigree_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    handle, path = tempfile.mkstemp(prefix="filigree-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._filigree_shipped = True
    atexit.register(lambda: os.path.exists(path) and os.remove(path))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where unset, a new one of a local master."""
    context = spark.sparkContext
    given = context.getConf().get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not getattr(context, "_filigree_shared", None):
        if context.master.startswith("local-cluster") or not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context._filigree_shared = tempfile.mkdtemp(prefix="filigree-shared-")
    return context._filigree_shared


def shared_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once as Parquet (with the writer's options) in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no recomputation of what stands before.
    The table goes when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    def remove() -> None:
        try:
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the JVM may be gone already; nothing is left to clean up with
            pass

    atexit.register(remove)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; timestamps without zone are read as UTC."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
