"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(master: str | None = None, app: str = "cuadro",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build one for local runs and tests.

    On a cluster the session comes from the launcher and only the SQL settings below are
    applied; nothing here touches resource or storage settings that the cluster owns.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        configure(active, shuffle_partitions)
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark, shuffle_partitions)
    return spark


def configure(spark: SparkSession, shuffle_partitions: int | None = None) -> None:
    """SQL settings the operators assume (UTC wall clock, AQE on)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    ship_package(spark)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    It is read from the session. Where it is unset, a local master (tests) gets a fresh
    folder; any other master raises, because executors cannot see the driver's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="cuadro-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared checkpoint folder, removed when the driver's Python ends
    (or before, by ``release_scratch``)."""
    base = checkpoint_dir(spark).rstrip("/")
    path = f"{base}/cuadro/{name}-{uuid.uuid4().hex[:12]}"
    if not _SCRATCH:
        atexit.register(_at_exit)
    _SCRATCH.append(path)
    return path


def scratch_count() -> int:
    """How many scratch folders this driver holds; see ``release_scratch``."""
    return len(_SCRATCH)


def release_scratch(since: int = 0, keep_last: bool = False) -> None:
    """Delete the scratch folders of this driver (those after the first ``since``, but with ``keep_last`` not
    the newest). Frames that read them cannot be used afterwards."""
    context, jvm = SparkContext._active_spark_context, SparkContext._jvm
    if jvm is None:
        return
    conf = context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()
    kept = _SCRATCH[-1:] if keep_last and len(_SCRATCH) > since else []
    while len(_SCRATCH) > since:
        name = _SCRATCH.pop()
        if name not in kept:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
    _SCRATCH.extend(kept)


def _at_exit() -> None:
    with contextlib.suppress(Py4JError, OSError):        # the JVM may be gone already
        release_scratch()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Cuts lineage like a reliable checkpoint: a lost executor re-reads files instead of
    recomputing, and several consumers share one evaluation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Functions run in the workers are pickled by module name, so the package must be importable
    there whatever folder the driver was started from.
    """
    sc = spark.sparkContext
    if getattr(sc, "_cuadro_shipped", None):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    holder = tempfile.TemporaryDirectory(prefix="cuadro-py-")   # kept: the driver serves the file
    archive = os.path.join(os.path.realpath(holder.name), f"cuadro-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for root, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(archive)
    sc._cuadro_shipped = holder


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread_for_cpu(df: DataFrame) -> DataFrame:
    """Spread CPU-heavy per-row work over the task slots when the input has fewer partitions.

    A small table in one file is one task; tokenising or vector scoring it would use one core.
    Large inputs already have more splits than slots, so they are returned unchanged (no
    shuffle is added at scale).
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "Exchange" in plan:
        # already spread over the shuffle partitions; counting them would run the stages
        return df
    if df.rdd.getNumPartitions() < slots:      # a scan-only plan: no job runs here
        return df.repartition(slots)
    return df


BROADCAST_BYTES = 64 << 20        # what is broadcast by name at most


def small(df: DataFrame, row_bytes: int = 64, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the counted rows can be broadcast. Spark's own estimate comes from file sizes and counts wide
    columns that are not read."""
    return df.count() * row_bytes <= limit
