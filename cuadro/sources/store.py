"""The document store: named stores in versions that are switched atomically.

Under the base folder:

* ``data/version=<v>/store_name=<s>/``: texts and vectors of one write; never changed afterwards;
* ``manifests/<n>/``: which version each store has after the n-th write, with its counts.

A write adds a version, then a manifest under a temporary name, and switches by renaming that to the next
number, which fails if another writer took it (then the manifest is made again on top of the other's).
Until the rename nobody sees the write, so one that fails half-way leaves every store as it was. A reader
takes the highest number when its plan is made and keeps to the versions listed there, whatever is
written later. ``vacuum`` deletes versions that only old manifests name.

The base folder lives under the shared checkpoint folder unless the caller names one. Metadata are a
VARIANT: numbers and arrays stay what they are.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_dir

STORE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("page_content", T.StringType()),
    T.StructField("metadata", T.VariantType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("store_name", T.StringType()),
])
_DATA_SCHEMA = T.StructType([*STORE_SCHEMA.fields[:-1], T.StructField("version", T.StringType()), STORE_SCHEMA.fields[-1]])
MANIFEST_SCHEMA = "store_name string, version string, n_docs long, n_vecs long"
#: Writers that meet try again so often.
COMMIT_TRIES = 20


def default_store_base(spark: SparkSession) -> str:
    return checkpoint_dir(spark).rstrip("/") + "/cuadro/stores"


# ---- files -------------------------------------------------------------------------------------

def _files(spark: SparkSession, path: str):
    """(Hadoop path, file context) of a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    qualified = p.getFileSystem(conf).makeQualified(p)
    return qualified, jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf)


def _names(spark: SparkSession, path: str) -> list[str]:
    p, files = _files(spark, path)
    if not files.util().exists(p):
        return []
    return [status.getPath().getName() for status in files.util().listStatus(p)]


def _numbers(spark: SparkSession, base: str) -> list[int]:
    return sorted(int(n) for n in _names(spark, f"{base}/manifests") if n.isdigit())


def _switch(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder unless the target exists; whether it was done."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    plain = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    (src, files), (dst, _) = _files(spark, source), _files(spark, target)
    try:
        files.rename(src, dst, plain)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
            return False
        raise
    return True


# ---- manifest ----------------------------------------------------------------------------------

def manifest(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """store_name, version, n_docs, n_vecs after the given write, by default the last one."""
    base = base.rstrip("/")
    numbers = _numbers(spark, base) if number is None else [number]
    if not numbers:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(f"{base}/manifests/{numbers[-1]}")


def list_stores(spark: SparkSession, base: str) -> DataFrame:
    """Complete stores from the manifest: (store_name, n_docs, n_vecs); no document is read."""
    return manifest(spark, base).where((F.col("n_docs") > 0) & (F.col("n_vecs") > 0)).select("store_name", "n_docs", "n_vecs")


# ---- write -------------------------------------------------------------------------------------

def write_store(docs: DataFrame, base: str) -> None:
    """Write (or replace) the stores present in ``docs`` under ``base``, all at once.

    ``docs`` needs the columns of ``STORE_SCHEMA``; metadata may be a map or a struct. Rows are clustered by
    store with a REBALANCE hint, so each store's folder gets few files, while AQE still splits a
    store holding a large share of the rows over several tasks instead of one.
    """
    spark, base, version = docs.sparkSession, base.rstrip("/"), uuid.uuid4().hex
    cols = []
    for f in STORE_SCHEMA.fields:
        c = F.col(f.name)
        if not isinstance(f.dataType, T.VariantType):
            c = c.cast(f.dataType)
        elif not isinstance(docs.schema[f.name].dataType, T.VariantType):
            c = F.to_variant_object(c)
        cols.append(c.alias(f.name))
    docs.select(*cols).hint("rebalance", "store_name").write.partitionBy("store_name") \
        .parquet(f"{base}/data/version={version}", compression="zstd")
    _commit(spark, base, _read_version(spark, base, version).groupBy("store_name", "version").agg(
        F.count("page_content").alias("n_docs"), F.count("embedding").alias("n_vecs")))


def _commit(spark: SparkSession, base: str, written: DataFrame) -> None:
    """Make the stores of ``written`` (manifest rows) the current ones."""
    for _ in range(COMMIT_TRIES):
        last = (_numbers(spark, base) or [0])[-1]
        before = manifest(spark, base, last or None)
        kept = before.join(written.select(F.col("store_name").alias("_new")), F.col("store_name").eqNullSafe(F.col("_new")), "left_anti")
        draft = f"{base}/manifests/_draft-{uuid.uuid4().hex}"
        columns = ["store_name", "version", "n_docs", "n_vecs"]
        kept.select(*columns).unionByName(written.select(*columns)).write.parquet(draft)
        if _switch(spark, draft, f"{base}/manifests/{last + 1}"):
            return
    raise RuntimeError(f"{COMMIT_TRIES} other writes came between under {base}")


def vacuum(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Delete manifests older than the last ``keep`` and the versions that only they name; how many versions.

    Readers that still hold an older manifest lose it. Versions of writes that are not committed stay.
    """
    base = base.rstrip("/")
    numbers = _numbers(spark, base)
    old, kept = numbers[:-keep], numbers[-keep:]
    if not old:
        return 0
    versions = lambda ns: {r["version"] for n in ns for r in manifest(spark, base, n).select("version").distinct().collect()}
    unused = versions(old) - versions(kept)
    for path in [f"{base}/data/version={v}" for v in unused] + [f"{base}/manifests/{n}" for n in old]:
        p, files = _files(spark, path)
        files.delete(p, True)
    return len(unused)


# ---- read --------------------------------------------------------------------------------------

def _read_version(spark: SparkSession, base: str, version: str) -> DataFrame:
    return spark.read.schema(_DATA_SCHEMA).option("basePath", f"{base}/data").parquet(f"{base}/data/version={version}")


def read_store(spark: SparkSession, base: str, store: str | None = None) -> DataFrame:
    """All stores, or one (its folder only), as they are now."""
    base = base.rstrip("/")
    known = manifest(spark, base)
    columns = [f.name for f in STORE_SCHEMA.fields]
    if store is not None:
        row = known.where(F.col("store_name") == store).select("version").first()
        if row is None:
            return spark.createDataFrame([], STORE_SCHEMA)
        return _read_version(spark, base, row["version"]).where(F.col("store_name") == store).select(*columns)
    if not _numbers(spark, base):
        return spark.createDataFrame([], STORE_SCHEMA)
    rows = spark.read.schema(_DATA_SCHEMA).parquet(f"{base}/data")
    current = known.select(F.col("store_name").alias("_store"), F.col("version").alias("_version"))
    same = (rows["version"] == current["_version"]) & rows["store_name"].eqNullSafe(current["_store"])
    return rows.join(current, same, "left_semi").select(*columns)


class StoreNotFound(FileNotFoundError):
    """The named store is not in the manifest."""


def load_store(spark: SparkSession, base: str, store: str) -> DataFrame:
    """One store, or ``StoreNotFound``; the manifest is read for it, no document."""
    if manifest(spark, base).where(F.col("store_name") == store).isEmpty():
        raise StoreNotFound(f"no store '{store}' under {base}")
    return read_store(spark, base, store)


def available_stores(corpus: DataFrame) -> DataFrame:
    """Stores holding at least one text and one vector: (store_name, n_docs, n_vecs)."""
    return (corpus.groupBy("store_name")
            .agg(F.count("page_content").alias("n_docs"), F.count("embedding").alias("n_vecs"))
            .where((F.col("n_docs") > 0) & (F.col("n_vecs") > 0)))
