"""Spark session helpers shared by tests, bench and the driver entry points."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # string scoring is CPU-bound on small shuffled inputs: keep AQE from
    # coalescing them below ~256 KB per task (no effect on large inputs)
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    # reliable checkpoints (dedupe rounds, inserts) are removed from the shared
    # folder once their DataFrames are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


_PKG_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``linkwright`` importable in Python workers (Arrow UDFs).

    Zips the package once per application and registers it with
    ``addPyFile``, which distributes it to every executor.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    zdir = tempfile.mkdtemp(prefix="linkwright-pkg-")
    zpath = os.path.join(zdir, "linkwright.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for root, _dirs, files in os.walk(os.path.join(_PKG_ROOT, "linkwright")):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, _PKG_ROOT))
    spark.sparkContext.addPyFile(zpath)
    _SHIPPED.add(app)


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "linkwright") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    master = master or os.environ.get("LINKWRIGHT_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("LINKWRIGHT_SHUFFLE_PARTITIONS", "8"))
    pp = os.environ.get("PYTHONPATH", "")
    if _PKG_ROOT not in pp.split(os.pathsep):
        os.environ["PYTHONPATH"] = _PKG_ROOT + (os.pathsep + pp if pp else "")
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    builder = builder.config("spark.driver.memory", os.environ.get("LINKWRIGHT_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is configured by the operator and must be shared
    storage; it is only created here when unset (local runs and tests).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="linkwright-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder, for written tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def ensure_parallelism(df, min_partitions: int | None = None):
    """Spread a small input over the cluster before CPU-heavy row work.

    A tiny file is one scan partition, so per-row string scoring would run
    on one core. Repartition (round-robin) only when the plan has fewer
    partitions than the cluster's default parallelism; large inputs already
    have enough partitions and are returned untouched (no extra shuffle).
    """
    sc = df.sparkSession.sparkContext
    target = min_partitions or sc.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
