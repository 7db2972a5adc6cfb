"""Session construction and shared-folder lookup."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every quire job relies on. AQE re-plans joins from runtime sizes
# (broadcast only when a side is measured small), coalesces small shuffle
# partitions and splits skewed ones.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # Listing many files (a stream batch re-lists every file it was handed)
    # runs as one job; cap its task count so each task checks a few hundred
    # paths instead of one path per task.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "quire", extra: dict | None = None,
                  input_bytes: int | None = None, executors: int | None = None) -> SparkSession:
    """A session with quire's settings; on a cluster name ``input_bytes`` and ``executors``, and scans, shuffles and
    Arrow batches are sized by :func:`cluster_conf` instead of ``shuffle_partitions``."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if input_bytes is not None and executors is not None:
        conf.update(cluster_conf(input_bytes, executors))
    elif not master.startswith("local"):
        raise ValueError("on a cluster, build_session needs input_bytes and executors to size its partitions")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int = 4,
                 target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Scan and shuffle sizing for a job reading ``input_bytes`` on ``executors`` executors.

    Scan splits of ``target_partition_bytes``; an initial shuffle partition
    count so that a shuffle as large as the input still lands near the target
    per partition (AQE then coalesces small ones to the advisory size and
    splits skewed join partitions); never fewer partitions than 3x the cores
    and never more than 100,000 (beyond that, map-status metadata, which
    grows with mappers x reducers, costs more than larger partitions do).
    """
    cores = executors * cores_per_executor
    shuffle_parts = min(100_000, max(3 * cores, input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle_parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(min(10_000, cores)),
        # Python stages receive page images (~1 MB each) or whole prompts: bound an Arrow batch by rows so
        # a worker holds a few hundred MB, not the 10,000-row default.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    }


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """A job that lists files has as few tasks as in our own sessions (Spark's default is a task a path up to 10,000), and
    what it has found is not kept beside the batch, for other queries (Spark's default is up to 250 MB of the driver's heap).

    A file stream lists by the settings of the session that it was made in, whenever a batch begins: hold this while it runs.
    """
    key, kept = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "spark.sql.hive.filesourcePartitionFileCacheSize"
    before = {k: spark.conf.get(k) for k in (key, kept)}
    spark.conf.set(key, str(min(int(before[key]), int(BASE_CONF[key]))))
    spark.conf.set(kept, "0")
    try:
        yield
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for lineage cuts, store versions and stream state.

    Taken from ``spark.checkpoint.dir``. Only when that is unset (local runs,
    tests) do we create a private folder and register it, so later calls agree.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = id(spark.sparkContext)
    if key not in _LOCAL_DIRS:
        local = tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(os.path.join(local, "rdd"))
        _LOCAL_DIRS[key] = local
    return _LOCAL_DIRS[key]


_LOCAL_DIRS: dict[int, str] = {}
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quire`` importable by the Python workers (what ``--py-files`` does), once per application.

    Python stages (recognition, batch completion, the file writer) run
    functions defined in this package; executors started without it on their
    path could not unpickle them. The package is zipped on the driver and
    handed to ``SparkContext.addPyFile``, which serves it to every executor.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    import quire

    pkg_dir = os.path.dirname(os.path.abspath(quire.__file__))
    base = shared_dir(spark)
    folder = base if "://" not in base or base.startswith("file:") else tempfile.mkdtemp(prefix="quire-code-")
    folder = folder[len("file:"):] if folder.startswith("file:") else folder
    os.makedirs(folder, exist_ok=True)
    out = os.path.join(folder, f"quire-{app}.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark would take it from (the cluster's default one, if it names
    none), in the form that both Spark and ``pyarrow.fs`` read."""
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(hadoop_path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file:///") else full


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A place in the shared folder, named so that every executor means the same one."""
    return os.path.join(qualified(spark, shared_dir(spark)), *parts)
