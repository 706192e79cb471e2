"""Session helpers: a tuned local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale as much as locally: AQE re-plans shuffles at runtime,
# coalesces small partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints (quantile ranks, AUC scores, line positions) are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def _default_driver_memory() -> str:
    """16g, or 3/4 of the machine's memory when that is smaller (local mode only)."""
    try:
        total_mb = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // (1024 * 1024)
        return f"{max(1024, min(16 * 1024, total_mb * 3 // 4))}m"
    except (ValueError, OSError, AttributeError):
        return "4g"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "tablesmith",
                  extra: dict | None = None) -> SparkSession:
    """Local session for tests and the benchmark. On a cluster the caller passes its own."""
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("TABLESMITH_DRIVER_MEMORY", _default_driver_memory())
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _checkpoint_dir(spark: SparkSession) -> str | None:
    d = None
    try:
        sc = spark.sparkContext
        d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    except Exception:  # remote session: no SparkContext
        pass
    return d or spark.conf.get("spark.checkpoint.dir", None)


def _is_local(spark: SparkSession) -> bool:
    try:
        master = spark.sparkContext.master
    except Exception:  # remote session
        master = spark.conf.get("spark.master", "")
    return str(master).startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only a local-mode session without one (tests, the benchmark) gets a private folder;
    on a cluster a machine-local folder would not be shared, so that is an error.
    """
    d = _checkpoint_dir(spark)
    if not d:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors "
                               "(checkpoints, scratch tables and models are written there)")
        d = tempfile.mkdtemp(prefix="tablesmith-ckpt-")
        try:
            spark.sparkContext.setCheckpointDir(d)
        except Exception:
            spark.conf.set("spark.checkpoint.dir", d)
        d = _checkpoint_dir(spark) or d
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder, for tables written and read back."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tablesmith/{name}-{uuid.uuid4().hex[:12]}"
