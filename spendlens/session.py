"""Spark session settings for spend reporting.

The reports are shuffle-light aggregations over one large fact table (PO
lines). The settings below let Catalyst/AQE size shuffles from runtime
statistics instead of a fixed partition count, so the same code runs on
local[8] and on a large cluster.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for the reports at any scale.
RECOMMENDED_CONF: dict[str, str] = {
    # Runtime re-planning: coalesce small shuffle partitions, split skewed
    # join partitions, turn sort-merge joins into broadcast joins when a
    # side turns out small at runtime (a size-checked broadcast).
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Static broadcast limit used by the planner's size estimate.
    "spark.sql.autoBroadcastJoinThreshold": "10m",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoint files go once nothing refers to them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


ADVISORY_PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions_for(input_bytes: int, min_partitions: int = 200) -> int:
    """Initial shuffle partition count for an input of ``input_bytes``: one
    advisory-size (128 MB) partition per 128 MB of input. AQE can coalesce
    small partitions after a stage runs but cannot split a partition that
    started too large, so the initial count must scale with the data
    (100 TB -> ~800k; AQE then merges what turns out small)."""
    return max(min_partitions, -(-int(input_bytes) // ADVISORY_PARTITION_BYTES))


def build_session(
    master: str | None = None,
    app_name: str = "spendlens",
    shuffle_partitions: int | None = None,
    extra_conf: dict[str, str] | None = None,
    input_bytes: int | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the recommended settings.

    ``input_bytes`` (size of the PO-line table) sizes the initial shuffle
    partition count for AQE; ``shuffle_partitions`` sets it directly."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(RECOMMENDED_CONF)
    if input_bytes is not None and shuffle_partitions is None:
        conf["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(
            shuffle_partitions_for(input_bytes)
        )
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared (DFS) folder and is
    used as is. Only in local mode, with nothing configured, a fresh scratch
    folder is created; elsewhere that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    else:
        base = os.environ.get("TMPDIR", "/tmp")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spendlens-ckpt-", dir=base))
    return sc.getCheckpointDir()


#: The folder of this package.
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def workers_find_package(spark: SparkSession) -> None:
    """Adds the folder of this package to the Python workers' path."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
