"""Session construction and the shared scratch location.

On a cluster the scratch location is whatever the cluster names in
``spark.checkpoint.dir`` (a shared, fault-tolerant filesystem).  Only when the
session has none (local tests) do we create a temporary directory and register
it, so ``DataFrame.checkpoint()`` and written intermediate tables work the same
way in both settings.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings every plan in this package relies on.
REQUIRED_CONF = {
    # Data URLs must be one unbroken base64 string (no CRLF every 76 chars).
    "spark.sql.chunkBase64String.enabled": "false",
    # Result tables are rewritten one (task, sub_task, ..., model) partition at a time.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Model names such as "4" must stay strings when partitions are read back.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only from measured sizes: no plan-time (estimated) broadcast;
    # AQE broadcasts a join side whose materialized shuffle output is small,
    # and explicit hints are used only after a proven bound (operators/joins.py).
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
    # Filters reach the asset listing, which then leaves out whole directories.
    "spark.sql.python.filterPushdown.enabled": "true",
}


# Settings for a large cluster (hundreds of executors, tens of TB of input).
# Shuffle partitions start high and AQE coalesces them to the advisory size, so
# small runs do not pay for them; skewed partitions are split at run time.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
    # the responder's Arrow batches: small enough to bound Python memory per task
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.task.maxFailures": "8",
}


def get_session(master: str | None = None, app_name: str = "evalframe", shuffle_partitions: int | None = None,
                extra_conf: dict[str, str] | None = None, cluster: bool = False) -> SparkSession:
    """Build (or reuse) a session with the options the plans rely on;
    ``cluster=True`` adds ``CLUSTER_CONF``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(REQUIRED_CONF)
    if cluster:
        conf.update(CLUSTER_CONF)
    conf.setdefault("spark.ui.enabled", "false")
    conf.setdefault("spark.ui.showConsoleProgress", "false")
    conf.setdefault("spark.sql.execution.arrow.pyspark.enabled", "true")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_required_conf(spark)
    return spark


def apply_required_conf(spark: SparkSession) -> None:
    """Set the runtime SQL options the plans depend on and make the package
    importable on executors (idempotent)."""
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)   # an option that cannot be set fails here, not as a wrong result later
    ship_package(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add this package to the executors' Python path (like ``--py-files``).

    Python code that runs in tasks (the responder, ``mapInPandas``
    functions) imports ``evalframe``; the package is zipped once per driver
    process and registered once per application.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="evalframe-pyfiles-")
    zpath = os.path.join(out_dir, "evalframe.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint directory.  A machine-local one is made only on a
    local master without the setting (tests), and removed at exit; on a
    cluster each executor would write to its own disk."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="evalframe-ckpt-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique directory under the shared checkpoint root."""
    root = checkpoint_root(spark)
    path = f"{root.rstrip('/')}/evalframe/{name}-{uuid.uuid4().hex}"
    if path.startswith("/") or path.startswith("file:"):
        os.makedirs(path.replace("file:", "", 1), exist_ok=True)
    return path
