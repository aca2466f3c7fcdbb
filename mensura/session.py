"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # remove reliable-checkpoint files once their RDDs are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app: str = "mensura") -> SparkSession:
    """Build (or reuse) a session with UTC time, AQE and Arrow enabled.

    A submitted job (``spark-submit``, or ``--conf`` in
    ``PYSPARK_SUBMIT_ARGS``) keeps its master, shuffle partitions and driver
    memory; arguments given here win. A plain local run defaults to
    ``local[*]``, 8 shuffle partitions and an 8 GB driver.
    """
    args = os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    b = SparkSession.builder.appName(app)
    if master or not (submitted or "--master" in args or "spark.master" in args or os.environ.get("SPARK_MASTER")):
        b = b.master(master or "local[*]")
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if not submitted and "driver-memory" not in args and "spark.driver.memory" not in args:
        b = b.config("spark.driver.memory", os.environ.get("MENSURA_DRIVER_MEMORY", "8g"))
    spark = b.getOrCreate()
    sc = _context(spark)
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    elif sc is not None and _local(sc.master) and not sc.getConf().contains("spark.sql.shuffle.partitions"):
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    if sc is not None:
        sc.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every job relies on, applied to any session: UTC session time
    (periods are UTC calendar months; epoch and formatted timestamps must not
    move with the caller's zone) and a reliable checkpoint folder."""
    if spark.conf.get("spark.sql.session.timeZone", "UTC") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None under Spark Connect (no driver-side context)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions raise here
        return None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names.

    The cluster's ``spark.checkpoint.dir`` wins; only a local run without it
    gets a fresh folder of this machine. On a cluster an unset folder is an
    error: executors do not share local disks. Under Spark Connect the
    setting is read as a session conf only.
    """
    sc = _context(spark)
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if sc is None or not _local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="mensura-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    if sc is None:
        return conf_dir
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def _local(master: str) -> bool:
    """Whether driver and executors are one process (``local-cluster`` is not)."""
    return re.match(r"local(\[|$)", master) is not None


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh, unique folder under the shared checkpoint location.

    Used for file round trips (CSV/JSON sinks then sources); never a
    machine-local temp folder on a cluster.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
