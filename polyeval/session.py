"""Session construction and cluster-safe helpers.

Nothing here is machine-local: lineage is cut into the folder named by
``spark.checkpoint.dir`` (a shared path on a cluster); we only set our own
folder when the session has none, as in tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; all of them are safe on local[N] as well.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # runtime broadcast only for join sides that AQE measured below 32 MiB
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    # post-shuffle partitions of ~128 MiB: set spark.sql.shuffle.partitions
    # high on a cluster (thousands) and let AQE coalesce down to this size
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    # scan splits of 128 MiB; documents are long texts, so splits stay in memory
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # keep Python batches small: model calls are slow per row
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, app: str = "polyeval",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``polyeval`` importable in the Python workers (what
    ``spark-submit --py-files`` does): the package is zipped once per
    application and added with ``addPyFile``; Spark copies it to every
    executor. Needed by every stage that runs Python (model runner, pandas
    UDFs, packing)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:") or base.startswith("/"):
        # the shared checkpoint folder when the driver can write it directly
        folder = os.path.join(base[len("file:"):] if base.startswith("file:") else base,
                              f"pyfiles-{os.urandom(4).hex()}")
        os.makedirs(folder, exist_ok=True)
    else:
        # remote file systems: build on the driver; addPyFile uploads it
        folder = tempfile.mkdtemp(prefix="polyeval-pyfiles-")
    target = os.path.join(folder, "polyeval.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("polyeval", os.path.relpath(full, pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is. Only when it is unset (local tests) do we create one of our own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    cur = sc.getConf().get("spark.checkpoint.dir", None)
    if not cur:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # one machine (tests): a folder of our own
        cur = tempfile.mkdtemp(prefix="polyeval-ckpt-")
    sc.setCheckpointDir(cur)
    return sc.getCheckpointDir() or cur


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder.

    Used where a Python stage (model call, tokenizer) must not be evaluated
    twice and where an executor loss must not recompute it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{os.urandom(6).hex()}"
