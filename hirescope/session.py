"""Session helpers for tests, the bench and local runs.

On a cluster the session comes from the platform; nothing here overrides a
setting the cluster already made. ``checkpoint_dir`` reads
``spark.checkpoint.dir`` from the session and only falls back to a local
scratch folder when the setting is absent (local tests).
"""

import os
import tempfile

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "8g",
}


def local_session(cpus: int | str = "*", app: str = "hirescope", **conf) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


class CheckpointDirMissing(RuntimeError):
    pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    Only a local-mode session (tests, single-machine runs) without one gets
    a scratch folder made for it; on a cluster a machine-local folder would
    be invisible to the other executors, so a missing setting is an error.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: only the session setting is visible
        raise CheckpointDirMissing("set spark.checkpoint.dir to a folder on shared storage") from None
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise CheckpointDirMissing(
            "set spark.checkpoint.dir to a folder on shared storage (HDFS, object store)")
    local = tempfile.mkdtemp(prefix="hirescope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    spark.conf.set("spark.checkpoint.dir", local)
    return local
