"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "baitline", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with UTC time and adaptive execution on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        # recording the Python call site of every column costs more than building the plan
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point the context at the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only where the session names
    none (a local test run) is a scratch folder chosen here.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get(CHECKPOINT_CONF, None)
    if not shared:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="baitline-checkpoint-")
    context.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Redistribute the rows of a scan that yields fewer splits than there are cores.

    Meant for narrow rows ahead of heavy per-row work (a small or unsplittable file would
    keep one core busy). A scan with enough splits is left alone, so large inputs are
    not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
