"""Session helpers: scratch folder and lineage cuts.

Scratch tables live in the shared folder named by
``spark.checkpoint.dir``. Only a local-mode session without that setting
(tests, a laptop) gets a folder of its own; a cluster session without it is an
error, because a machine-local folder would vanish with its executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "swathline", master: str | None = None, cores: int = 8, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    if master and master.startswith("local"):
        settings.setdefault("spark.sql.shuffle.partitions", str(cores))
        settings.setdefault("spark.driver.memory", "8g")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The shared folder for scratch data, set up on first use."""
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="swathline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/scratch/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    The table survives the loss of any executor. Unlike a checkpointed plan it carries
    its true size, so later joins are planned by it, and no inferred constraints, which
    would double with every round of an iterative job.
    """
    path = scratch_path(df.sparkSession, "stage")
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored._stage_path = path
    return stored


def drop_stages(*stored: DataFrame) -> None:
    """Deletes the tables behind frames that ``cut_lineage`` returned, so that a long job holds few of them at a time.

    Only for tables that nothing still to be computed reads: all that was made from them is itself stored or collected.
    """
    for frame in stored:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame._stage_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
