"""Session set-up, table access and lineage cuts.

Nothing here assumes local mode: ``get_session`` only fills in defaults, and the
folder for lineage cuts is the one the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "hemerion", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (_DEFAULTS | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; one is set only where none is named."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured and current is None:
        context.setCheckpointDir(configured)
    if configured:
        return configured
    if current is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="hemerion-ckpt-")
        context.setCheckpointDir(current)
    return current


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    This cuts the lineage as ``checkpoint()`` does and survives the loss of executors,
    but keeps column pruning, compression and size statistics for the plan that follows.
    The files are deleted when the application ends.
    """
    spark = df.sparkSession
    own = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hemerion/{spark.sparkContext.applicationId}"
    path = f"{own}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    # What the application wrote goes when it ends; until then a plan may still read it.
    folder = spark._jvm.org.apache.hadoop.fs.Path(own)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
