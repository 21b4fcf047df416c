"""Cutting lineage through the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    The cluster's own ``spark.checkpoint.dir`` is used whenever the session has one. Only where it is unset and the
    session runs in one process (tests) a folder of this machine is made; a cluster without it is refused.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if not named and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` written once to the checkpoint folder; later reads survive lost executors and recompute nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)
