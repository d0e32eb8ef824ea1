"""Session helpers: table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; only where it is unset (tests, one machine), set a folder of our own."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isEmpty():
        return
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        folder = tempfile.mkdtemp(prefix="stepmill-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    else:  # the warehouse is a folder that all executors share
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, inside the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and continue from there: lineage ends, executors may be lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_below(df: DataFrame, limit: int, count: int) -> DataFrame:
    """Broadcast hint only for a side whose counted rows are at most `limit`; else the plain frame (shuffle join)."""
    return F.broadcast(df) if count <= limit else df


def latest_steps(steps: DataFrame, *columns: str) -> DataFrame:
    """One row per (rollout_id, step_index): of repeated deliveries the one with the latest ingested_at.

    Only the named columns are shuffled. Rows of equal ingested_at are equal by contract; among them any one is kept.
    A NULL ingested_at loses against any other. NULL keys form their own step.
    """
    cols = [c for c in columns if c not in ("rollout_id", "step_index")]
    packed = F.max_by(F.struct(*cols), F.coalesce(F.col("ingested_at"), F.timestamp_micros(F.lit(-(2**62)))))
    return steps.groupBy("rollout_id", "step_index").agg(packed.alias("__v")).select("rollout_id", "step_index", *(F.col(f"__v.{c}").alias(c) for c in cols))
