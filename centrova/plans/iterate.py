"""What loops over jobs share: cut lineage in the shared folder, small things to and from the driver."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and runs on this machine alone, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Values (k * d) that centers may have together where they go to every worker.
CENTER_VALUES = 8_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it; a local one only for a master that is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINTS


def saved(df: DataFrame) -> DataFrame:
    """The frame as written to the folder in spark.checkpoint.dir."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def centers_of(df: DataFrame) -> np.ndarray:
    """The rows of centers (cid, features) by cid as an array; the number of centers is a parameter, not data."""
    rows = sorted(df.select("cid", "features").collect())
    return np.array([r["features"] for r in rows], float)


def center_frame(spark, centers: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "cid int, features array<double>")
