"""The folder that driver and executors share, and frames that are written there."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of the warehouse in a session of one process (tests), and an error on a cluster."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(known)
    return known.rstrip("/")


def keep(rows: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back: its lineage ends there, and a lost executor costs nothing."""
    shared_dir(rows.sparkSession)
    return rows.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
