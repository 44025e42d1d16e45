"""Cutting lineage: intermediate tables that several steps read are written once, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df from a checkpoint under spark.checkpoint.dir; a folder is made only where that is unset, as in tests."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="orrery-"))
    return df.checkpoint()
