"""Cuts of lineage in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a checkpoint. Where the session names no folder for them, a local one is set, but only if all runs in one JVM (tests)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        given = context.getConf().get("spark.checkpoint.dir")
        if not given and not re.match(r"local(\[|$)", context.master):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="locusframe-"))
    return df.checkpoint()
