"""What plans need of the session."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Ends lineage by a checkpoint in the folder that the cluster shares (spark.checkpoint.dir); a local one is set
    on one machine alone, and only where none is named."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "geoweave-checkpoints"))
    return df.checkpoint()
