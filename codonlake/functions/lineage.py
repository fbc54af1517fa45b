"""Results kept between jobs in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """The rows computed once, in the folder of `spark.checkpoint.dir`. On one machine it may be unset (tests); elsewhere that is an error."""
    sc, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not folder and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codonlake-"))
    return df.checkpoint()
