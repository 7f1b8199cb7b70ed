"""Cutting lineage: rows that later steps must see exactly as they were."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the folder that the session names in ``spark.checkpoint.dir``.

    What is read afterwards doesn't depend on a partition being made again as it was, so a lost executor changes
    nothing. Only a local session may go without a folder; it gets one that goes with the process.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or "cluster" in context.master:
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="lamina-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return df.checkpoint()
