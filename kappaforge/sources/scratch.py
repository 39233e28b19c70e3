"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir. Only where Spark runs in one process, as in tests, may it be unset."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local($|\[)", sc.master):
                raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
            folder = tempfile.mkdtemp(prefix="kappaforge-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()
