"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: paths of tables from written() that are still there; no DataFrame is held, as its plan would hold shuffles
_LEFT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where Spark runs in one process, as in tests, may it be unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="kappaforge-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: later jobs start from the files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kappaforge-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    _LEFT.add(path)
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _LEFT.discard(path)


@atexit.register
def _last() -> None:
    """What no operator could delete, as its result still read it, goes when the driver ends."""
    spark = SparkSession.getActiveSession() if _LEFT else None
    if spark is not None:
        with contextlib.suppress(Exception):  # the session's Java side may be gone
            for path in sorted(_LEFT):
                _deleted(spark, path)


def dropped(*frames: DataFrame) -> None:
    """Delete the files of tables from written() that nothing reads any more."""
    for df in frames:
        _deleted(df.sparkSession, df.written_to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of DataFrames that are no longer in use.

    The cleaner acts when the driver's garbage is collected, which may be long
    after a phase whose result is already written.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores as keep it apart from ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
