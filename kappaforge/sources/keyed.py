"""Tables of documents by key, of which the last committed write counts.

A write puts its rows into packed files of a folder of its own, with an index of
keys beside them, and then adds one commit. Readers look at commits only, so
nothing of a write is seen before all of it is, and nothing of one that failed
or lost its driver; lost tasks are Spark's to repeat. For every key the latest
commit that has it counts, with all rows that it has there. There is no folder
and no file of a key's own.

A commit is a file named by its number that is created only if there is none: of
two writers one takes the next number.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Store:
    """A table by key below ``path``; ``schema`` as DDL, which names the key's columns too."""

    spark: SparkSession
    path: str
    keys: list[str]
    schema: str

    def _folder(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path.rstrip("/"), *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[tuple[int, str]]:
        """(number, name of the write) of every commit, in order."""
        folder, fs = self._folder("commits")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted((int(n.partition("-")[0]), n.partition("-")[2]) for n in (self._named(fs, x) for x in names if x.isdigit()))

    def _named(self, fs, number: str) -> str:
        path, _ = self._folder("commits", number)
        stream = fs.open(path)
        try:
            return f"{number}-{stream.readUTF()}"
        finally:
            stream.close()

    def write(self, rows: DataFrame, order: str | None = None) -> int:
        """Rows of some keys in place of what those keys had, and the number of the commit.

        With ``order``, a key keeps only its last row by that column, else all its rows.
        """
        if order:
            rows = rows.withColumn("_n", F.row_number().over(W.partitionBy(*self.keys).orderBy(F.desc_nulls_last(order)))).where("_n = 1").drop("_n")
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        write = uuid.uuid4().hex
        rows.select(*names).write.option("compression", "zstd").parquet(f"{self.path}/data/{write}")
        self._index(write)
        return self._commit(write)

    def _index(self, write: str) -> None:
        own = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{write}")
        own.select(*self.keys, F.col("_metadata.file_name").alias("_file")).distinct().write.parquet(f"{self.path}/index/{write}")

    def _commit(self, write: str) -> int:
        folder, fs = self._folder("commits")
        fs.mkdirs(folder)
        number = max((n for n, _ in self.commits()), default=0) + 1
        while True:
            path, _ = self._folder("commits", f"{number:012d}")
            staged, _ = self._folder("staged", write)
            stream = fs.create(staged, True)
            stream.writeUTF(write)
            stream.close()
            # a name that exists is not taken: rename fails then, and the next number is tried
            if not fs.exists(path) and fs.rename(staged, path):
                return number
            number += 1

    def read(self, only: DataFrame | None = None) -> DataFrame:
        """The rows that count; with ``only`` (the keys' columns) those of its keys."""
        commits = self.commits()
        if not commits:
            return self.spark.createDataFrame([], self.schema)
        index = reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.path}/index/{w}").select(*self.keys, F.lit(n).alias("_number"), F.lit(w).alias("_write")) for n, w in commits)).distinct()
        if only is not None:
            index = index.join(only.select(*self.keys).distinct(), self.keys, "left_semi")
        last = index.groupBy(*self.keys).agg(F.max_by("_write", "_number").alias("_write"))
        data = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{w}" for _, w in commits))
        data = data.withColumn("_in", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        own = last.select(*(F.col(c).alias(f"_{c}") for c in self.keys), "_write")
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.keys]
        return data.join(own, [F.col("_in") == F.col("_write"), *same], "left_semi").drop("_in")

    def compact(self) -> int:
        """One write of what counts in place of all; then whatever no commit names is deleted.

        Not beside other writers: what they have staged would go as well.
        """
        before = self.commits()
        number = self.write(self.read())
        for n, _ in before:
            path, fs = self._folder("commits", f"{n:012d}")
            fs.delete(path, False)
        named = {w for _, w in self.commits()}
        for part in ("data", "index", "staged"):
            folder, fs = self._folder(part)
            for f in fs.listStatus(folder) if fs.exists(folder) else []:
                if f.getPath().getName() not in named:
                    fs.delete(f.getPath(), True)
        return number
