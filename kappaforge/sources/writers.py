"""Sinks: result tables, bundles, stage documents and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kappaforge.sources import readers


def result_csv(df: DataFrame, path: str) -> None:
    """A small result table (one row per comparison or model) as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def result_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def bundle_json(rows: DataFrame, path: str) -> int:
    """Bundles by episode_id in packed files; a later bundle of an id overwrites the earlier one, and no other. Returns the commit's number.

    Of several bundles of an id in one write the one with most notes stays.
    """
    return readers.bundle_store(rows.sparkSession, path).write(rows.withColumn("_size", F.size("notes")), "_size")


def search_results(rows: DataFrame, path: str) -> int:
    """Answers of searches by episode, label and round: the terms with their ids. A later answer overwrites the earlier one."""
    return readers.search_store(rows.sparkSession, path).write(rows)


def stage_documents(envelopes: DataFrame, path: str) -> None:
    """(episode_id, stage, body) as text documents, by stage."""
    envelopes.select("stage", F.col("body").alias("value")).write.mode("overwrite").partitionBy("stage").text(path)


def append_log(df: DataFrame, path: str, run_id: str) -> None:
    """Replies, conversation, metadata or manifest rows of a run, appended by run."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def lookup(targets: DataFrame, path: str) -> None:
    """Chosen map targets by reference set, to be read back as a small table."""
    targets.write.mode("overwrite").partitionBy("refset").parquet(path)


def notes_by_person(notes: DataFrame, table: str, buckets: int = 200) -> None:
    """Notes as a table in buckets of persons, each sorted: joins by person_id then read it in place, without a shuffle."""
    notes.repartition(buckets, "person_id").write.mode("overwrite").bucketBy(buckets, "person_id").sortBy("person_id").format("parquet").saveAsTable(table)
