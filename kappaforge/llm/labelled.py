"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids are null."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % modulus


def known_labels(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, y) of rows that may be learned from: a label, an id, remainder not ``held_out``.

    Repeated ids count once, with their largest label.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder("doc_id", modulus) != held_out))
    return usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def first_by_hash(ids: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows, the same for equal input: those with the smallest hash of their id."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def split_column(doc_id: str, modulus: int, held_out: int) -> Column:
    """True for held-out ids; null ids are not held out."""
    return F.coalesce(remainder(doc_id, modulus) == held_out, F.lit(False))


def sampled(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``ids`` with ``column`` of ``rows``: one row an id, however many rows have it (that of the smallest hash).

    ``ids`` is a bounded sample, so its broadcast and the result are bounded too.
    The order of rows is the same in every run.
    """
    found = rows.select("doc_id", column).join(F.broadcast(ids), "doc_id")
    return found.groupBy(*ids.columns).agg(F.min_by(column, F.xxhash64(column)).alias(column)).sortWithinPartitions(*ids.columns)
