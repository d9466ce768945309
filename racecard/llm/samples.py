"""Bounded samples of labelled rows, for fitting on the driver, and names that no column has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(key: str, parts: int, part: int):
    """Whether crc32 of the id as text falls in the part that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def labelled_sample(labels: DataFrame, label: str, most: int, parts: int, part: int,
                    key: str = "doc_id") -> DataFrame:
    """``sample_id, label`` of at most ``most`` labelled ids outside the held-out part.

    The ids of smallest hash are taken, so the choice does not depend on partitions. Of
    several labels of one id the largest counts; ids or labels that are null don't.
    """
    return (labels.select(F.col(key).alias("sample_id"), F.col(label).cast("int").alias("label"))
            .dropna().where(~held_out("sample_id", parts, part))
            .groupBy("sample_id").agg(F.max("label").alias("label"))
            .orderBy(F.xxhash64("sample_id"), "sample_id").limit(most))


def unused_prefix(prefix: str, docs: DataFrame) -> str:
    """``prefix`` made longer until no column of ``docs`` begins with it."""
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return prefix
