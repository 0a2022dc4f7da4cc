"""Folds, bounded samples of labelled rows, and names that do not clash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unused(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as no column of ``df`` begins with."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; -1 without id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)), F.lit(-1)).cast("int")


def labelled(labels: DataFrame, label: str, modulus: int, held_out: int) -> DataFrame:
    """doc_id and y (0 or 1), one row per id that may be learned from.

    Ids with contradicting labels count as 1; rows without id or label are left out.
    """
    return (
        labels.filter(F.col(label).isin(0, 1) & (fold(F.col("doc_id"), modulus) != held_out) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )


def bounded(rows: DataFrame, key: str, values: list, per_value: int) -> DataFrame:
    """Up to ``per_value`` rows of each value of ``key``: those whose id has the least digest."""
    draw = F.xxhash64(F.col("doc_id").cast("string"), F.lit(2024))
    picked = [rows.filter(F.col(key) == v).orderBy(draw, "doc_id").limit(per_value) for v in values]
    return reduce(DataFrame.unionByName, picked)
