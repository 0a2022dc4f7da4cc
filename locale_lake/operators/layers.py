"""Merging layers of units: language files, definitions, patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locale_lake.operators import skew

CHANNELS = ("keyed", "injected", "strings")


def fill_uncovered(units: DataFrame, fields: DataFrame, covered: DataFrame) -> DataFrame:
    """Adds definition fields only for types no language folder covers.

    ``covered`` has one row per (pkg_id, def_type); it comes from folder names, so
    an empty folder covers its type too.
    """
    missing = fields.join(
        covered.select("pkg_id", "def_type").distinct(), ["pkg_id", "def_type"], "left_anti"
    )
    return units.unionByName(missing, allowMissingColumns=True)


def union_layers(*parts: DataFrame) -> DataFrame:
    """One table with an explicit channel rank, since a union has no order."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    rank = F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col("channel"))
    return whole.withColumn("channel_rank", rank.cast("int"))


def refresh_stale(
    units: DataFrame, fields: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Where definitions hold the same key, their (last) text replaces the unit's."""
    current = skew.latest(fields, keys, ["source_text"], order).withColumnRenamed(
        "source_text", "_current"
    )
    return (
        units.join(current, keys, "left")
        .withColumn("source_text", F.coalesce("_current", "source_text"))
        .drop("_current")
    )


def apply_patches(
    units: DataFrame,
    patches: DataFrame,
    keys: list[str],
    order: list[str],
    new_key_policy: str = "first",
) -> DataFrame:
    """Patched text wins for known keys (last patch) and adds unknown keys.

    For unknown keys the first patch counts unless ``new_key_policy='last'``.
    """
    if new_key_policy not in ("first", "last"):
        raise ValueError(f"unknown policy: {new_key_policy!r}")
    last = skew.latest(patches, keys, ["source_text"], order).withColumnRenamed(
        "source_text", "_patched"
    )
    known = (
        units.join(last, keys, "left")
        .withColumn("source_text", F.coalesce("_patched", "source_text"))
        .drop("_patched")
    )
    pick = skew.earliest if new_key_policy == "first" else skew.latest
    values = [c for c in patches.columns if c not in keys]
    fresh = pick(patches, keys, values, order).join(
        units.select(*keys).distinct(), keys, "left_anti"
    )
    return known.unionByName(fresh, allowMissingColumns=True)


def scan_summary(units: DataFrame) -> DataFrame:
    """Files and strings per package and channel, with totals (null = all).

    A file belongs to one package and channel, so after counting per file the
    number of rows is the number of files and no distinct count is needed.
    """
    files = units.groupBy("pkg_id", "channel", "file_id").agg(F.count("*").alias("_n"))
    return files.rollup("pkg_id", "channel").agg(
        F.count("*").alias("files"), F.sum("_n").alias("strings")
    )


def empty_packages(units: DataFrame, packages: DataFrame) -> DataFrame:
    """Packages without a single translatable string: an error, not a result."""
    return packages.join(units.select("pkg_id").distinct(), "pkg_id", "left_anti")
