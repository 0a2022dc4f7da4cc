"""Joins and numbering that stay balanced when one key holds much of the data."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# A key with at least this many rows on the many side is spread over SPREAD tasks.
HOT_ROWS = 1_000_000
SPREAD = 64
# A key is hot from this share of all rows on, so there are at most HOT_SHARE hot
# keys (8-byte hashes) to broadcast, however large the table.
HOT_SHARE = 65_536
# Rows that a task sorts at a time, where rows are wide.
ROWS_A_TASK = 100_000


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Hashes of the most frequent keys: at most HOT_SHARE rows of one BIGINT.

    Only hashes and counts are shuffled, after a map-side count.
    """
    counts = (
        df.select(F.xxhash64(*keys).alias("_hot"))
        .groupBy("_hot")
        .agg(F.count("*").alias("_n"))
    )
    return hottest(counts, hot_rows)


def hottest(counts: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The hot list from hashes ``_hot`` with their row counts ``_n``.

    Hot is a key with ``hot_rows`` rows, or with a HOT_SHAREth of all rows where that
    is more: the list is bounded by arithmetic and no key that qualifies is left out.
    """
    total = counts.agg((F.sum("_n") / HOT_SHARE).alias("_share"))
    return (
        counts.filter(F.col("_n") >= hot_rows)
        .join(F.broadcast(total), F.col("_n") >= F.col("_share"))  # one row
        .select("_hot")
    )


def lookup(
    many: DataFrame,
    one: DataFrame,
    keys: list[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    spread: int = SPREAD,
    broadcast_rows: int | None = None,
    hot: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Join rows to a table that has few rows per key, however frequent a key is.

    Rows of a hot key get a salt and the matching rows of ``one`` are copied once
    per salt. All other keys keep salt 0, so ``one`` grows only by
    ``hot keys x spread`` rows. The result equals ``many.join(one, keys, how)``.

    With ``broadcast_rows``, ``one`` is counted first (never past that number) and
    broadcast if it is no larger; ``many`` is then not shuffled at all. Where
    ``many`` is costly to make, pass the ``hot`` keys counted on something cheaper. Where
    its number of ``rows`` is known, tasks follow it (see ``dealt``).
    """
    if how not in ("left", "inner"):
        raise ValueError("lookup supports left and inner joins")
    if broadcast_rows is not None and has_at_most(one, broadcast_rows):
        return many.join(F.broadcast(one), keys, how)
    if hot is None:
        hot = hot_keys(many, keys, hot_rows)
    hot = F.broadcast(hot.withColumn("_is_hot", F.lit(True)))
    rest = [c for c in many.columns if c not in keys]
    place = F.xxhash64(*(rest or keys))
    is_null = functools.reduce(Column.__or__, [F.col(key).isNull() for key in keys])
    # a key that is null meets nothing, so its rows may go anywhere
    salt = (
        F.when(is_null, F.pmod(place, F.lit(1 << 20)).cast("int"))
        .when(F.col("_is_hot"), F.pmod(place, F.lit(spread)).cast("int"))
        .otherwise(F.lit(0))
    )
    left = (
        many.withColumn("_hot", F.xxhash64(*keys))
        .join(hot, "_hot", "left")
        .withColumn("_salt", salt)
        .drop("_hot", "_is_hot")
    )
    right = (
        one.withColumn("_hot", F.xxhash64(*keys))
        .join(hot, "_hot", "left")
        .withColumn(
            "_salt",
            F.explode(
                F.when(F.col("_is_hot"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(
                    F.array(F.lit(0))
                )
            ),
        )
        .drop("_hot", "_is_hot")
    )
    if rows is not None:
        left, right = (dealt(side, rows, *keys, "_salt") for side in (left, right))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def has_at_most(df: DataFrame, rows: int) -> bool:
    """Is the table that small? Reads no more than ``rows + 1`` rows of it."""
    return df.limit(rows + 1).count() <= rows


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Dealt by keys to so many tasks that each gets ROWS_A_TASK of ``rows`` on the average.

    Left alone, Spark makes tasks by bytes as they are compressed, which for texts that
    resemble each other may be many times as much in memory.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_A_TASK)), *keys) if rows > ROWS_A_TASK else df


def number_rows(
    df: DataFrame,
    group: list[str],
    buckets: list[str],
    order: list[str | Column],
    out: str,
) -> DataFrame:
    """0-based position of each row inside its group, without one task per group.

    ``buckets`` are columns from coarse to fine that agree with the wanted order;
    rows are numbered inside the finest bucket, and every bucket starts where the
    buckets before it end. Each level's running sum sees only the distinct buckets
    below one parent, so a group may be as large as it likes.
    """
    finest = [*group, *buckets]
    counts = df.groupBy(*finest).agg(F.count("*").alias("_n"))
    offsets = _bucket_offsets(counts, group, buckets)
    local = F.row_number().over(W.partitionBy(*finest).orderBy(*order)) - 1
    joined = df.withColumn("_local", local).join(offsets, finest)
    return joined.withColumn(out, (F.col("_start") + F.col("_local")).cast("bigint")).drop(
        "_start", "_local"
    )


def _bucket_offsets(counts: DataFrame, group: list[str], buckets: list[str]) -> DataFrame:
    parent, level = [*group, *buckets[:-1]], buckets[-1]
    before = (
        W.partitionBy(*parent).orderBy(level).rowsBetween(W.unboundedPreceding, -1)
    )
    here = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if len(buckets) == 1:
        return here.drop("_n")
    above = _bucket_offsets(
        counts.groupBy(*parent).agg(F.sum("_n").alias("_n")), group, buckets[:-1]
    ).withColumnRenamed("_start", "_above")
    return (
        here.join(above, parent)
        .withColumn("_start", F.col("_start") + F.col("_above"))
        .drop("_n", "_above")
    )


def latest(df: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """Last row per key by ``order``: a map-side combined aggregate, no window."""
    return _extreme(df, keys, values, order, F.max_by)


def earliest(df: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    return _extreme(df, keys, values, order, F.min_by)


def _extreme(df, keys, values, order, pick) -> DataFrame:
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return (
        df.groupBy(*keys)
        .agg(pick(F.struct(*values), rank).alias("_row"))
        .select(*keys, *[F.col("_row")[v].alias(v) for v in values])
    )
