"""Snapshots, reuse of earlier results, manual edits and translation memory."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locale_lake.operators import skew
from locale_lake.session import cut_lineage

# Hashes of a run's texts are broadcast up to this (4 MB).
BROADCAST_TEXTS = 500_000
ORIGINS = ("override", "reuse", "memory")


def snapshot_source(units: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Source text per key, last unit wins."""
    rows = units.filter(~F.col("is_comment")) if "is_comment" in units.columns else units
    return skew.latest(rows, keys, ["source_text"], order)


def reuse_unchanged(
    units: DataFrame, old_source: DataFrame, old_target: DataFrame, keys: list[str]
) -> DataFrame:
    """Adds ``reused_text``: the old result where the source did not change.

    The two old tables meet first (both have one row per key), so units are
    shuffled once. A row of ``old_target`` whose ``origin`` is ``override`` is an
    edit, not a machine result; an edit that was deleted must not come back.
    """
    target = old_target
    if "origin" in target.columns:
        target = target.filter(~F.col("origin").eqNullSafe(F.lit("override")))
    pairs = (
        old_source.select(*keys, F.col("text").alias("_old_source"))
        .join(target.select(*keys, F.col("text").alias("_old_target")), keys)
    )
    return (
        units.join(pairs, keys, "left")
        .withColumn(
            "reused_text",
            F.when(F.col("_old_source") == F.col("source_text"), F.col("_old_target")),
        )
        .drop("_old_source", "_old_target")
    )


def diff_snapshots(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new / changed / unchanged / deleted per key."""
    before = old.select(*keys, F.col("text").alias("old_text"), F.lit(True).alias("_in_old"))
    after = new.select(*keys, F.col("text").alias("new_text"), F.lit(True).alias("_in_new"))
    status = (
        F.when(F.col("_in_old").isNull(), "new")
        .when(F.col("_in_new").isNull(), "deleted")
        .when(F.col("old_text").eqNullSafe(F.col("new_text")), "unchanged")
        .otherwise("changed")
    )
    return (
        before.join(after, keys, "full_outer")
        .withColumn("status", status)
        .drop("_in_old", "_in_new")
    )


def harvest_edits(current: DataFrame, snapshot: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the last machine snapshot whose file text was changed by hand."""
    machine = snapshot.select(*keys, F.col("text").alias("_machine"))
    return (
        current.select(*keys, "text")
        .join(machine, keys)
        .filter(F.col("text") != F.col("_machine"))
        .drop("_machine")
    )


def upsert_overrides(stored: DataFrame, harvested: DataFrame, keys: list[str]) -> DataFrame:
    """Harvested edits replace stored ones, all others stay.

    A stored tombstone (``deleted``) is dropped unless a new edit revives the key.
    """
    old = stored
    if "deleted" in old.columns:
        old = old.filter(~F.coalesce(F.col("deleted"), F.lit(False)))
    return (
        old.select(*keys, F.col("text").alias("_old"))
        .join(harvested.select(*keys, F.col("text").alias("_new")), keys, "full_outer")
        .select(*keys, F.coalesce("_new", "_old").alias("text"))
    )


def apply_overrides(units: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``override_text``."""
    active = overrides
    if "deleted" in active.columns:
        active = active.filter(~F.coalesce(F.col("deleted"), F.lit(False)))
    return units.join(
        active.select(*keys, F.col("text").alias("override_text")), keys, "left"
    )


def _asked_for(memory: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Memory of the run's own texts, where these are few enough for a list of 8-byte hashes.

    Memory grows with all runs and a run may be small: what it does not ask for is
    dropped where it is read, and takes no part in the shuffle that finds the last result.
    """
    wanted = texts.select(F.xxhash64(*keys).alias("_wanted")).distinct()
    if not skew.has_at_most(wanted, BROADCAST_TEXTS):
        return memory
    marked = memory.withColumn("_wanted", F.xxhash64(*keys))
    return marked.join(F.broadcast(wanted), "_wanted", "left_semi").drop("_wanted")


def lookup_memory(
    units: DataFrame,
    memory: DataFrame,
    languages: list[str] | None = None,
    hot_rows: int = skew.HOT_ROWS,
    texts: DataFrame | None = None,
) -> DataFrame:
    """Adds ``memory_text`` by exact source text, for units nothing else settles.

    Texts repeat, and a text may repeat a lot, so the lookup is spread. ``memory``
    may hold several results for one text; the last one counts. ``texts`` are the
    same units before other joins, to count frequent texts without those joins.
    """
    keys = [*(languages or []), "source_text"]
    hot = skew.hot_keys(units if texts is None else texts, keys, hot_rows)
    known = skew.latest(_asked_for(memory, units if texts is None else texts, keys), keys, ["target_text"], ["seq"])
    settled = F.col("reused_text").isNotNull() | F.col("override_text").isNotNull()
    found = skew.lookup(units, known, keys, "left", hot=hot)
    return found.withColumn(
        "memory_text", F.when(~settled, F.col("target_text"))
    ).drop("target_text")


def resolve(units: DataFrame) -> DataFrame:
    """Adds ``settled_text`` and ``origin``: override, then reuse, then memory."""
    return units.withColumns(
        {
            "settled_text": F.coalesce("override_text", "reused_text", "memory_text"),
            "origin": F.when(F.col("override_text").isNotNull(), "override")
            .when(F.col("reused_text").isNotNull(), "reuse")
            .when(F.col("memory_text").isNotNull(), "memory"),
        }
    )


def pending(units: DataFrame) -> DataFrame:
    """The worklist: units with no result yet."""
    return units.filter(F.col("origin").isNull())


def reuse_summary(units: DataFrame, by: list[str]) -> DataFrame:
    """Counts per group. Reuse and edits may overlap, as each is counted whole."""

    def count_if(condition: Column, name: str) -> Column:
        return F.count_if(condition).alias(name)

    return units.groupBy(*by).agg(
        F.count("*").alias("total"),
        count_if(F.col("reused_text").isNotNull(), "unchanged"),
        count_if(F.col("override_text").isNotNull(), "edits"),
        count_if(F.col("memory_text").isNotNull(), "from_memory"),
        count_if(F.col("origin").isNull(), "to_do"),
    )


def elect_leaders(todo: DataFrame, text: str = "source_text", package: str = "pkg_seq") -> DataFrame:
    """Adds ``leads``: does a unit belong to the first package that needs a result for its text?

    Packages run in ``package`` order, and a text that one has translated is memory for
    all that follow. So only the first package's units go to a model; the others wait.
    """
    first = todo.groupBy(text).agg(F.min(package).alias("_first"))
    return (
        skew.lookup(todo, first, [text], "left")
        .withColumn("leads", F.col(package).eqNullSafe(F.col("_first")))
        .drop("_first")
    )


def fill_followers(
    followers: DataFrame, led: DataFrame, order: list[str], text: str = "source_text"
) -> DataFrame:
    """Adds ``memory_text``: what the leading package left for the text, its last unit's result.

    Units that fell back to their source text leave nothing behind.
    """
    left = skew.latest(led.filter("origin <> 'fallback'"), [text], ["final_text"], order)
    return skew.lookup(
        followers.drop("memory_text"), left.withColumnRenamed("final_text", "memory_text"), [text], "left"
    )


def in_package_order(
    todo: DataFrame,
    infer: Callable[[DataFrame], DataFrame],
    order: list[str],
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Results of one run over many packages, as if they were translated one after the other.

    ``infer`` adds ``final_text`` and ``origin``. It sees each text in the first package
    that needs it; later packages take that result from memory (origin ``memory``).
    Where the first package got none, the others are translated by themselves.
    """
    elected = materialise(elect_leaders(todo))
    led = materialise(infer(elected.filter("leads").drop("leads")))
    filled = materialise(fill_followers(elected.filter("NOT leads").drop("leads"), led, order))
    known = filled.filter("memory_text IS NOT NULL")
    known = known.withColumns({"final_text": F.col("memory_text"), "origin": F.lit("memory")})
    alone = infer(filled.filter("memory_text IS NULL"))
    columns = [*dict.fromkeys([*todo.columns, "final_text", "origin"])]
    plain = [led, known, alone]
    return functools.reduce(DataFrame.unionByName, [df.select(*columns) for df in plain])


def propagate_memory(
    units: DataFrame,
    text: str = "source_text",
    package: str = "pkg_seq",
    order: str = "seq",
    bucket_size: int = 4096,
) -> DataFrame:
    """What each package finds in the memory its predecessors left, per text.

    ``units`` carry ``pinned_text`` (an override or a reused result, else null)
    and ``fresh_text`` (what translating now would give, else null). Packages run
    in ``package`` order. After a package, each of its texts leaves its last
    unit's result behind: the pinned text, else what memory held, else the fresh
    text. So before package *m* memory holds the last pinned text of an earlier
    package, or else the first fresh one.

    One row per (text, package) remains before any shuffle by text; the packages
    of a text are cut into buckets, so a text that every package contains is
    spread over many tasks.
    """
    hashed = units.withColumn("_hash", F.xxhash64(text))
    leaves = skew.latest(
        hashed, ["_hash", text, package], ["pinned_text", "fresh_text"], [order]
    ).withColumn("_bucket", F.floor(F.col(package) / bucket_size))

    keys = ["_hash", text]
    summary = leaves.groupBy(*keys, "_bucket").agg(
        F.max_by(
            "pinned_text", F.when(F.col("pinned_text").isNotNull(), F.col(package))
        ).alias("_pinned"),
        F.min_by(
            "fresh_text", F.when(F.col("fresh_text").isNotNull(), F.col(package))
        ).alias("_fresh"),
    )
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        "_bucket",
        F.last("_pinned", ignorenulls=True).over(earlier).alias("_pinned_in"),
        F.first("_fresh", ignorenulls=True).over(earlier).alias("_fresh_in"),
    ).filter("_pinned_in IS NOT NULL OR _fresh_in IS NOT NULL")  # first buckets, often all, carry nothing
    inside = (
        W.partitionBy(*keys, "_bucket")
        .orderBy(package)
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        leaves.withColumn("_p", F.last("pinned_text", ignorenulls=True).over(inside))
        .withColumn("_f", F.first("fresh_text", ignorenulls=True).over(inside))
        .join(carried, [*keys, "_bucket"], "left")
        .select(
            text,
            package,
            F.coalesce("_p", "_pinned_in", "_fresh_in", "_f").alias("memory_text"),
            "pinned_text",
            "fresh_text",
        )
    )
