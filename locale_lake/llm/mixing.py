"""Mix sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locale_lake.llm.sampling import unused
from locale_lake.operators import skew
from locale_lake.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
# Ranks of a source are cut into so many ranges; only the range in which the
# budget ends is ordered row by row.
RANGES = 4096
# Up to so many sources are broadcast (a row is a short name and six numbers).
BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(doc_id: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the id and the seed alone."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], copies: int) -> DataFrame:
    """Targets per source (``src``, ``source_size``): water filling below ``copies`` x size.

    Sources in code point order, null last, take the weights in turn. The level at
    which the capped sources and the others use up the total is found by one running
    sum over the sources, ordered by the level at which each of them is full.
    """
    total = sizes.agg(F.sum("source_size").alias("total"))
    order = W.orderBy("src")
    place = (F.row_number().over(order) - 1) % len(weights)
    weighted = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    weighted = weighted.withColumn("full", F.col("source_size") * copies)
    by_level = W.orderBy("full_at", "src")
    before, onward = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    levels = (
        weighted.withColumn("full_at", F.col("full").cast("double") / F.col("w"))
        .crossJoin(F.broadcast(total))  # one row
        .withColumn("used", F.coalesce(F.sum("full").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(onward))
        .withColumn("level", (F.col("total") - F.col("used")).cast("double") / F.col("w_left"))
    )
    level = levels.filter("full_at >= level").agg(F.min_by("level", F.struct("full_at", "src")).alias("found"))
    return levels.crossJoin(F.broadcast(level)).select(  # one row
        "src", "source_size", F.least(F.col("full").cast("double"), F.col("found") * F.col("w")).alias("target")
    )


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), copies: int = 3, seed: str = "mix"
) -> DataFrame:
    """How many words the mix takes of each document.

    A source's rate is its target over its size. Every document gets the whole part
    of the rate as certain copies. For the rest, documents are ranked by the odds of
    a random number over the odds of their inclusion (the rate's fraction), and the
    first of them are taken while the middle of the next one lies within the words
    still due, so a source misses its target by half a document at most. No
    document is taken more than ``copies`` times.

    Returns doc_id, source_size, size, target, taken. A null source is a source of
    its own; a null or empty text has size 0 and nothing is taken; ties of rank go
    to the smaller id, then the smaller size; rows with the same id each count. An empty table gives
    no rows. Other columns are ignored. Reruns agree: the random numbers are digests
    of the ids.
    """
    rows = cut_lineage(
        docs.select(
            "doc_id",
            # the prefix keeps null last
            F.coalesce(F.concat(F.lit("0"), F.col("source").cast("string")), F.lit("1")).alias("src"),
            n_words(F.col("text")).alias("size"),
            uniform(F.col("doc_id"), seed).alias("u"),
        )
    )
    sizes = rows.groupBy("src").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = cut_lineage(
        source_targets(sizes, weights, copies)
        .withColumn("rate", rate)
        .withColumn("whole", F.floor("rate"))
        .withColumn("chance", F.col("rate") - F.col("whole"))
        .withColumn("due", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    inclusion = F.col("chance") / (1 - F.col("chance"))
    ranked = skew.lookup(rows, targets, ["src"], broadcast_rows=BROADCAST_SOURCES).withColumn(
        "q", F.when(F.col("chance") > 0, F.col("u") / (1 - F.col("u")) / inclusion).otherwise(F.lit(1e300))
    )
    part = F.least(F.floor(F.col("q") / (1 + F.col("q")) * RANGES), F.lit(RANGES - 1)).cast("int")
    ranked = ranked.withColumn("part", part)
    in_source = W.partitionBy("src").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
    ranges = (
        ranked.groupBy("src", "part", "due", "chance").agg(F.sum("size").alias("words")).withColumn("end", F.sum("words").over(in_source))
    )
    # the range in which the words due run out; a source that has its last copy has no more due
    cuts = cut_lineage(
        ranges.filter("chance > 0 AND end > due")
        .groupBy("src")
        .agg(F.min("part").alias("cut"), F.min_by(F.col("end") - F.col("words"), "part").alias("begun"))
    )
    placed = skew.lookup(ranked, cuts, ["src"], broadcast_rows=BROADCAST_SOURCES)
    at_cut = F.coalesce(F.col("part") == F.col("cut"), F.lit(False))
    late = (F.col("part") > F.col("cut")) | (F.col("chance") == 0)
    clear = placed.filter(~at_cut).withColumn("more", F.when(late, 0).otherwise(1))
    running = W.partitionBy("src", "part").orderBy("q", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("begun") + F.coalesce(F.sum("size").over(running), F.lit(0)) + F.col("size") / 2
    edge = placed.filter(at_cut).withColumn("more", F.when(middle <= F.col("due"), 1).otherwise(0))
    return clear.unionByName(edge).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more"))).alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken.

    Rows that share an id share the largest decision of theirs; a document with
    ``taken`` twice its size is to be read twice. The names of the four columns are
    taken from the decision if documents had them before.
    """
    added = ["size", "source_size", "target", "taken"]
    decided = mix_sources(docs, **options).filter("taken > 0")
    kept = docs.drop(*added)
    own, names = unused(kept, "id_of_mix"), {c: unused(kept, f"mix_{c}") for c in added}
    decided = decided.groupBy(F.col("doc_id").alias(own)).agg(
        *[F.max_by(c, F.struct("taken", "size")).alias(name) for c, name in names.items()]
    )
    return kept.join(decided, F.col("doc_id").eqNullSafe(F.col(own))).select(
        *kept.columns, *[F.col(name).alias(c) for c, name in names.items()]
    )
