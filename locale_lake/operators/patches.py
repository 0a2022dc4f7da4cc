"""Text that change operations inject into definitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locale_lake.functions import fixed
from locale_lake.functions import text as tx
from locale_lake.operators import skew
from locale_lake.operators.tree import drop_first, parent, short_type, walk_fields
from locale_lake.session import cut_lineage


def patch_ops(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """Add, Replace and Insert operations at any depth, whatever their conditions.

    Nesting costs nothing: every node is a row, an operation is a filter, and its
    address and value are two of its children.
    """
    kind = F.element_at(
        F.split(F.coalesce(F.try_element_at("attrs", F.lit("Class")), F.lit("")), r"\."), -1
    )
    # attribute of the node itself, or a child that may be its address or value
    operations = nodes.filter(kind.isin(*fixed.TEXT_OPERATIONS)).select(
        "file_id", F.col("pos").alias("op_pos"), kind.alias("op"), *carry
    )
    named = nodes.filter((F.size("pos") > 0) & F.col("tag").isin("xpath", "value")).select(
        "file_id", parent(F.col("pos")).alias("op_pos"), "pos", "tag", "text"
    )
    parts = (
        skew.dealt(named, named.count(), "file_id", "op_pos")
        .groupBy("file_id", "op_pos")
        .agg(
            F.min_by("text", F.when(F.col("tag") == "xpath", F.col("pos"))).alias("address"),
            F.min(F.when(F.col("tag") == "value", F.col("pos"))).alias("value_pos"),
        )
    )
    return operations.join(parts, ["file_id", "op_pos"]).filter(
        (F.coalesce("address", F.lit("")) != "") & F.col("value_pos").isNotNull()
    )


def parse_address(ops: DataFrame, address: str = "address") -> DataFrame:
    """Adds ``def_type``, ``def_name`` (one row per target) and ``segments``.

    Addresses that do not say exactly where the text goes are dropped.
    """
    pattern = "(?U)" + fixed.ADDRESS
    trimmed = tx.strip(F.col(address))
    rest = F.regexp_extract(trimmed, pattern, 3)
    segments = F.when(rest == "", F.array().cast("array<string>")).otherwise(
        F.split(rest, "/", -1)
    )
    item, plain = "(?U)" + fixed.ADDRESS_ITEM, "(?U)" + fixed.ADDRESS_SEGMENT
    return (
        ops.filter(trimmed.rlike(pattern))
        .withColumn("_segments", segments)
        .filter(
            F.forall(
                "_segments", lambda s: s.rlike(item) | (s.rlike(plain) & (s != F.lit("li")))
            )
        )
        .withColumn("def_type", short_type(F.regexp_extract(trimmed, pattern, 1)))
        .withColumn(
            "def_name",
            F.explode(
                F.regexp_extract_all(
                    F.regexp_extract(trimmed, pattern, 2), F.lit(fixed.ADDRESS_NAME), F.lit(1)
                )
            ),
        )
        .withColumn(
            "segments",
            F.transform(
                "_segments",
                lambda s: F.when(
                    s.rlike(item),
                    (F.regexp_extract(s, item, 1).cast("bigint") - 1).cast("string"),
                ).otherwise(s),
            ),
        )
        .drop("_segments")
    )


def patch_fields(
    nodes: DataFrame,
    carry: list[str],
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
    denied_tags: tuple[str, ...] = (),
) -> DataFrame:
    """(carry, def_type, def_name, field_path, text, patch_pos) of all operations.

    The value of an Add goes into the addressed node, that of a Replace or Insert
    into its parent. List members are skipped, since their place in the final list
    is unknown. A payload with a name of its own, put where no field is addressed,
    is a whole definition.
    """
    targets = parse_address(patch_ops(nodes, carry))
    segments = F.col("segments")
    targets = materialise(
        targets.withColumn(
            "segments",
            F.when(F.col("op") == "PatchOperationAdd", segments).otherwise(
                F.slice(segments, F.lit(1), F.greatest(F.size(segments) - 1, F.lit(0)))
            ),
        )
    )
    # payloads: the children of a value node and all below them
    values = targets.select("file_id", "value_pos").distinct()
    # only an ancestor called "value" can be one
    ups = F.transform(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.size("pos") - 1, F.lit(1))),
            lambda n: F.get("tags", n) == "value",
        ),
        lambda n: F.slice("pos", F.lit(1), n),
    )
    below = (
        nodes.filter(F.size("pos") > 1)
        .select("file_id", "pos", "tags", "tag", "text", F.explode(ups).alias("value_pos"))
        .join(values, ["file_id", "value_pos"])
        .withColumn("child_pos", F.slice("pos", F.lit(1), F.size("value_pos") + 1))
        .withColumn("child_tag", F.get("tags", F.size("value_pos") + 1))
        .filter((F.col("child_tag") != "li") & (F.size("pos") > F.size("value_pos")))
    )
    is_name = (F.size("pos") == F.size("value_pos") + 2) & (F.col("tag") == "defName")
    names = (
        below.filter(is_name)
        .groupBy("file_id", "value_pos", "child_pos")
        .agg(tx.strip(F.min_by("text", "pos")).alias("own_name"))
    )
    payload = materialise(below.join(names, ["file_id", "value_pos", "child_pos"], "left"))

    def trees(rows: DataFrame, root: str) -> DataFrame:
        """``root`` becomes the root of the tree."""
        rooted = rows.select(
            F.concat_ws("#", "file_id", F.array_join(F.col(root).cast("array<string>"), ".")).alias("tree_id"),
            F.slice("pos", F.size(root) + 1, F.size("pos")).alias("pos"),
            drop_first(F.col("tags"), F.size(root) + 1).alias("tags"),
            "tag",
            "text",
            "file_id",
            "value_pos",
            "child_pos",
            "child_tag",
            "own_name",
        )
        return skew.dealt(rooted, rows.count(), "tree_id")

    described = ["file_id", "value_pos", "child_pos", "child_tag", "own_name"]
    fields = walk_fields(trees(payload, "value_pos"), described, denied_tags).withColumnRenamed("pos", "_pos")
    inner = walk_fields(
        trees(payload.filter(F.col("own_name").isNotNull()), "child_pos"), described, denied_tags
    ).withColumnRenamed("pos", "_pos")

    place = ["file_id", "value_pos"]
    bare = F.size("segments") == 0
    into = fields.join(targets, place).filter(~(bare & F.col("own_name").isNotNull())).select(
        *carry,
        "def_type",
        "def_name",
        F.array_join(F.concat("segments", F.array("field_path")), ".").alias("field_path"),
        "text",
        F.concat("value_pos", "_pos").alias("patch_pos"),
    )
    whole = (
        inner.join(targets.filter(bare), place)
        .filter(F.col("own_name") != "")
        .select(
            *carry,
            short_type(F.col("child_tag")).alias("def_type"),
            F.col("own_name").alias("def_name"),
            "field_path",
            "text",
            F.concat("child_pos", "_pos").alias("patch_pos"),
        )
    )
    return into.unionByName(whole)
