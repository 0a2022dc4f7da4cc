"""Trees of nodes to translatable fields.

A tree is a set of rows (tree_id, pos, tags, tag, text): ``pos`` is the Dewey label
below the tree's root and ``tags`` the tag path below it. Parents are prefixes and
document order is array order, so nothing here walks a tree node by node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locale_lake.functions import classify as cl
from locale_lake.functions import text as tx


def parent(pos: Column) -> Column:
    return F.slice(pos, 1, F.greatest(F.size(pos) - 1, F.lit(0)))


def drop_first(array: Column, n: int) -> Column:
    return F.slice(array, n + 1, F.greatest(F.size(array) - n, F.lit(0)))


def prefixes(pos: Column, shortest: int, proper: bool) -> Column:
    """Ancestor labels of a node, from ``shortest`` long up to (not) itself."""
    lengths = F.sequence(F.lit(0), F.size(pos))
    longest = F.size(pos) - (1 if proper else 0)
    return F.transform(
        F.filter(lengths, lambda n: (n >= shortest) & (n <= longest)),
        lambda n: F.slice(pos, F.lit(1), n),
    )


def def_trees(nodes: DataFrame) -> DataFrame:
    """One tree per definition (a child of the document root)."""
    return (
        nodes.filter((F.size("pos") >= 1) & ~F.col("is_comment"))
        .withColumn("ordinal", F.col("pos")[0])
        .withColumn("tree_id", F.concat_ws("#", "file_id", F.col("ordinal").cast("string")))
        .withColumn("type_tag", F.col("tags")[1])
        .withColumn("pos", drop_first(F.col("pos"), 1))
        .withColumn("tags", drop_first(F.col("tags"), 2))
    )


def def_heads(trees: DataFrame, carry: list[str]) -> DataFrame:
    """One row per definition: its own name, its inheritance attributes, its type.

    The name is read from the definition itself, before any inheritance.
    """
    near = trees.filter(F.size("pos") <= 1)
    is_root = F.size("pos") == 0
    is_name = (F.size("pos") == 1) & (F.col("tag") == "defName")

    def attribute(name: str) -> Column:
        return F.max(F.when(is_root, F.try_element_at("attrs", F.lit(name))))

    heads = near.groupBy("tree_id", *carry).agg(
        F.max(F.when(is_root, F.col("type_tag"))).alias("type_tag"),
        attribute("Name").alias("name"),
        attribute("ParentName").alias("parent_name"),
        attribute("Abstract").alias("abstract"),
        tx.strip(F.min_by("text", F.when(is_name, F.col("pos")))).alias("def_name"),
    )
    return heads.withColumns(
        {
            "name": F.when(F.col("name") != "", F.col("name")),
            "parent_name": F.when(F.col("parent_name") != "", F.col("parent_name")),
        }
    )


def filter_defs(heads: DataFrame) -> DataFrame:
    """Concrete definitions that have a name of their own."""
    abstract = F.lower(F.coalesce("abstract", F.lit(""))) == "true"
    return heads.filter(~abstract & (F.coalesce("def_name", F.lit("")) != ""))


def short_type(tag: Column) -> Column:
    return F.element_at(F.split(tag, r"\."), -1)


def emit_types(fields: DataFrame) -> DataFrame:
    """A dotted type stands under its short and its full name."""
    return fields.withColumn(
        "def_type",
        F.explode(F.array_distinct(F.array(short_type(F.col("type_tag")), F.col("type_tag")))),
    )


def unit_key(name: Column, path: Column) -> Column:
    return F.concat_ws(".", name, F.when(path != "", path))


def walk_fields(
    trees: DataFrame, carry: list[str] | None = None, denied_tags: tuple[str, ...] = ()
) -> DataFrame:
    """Leaves that hold text: (tree_id, pos, field_path, test_tag, text, carry...).

    Tags are joined by dots; members of a list (all siblings ``li``) are numbered
    from 0. A member is tested under its list's tag, and a rule string passes even
    where the value alone would not. ``denied_tags`` hold no text, besides those known.
    """
    return readable(_leaves(trees, carry or []), denied_tags)


def readable(fields: DataFrame, denied_tags: tuple[str, ...] = ()) -> DataFrame:
    """The leaves whose text is for people; ``_member`` tells members of a list."""
    passes = cl.is_translatable(F.col("test_tag"), F.col("text"), denied_tags) | (
        F.col("_member") & tx.is_rule_string(F.col("test_tag"), F.col("text")) & ~F.lower("test_tag").isin(*[t.lower() for t in denied_tags])
    )
    return fields.filter(passes).drop("_member")


def _leaves(trees: DataFrame, carry: list[str]) -> DataFrame:
    in_document = W.partitionBy("tree_id").orderBy("pos")
    siblings = W.partitionBy("tree_id", "_parent")
    # one shuffle by tree serves all three windows
    marked = (
        trees.select("tree_id", "pos", "tags", "tag", "text", *carry)
        .withColumn("_next", F.lead("pos").over(in_document))
        .withColumn("_parent", parent(F.col("pos")))
        # in this order the second of these finds its rows sorted
        .withColumn("_index", F.row_number().over(siblings.orderBy("pos")) - 1)
        .withColumn("_in_list", F.bool_and(F.col("tag") == "li").over(siblings))
        .filter(F.size("pos") > 0)
        .withColumn("_is_leaf", F.col("_next").isNull() | (F.size("_next") <= F.size("pos")))
        # a list is a field, so its members are at least two levels down
        .withColumn("_own", F.when(F.coalesce("_in_list", F.lit(False)) & (F.size("pos") >= 2), F.col("_index")))
        .drop("_next", "_parent", "_in_list", "_index")
    )
    leaves = marked.filter(F.col("_is_leaf") & ~tx.is_blank(F.col("text"))).drop("_is_leaf")

    # members stand among elements called "li"; where only the leaf itself is called
    # so, its own number is all that counts, and most leaves are done in one pass
    above = prefixes(F.col("pos"), 2, proper=True)
    member_like = F.filter(above, lambda p: F.get("tags", F.size(p) - 1) == "li")
    is_nested = F.size(member_like) > 0
    last = F.size("tags") - 1
    flat = leaves.filter(~is_nested).select(
        "tree_id",
        "pos",
        "text",
        *carry,
        F.array_join(
            F.when(F.col("_own").isNull(), F.col("tags")).otherwise(
                F.concat(F.slice("tags", F.lit(1), last), F.array(F.col("_own").cast("string")))
            ),
            ".",
        ).alias("field_path"),
        F.when(F.col("_own").isNotNull(), F.get("tags", last - 1)).otherwise(F.col("tag")).alias("test_tag"),
        F.col("_own").isNotNull().alias("_member"),
    )
    members = marked.filter(F.col("_own").isNotNull() & ~F.col("_is_leaf")).select(
        "tree_id", F.col("pos").alias("_at"), F.col("_own").alias("_i")
    )
    steps = (
        leaves.filter(is_nested)
        .withColumn("_at", F.explode(above))
        .join(members, ["tree_id", "_at"], "left")
        .groupBy("tree_id", "pos", "tags", "tag", "text", "_own", *carry)
        .agg(
            F.sort_array(
                F.collect_list(F.struct(F.size("_at").alias("n"), F.col("_i").alias("i")))
            ).alias("_steps")
        )
        .withColumn(
            "_numbers",
            _list_numbers(F.concat("_steps", F.array(F.struct(F.size("pos").alias("n"), F.col("_own").alias("i"))))),
        )
    )
    numbered = steps.select(
        "tree_id",
        "pos",
        "text",
        *carry,
        F.array_join(
            F.transform(
                "tags",
                lambda tag, d: F.coalesce(F.get(F.col("_numbers"), d).cast("string"), tag),
            ),
            ".",
        ).alias("field_path"),
        F.when(
            F.element_at("_numbers", -1).isNotNull(), F.get("tags", F.size("tags") - 2)
        )
        .otherwise(F.col("tag"))
        .alias("test_tag"),
        F.element_at("_numbers", -1).isNotNull().alias("_member"),
    )
    return flat.unionByName(numbered)


def _list_numbers(steps: Column) -> Column:
    """Per level the number a member shows in the path, or null for its tag.

    A member is itself no field, so a list right below a member is not numbered:
    of nested lists every second level is.
    """
    nothing = F.array(F.lit(None).cast("int"))

    def step(numbers: Column, x: Column) -> Column:
        above = F.element_at(numbers, -1)
        return F.concat(numbers, F.array(F.when(above.isNull(), x["i"])))

    return F.aggregate(steps, nothing, step)


def assign_files(fields: DataFrame) -> DataFrame:
    """Adds the output file: one per type and stem of the source file."""
    return fields.withColumn(
        "out_path",
        F.concat(F.lit("DefInjected/"), "def_type", F.lit("/"), "stem", F.lit(".xml")),
    )
