"""Inheritance between definitions: registry, ancestor chains, merged trees.

Merging needs no walk over trees. Nodes with the same tag path correspond, so one
equi-join per inheritance level pairs a child's nodes with its parent's, the rules
are decided for all pairs at once, and whole subtrees are adopted by their labels.
"""

from __future__ import annotations

import functools
import itertools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locale_lake.functions import fixed
from locale_lake.functions import text as tx
from locale_lake.operators import skew
from locale_lake.operators.tree import drop_first, parent, prefixes, readable, walk_fields
from locale_lake.session import rewritten


def name_registry(heads: DataFrame, order: list[str]) -> DataFrame:
    """(pkg_id, name, tree_id, parent_name): the first definition of each name."""
    return skew.earliest(
        heads.filter(F.col("name").isNotNull()),
        ["pkg_id", "name"],
        ["tree_id", "parent_name"],
        order,
    )


def ancestors(
    links: DataFrame,
    node: str,
    up: str,
    scope: list[str] | None = None,
    materialise: Callable[[DataFrame], DataFrame] = rewritten,
) -> DataFrame:
    """Transitive closure of parent pointers: (scope, node, ancestor, dist).

    ``links`` has one row per node. A node's way is the list of its next ancestors;
    a round appends to every way the way of its last member, so ways double and the
    rounds grow with the logarithm of the longest one. A pointer to nowhere ends a
    way, and so does a node that is already on it (cycle guard, which includes the
    start): pointers are a function, so all that follows a repetition repeats too.
    """
    scope = scope or []
    few = skew.has_at_most(links, skew.HOT_ROWS)  # then no pointer can be hot

    def follow(many: DataFrame, one: DataFrame, how: str) -> DataFrame:
        keys = [*scope, "_end"]
        return many.join(one, keys, how) if few else skew.lookup(many, one, keys, how)

    pointers = links.select(*scope, node, F.col(up).alias("_end")).filter("_end IS NOT NULL").filter(F.col("_end") != F.col(node))
    there = links.select(*scope, F.col(node).alias("_end"))
    ways = materialise(follow(pointers, there, "inner").select(*scope, node, F.array("_end").alias("_way")))
    length = 1
    while not ways.filter(F.size("_way") == length).isEmpty():  # ends: no way is longer than there are nodes
        further = ways.select(*scope, F.col(node).alias("_end"), F.col("_way").alias("_on"))
        unfinished = ways.filter(F.size("_way") == length).withColumn("_end", F.element_at("_way", -1))
        whole = F.concat(F.array(node), "_way", F.coalesce("_on", F.slice("_way", 1, 0)))
        longer = follow(unfinished, further, "left").select(
            *scope, node, drop_first(F.array_distinct(whole), 1).alias("_way")
        )
        ways = materialise(ways.filter(F.size("_way") < length).unionByName(longer))
        length *= 2
    return ways.select(*scope, node, F.posexplode("_way").alias("_d", "ancestor")).select(
        *scope, node, "ancestor", (F.col("_d") + 1).alias("dist")
    )


def chains(
    heads: DataFrame,
    registry: DataFrame,
    materialise: Callable[[DataFrame], DataFrame] = rewritten,
) -> DataFrame:
    """(pkg_id, tree_id, anc_id, dist) of every definition with a known parent.

    Chains are walked once over names, of which there are few, and then looked up
    by the definitions, of which many may share a parent.
    """
    by_name = ancestors(registry, "name", "parent_name", ["pkg_id"], materialise=materialise)
    links = (
        by_name.select("pkg_id", F.col("name").alias("parent_name"), F.col("ancestor").alias("n"), "dist")
        .unionByName(
            registry.select(
                "pkg_id", F.col("name").alias("parent_name"), F.col("name").alias("n"), F.lit(0).alias("dist")
            )
        )
    )
    members = registry.select("pkg_id", F.col("name").alias("n"), F.col("tree_id").alias("anc_id"))
    way = (
        links.join(members, ["pkg_id", "n"])
        .groupBy("pkg_id", "parent_name")
        .agg(F.sort_array(F.collect_list(F.struct("dist", "anc_id"))).alias("_way"))
    )
    children = heads.filter(F.col("parent_name").isNotNull()).select("pkg_id", "tree_id", "parent_name")
    found = skew.lookup(children, way, ["pkg_id", "parent_name"], "inner")
    ids = F.transform("_way", lambda x: x["anc_id"])
    own = F.array_position(ids, F.col("tree_id")).cast("int")
    kept = F.when(own > 0, F.slice(ids, F.lit(1), own - 1)).otherwise(ids)
    return found.select("pkg_id", "tree_id", F.posexplode(kept).alias("_d", "anc_id")).select(
        "pkg_id", "tree_id", "anc_id", (F.col("_d") + 1).alias("dist")
    )


# Chains of up to so many ancestors are folded in one pass.
FOLD_LEVELS = 24
# what ``functions.text`` calls blank
_BLANK = regex.compile(r"\s*")

_NODE = ["pos", "tags", "tag", "text"]
_FACTS = ["refuses", "child_tags", "lo", "hi", "is_first"]


def _subtree_end(pos: Column) -> Column:
    """The smallest label after a node's subtree, in document order."""
    return F.when(F.size(pos) == 0, F.array(F.lit(2**31 - 1))).otherwise(
        F.concat(parent(pos), F.array(F.try_element_at(pos, F.lit(-1)) + 1))
    )


def _in_document(*keys: str) -> W:
    return W.partitionBy(*keys).orderBy("pos")


def _below_any(marked: Column, document: W) -> Column:
    """Is a node inside the subtree of an earlier marked node?

    Subtrees nest, so it is enough to keep the farthest end seen so far.
    """
    before = document.rowsBetween(W.unboundedPreceding, -1)
    farthest = F.max(F.when(marked, _subtree_end(F.col("pos")))).over(before)
    return F.coalesce(farthest > F.col("pos"), F.lit(False))


def _with_facts(trees: DataFrame) -> DataFrame:
    """Per node: tags and ordinals of its children, and whether the way to it leads
    only over first elements of their tag. Trees are shuffled once for all of it."""
    last = F.element_at("pos", -1)
    children = (
        trees.filter(F.size("pos") > 0)
        .groupBy("tree_id", parent(F.col("pos")).alias("pos"))
        .agg(
            F.collect_set("tag").alias("child_tags"),
            F.min(last).alias("lo"),
            F.max(last).alias("hi"),
        )
    )
    alike = W.partitionBy("tree_id", "_parent", "tag").orderBy("pos")
    refuses = F.lower(F.coalesce(F.try_element_at("attrs", F.lit("Inherit")), F.lit("")))
    return (
        trees.withColumn("_parent", parent(F.col("pos")))
        .withColumn("_other", (F.size("pos") > 0) & (F.row_number().over(alike) > 1))
        .withColumn(
            "is_first", ~F.col("_other") & ~_below_any(F.col("_other"), _in_document("tree_id"))
        )
        .withColumn("refuses", refuses == "false")
        .join(children, ["tree_id", "pos"], "left")
        .select("tree_id", *_NODE, *_FACTS)
    )


def merge_level(child: DataFrame, above: DataFrame) -> DataFrame:
    """Child trees with what they inherit from the resolved tree of the same id.

    All of the child's nodes stay. Corresponding nodes are decided in this order:
    the child alone, if it refuses to inherit, if the parent node has no elements,
    or if the child is a text; the parent's content, if the child is empty; both
    lists one after the other, parent first; else element by element, where an
    element of the child meets the parent's first element of that tag.

    Both sides carry facts about their nodes, which are kept up to date here, so a
    level takes two joins and one pass in document order.
    """
    theirs = above.filter("is_first").select(
        "tree_id",
        "tags",
        F.col("pos").alias("ppos"),
        F.col("child_tags").alias("p_tags"),
        F.col("lo").alias("p_lo"),
        F.col("hi").alias("p_hi"),
    )
    only_items = F.array(F.lit("li"))
    empty = F.col("child_tags").isNull()
    rule = (
        F.when(F.col("refuses") | F.col("p_tags").isNull(), "child")
        .when(empty & ~tx.is_blank(F.col("text")), "child")
        .when(empty, "parent")
        .when((F.col("child_tags") == only_items) & (F.col("p_tags") == only_items), "append")
        .otherwise("merge")
    )
    document = _in_document("tree_id")
    # below a pair that is not merged element by element, nothing corresponds
    decided = (
        child.join(theirs, ["tree_id", "tags"], "left")
        .withColumn("rule", rule)
        .withColumn("_stops", ~empty & (F.col("rule") != "merge"))
        .withColumn("_live", ~_below_any(F.col("_stops"), document))
        .withColumn("_appends", F.col("_live") & (F.col("rule") == "append"))
        .withColumn("_shifted", _below_any(F.col("_appends"), document))
    )
    takes = F.col("_live") & (F.col("rule") != "child")
    width = F.col("p_hi") - F.col("p_lo")
    lo, hi = F.coalesce("lo", F.lit(0)), F.coalesce("hi", F.lit(-1))
    kept = decided.select(
        "tree_id",
        *_NODE,
        "refuses",
        F.when(takes, F.array_union(F.coalesce("child_tags", "p_tags"), "p_tags"))
        .otherwise(F.col("child_tags"))
        .alias("child_tags"),
        F.when(F.col("_appends"), lo - 1 - width).when(takes, lo).otherwise(F.col("lo")).alias("lo"),
        F.when(takes & ~F.col("_appends"), hi + 1 + width).otherwise(F.col("hi")).alias("hi"),
        # the parent's members come first in a joint list
        (F.col("is_first") & ~F.col("_shifted")).alias("is_first"),
    )
    live = decided.filter(takes).select(
        "tree_id",
        "ppos",
        F.col("pos").alias("_cpos"),
        F.col("is_first").alias("_c_first"),
        "rule",
        lo.alias("_lo"),
        hi.alias("_hi"),
        F.col("child_tags").alias("_c_tags"),
        "p_lo",
        "p_hi",
    )
    # every node of the parent below a live pair, seen from that pair
    seen = above.filter(F.size("pos") > 0).withColumn(
        "ppos", F.explode(prefixes(F.col("pos"), 0, proper=True))
    )
    depth = F.size("ppos")
    adopted = seen.join(live, ["tree_id", "ppos"]).filter(
        (F.col("rule") != "merge") | ~F.array_contains("_c_tags", F.get("tags", depth))
    )
    ordinal = F.get("pos", depth)
    place = F.when(
        F.col("rule") == "append", F.col("_lo") - 1 - (F.col("p_hi") - ordinal)
    ).otherwise(F.col("_hi") + 1 + (ordinal - F.col("p_lo")))
    rest = F.slice("pos", depth + 2, F.greatest(F.size("pos") - depth - 1, F.lit(0)))
    moved = adopted.withColumns(
        {
            "pos": F.concat("_cpos", F.array(place), rest),
            "is_first": F.col("is_first") & F.col("_c_first"),
        }
    )
    return kept.unionByName(moved.select(*kept.columns))


def merge_inherited(
    trees: DataFrame,
    chain: DataFrame,
    materialise: Callable[[DataFrame], DataFrame] = rewritten,
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Trees with everything they inherit.

    A definition is folded with the trees of its chain, farthest ancestor first, in one
    ordered pass over all of them. Chains of more than FOLD_LEVELS ancestors are
    merged level by level instead: from the roots down, every definition is merged once
    with its resolved parent, however many heirs that has, and where ancestors form a
    cycle each heir is walked by itself. Definitions without a known parent pass
    unchanged.
    """
    others, folded = _merged(trees, chain, materialise, hot_rows, _node_rows, _NODES)
    return others.unionByName(folded)


def inherited_fields(
    trees: DataFrame,
    chain: DataFrame,
    denied_tags: tuple[str, ...] = (),
    materialise: Callable[[DataFrame], DataFrame] = rewritten,
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """``tree.walk_fields`` of ``merge_inherited``: definitions that are folded are walked as they are made."""
    others, folded = _merged(trees, chain, materialise, hot_rows, _leaf_rows, _LEAVES)
    plain = walk_fields(others, denied_tags=denied_tags)
    return plain.unionByName(readable(folded, denied_tags).select(*plain.columns))


def _merged(
    trees: DataFrame,
    chain: DataFrame,
    materialise: Callable[[DataFrame], DataFrame],
    hot_rows: int,
    rows_of: Callable[[str, _Element], Iterator[tuple]],
    kind: pa.Schema,
) -> tuple[DataFrame, DataFrame]:
    """Nodes of the definitions that are not folded, and ``rows_of`` those that are."""
    own = trees.select("tree_id", *_NODE, "attrs")
    way = F.transform(F.sort_array(F.collect_list(F.struct("dist", "anc_id"))), lambda x: x["anc_id"])
    ways = materialise(
        chain.groupBy("tree_id")
        .agg(way.alias("way"))
        .select("tree_id", "way", F.size("way").alias("length"), F.get("way", F.lit(0)).alias("parent"))
    )
    others = own.join(ways, "tree_id", "left_anti").drop("attrs")
    folded = _fold(own, ways.filter(F.col("length") <= FOLD_LEVELS), hot_rows, rows_of, kind)
    long = materialise(ways.filter(F.col("length") > FOLD_LEVELS))
    if not long.isEmpty():
        others = others.unionByName(_merge_long(own, chain, ways, long, materialise, hot_rows))
    return others, folded


class _Element:
    __slots__ = ("tag", "text", "refuses", "children")

    def __init__(self, tag: str | None, text: str | None, refuses: bool):
        self.tag, self.text, self.refuses = tag, text, refuses
        self.children: list[_Element] = []


def inherited(child: _Element, above: _Element) -> _Element:
    """The child's element with what it inherits from the corresponding one; see ``merge_level``."""
    if child.refuses or not above.children or (not child.children and not _BLANK.fullmatch(child.text or "")):
        return child
    out = _Element(child.tag, child.text, child.refuses)
    mine = {c.tag for c in child.children}
    if not child.children:
        out.children = above.children
    elif mine == {"li"} == {a.tag for a in above.children}:
        out.children = above.children + child.children
    else:
        first: dict[str | None, _Element] = {}
        for a in above.children:
            first.setdefault(a.tag, a)
        met = [inherited(c, first[c.tag]) if c.tag in first else c for c in child.children]
        out.children = met + [a for a in above.children if a.tag not in mine]
    return out


def _element_tree(depths: list[int], tags: list, texts: list, refuses: list) -> _Element | None:
    """The tree of nodes in document order."""
    root, way = None, []
    for depth, tag, text, refused in zip(depths, tags, texts, refuses, strict=True):
        element = _Element(tag, text, refused)
        del way[depth:]
        if way:
            way[-1].children.append(element)
        elif root is None:
            root = element
        way.append(element)
    return root


_NODES = pa.schema(
    [("tree_id", pa.string()), ("pos", pa.list_(pa.int32())), ("tags", pa.list_(pa.string())), ("tag", pa.string()), ("text", pa.string())]
)
_LEAVES = pa.schema(
    [
        ("tree_id", pa.string()), ("pos", pa.list_(pa.int32())), ("text", pa.string()),
        ("field_path", pa.string()), ("test_tag", pa.string()), ("_member", pa.bool_()),
    ]
)
_DDL = {
    _NODES: "tree_id string, pos array<int>, tags array<string>, tag string, text string",
    _LEAVES: "tree_id string, pos array<int>, text string, field_path string, test_tag string, _member boolean",
}


def _node_rows(tree_id: str, root: _Element) -> Iterator[tuple]:
    stack = [(root, [], [])]
    while stack:
        element, pos, tags = stack.pop()
        yield tree_id, pos, tags, element.tag, element.text
        stack += [(c, [*pos, i], [*tags, c.tag or ""]) for i, c in reversed([*enumerate(element.children)])]


def _leaf_rows(tree_id: str, root: _Element) -> Iterator[tuple]:
    """Leaves that hold text, as ``tree.walk_fields`` finds them before it looks at their text."""
    stack: list[tuple] = [(root, [], [], None, None)]
    while stack:
        element, pos, path, number, above = stack.pop()
        if not element.children:
            if pos and (element.text or "").strip(fixed.WHITESPACE):
                test_tag = element.tag if number is None else above.tag or ""
                yield tree_id, pos, element.text, ".".join(path), test_tag, number is not None
            continue
        named = [c.tag for c in element.children if c.tag is not None]
        # a list is a field, and of nested lists every second level is numbered
        numbers = bool(pos) and number is None and bool(named) and all(tag == "li" for tag in named)
        stack += [
            (c, [*pos, i], [*path, str(i) if numbers else c.tag or ""], i if numbers else None, element)
            for i, c in reversed([*enumerate(element.children)])
        ]


def _lists(column: pa.Array) -> Iterator[list]:
    """The lists of a column, one by one; their values are made Python's all at once, equal texts as one."""
    flat, ends = column.flatten(), column.value_lengths().to_pylist()
    if pa.types.is_string(flat.type):
        coded = flat.dictionary_encode()
        texts = np.array([*coded.dictionary.to_pylist(), None], dtype=object)
        values = texts[coded.indices.fill_null(len(texts) - 1).to_numpy(zero_copy_only=False)].tolist()
    else:
        values = flat.to_numpy(zero_copy_only=False).tolist() if not flat.null_count else flat.to_pylist()
    start = 0
    for length in ends:
        yield values[start : start + (length or 0)]
        start += length or 0


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(group, dist, tree_id, tree) of rows that hold a tree each."""
    for batch in batches:
        plain = [batch.column(name).to_pylist() for name in ("_group", "dist", "tree_id")]
        nested = [_lists(batch.column(name)) for name in ("depths", "tags", "texts", "refuses")]
        for group, dist, tree_id, *nodes in zip(*plain, *nested, strict=True):
            yield group, dist, tree_id, _element_tree(*nodes)


def _folded(rows_of: Callable[[str, _Element], Iterator[tuple]], kind: pa.Schema):
    """Rows by group, farthest ancestor first and the heirs last: one resolved tree an heir."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20_000))
        out: list[tuple] = []
        for _, members in itertools.groupby(_packed(batches), lambda r: r[0]):
            above = None
            for _, dist, tree_id, own in members:
                if own is None:
                    continue
                resolved = own if above is None else inherited(own, above)
                if dist < 0:
                    above = resolved
                    continue
                out += rows_of(tree_id, resolved)
                if len(out) >= 10_000:
                    yield _row_batch(out, kind)
                    out = []
        if out:
            yield _row_batch(out, kind)

    return run


def _row_batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=kind)


# Heirs of one parent that are folded together.
_HEIRS = 1_000


def _fold(
    trees: DataFrame,
    heirs: DataFrame,
    hot_rows: int,
    rows_of: Callable[[str, _Element], Iterator[tuple]],
    kind: pa.Schema,
) -> DataFrame:
    """Heirs folded with their chains, farthest ancestor first.

    A tree travels as one row. Heirs of one parent with one chain share what is above them: up to about
    ``_HEIRS`` of them are a group, which gets the trees of the chain once and resolves
    them once. Groups are read in order, so no step waits for another; what is common
    to many groups comes from a spread lookup.
    """
    refuses = F.lower(F.coalesce(F.try_element_at("attrs", F.lit("Inherit")), F.lit(""))) == "false"
    node = F.struct("pos", "tag", "text", refuses.alias("refuses"))
    each = F.sort_array(F.collect_list(node))
    packed = (
        trees.groupBy("tree_id")
        .agg(each.alias("n"))
        .select(
            F.col("tree_id").alias("anc_id"),
            F.transform("n", lambda x: F.size(x["pos"])).alias("depths"),
            F.col("n.tag").alias("tags"),
            F.col("n.text").alias("texts"),
            F.col("n.refuses").alias("refuses"),
        )
    )
    # two heirs of a parent may have other chains where these are cut at themselves
    keyed = heirs.select("tree_id", "way", F.xxhash64("way").alias("_way"))
    many = keyed.groupBy("_way").agg(F.ceil(F.count("*") / _HEIRS).alias("_parts")).filter("_parts > 1")
    part = F.pmod(F.xxhash64("tree_id"), F.coalesce("_parts", F.lit(1)))
    grouped = keyed.join(many, "_way", "left").select(
        "tree_id", "way", F.concat_ws("#", F.get("way", F.lit(0)), F.col("_way").cast("string"), part.cast("string")).alias("_group")
    )
    above = grouped.groupBy("_group").agg(F.any_value("way").alias("way")).select("_group", F.posexplode("way").alias("_d", "anc_id"))
    levels = above.select("_group", (-F.col("_d") - 1).alias("dist"), "anc_id").unionByName(
        grouped.select("_group", F.lit(0).alias("dist"), F.col("tree_id").alias("anc_id"))
    )
    few = skew.has_at_most(levels, hot_rows)  # then no ancestor can be hot
    met = levels.join(packed, "anc_id") if few else skew.lookup(levels, packed, ["anc_id"], "inner", hot_rows)
    return (
        met.select("_group", "dist", F.col("anc_id").alias("tree_id"), "depths", "tags", "texts", "refuses")
        .repartition("_group")
        .sortWithinPartitions("_group", "dist")
        .mapInArrow(_folded(rows_of, kind), _DDL[kind])
    )


def _merge_long(
    own: DataFrame,
    chain: DataFrame,
    ways: DataFrame,
    long: DataFrame,
    materialise: Callable[[DataFrame], DataFrame],
    hot_rows: int,
) -> DataFrame:
    """Heirs with long chains: level by level, where a parent is resolved once for all of them."""
    members = long.select("tree_id").unionByName(long.select(F.explode("way").alias("tree_id"))).distinct()
    ways = materialise(ways.join(members, "tree_id", "left_semi"))
    above = ways.select(F.col("tree_id").alias("parent"), F.col("way").alias("_above"))
    rest = F.slice("way", F.lit(2), F.greatest(F.col("length") - 1, F.lit(0)))
    cut_short = skew.lookup(ways, above, ["parent"], "left", hot_rows).filter(
        (F.col("length") > 1) & ~rest.eqNullSafe(F.col("_above")) | (F.col("length") == 1) & F.col("_above").isNotNull()
    )
    cut_short = materialise(cut_short.select("tree_id"))
    results, plain = [], ways
    if not cut_short.isEmpty():
        near = chain.join(cut_short.withColumnRenamed("tree_id", "anc_id"), "anc_id", "left_semi").select("tree_id")
        circular = materialise(near.unionByName(cut_short).distinct())
        results.append(_merge_each(own, chain.join(circular, "tree_id", "left_semi"), materialise, hot_rows))
        plain = materialise(ways.join(circular, "tree_id", "left_anti"))
    longest = plain.agg(F.max("length")).first()[0]
    if longest is not None:
        heirs = plain.select("tree_id", "length", "parent")
        members = heirs.select("tree_id").unionByName(plain.select(F.explode("way").alias("tree_id"))).distinct()
        facts = _with_facts(own.join(members, "tree_id", "left_semi"))
        line = materialise(facts.join(heirs, "tree_id", "left").withColumn("length", F.coalesce("length", F.lit(0))))
        resolved = line.filter("length = 0").drop("length", "parent")
        for length in range(1, longest + 1):
            child = line.filter(F.col("length") == length).drop("length", "parent")
            asking = heirs.filter(F.col("length") == length).select("tree_id", "parent")
            theirs = skew.lookup(asking, resolved.withColumnRenamed("tree_id", "parent"), ["parent"], "inner", hot_rows)
            resolved = materialise(merge_level(child, theirs.drop("parent")))
            results.append(resolved.select("tree_id", *_NODE))
    every = functools.reduce(DataFrame.unionByName, results)
    return every.join(long.select("tree_id"), "tree_id", "left_semi")


def _merge_each(
    trees: DataFrame,
    chain: DataFrame,
    materialise: Callable[[DataFrame], DataFrame] = rewritten,
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Heirs merged with their own copies of all ancestors, farthest first."""
    own = trees
    length = chain.groupBy("tree_id").agg(F.max("dist").alias("length"))
    levels = (
        chain.select("tree_id", "anc_id", "dist")
        .unionByName(
            length.select("tree_id", F.col("tree_id").alias("anc_id"), F.lit(0).alias("dist"))
        )
        .join(length, "tree_id")
    )
    levels = materialise(levels)
    longest = levels.agg(F.max("dist")).first()[0]
    involved = own.join(
        levels.select(F.col("anc_id").alias("tree_id")).distinct(), "tree_id", "left_semi"
    )
    facts = _with_facts(involved).withColumnRenamed("tree_id", "anc_id")
    line = materialise(
        skew.lookup(levels, facts, ["anc_id"], "inner", hot_rows).drop("anc_id")
    )

    def nodes_at(dist: int) -> DataFrame:
        return line.filter(F.col("dist") == dist)

    merged = None
    for dist in range(longest, 0, -1):
        starting = nodes_at(dist).filter(F.col("length") == dist).drop("dist", "length")
        above = starting if merged is None else merged.unionByName(starting)
        merged = materialise(merge_level(nodes_at(dist - 1).filter(
            F.col("length") >= dist).drop("dist", "length"), above))
    return merged.select("tree_id", *_NODE)
