"""The whole scan of a corpus of packages: files in, translatable units out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locale_lake.operators import inherit, layers, patches, tree
from locale_lake.schemas import key_columns
from locale_lake.session import cut_lineage
from locale_lake.sources import files as fs
from locale_lake.sources import lists, xml

KEYED, INJECTED, DEFINITIONS, PATCHED, STRINGS = range(5)
_FILE = ["pkg_id", "file_id", "sort_path", "stem"]
UNIT_COLUMNS = [
    "unit_id", "pkg_id", "file_id", "channel", "def_type", "type_key", "out_path", "layer", "sort_path",
    "seq", "key", "is_comment", "has_bom", "source_text",
]


@dataclass
class Scan:
    """Units (comments included), package metadata and what could not be read."""

    units: DataFrame
    packages: DataFrame
    quarantine: DataFrame
    roots: DataFrame

    @property
    def translatable(self) -> DataFrame:
        return self.units.filter(~F.col("is_comment"))


def definition_fields(nodes: DataFrame, denied_tags: tuple[str, ...] = ()) -> DataFrame:
    """Fields of all definitions, inheritance resolved across a package's files."""
    carry = ["pkg_id", "file_id", "sort_path", "stem", "root_rank", "ordinal"]
    trees = tree.def_trees(nodes)
    heads = cut_lineage(tree.def_heads(trees, carry))
    registry = cut_lineage(
        inherit.name_registry(heads, ["root_rank", "sort_path", "ordinal"])
    )
    concrete = tree.filter_defs(heads)
    chain = inherit.chains(concrete, registry)
    fields = inherit.inherited_fields(trees, chain, denied_tags).join(concrete, "tree_id")
    return tree.emit_types(fields).select(
        *carry,
        "def_type",
        tree.unit_key(F.col("def_name"), F.col("field_path")).alias("key"),
        F.col("text").alias("source_text"),
        "pos",
        (F.col("def_type") == tree.short_type(F.col("type_tag"))).alias("is_short"),
    )


def _injected_units(fields: DataFrame, layer: int, position) -> DataFrame:
    """Fields as units of the injected channel, in the order they were found.

    ``position`` orders the fields of one file; it becomes the last part of the
    sort path, so no numbering is needed.
    """
    labels = F.transform(position, lambda n: F.lpad((n + 2**31).cast("string"), 10, "0"))
    return tree.assign_files(fields).select(
        "pkg_id",
        "file_id",
        F.lit("injected").alias("channel"),
        "def_type",
        tree.short_type(F.col("def_type")).alias("type_key"),
        "out_path",
        F.lit(layer).alias("layer"),
        F.concat_ws(
            "\x01",
            F.lpad(F.col("root_rank").cast("string"), 6, "0"),
            "sort_path",
            F.array_join(labels, "."),
        ).alias("sort_path"),
        F.lit(0).cast("bigint").alias("seq"),
        "key",
        F.lit(False).alias("is_comment"),
        F.lit(False).alias("has_bom"),
        "source_text",
    )


def _language_units(entries: DataFrame, rank: dict[str, int]) -> DataFrame:
    layer = F.element_at(F.create_map(*[F.lit(x) for p in rank.items() for x in p]), F.col("channel"))
    return entries.select(
        "pkg_id",
        "file_id",
        "channel",
        "def_type",
        F.coalesce(tree.short_type(F.col("def_type")), F.lit("")).alias("type_key"),
        "out_path",
        layer.alias("layer"),
        "sort_path",
        "seq",
        "key",
        "is_comment",
        "has_bom",
        "source_text",
    )


def scan_corpus(
    spark: SparkSession,
    locations: list[str],
    packages: DataFrame,
    source_folder: str = "english",
    key_scope: str = "typed",
    new_key_policy: str = "first",
    all_language_roots: bool = False,
    line_breaks: str = lists.NEWLINES,
    denied_tags: tuple[str, ...] = (),
) -> Scan:
    """Scan packages: language files < definitions < patches, per package.

    Layers come together by joins on (package, channel, type, key), so packages of
    any size and number are merged in the same few shuffles. What several steps
    read (folder choices, parsed nodes, fields) is written once to the checkpoint
    folder: files are parsed once, and plans stay small. ``denied_tags`` never hold text,
    besides the tags that are known to hold none.
    """
    keys = key_columns(key_scope)
    packages = cut_lineage(packages)
    listing = cut_lineage(fs.read_corpus(spark, locations, packages))
    manifests = fs.read_corpus(spark, locations, packages, fs.MANIFEST).filter(F.size("rel") == 1)
    manifest_nodes = cut_lineage(xml.shred_xml(manifests, ["pkg_id", "file_id"]))
    roots = cut_lineage(fs.newest_roots(listing, manifest_nodes))
    languages = fs.language_roots(listing, roots, all_language_roots)
    lang_dirs = cut_lineage(fs.source_language(listing, languages, source_folder))

    # folders are chosen on the listing, so what lies in none that counts is not opened
    chosen = fs.chosen_files(fs.place_files(listing, roots, lang_dirs))

    def contents(pattern: str) -> DataFrame:
        return fs.read_corpus(spark, locations if chosen is None else chosen, packages, pattern)

    # every file that is used is opened and parsed once, whatever it is used for
    described = [*_FILE, "area", "root_rank", "channel", "def_type", "out_path", "spoken"]
    placed = fs.place_files(contents("*.xml"), roots, lang_dirs).withColumn(
        "spoken", F.col("area").isin("keyed", "injected")
    )
    nodes = cut_lineage(xml.shred_xml(placed, described, keep_comments="spoken"))
    readable = nodes.filter(F.col("parse_error").isNull())

    def area(name: str) -> DataFrame:
        return readable.filter(F.col("area") == name)

    fields = cut_lineage(definition_fields(area("definitions"), denied_tags))
    entries = xml.read_keyed(readable.filter("spoken"))
    rank = {"keyed": KEYED, "injected": INJECTED, "strings": STRINGS}
    language = _language_units(entries, rank)

    # a definition fills in where no language folder covers its type
    ordered = F.concat(F.array(F.col("ordinal")), F.col("pos"))
    from_defs = _injected_units(fields, DEFINITIONS, ordered)
    covered = fs.covered_types(listing, lang_dirs)
    filled = layers.fill_uncovered(language, from_defs, covered)

    # text in definitions is newer than text in language files; comments stay out
    # without a language folder there is nothing to refresh
    current = (
        fields.filter("is_short")
        .join(lang_dirs.select("pkg_id"), "pkg_id", "left_semi")
        .withColumns({"channel": F.lit("injected"), "type_key": F.col("def_type")})
    )
    order = ["root_rank", "sort_path", "ordinal", "pos"]
    injected = (F.col("channel") == "injected") & ~F.col("is_comment")
    refreshed = layers.refresh_stale(filled.filter(injected), current, keys, order)

    patch_fields = cut_lineage(
        patches.patch_fields(
            area("patches"),
            ["pkg_id", "file_id", "sort_path", "stem", "root_rank"],
            denied_tags=denied_tags,
        )
    )
    stems = patch_fields.groupBy("pkg_id", "stem").agg(
        F.min(F.struct("root_rank", "sort_path")).alias("stem_rank")
    )
    change = patch_fields.join(stems, ["pkg_id", "stem"]).select(
        "*",
        tree.unit_key(F.col("def_name"), F.col("field_path")).alias("key"),
        F.col("text").alias("source_text"),
    )
    change_units = _injected_units(change.withColumn("pos", F.col("patch_pos")), PATCHED, F.col("patch_pos"))
    change_units = change_units.withColumn(
        "stem", F.regexp_extract("out_path", r"(?s)([^/]*)\.xml$", 1)
    ).join(stems, ["pkg_id", "stem"])
    patched = layers.apply_patches(
        refreshed, change_units, keys, ["stem_rank", "sort_path"], new_key_policy
    ).drop("stem", "stem_rank")

    texts = fs.place_files(contents("*.txt"), roots, lang_dirs)
    strings = lists.split_lines(
        texts.filter(F.col("area") == "strings").select(
            *_FILE,
            "channel",
            "def_type",
            "out_path",
            F.startswith(F.col("content"), F.lit(b"\xef\xbb\xbf")).alias("has_bom"),
            F.col("out_path").alias("prefix"),
            lists.decode(F.col("content")).alias("content"),
        ),
        [*_FILE, "channel", "def_type", "out_path", "has_bom"],
        line_breaks,
    ).withColumnRenamed("text", "source_text")

    units = (
        filled.filter(~injected)
        .unionByName(patched)
        .unionByName(_language_units(strings, rank))
    )
    units = units.withColumn(
        "unit_id",
        F.sha2(
            F.concat_ws(
                "\x02", "pkg_id", "out_path", F.col("layer").cast("string"), "sort_path",
                F.col("seq").cast("string"), "key",
            ),
            256,
        ),
    ).select(*UNIT_COLUMNS)
    return Scan(
        units=units,
        packages=fs.read_packages(packages, area("about"), lang_dirs),
        quarantine=xml.quarantine(nodes, ["pkg_id", "file_id", "area"]),
        roots=roots,
    )
