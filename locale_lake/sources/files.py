"""Listing a corpus of packages and choosing the folders that count."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locale_lake.functions import fixed
from locale_lake.functions import text as tx
from locale_lake.operators import skew
from locale_lake.session import qualified

# Package dimension tables (roots, language folders) are broadcast only when
# counted to be no larger (a row holds a few paths); else the join is spread over tasks.
BROADCAST_PACKAGES = 100_000
# Files that are used are opened by name up to this many, as Spark lists every path that
# it is given in a task of its own; beyond, the folders that hold them are read, and beyond
# so many folders all files of a kind. Those that are not used are dropped after.
CHOSEN_FILES = 500
# Spark deals small files out by some 30 a task; so many of these make one.
PACKED_TASKS = 16


# the manifest's name in any case
MANIFEST = "".join(
    f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in "loadfolders.xml"
)


def _local(path: Column) -> Column:
    """``file:/x`` and ``file:///x`` both become ``/x``; other schemes stay."""
    return F.regexp_replace(path, "^file:/+", "/")


def packages_in(spark: SparkSession, folder: str) -> DataFrame:
    """(pkg_id, pkg_seq): every folder directly below ``folder`` is a package.

    Packages are numbered by name, in buckets of equal first letters.
    """
    folder = qualified(spark, folder.rstrip("/"))
    paths = _packed(_listing(spark, [folder]).select(_local(F.col("path")).alias("path")))
    base = folder if "://" in folder else _plain(folder)
    names = (
        paths.select(F.split(F.expr(f"substring(path, {len(base) + 2})"), "/").alias("p"))
        .filter(F.size("p") > 1)
        .select(F.concat(F.lit(base + "/"), F.col("p")[0]).alias("pkg_id"))
        .distinct()
    )
    name = F.element_at(F.split("pkg_id", "/"), -1)
    lettered = names.withColumns(
        {"_first": F.substring(name, 1, 2), "_more": F.substring(name, 1, 8)}
    )
    return skew.number_rows(lettered, [], ["_first", "_more"], ["pkg_id"], "pkg_seq").select(
        "pkg_id", "pkg_seq"
    )


def packages_from(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(pkg_id, pkg_seq) for an explicit, ordered list of package folders."""
    rows = [(_plain(qualified(spark, root)), i) for i, root in enumerate(roots)]
    return spark.createDataFrame(rows, "pkg_id string, pkg_seq bigint")


def _plain(path: str) -> str:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return path.rstrip("/")


def _listing(spark: SparkSession, paths: list[str], glob: str | None = None) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length bigint, content binary")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(paths)


def _packed(files: DataFrame) -> DataFrame:
    """A scan of small files in fewer tasks, no less than there are cores."""
    tasks, cores = files.rdd.getNumPartitions(), files.sparkSession.sparkContext.defaultParallelism
    packed = max(cores, -(-tasks // PACKED_TASKS))
    return files.coalesce(packed) if packed < tasks else files


def read_corpus(
    spark: SparkSession, locations: list[str], packages: DataFrame, content: str | None = None
) -> DataFrame:
    """Files below the given locations, assigned to their packages.

    ``content`` names the files to read by a pattern; without it only the listing
    is made and no file is opened. ``rel`` is the path below the package
    as an array, ``sort_path`` orders files the way path components compare.
    """
    files = _listing(spark, locations, content)
    files = files.select(
        _local(F.col("path")).alias("path"), *(["content"] if content else [])
    )
    files = _packed(files).withColumn("_parts", F.split("path", "/"))
    # package folders sit at one of a few depths; each file looks up its prefixes
    depths = [
        row[0]
        for row in packages.select(F.size(F.split("pkg_id", "/")).alias("d")).distinct().collect()
    ]
    prefixes = F.array(*[F.array_join(F.slice("_parts", 1, d), "/") for d in sorted(depths)])
    keyed = files.withColumn("pkg_id", F.explode(F.array_distinct(prefixes)))
    found = skew.lookup(
        keyed, packages, ["pkg_id"], "inner", broadcast_rows=BROADCAST_PACKAGES
    )
    depth = F.size(F.split("pkg_id", "/"))
    rel = F.slice("_parts", depth + 1, F.greatest(F.size("_parts") - depth, F.lit(0)))
    name = F.element_at("rel", -1)
    return (
        found.withColumn("rel", rel)
        .filter(F.size("rel") > 0)
        .withColumns(
            {
                "file_id": F.col("path"),
                "rel_path": F.array_join("rel", "/"),
                "sort_path": F.array_join("rel", "\x01"),
                "name": name,
                "stem": F.regexp_replace(name, r"(?s)(.)\.[^.]*$", "$1"),
            }
        )
        .drop("_parts")
    )


def chosen_files(used: DataFrame) -> list[str] | None:
    """Paths of the files that are used, or of the folders that hold them, as patterns that match themselves.

    Of folders inside each other only the outer one is named. None if there are too many for a list.
    """
    file = F.col("file_id")
    for place in (file, F.regexp_replace(file, "/[^/]*$", "")):
        paths = sorted(r[0] + "/" for r in used.select(place.alias("place")).distinct().limit(CHOSEN_FILES + 1).collect())
        if len(paths) <= CHOSEN_FILES:
            outer: list[str] = []
            for path in paths:
                if not outer or not path.startswith(outer[-1]):
                    outer.append(path)
            return [re.sub(r"([\\{}\[\]*?])", r"\\\1", path[:-1]) for path in outer]
    return None


def _version(tag: Column) -> Column:
    """(major, minor) of a version tag; numbers compare, not text."""
    return F.when(
        tag.rlike(fixed.VERSION_TAG),
        F.struct(
            F.regexp_extract(tag, fixed.VERSION_TAG, 1).cast("int").alias("major"),
            F.regexp_extract(tag, fixed.VERSION_TAG, 2).cast("int").alias("minor"),
        ),
    )


def newest_by(df: DataFrame, group: list[str], tag: str) -> DataFrame:
    """The numerically greatest version tag per group."""
    return (
        df.withColumn("_v", _version(F.col(tag)))
        .filter(F.col("_v").isNotNull())
        .groupBy(*group)
        .agg(F.max_by(tag, F.struct("_v", tag)).alias(tag))
    )


def folders(files: DataFrame) -> DataFrame:
    """(pkg_id, folder) for every folder that holds a file at any depth."""
    lengths = F.sequence(F.lit(0), F.size("rel") - 1)
    return files.select(
        "pkg_id",
        F.explode(
            F.transform(lengths, lambda n: F.array_join(F.slice("rel", F.lit(1), n), "/"))
        ).alias("folder"),
    ).distinct()


def newest_roots(files: DataFrame, manifest_nodes: DataFrame) -> DataFrame:
    """(pkg_id, root, root_rank, conditional): the folders the newest version loads.

    The manifest decides if it names a version and one of its folders exists; else
    the package folder and its greatest version folder; else the package folder.
    Items with a condition are kept and only marked.
    """
    tops = manifest_nodes.filter((F.size("pos") == 1) & F.col("parse_error").isNull())
    best = newest_by(tops, ["pkg_id", "file_id"], "tag")
    chosen = (
        tops.join(best, ["pkg_id", "file_id", "tag"])
        .groupBy("pkg_id", "file_id")
        .agg(F.min("pos").alias("_top"))
    )
    cleaned = F.split(F.btrim(tx.strip(F.coalesce("text", F.lit(""))), F.lit("/\\")), "/")
    items = (
        manifest_nodes.filter(F.size("pos") == 2)
        .join(chosen, ["pkg_id", "file_id"])
        .filter(F.slice("pos", 1, 1) == F.col("_top"))
        .select(
            "pkg_id",
            F.col("pos")[1].alias("root_rank"),
            F.array_join(F.filter(cleaned, lambda s: ~s.isin("", ".")), "/").alias("root"),
            F.map_contains_key("attrs", "IfModActive").alias("conditional"),
        )
    )
    with_manifest = files.join(manifest_nodes.select("pkg_id").distinct(), "pkg_id", "left_semi")
    listed = items.join(
        folders(with_manifest).withColumnRenamed("folder", "root"), ["pkg_id", "root"]
    )
    nested = files.filter(F.size("rel") > 1).select("pkg_id", F.col("rel")[0].alias("root"))
    plain = files.select("pkg_id").distinct().select(
        "pkg_id", F.lit("").alias("root"), F.lit(0).alias("root_rank")
    )
    by_folder = plain.unionByName(
        newest_by(nested.distinct(), ["pkg_id"], "root").withColumn("root_rank", F.lit(1))
    ).withColumn("conditional", F.lit(False))
    fallback = by_folder.join(listed.select("pkg_id").distinct(), "pkg_id", "left_anti")
    return dedup_roots(listed.unionByName(fallback))


def dedup_roots(roots: DataFrame) -> DataFrame:
    """A folder named twice is read once, at its first place."""
    return roots.groupBy("pkg_id", "root").agg(
        F.min("root_rank").alias("root_rank"), F.bool_and("conditional").alias("conditional")
    )


def language_roots(files: DataFrame, roots: DataFrame, all_roots: bool = False) -> DataFrame:
    """(pkg_id, languages): the least nested Languages folder of each package.

    Folders inside a version folder that is not loaded are left out.
    """
    at = F.filter(
        F.sequence(F.lit(1), F.size("rel")),
        lambda i: (F.get("rel", i - 1) == "Languages") & (i < F.size("rel")),
    )
    candidates = (
        files.select("pkg_id", F.explode(F.transform(at, lambda i: F.slice("rel", F.lit(1), i))).alias("c"))
        .distinct()
    )
    loaded = roots.groupBy("pkg_id").agg(F.collect_set("root").alias("_roots"))
    above = F.transform(
        F.sequence(F.lit(1), F.size("c")), lambda n: F.slice("c", F.lit(1), n)
    )
    versioned = F.filter(
        F.slice(above, 1, F.size("c") - 1),
        lambda p: F.element_at(p, -1).rlike(fixed.VERSION_TAG),
    )
    allowed = candidates.join(loaded, "pkg_id").filter(
        F.forall(versioned, lambda p: F.array_contains(F.col("_roots"), F.array_join(p, "/")))
    )
    named = allowed.select("pkg_id", F.array_join("c", "/").alias("languages"), F.size("c").alias("depth"))
    if all_roots:
        return named.drop("depth")
    return named.groupBy("pkg_id").agg(
        F.min_by("languages", F.struct("depth", "languages")).alias("languages")
    )


def source_language(files: DataFrame, languages: DataFrame, folder: str = "english") -> DataFrame:
    """(pkg_id, lang_dir): the source folder below the Languages folder, any case."""
    below = files.join(languages, "pkg_id").filter(
        F.startswith(F.col("rel_path"), F.concat("languages", F.lit("/")))
    )
    named = below.select(
        "pkg_id",
        "languages",
        F.get("rel", F.size(F.split("languages", "/"))).alias("dir"),
        (F.size("rel") - F.size(F.split("languages", "/"))).alias("_left"),
    )
    return (
        named.filter((F.lower("dir") == folder.lower()) & (F.col("_left") > 1))
        .groupBy("pkg_id", "languages")
        .agg(F.min("dir").alias("dir"))
        .select("pkg_id", F.concat_ws("/", "languages", "dir").alias("lang_dir"))
    )


def _below(folder: Column) -> Column:
    """Path components of a file below a folder, or null outside of it."""
    return F.when(
        F.startswith(F.col("rel_path"), F.concat(folder, F.lit("/"))),
        F.slice("rel", F.size(F.split(folder, "/")) + 1, F.size("rel")),
    )


def _channel(below: Column) -> Column:
    top, depth = F.get(below, F.lit(0)), F.size(below)
    is_xml = F.endswith(F.col("name"), F.lit(".xml"))
    is_text = F.endswith(F.col("name"), F.lit(".txt"))
    return (
        F.when((top == "Keyed") & (depth > 1) & is_xml, "keyed")
        .when((top == "DefInjected") & (depth > 2) & is_xml, "injected")
        .when((top == "Strings") & (depth > 1) & is_text, "strings")
    )


def channel_files(files: DataFrame, lang_dirs: DataFrame) -> DataFrame:
    """Language files with ``channel``, ``def_type`` and ``out_path``."""
    inside = skew.lookup(
        files, lang_dirs, ["pkg_id"], "inner", broadcast_rows=BROADCAST_PACKAGES
    ).withColumn("_below", _below(F.col("lang_dir")))
    return _described(inside.withColumn("channel", _channel(F.col("_below")))).filter(
        F.col("channel").isNotNull()
    )


def _described(files: DataFrame) -> DataFrame:
    return (
        files.withColumn("def_type", F.when(F.col("channel") == "injected", F.get("_below", F.lit(1))))
        .withColumn("out_path", F.array_join("_below", "/"))
        .drop("_below")
    )


AREAS = ("definitions", "patches", "about", "keyed", "injected", "strings")


def place_files(files: DataFrame, roots: DataFrame, lang_dirs: DataFrame) -> DataFrame:
    """Files that are used, with their ``area`` and what the area needs to know.

    Folder choices are a few values per package, so one lookup brings them to the
    files and the content of files is read once for all areas. Definitions and
    patches count only directly below a loaded root; a file of two roots stands
    under both.
    """
    chosen = roots.groupBy("pkg_id").agg(
        F.collect_list(F.struct("root", "root_rank")).alias("_roots")
    )
    spoken = lang_dirs.groupBy("pkg_id").agg(F.sort_array(F.collect_set("lang_dir")).alias("_dirs"))
    found = skew.lookup(
        files,
        chosen.join(spoken, "pkg_id", "left"),
        ["pkg_id"],
        "inner",
        broadcast_rows=BROADCAST_PACKAGES,
    )
    place = "array<struct<area:string,root_rank:int>>"
    nowhere = F.array().cast(place)
    is_xml = F.endswith(F.col("name"), F.lit(".xml"))

    def under(folder: str, area: str) -> Column:
        holding = F.filter(
            "_roots",
            lambda r: F.startswith(
                F.col("rel_path"),
                F.concat(r["root"], F.when(r["root"] == "", "").otherwise("/"), F.lit(folder + "/")),
            ),
        )
        places = F.transform(holding, lambda r: F.struct(F.lit(area), r["root_rank"]))
        return F.when(is_xml, places.cast(place)).otherwise(nowhere)

    def only(condition: Column, area: Column) -> Column:
        there = F.array(F.struct(area, F.lit(0))).cast(place)
        return F.when(F.coalesce(condition, F.lit(False)), there).otherwise(nowhere)

    about = (F.col("name") == "About.xml") & (F.get("rel", F.size("rel") - 2) == "About")
    folder = F.get(
        F.filter("_dirs", lambda d: F.startswith(F.col("rel_path"), F.concat(d, F.lit("/")))),
        F.lit(0),
    )
    placed = (
        found.withColumn("_below", _below(folder))
        .withColumn("channel", _channel(F.col("_below")))
        .withColumn(
            "_place",
            F.explode(
                F.concat(
                    under("Defs", "definitions"),
                    under("Patches", "patches"),
                    only(about, F.lit("about")),
                    only(F.col("channel").isNotNull(), F.col("channel")),
                )
            ),
        )
    )
    return _described(placed.select("*", "_place.*").drop("_place", "_roots", "_dirs"))


def covered_types(files: DataFrame, lang_dirs: DataFrame) -> DataFrame:
    """(pkg_id, def_type) of every folder of injected text, whatever it holds."""
    inside = files.join(lang_dirs, "pkg_id").filter(
        F.startswith(F.col("rel_path"), F.concat("lang_dir", F.lit("/DefInjected/")))
    )
    below = F.slice("rel", F.size(F.split("lang_dir", "/")) + 2, F.size("rel"))
    return (
        inside.filter(F.size(below) > 1).select("pkg_id", F.get(below, F.lit(0)).alias("def_type")).distinct()
    )


def read_packages(packages: DataFrame, about_nodes: DataFrame, lang_dirs: DataFrame) -> DataFrame:
    """Package metadata from its descriptor; whatever cannot be read is null."""
    fine = about_nodes.filter(F.col("parse_error").isNull())
    first = fine.groupBy("pkg_id").agg(F.min("sort_path").alias("sort_path"))
    here = fine.join(first, ["pkg_id", "sort_path"])

    def top(tag: str) -> Column:
        return F.min_by(
            F.coalesce("text", F.lit("")),
            F.when((F.size("pos") == 1) & (F.col("tag") == tag), F.col("pos")),
        )

    is_version = (F.size("pos") == 2) & (F.col("tags")[1] == "supportedVersions") & (
        F.col("tag") == "li"
    ) & (F.coalesce("text", F.lit("")) != "")
    about = here.groupBy("pkg_id").agg(
        top("name").alias("name"),
        top("packageId").alias("package_id"),
        F.transform(
            F.sort_array(F.collect_list(F.when(is_version, F.struct("pos", "text")))),
            lambda x: x["text"],
        ).alias("supported_versions"),
    )
    return (
        packages.join(about, "pkg_id", "left")
        .join(lang_dirs, "pkg_id", "left")
        .select(
            "pkg_id",
            "pkg_seq",
            F.col("pkg_id").alias("root_path"),
            "name",
            "package_id",
            F.coalesce("supported_versions", F.array().cast("array<string>")).alias(
                "supported_versions"
            ),
            F.col("lang_dir").alias("source_lang_dir"),
        )
    )
