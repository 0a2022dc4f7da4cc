"""Earlier output as state: what the files of the last run say now."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locale_lake.operators import skew, tree
from locale_lake.sources import files as fs
from locale_lake.sources import lists, xml


def read_existing(
    spark: SparkSession, packages: DataFrame, lang_folder: str, keys: list[str]
) -> DataFrame:
    """(keys..., text) of all translated files; the last file read wins.

    ``packages`` has ``pkg_id`` and ``out_root``; packages without output give no
    rows. Keyed and injected files come before line lists, then path order.
    """
    out = packages.select("pkg_id", "out_root")
    parents = [
        r[0]
        for r in out.select(F.regexp_replace("out_root", "/[^/]*$", "").alias("p"))
        .distinct()
        .limit(2)
        .collect()
    ]
    schema = "pkg_id string, channel string, type_key string, key string, text string"
    if len(parents) > 1:
        raise ValueError("translated packages must lie in one folder")
    if not parents or not _exists(spark, parents[0]):
        return spark.createDataFrame([], schema).select(*keys, "text")
    roots = out.select(F.col("out_root").alias("pkg_id"), F.col("pkg_id").alias("_owner"))
    lang_dirs = roots.select("pkg_id", F.lit(f"Languages/{lang_folder}").alias("lang_dir"))
    # only what belongs to these packages and this language is opened
    chosen = fs.chosen_files(fs.channel_files(fs.read_corpus(spark, parents, roots), lang_dirs))
    content = fs.read_corpus(spark, parents if chosen is None else chosen, roots, content="*.{xml,txt}")
    found = fs.channel_files(content, lang_dirs).withColumn("pkg_id", F.col("_owner"))
    described = ["pkg_id", "file_id", "sort_path", "channel", "def_type", "out_path"]
    nodes = xml.shred_xml(found.filter("channel <> 'strings'"), described, keep_comments=True)
    entries = xml.read_keyed(nodes.filter(F.col("parse_error").isNull()))
    lines = lists.split_lines(
        found.filter("channel = 'strings'").select(
            *described,
            F.col("out_path").alias("prefix"),
            lists.decode(F.col("content")).alias("content"),
        ),
        described,
    )
    columns = ["pkg_id", "channel", "def_type", "sort_path", "seq", "key", "text", "is_comment"]
    rows = (
        entries.withColumnRenamed("source_text", "text")
        .select(*columns)
        .unionByName(lines.select(*columns))
        .filter(~F.col("is_comment"))
        .withColumn("type_key", F.coalesce(tree.short_type(F.col("def_type")), F.lit("")))
        .withColumn("_late", (F.col("channel") == "strings").cast("int"))
    )
    return skew.latest(rows, keys, ["text"], ["_late", "sort_path", "seq"])


def _exists(spark: SparkSession, folder: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
