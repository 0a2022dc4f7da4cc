"""Whole steps of a run over files that Spark writes from the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locale_lake.functions import text as tx
from locale_lake.plans.registry import query, table
from locale_lake.plans.scan import scan_corpus
from locale_lake.session import ensure_checkpoint_dir
from locale_lake.sinks import files as sink
from locale_lake.sources import files as fs
from locale_lake.sources import lists
from locale_lake.sources.existing import read_existing
from locale_lake.streaming import queue


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all tasks share."""
    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return fs._plain(f"{shared}/{name}-{uuid.uuid4().hex}")


def _turn_results(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """A translated unit per turn; a role is a package, its files come in two layers."""
    turns = table(spark, folder, "conversations", spread=True)
    is_list = F.col("role") == "system"
    return turns.select(
        F.concat(F.lit(f"{out}/"), "role").alias("out_root"),
        F.col("role").alias("pkg_id"),
        F.when(is_list, "strings").otherwise("keyed").alias("channel"),
        F.when(is_list, F.lit("Strings/all.txt")).otherwise(F.concat(F.lit("Keyed/"), (F.col("turn") % 2).cast("string"), F.lit(".xml"))).alias("out_path"),
        (F.col("turn") % 3).alias("layer"),
        F.lpad(F.col("conv_id").cast("string"), 12, "0").alias("sort_path"),
        F.col("turn").cast("bigint").alias("seq"),
        F.concat(F.lit("c"), (F.col("conv_id") % 997).cast("string")).alias("key"),
        (~is_list & (F.col("turn") % 5 == 4)).alias("is_comment"),
        F.lit(False).alias("has_bom"),
        F.col("text").alias("source_text"),
        F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("tr: "), "text")).alias("final_text"),
    )


_COMMENT_SQL = "CASE WHEN s LIKE '%-' THEN s || ' ' ELSE s END"
_ENTRIES_SQL = f"""
turns AS (
  SELECT *, regexp_replace(regexp_replace(text, '--', '- -', 'g'), '--', '- -', 'g') AS s,
    CASE WHEN turn % 2 = 0 THEN text ELSE 'tr: ' || text END AS final FROM conversations),
entries AS (
  SELECT role, turn, conv_id, 'c' || conv_id % 997 AS key, role <> 'system' AND turn % 5 = 4 AS is_comment, final,
    CASE WHEN role = 'system' THEN 'Strings/all.txt' ELSE 'Keyed/' || turn % 2 || '.xml' END AS out_path,
    CASE WHEN role = 'system' THEN final || chr(10)
      WHEN turn % 5 = 4 THEN '  <!--' || {_COMMENT_SQL} || '-->' || chr(10)
      ELSE CASE WHEN turn % 2 = 1 THEN '  <!--EN: ' || {_COMMENT_SQL} || '-->' || chr(10) ELSE '' END
        || '  <' || key || '>' || replace(replace(replace(final, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</' || key || '>' || chr(10)
    END AS line
  FROM turns)
"""


@query(
    "entry_lines",
    f"""WITH {_ENTRIES_SQL},
    files AS (
      SELECT role, out_path, CASE WHEN role = 'system' THEN '' ELSE '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<LanguageData>' || chr(10) END
        || string_agg(line, '' ORDER BY turn % 3, conv_id, turn) || CASE WHEN role = 'system' THEN '' ELSE '</LanguageData>' || chr(10) END AS body
      FROM entries GROUP BY 1, 2)
    SELECT role, out_path, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS i, unnest(string_split(body, chr(10))) AS line FROM files""",
)
def entry_lines(spark: SparkSession, folder: str) -> DataFrame:
    """What stands in the written language files, line by line."""
    out = _folder(spark, "entry_lines")
    sink.write_language_files(_turn_results(spark, folder, out), "Tongue", with_source=True)
    path = F.split(F.element_at(F.split("path", "/entry_lines-[0-9a-f]+/"), -1), "/Languages/Tongue/")
    return lists.written_lines(spark, out).select(path[0].alias("role"), path[1].alias("out_path"), "i", "line")


@query(
    "existing_wins",
    f"""WITH {_ENTRIES_SQL},
    ranked AS (
      SELECT role AS pkg_id, key, final, row_number() OVER (PARTITION BY role, key ORDER BY out_path DESC, turn % 3 DESC, conv_id DESC, turn DESC) AS r
      FROM entries WHERE role <> 'system' AND NOT is_comment)
    SELECT pkg_id, 'keyed' AS channel, key, final AS text FROM ranked WHERE r = 1""",
)
def existing_wins(spark: SparkSession, folder: str) -> DataFrame:
    """Written files read back: of entries with the same key the last one in file order counts."""
    out = _folder(spark, "existing_wins")
    results = _turn_results(spark, folder, out).filter("channel = 'keyed'")
    sink.write_language_files(results, "Tongue")
    packages = results.select("pkg_id", "out_root").distinct()
    return read_existing(spark, packages, "Tongue", ["pkg_id", "channel", "key"])


def _supplier_files(spark: SparkSession, folder: str, corpus: str) -> DataFrame:
    """A package per nation: a definition file per supplier, for odd nations a language file over some of them."""
    suppliers = table(spark, folder, "supplier", spread=True)
    number, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    root = F.concat(F.lit(f"{corpus}/n"), nation, F.lit("/"))

    def element(tag: str, body: Column) -> Column:
        return F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))

    notes = element("label", tx.xml_escape(F.col("s_name")))
    described = element("description", F.concat(F.lit("Trades with "), F.col("s_acctbal").cast("decimal(12,2)").cast("string"), F.lit(" in hand.")))
    definition = element("Defs", element("SupplierDef", F.concat(element("defName", F.concat(F.lit("S"), number)), notes, described)))
    definitions = suppliers.select(F.concat(root, F.lit("Defs/"), number, F.lit(".xml")).alias("file"), definition.alias("content"))
    entry = F.concat(F.lit("<S"), number, F.lit(".label>old name of "), number, F.lit("</S"), number, F.lit(".label>"))
    spoken = (
        suppliers.filter("s_nationkey % 2 = 1 AND s_suppkey % 3 = 0")
        .groupBy(root.alias("root"))
        .agg(F.array_join(F.sort_array(F.collect_list(F.struct("s_suppkey", entry.alias("e")))).getField("e"), "").alias("body"))
        .select(F.concat("root", F.lit("Languages/English/DefInjected/SupplierDef/All.xml")).alias("file"), element("LanguageData", F.col("body")).alias("content"))
    )
    about = suppliers.select("s_nationkey", nation.alias("n")).distinct().select(
        F.concat(F.lit(f"{corpus}/n"), "n", F.lit("/About/About.xml")).alias("file"),
        element(
            "ModMetaData",
            F.concat(
                F.lit(" <name>Nation "), "n", F.lit(" &amp; Co</name><packageId>nation."), "n", F.lit("</packageId>"),
                F.when(F.col("s_nationkey") % 4 == 0, "").otherwise(
                    F.concat(F.lit("<supportedVersions><li>1.5</li><li/><li>1."), "n", F.lit("</li></supportedVersions>"))
                ),
            ),
        ).alias("content"),
    )
    return definitions.unionByName(spoken).unionByName(about)


def _supplier_scan(spark: SparkSession, folder: str, name: str):
    corpus = _folder(spark, name)
    sink.write_texts(_supplier_files(spark, folder, corpus))
    return scan_corpus(spark, [corpus], fs.packages_in(spark, corpus))


@query(
    "no_language",
    """WITH fields AS (
      SELECT 'n' || s_nationkey AS pkg, s_nationkey, s_suppkey, 'S' || s_suppkey || '.label' AS key, s_name AS text, true AS is_label FROM supplier
      UNION ALL SELECT 'n' || s_nationkey, s_nationkey, s_suppkey, 'S' || s_suppkey || '.description',
        'Trades with ' || s_acctbal::DECIMAL(12,2) || ' in hand.', false FROM supplier),
    spoken AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey % 2 = 1 AND s_suppkey % 3 = 0)
    SELECT pkg, 'injected' AS channel, key, text AS source_text FROM fields
    WHERE s_nationkey NOT IN (SELECT s_nationkey FROM spoken) OR (is_label AND s_suppkey % 3 = 0)""",
)
def no_language(spark: SparkSession, folder: str) -> DataFrame:
    """Packages without a language folder give the text of their definitions; where a folder
    covers a type only its keys count, refreshed from the definitions."""
    return _supplier_scan(spark, folder, "no_language").units.select(
        F.element_at(F.split("pkg_id", "/"), -1).alias("pkg"), "channel", "key", "source_text"
    )


@query(
    "package_info",
    """SELECT 'n' || s_nationkey AS pkg, 'Nation ' || s_nationkey || ' & Co' AS name, 'nation.' || s_nationkey AS package_id,
      CASE WHEN s_nationkey % 4 = 0 THEN '' ELSE '1.5,1.' || s_nationkey END AS versions,
      CASE WHEN s_nationkey % 2 = 1 AND bool_or(s_suppkey % 3 = 0) THEN 'Languages/English' END AS source_lang_dir
    FROM supplier GROUP BY s_nationkey""",
)
def package_info(spark: SparkSession, folder: str) -> DataFrame:
    """Name, id, versions and source folder of each package, as its files say."""
    packages = _supplier_scan(spark, folder, "package_info").packages
    return packages.select(
        F.element_at(F.split("pkg_id", "/"), -1).alias("pkg"), "name", "package_id", F.array_join("supported_versions", ",").alias("versions"), "source_lang_dir"
    )


@query(
    "descriptor",
    """SELECT r_name || '_DE/About/About.xml' AS file, '<?xml version="1.0" encoding="utf-8"?>' || chr(10) || '<ModMetaData>' || chr(10)
      || '  <name>' || n || ' - German</name>' || chr(10) || '  <author>locale_lake</author>' || chr(10)
      || '  <description>German translation of ' || n || '</description>' || chr(10)
      || '  <packageId>' || p || '.DE.Translation</packageId>' || chr(10) || '  <supportedVersions>' || chr(10)
      || array_to_string(list_transform(v, lambda x: '    <li>' || x || '</li>' || chr(10)), '') || '  </supportedVersions>' || chr(10)
      || '  <modDependencies>' || chr(10) || '    <li>' || chr(10) || '      <packageId>' || p || '</packageId>' || chr(10)
      || '      <displayName>' || n || '</displayName>' || chr(10) || '    </li>' || chr(10) || '  </modDependencies>' || chr(10)
      || '  <loadAfter>' || chr(10) || '    <li>' || p || '</li>' || chr(10) || '  </loadAfter>' || chr(10) || '</ModMetaData>' || chr(10) AS content
    FROM (SELECT p_brand || '-' || p_type AS r_name,
        CASE WHEN min(p_size) > 1 THEN min(p_name) || ' &amp; &lt;co&gt;' ELSE 'Unknown Mod' END AS n,
        CASE WHEN max(p_size) > 49 THEN replace(p_brand, '#', '.') ELSE 'unknown.mod' END AS p,
        CASE WHEN min(p_size) > 2 THEN ['1.4', '1.' || max(p_size)] ELSE ['1.6'] END AS v
      FROM part GROUP BY p_brand, p_type)""",
)
def descriptor(spark: SparkSession, folder: str) -> DataFrame:
    """The written descriptors of translated packages, read back."""
    out = _folder(spark, "descriptor")
    low, high = F.min("p_size"), F.max("p_size")
    packages = table(spark, folder, "part").groupBy("p_brand", "p_type").agg(
        F.when(low > 1, F.concat(F.min("p_name"), F.lit(" & <co>"))).alias("name"),
        F.when(high > 49, F.replace(F.col("p_brand"), F.lit("#"), F.lit("."))).alias("package_id"),
        F.when(low > 2, F.array(F.lit("1.4"), F.concat(F.lit("1."), high.cast("string")))).otherwise(F.array().cast("array<string>")).alias("supported_versions"),
    )
    packages = packages.withColumn("pkg_id", F.concat("p_brand", F.lit("-"), "p_type"))
    sink.write_texts(sink.descriptor(sink.output_folders(packages, out, "de"), "de"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(out)
    # file names come back as parts of a URI
    path = F.url_decode(F.element_at(F.split("path", "/descriptor-[0-9a-f]+/"), -1))
    return files.select(path.alias("file"), F.col("content").cast("string").alias("content"))


@query(
    "queue_report",
    """SELECT status, count(*) AS packages, coalesce(list(DISTINCT message ORDER BY message) FILTER (message IS NOT NULL), []) AS messages FROM (
      SELECT CASE WHEN p_size > 25 THEN 'failed' ELSE 'done' END AS status,
        CASE WHEN p_size > 40 THEN 'package folder not found' WHEN p_size > 25 THEN 'no translatable strings' END AS message FROM part)
    GROUP BY status""",
)
def queue_report(spark: SparkSession, folder: str) -> DataFrame:
    """Packages and messages per status, over the rows that the batches of a queue leave."""
    state = _folder(spark, "queue_report")
    rows = table(spark, folder, "part").select(
        (F.col("p_partkey") % 7).alias("batch_id"),
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("pkg_id"),
        F.when(F.col("p_size") > 25, queue.FAILED).otherwise(queue.DONE).alias("status"),
        F.when(F.col("p_size") > 40, "package folder not found").when(F.col("p_size") > 25, "no translatable strings").alias("message"),
    )
    rows.withColumn("batch", F.col("batch_id").cast("string")).write.partitionBy("batch").parquet(f"{state}/report")
    return queue.queue_report(spark, state)
