"""Line lists: one unit per line of a text file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locale_lake.functions import text as tx
from locale_lake.operators import skew
from locale_lake.session import rewritten

NEWLINES = r"\r\n|\n|\r"
# fixed values: every line boundary of the wider convention
ALL_LINE_BREAKS = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def split_lines(
    files: DataFrame, keep: list[str], line_breaks: str = NEWLINES
) -> DataFrame:
    """``content`` -> one row per line with its 0-based number in the key.

    Blank lines and ``//`` lines stay as comment rows, so numbers do not move.
    A line break at the end of a file does not start another line. Files without
    a single entry are dropped: their lines become an empty list, so no join is needed.
    """
    breaks = "(?:" + line_breaks + ")"
    body = F.regexp_replace("content", breaks + r"\z", "")
    none = F.array().cast("array<string>")
    lines = tx.let(
        F.split(body, line_breaks, -1),
        lambda ls: F.when(F.exists(ls, lambda line: ~_is_comment(line)), ls).otherwise(none),
    )
    return (
        # an inner generator would have its input worked out again, as a filter before the scan is spread
        files.select(
            *keep,
            *[c for c in ("prefix",) if c in files.columns],
            F.posexplode_outer(lines).alias("_no", "text"),
        )
        .filter(F.col("_no").isNotNull())
        .withColumn("is_comment", _is_comment(F.col("text")))
        .withColumn(
            "key",
            F.when(F.col("is_comment"), F.lit("")).otherwise(
                F.concat(F.col("prefix"), F.lit(":"), F.col("_no").cast("string"))
            ),
        )
        .withColumn("seq", F.col("_no").cast("bigint"))
        .drop("_no", "prefix")
    )


def _is_comment(line):
    stripped = tx.strip(line)
    return (stripped == "") | F.startswith(stripped, F.lit("//"))


def decode(content):
    """UTF-8 without a byte order mark; invalid bytes are replaced."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^\x{FEFF}", "")


def written_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, i, line): what stands between line feeds in every file below a folder, numbered from 0.

    Files are read in blocks by many tasks, however large one is. Rows of a block follow each
    other, so a line's number is its place in the block and the lines of the blocks before.
    Blocks are written once with their lines: read anew they might be cut in another way.
    """
    found = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(folder)
    told = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size")
    rows = rewritten(
        found.select(*told, F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"))
    )
    blocks = rewritten(
        rows.groupBy("path", "size", "block").agg(F.min("row").alias("first"), F.count("*").alias("n"), F.sum(F.octet_length("line") + 1).alias("bytes"))
    )
    # the reader leaves out a byte order mark and what follows the last line feed if it is empty
    left = F.col("size") - F.sum("bytes")
    files = blocks.groupBy("path", "size").agg(F.sum("n").alias("i"), (left >= 2).alias("marked"), left.isin(0, 3).alias("ended"))
    before = F.sum("n").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = blocks.withColumn("before", F.coalesce(before, F.lit(0))).join(files.select("path", "marked"), "path")
    placed = skew.lookup(rows.drop("size"), starts.select("path", "block", "first", "before", "marked"), ["path", "block"], "inner", broadcast_rows=100_000)
    number = F.col("before") + F.col("row") - F.col("first")
    line = F.when(F.col("marked") & (number == 0), F.concat(F.lit("\ufeff"), "line")).otherwise(F.col("line"))
    lines = placed.select("path", number.alias("i"), line.alias("line")).unionByName(files.filter("ended").select("path", "i", F.lit("").alias("line")))
    # paths come as parts of a URI, where a plus is a plus
    return lines.withColumn("path", F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))))
