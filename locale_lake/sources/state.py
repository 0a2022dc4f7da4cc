"""State tables: key -> text, from JSON objects or from committed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locale_lake import schemas
from locale_lake.operators import skew
from locale_lake.sources.existing import _exists

_PACKAGE = "pkg_id string, lang string"
TABLES = {"state": schemas.STATE, "memory": schemas.MEMORY}


def explode_json_map(df: DataFrame, column: str) -> DataFrame:
    """One row per entry of a JSON object; anything else gives no row.

    Values that are not strings become their JSON text.
    """
    keep = [c for c in df.columns if c != column]
    return df.select(
        *keep, F.explode(F.from_json(column, "map<string,string>")).alias("key", "text")
    )


def read_json_state(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, text) of JSON files that hold one object each.

    A folder that is not there and a file that is no JSON object give no rows.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "file string, key string, text string")
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value"
    )
    return explode_json_map(files, "value")


def _runs(spark: SparkSession, path: str, before: int | None = None) -> list[int]:
    """Runs that count: committed, and none before the last one that holds everything."""
    if not _exists(spark, f"{path}/runs"):
        return []
    done = spark.read.schema("run_id bigint, complete boolean").parquet(f"{path}/runs")
    if before is not None:
        done = done.filter(F.col("run_id") < before)
    # one number per run since the last compaction
    runs = sorted((r["run_id"], r["complete"]) for r in done.select("run_id", "complete").collect())
    start = max((r for r, complete in runs if complete), default=-1)
    return [r for r, _ in runs if r >= start]


def committed_run(spark: SparkSession, path: str) -> int | None:
    """The last run that finished; runs without a commit row do not exist."""
    return max(_runs(spark, path), default=None)


def read_state(spark: SparkSession, path: str, name: str, before: int | None = None) -> DataFrame:
    """A state table as all committed runs left it (empty without one).

    A run stores only what it has worked on. State is that of the last run of each
    package and language, so packages and languages outside a run keep theirs;
    memory holds the results of all runs, and ``seq`` is the run. ``before`` leaves
    out later runs, so a repeated run starts from the same state.
    """
    schema = TABLES[name]
    runs = _runs(spark, path, before)
    if not runs:
        return spark.createDataFrame([], schema)

    def stored(table: str, columns: str) -> DataFrame:
        # by run, not by folder: two reads of one folder pass for the same scan, whatever they listed
        folders = [f"{path}/{table}/run_id={run}" for run in runs]
        return spark.read.schema(f"{columns}, run_id bigint").option("basePath", f"{path}/{table}").parquet(*folders)

    rows = stored(name, schema)
    if name == "memory":
        return rows.withColumn("seq", F.col("run_id")).drop("run_id")
    last = stored("packages", _PACKAGE).groupBy("pkg_id", "lang").agg(F.max("run_id").alias("run_id"))
    return skew.lookup(rows, last, ["pkg_id", "lang", "run_id"], "inner").drop("run_id")


def commit_run(
    tables: dict[str, DataFrame], packages: DataFrame, path: str, run_id: int, complete: bool = False
) -> None:
    """Write what a run has worked on (``packages``: pkg_id, lang), then its commit row.

    The row is written last: a run that fails or is cancelled leaves files, but no
    state. A repeated run replaces its own folders. ``complete`` says that the tables
    hold everything, so that earlier runs need not be read any more.
    """
    spark = packages.sparkSession
    for name, df in {**tables, "packages": packages.select("pkg_id", "lang").distinct()}.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/run_id={run_id}")
    row = spark.range(1).select(F.lit(run_id).cast("bigint").alias("run_id"), F.lit(complete).alias("complete"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/runs/commit={run_id}")


def next_run(spark: SparkSession, path: str) -> int:
    last = committed_run(spark, path)
    return 0 if last is None else last + 1


def compact(spark: SparkSession, path: str) -> int:
    """Commit the state of all runs as one, which later reads start from; returns its id."""
    run_id = next_run(spark, path)
    state = read_state(spark, path, "state")
    memory = skew.latest(
        read_state(spark, path, "memory"), ["src_lang", "tgt_lang", "source_text"], ["target_text", "seq"], ["seq"]
    )
    commit_run({"state": state, "memory": memory}, state, path, run_id, complete=True)
    return run_id


def take_back(spark: SparkSession, path: str, edits: DataFrame, keys: list[str]) -> int:
    """Forget stored edits, given by ``keys`` and ``lang``, as a run of its own; returns its id.

    The units are translated anew by the next run, since their last result was the edit.
    """
    run_id = next_run(spark, path)
    on = [*keys, "lang"]
    gone = edits.select(*on).distinct().withColumn("_gone", F.lit(True))
    touched = gone.select("pkg_id", "lang").distinct()
    state = read_state(spark, path, "state").join(touched, ["pkg_id", "lang"], "left_semi")
    marked = state.join(gone, on, "left")
    taken = F.coalesce("_gone", F.lit(False))
    left = marked.filter(~((F.col("kind") == "override") & taken))
    # memory holds the edit as a result: a null takes its place
    text = lambda kind, name: marked.filter((F.col("kind") == kind) & taken).select(*on, F.col("text").alias(name))
    edited = text("source", "source_text").join(text("override", "target_text"), on).withColumnRenamed("lang", "tgt_lang")
    known = ["tgt_lang", "source_text", "target_text"]
    forgotten = read_state(spark, path, "memory").join(edited.select(*known).distinct(), known, "left_semi")
    forgotten = forgotten.select("src_lang", "tgt_lang", "source_text").distinct()
    forgotten = forgotten.select("*", F.lit(None).cast("string").alias("target_text"), F.lit(0).cast("bigint").alias("seq"))
    commit_run({"state": left.select(*state.columns), "memory": forgotten}, touched, path, run_id)
    return run_id
