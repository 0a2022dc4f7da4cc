"""A queue of packages as a stream: each queue file lists package folders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from locale_lake.operators import layers
from locale_lake.operators.inference import CallFn, TranslateFn
from locale_lake.plans.scan import scan_corpus
from locale_lake.plans.translate import Options, RunCancelled, translate_corpus
from locale_lake.session import cut_lineage
from locale_lake.sources import files as fs
from locale_lake.sources.existing import _exists
from locale_lake.sources.state import next_run

DONE, FAILED = "done", "failed"


def run_queue(
    spark: SparkSession,
    queue_dir: str,
    out: str,
    state_path: str,
    checkpoint: str,
    options: Options,
    translate_fn: TranslateFn | None = None,
    call_fn: CallFn | None = None,
    files_per_trigger: int = 1,
    stop_on_error: bool = False,
    cancelled: Callable[[], bool] = lambda: False,
    **scan_options,
) -> StreamingQuery:
    """Work through the queue once (``availableNow``); start again for new files.

    A package never spans two batches. A batch takes its run id from the state folder
    and notes it before it starts, so a repeated batch replaces itself, whatever stream
    checkpoint it comes from. A package that is missing, empty or fails is recorded
    and the others go on, unless ``stop_on_error``.
    """
    entries = (
        spark.readStream.format("text")
        .option("wholetext", "true")
        .option("maxFilesPerTrigger", files_per_trigger)
        .load(queue_dir)
        .select(F.col("_metadata.file_path").alias("queue_file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    )

    def work(folders: list[str], run_id: int) -> list[tuple[str, str, str | None]]:
        """Translate packages as one run; returns a row of the report for each."""
        packages = fs.packages_from(spark, folders)
        scan = scan_corpus(spark, folders, packages, **scan_options)
        scan.units = cut_lineage(scan.units)
        empty = layers.empty_packages(scan.translatable, scan.packages)
        failed = {r.pkg_id: "no translatable strings" for r in empty.select("pkg_id").collect()}
        if stop_on_error and failed:
            raise ValueError(f"{min(failed)}: {failed[min(failed)]}")
        good = [path for path in folders if path not in failed]
        if good:
            # as many rows as the queue files of a batch have lines
            keep = spark.createDataFrame([(p,) for p in good], "pkg_id string")
            scan.packages = scan.packages.join(keep, "pkg_id", "left_semi")
            translate_corpus(spark, scan, out, state_path, run_id, options, translate_fn, call_fn, cancelled)
        return [(path, FAILED, failed[path]) if path in failed else (path, DONE, None) for path in folders]

    def handle(batch: DataFrame, batch_id: int) -> None:
        # one line per package: the list of a batch is bounded by its queue files
        listed = [
            r.value.strip()
            for r in batch.filter(F.trim("value") != "").orderBy("queue_file", "line").collect()
        ]
        folders = list(dict.fromkeys(fs._plain(path) for path in listed))
        present = [path for path in folders if _exists(spark, path)]
        report = [
            (path, FAILED, "package folder not found") for path in folders if path not in present
        ]
        if stop_on_error and report:
            raise ValueError(f"{report[0][0]}: {report[0][2]}")
        if present:
            try:
                report += work(present, _run_of(spark, state_path, checkpoint, f"{batch_id}"))
            except RunCancelled:
                raise
            except Exception as error:
                if stop_on_error:
                    raise
                if len(present) == 1:
                    report.append((present[0], FAILED, _short(error)))
                else:  # find out which of them it is: one run each
                    for number, path in enumerate(present):
                        try:
                            report += work([path], _run_of(spark, state_path, checkpoint, f"{batch_id}.{number}"))
                        except RunCancelled:
                            raise
                        except Exception as single:
                            report.append((path, FAILED, _short(single)))
        name = f"{_mark(checkpoint)}-{batch_id}"
        rows = spark.createDataFrame(
            [(batch_id, *r) for r in report], "batch_id bigint, pkg_id string, status string, message string"
        )
        rows.coalesce(1).write.mode("overwrite").parquet(f"{state_path}/report/batch={name}")

    return (
        entries.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _mark(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.encode()).hexdigest()


def _short(error: Exception) -> str:
    return f"{type(error).__name__}: {error}".splitlines()[0]


def _run_of(spark: SparkSession, state_path: str, checkpoint: str, batch: str) -> int:
    """The run id of a batch: noted when the batch is first seen, beyond all ids given so far."""
    notes, place = f"{state_path}/batches", f"{state_path}/batches/{_mark(checkpoint)}-{batch}"
    read = lambda path: spark.read.schema("run_id bigint").option("recursiveFileLookup", "true").parquet(path)
    if _exists(spark, f"{place}/_SUCCESS"):
        return read(place).first()[0]
    given = read(notes).agg(F.max("run_id")).first()[0] if _exists(spark, notes) else None
    run_id = max(next_run(spark, state_path), -1 if given is None else given + 1)
    spark.createDataFrame([(run_id,)], "run_id bigint").coalesce(1).write.mode("overwrite").parquet(place)
    return run_id


def queue_report(spark: SparkSession, state_path: str) -> DataFrame:
    """Packages and messages per status."""
    rows = spark.read.schema(
        "batch_id bigint, pkg_id string, status string, message string"
    ).parquet(f"{state_path}/report")
    return rows.groupBy("status").agg(
        F.count("*").alias("packages"),
        F.sort_array(F.collect_set("message")).alias("messages"),
    )
