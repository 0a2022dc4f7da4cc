"""A whole run: scan, settle, translate, guard, write, commit."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locale_lake.functions import fixed
from locale_lake.operators import inference as inf
from locale_lake.operators import layers, reuse, skew
from locale_lake.plans.scan import Scan
from locale_lake.schemas import key_columns
from locale_lake.session import cut_lineage
from locale_lake.sinks import files as sink
from locale_lake.sources.existing import read_existing
from locale_lake.sources.state import commit_run, read_state


class RunCancelled(RuntimeError):
    """The run was stopped; files may be there, state is not."""


@dataclass
class Options:
    lang: str
    source_lang: str = "en"
    update: bool = False
    mode: str = inf.REWRITE
    batch_size: int | None = None
    with_source: bool = False
    key_scope: str = "typed"
    profile: str = "braces"
    glossary: dict[str, str] | DataFrame | None = None  # or a table (lang, term, replacement)
    lexicon: DataFrame | None = None  # (lang, noun, gender, number)
    inflections: dict | None = None  # see operators.glossary.agree
    retry_delays: Sequence[float] = fixed.RETRY_DELAYS_SECONDS
    parallel: int = fixed.PARALLEL_REQUESTS


@dataclass
class Outcome:
    results: DataFrame
    files: DataFrame
    summary: DataFrame


def settle(
    units: DataFrame,
    source: DataFrame,
    existing: DataFrame,
    overrides: DataFrame,
    memory: DataFrame,
    keys: list[str],
    update: bool,
    languages: tuple[str, str],
) -> DataFrame:
    """Units with what is known already: edits, unchanged results, memory.

    Memory is what earlier runs stored, and on top of it what packages earlier in
    this run's order have settled for the same text.
    """
    if not update:
        source = source.limit(0)
    known = reuse.reuse_unchanged(units, source, existing, keys)
    known = reuse.apply_overrides(known, overrides, keys)
    known = known.withColumns(
        {
            "src_lang": F.lit(languages[0]),
            "tgt_lang": F.lit(languages[1]),
            "pinned_text": F.coalesce("override_text", "reused_text"),
            "fresh_text": F.lit(None).cast("string"),
            "_order": F.struct("layer", "sort_path", "seq"),
        }
    )
    carried = (
        reuse.propagate_memory(known, order="_order")
        .filter(F.col("memory_text").isNotNull())
        .select("source_text", "pkg_seq", F.col("memory_text").alias("_carried"))
    )
    spoken = units.withColumns(
        {"src_lang": F.lit(languages[0]), "tgt_lang": F.lit(languages[1])}
    )
    known = reuse.lookup_memory(known, memory, ["src_lang", "tgt_lang"], texts=spoken)
    again = ["source_text", "pkg_seq"]
    known = skew.lookup(known, carried, again, "left", hot=skew.hot_keys(units, again))
    pinned = F.col("pinned_text").isNotNull()
    known = known.withColumn(
        "memory_text", F.when(~pinned, F.coalesce("_carried", "memory_text"))
    ).drop("_carried", "_order", "pinned_text", "fresh_text", "src_lang", "tgt_lang")
    return reuse.resolve(known)


def translate_corpus(
    spark: SparkSession,
    scan: Scan,
    out: str,
    state_path: str,
    run_id: int,
    options: Options,
    translate_fn: inf.TranslateFn | None = None,
    call_fn: inf.CallFn | None = None,
    cancelled: Callable[[], bool] = lambda: False,
) -> Outcome:
    """Translate all packages of a scan together and commit the run's state."""
    size = inf.plan_run(
        translate_fn is not None, call_fn is not None, options.mode, options.batch_size
    )
    keys = key_columns(options.key_scope)
    folder = fixed.LANGUAGE_FOLDERS.get(options.lang.lower(), options.lang.capitalize())
    packages = cut_lineage(
        sink.output_folders(scan.packages, out, options.lang)
    )
    all_units = cut_lineage(scan.units)
    units = skew.lookup(
        all_units.filter(~F.col("is_comment")), packages.select("pkg_id", "pkg_seq"), ["pkg_id"], "inner"
    )

    # what earlier runs left for these packages, and what their files say now
    state = cut_lineage(
        read_state(spark, state_path, "state", run_id)
        .filter(F.col("lang") == options.lang)
        .join(packages.select("pkg_id"), "pkg_id", "left_semi")
    )
    memory = read_state(spark, state_path, "memory", run_id)

    def part(kind: str) -> DataFrame:
        return state.filter(F.col("kind") == kind)

    existing = cut_lineage(read_existing(spark, packages, folder, keys))
    edits = reuse.harvest_edits(existing, part("machine"), keys)
    overrides = cut_lineage(reuse.upsert_overrides(part("override"), edits, keys))
    # an edit that was taken back must not return as an unchanged result
    origins = part("machine").select(*keys, "origin")
    reusable = existing.join(origins, keys, "left")

    known = cut_lineage(
        settle(
            units, part("source"), reusable, overrides, memory, keys, options.update,
            (options.source_lang, options.lang),
        )
    )
    if cancelled():
        raise RunCancelled("stopped before the first unit")
    todo = reuse.pending(known).drop("settled_text", "origin")
    fresh = cut_lineage(
        reuse.in_package_order(
            todo,
            lambda units: _infer(units, translate_fn, call_fn, size, options),
            ["layer", "sort_path", "seq"],
        )
    )
    if cancelled():
        raise RunCancelled("stopped after the draft")
    # what this run's earlier packages left counts as memory
    followed = fresh.filter("origin = 'memory'").select(
        "unit_id", F.col("final_text").alias("_followed")
    )
    told = known.join(followed, "unit_id", "left").withColumns(
        {
            "memory_text": F.coalesce("memory_text", "_followed"),
            "origin": F.when(F.col("_followed").isNotNull(), "memory").otherwise(F.col("origin")),
        }
    )

    settled = known.filter(F.col("origin").isNotNull()).withColumn(
        "final_text", F.col("settled_text")
    )
    columns = ["unit_id", "pkg_seq", "origin", "final_text"]
    done = cut_lineage(settled.select(*columns).unionByName(fresh.select(*columns)))
    results = all_units.join(done, "unit_id", "left")

    placed = skew.lookup(results, packages.select("pkg_id", "out_root"), ["pkg_id"], "inner")
    written = sink.write_language_files(placed, folder, options.with_source)
    about = sink.write_texts(sink.descriptor(packages, options.lang))
    if cancelled():
        raise RunCancelled("stopped after writing files")
    final = results.filter(~F.col("is_comment"))
    commit_run(
        {
            "state": new_state(final, overrides, keys, options.lang),
            "memory": new_memory(final, options),
        },
        packages.select("pkg_id", F.lit(options.lang).alias("lang")),
        state_path,
        run_id,
    )
    return Outcome(
        results=results,
        files=written.unionByName(about),
        summary=reuse.reuse_summary(told, ["pkg_id"]),
    )


def _infer(todo, translate_fn, call_fn, size: int, options: Options) -> DataFrame:
    """Draft and polish; a unit no engine could help keeps its source text."""
    if translate_fn is not None:
        drafted = cut_lineage(
            inf.draft(
                todo,
                translate_fn,
                options.lang,
                options.glossary,
                profile=options.profile,
                delays=options.retry_delays,
                lexicon=options.lexicon,
                inflections=options.inflections,
            )
        )
    else:
        drafted = todo.withColumn("draft_text", F.lit(None).cast("string"))
    has_draft = F.col("draft_text").isNotNull()
    ready = drafted.withColumn("_drafted", has_draft).withColumn(
        "draft_text", F.coalesce("draft_text", "source_text")
    )
    if call_fn is not None:
        ready = inf.polish(
            ready,
            call_fn,
            options.mode,
            size,
            buckets=["layer", "file_id", "sort_path"],
            order=["seq"],
            profile=options.profile,
            parallel=options.parallel,
        )
    else:
        ready = ready.withColumns(
            {"final_text": F.col("draft_text"), "polished": F.lit(False)}
        )
    origin = (
        F.when(F.col("polished"), "polished").when(F.col("_drafted"), "draft").otherwise("fallback")
    )
    return ready.withColumn("origin", origin)


def new_state(final: DataFrame, overrides: DataFrame, keys: list[str], lang: str) -> DataFrame:
    """Source and machine snapshots and the overrides, as one table.

    Units that fell back to their source text are no results: they get no source
    snapshot, so the next update translates them.
    """
    order = ["layer", "sort_path", "seq"]

    def rows(df: DataFrame, kind: str, text: str, origin) -> DataFrame:
        present = {c: F.col(c) for c in df.columns}
        return df.select(
            F.lit(kind).alias("kind"),
            "pkg_id",
            F.lit(lang).alias("lang"),
            present.get("channel", F.lit(None).cast("string")).alias("channel"),
            present.get("type_key", F.lit(None).cast("string")).alias("type_key"),
            "key",
            F.col(text).alias("text"),
            origin.alias("origin"),
            F.lit(False).alias("deleted"),
        )

    last = skew.latest(final, keys, ["source_text", "final_text", "origin"], order)
    solid = last.filter(F.col("origin") != "fallback")
    none = F.lit(None).cast("string")
    return (
        rows(solid, "source", "source_text", none)
        .unionByName(rows(last, "machine", "final_text", F.col("origin")))
        .unionByName(rows(overrides, "override", "text", none))
    )


def new_memory(final: DataFrame, options: Options) -> DataFrame:
    """This run's results for memory; packages in order, last unit wins."""
    order = ["pkg_seq", "layer", "sort_path", "seq"]
    return skew.latest(
        final.filter(F.col("origin") != "fallback"), ["source_text"], ["final_text"], order
    ).select(
        F.lit(options.source_lang).alias("src_lang"),
        F.lit(options.lang).alias("tgt_lang"),
        "source_text",
        F.col("final_text").alias("target_text"),
        F.lit(0).cast("bigint").alias("seq"),
    )


def summarise(scan: Scan) -> DataFrame:
    """Files and strings per package and channel, with totals."""
    return layers.scan_summary(scan.translatable)
