"""Batch inference around a user-supplied model: dedup, batches, guards, fallback.

The only Python in here is the call of the user's function on Arrow batches.
"""

from __future__ import annotations

import queue
import string
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locale_lake.functions import answers as an
from locale_lake.functions import classify as cl
from locale_lake.functions import fixed
from locale_lake.functions import glossary as gl
from locale_lake.functions import text as tx
from locale_lake.operators import glossary as go
from locale_lake.operators import skew
from locale_lake.session import cut_lineage

TranslateFn = Callable[[list[str]], list[str]]
CallFn = Callable[[list[dict]], list[str]]

REWRITE, CHECK = "rewrite", "check"


def plan_run(use_draft: bool, use_polish: bool, mode: str = REWRITE, batch: int | None = None) -> int:
    """Check the engine options; returns the request size."""
    if mode not in (REWRITE, CHECK):
        raise ValueError(f"unknown mode: {mode!r}")
    if not use_draft and not use_polish:
        raise ValueError("at least one engine is required")
    if mode == CHECK and not use_draft:
        raise ValueError("check mode needs a draft to check")
    if batch is not None:
        if batch < 1:
            raise ValueError("the request size must be positive")
        return batch
    return fixed.CHECK_BATCH if mode == CHECK else fixed.REWRITE_BATCH


def call_with_retry(
    function: Callable[[list], list[str]],
    batch: list,
    delays: Sequence[float] = fixed.RETRY_DELAYS_SECONDS,
) -> tuple[list[str | None], str | None]:
    """Call on one batch; I/O errors are retried, then become an error text."""
    error: Exception | None = None
    for delay in (0, *delays):
        if delay:
            time.sleep(delay)
        try:
            result = list(function(batch))
            if len(result) != len(batch):
                raise ValueError(f"{len(batch)} texts in, {len(result)} out")
            return result, None
        except OSError as failure:
            error = failure
        except Exception as failure:  # a fault of the model, not of the machine
            error = failure
            break
    return [None] * len(batch), f"{type(error).__name__}: {error}"


def each_or_none(
    function: Callable[[list], list[str]], items: list, delays: Sequence[float]
) -> tuple[list[str | None], list[str | None]]:
    """Answers and errors by item: a batch that fails is halved until the faulty item is alone.

    The waits between repetitions are spent once, on the whole batch.
    """
    if not items:
        return [], []
    answers, error = call_with_retry(function, items, delays)
    if error is None or len(items) == 1:
        return answers, [error] * len(items)
    middle = len(items) // 2
    first, second = (each_or_none(function, part, ()) for part in (items[:middle], items[middle:]))
    return first[0] + second[0], first[1] + second[1]


class _Call:
    """One call in a thread of its own; what it says after its time is not heard."""

    def __init__(self, function: Callable, item: object, seconds: float, finished: queue.SimpleQueue):
        self.deadline = time.monotonic() + seconds
        self.result: object = None

        def run() -> None:
            try:
                told: object = function(item)
            except BaseException as failure:
                told = failure
            finished.put((self, told))

        threading.Thread(target=run, daemon=True).start()


def in_order(
    function: Callable, items: Iterable, parallel: int, seconds: Callable[[object], float], ahead: int | None = None
) -> Iterator[object]:
    """The function's results in the order of the items, with up to ``parallel`` calls at once.

    Items are drawn as calls become free, never more than ``ahead`` beyond the next
    result that is due, so a slow call holds back a bounded buffer. A call that takes
    longer than ``seconds`` of its item is given up, as is one that raises: its
    exception is the result, and its place is free for the next one.
    """
    finished: queue.SimpleQueue = queue.SimpleQueue()
    due: deque[_Call] = deque()
    running: set[_Call] = set()
    rest, more = iter(items), True
    ahead = ahead or 4 * parallel
    while True:
        while more and len(running) < parallel and len(due) < ahead:
            try:
                item = next(rest)
            except StopIteration:
                more = False
                break
            call = _Call(function, item, seconds(item), finished)
            due.append(call)
            running.add(call)
        while due and due[0] not in running:
            yield due.popleft().result
        if not due and not more:
            return
        if not running:
            continue
        try:
            call, told = finished.get(timeout=max(0.0, min(c.deadline for c in running) - time.monotonic()))
            if call in running:
                call.result = told
                running.discard(call)
        except queue.Empty:
            for call in [c for c in running if c.deadline <= time.monotonic()]:
                call.result = TimeoutError("no answer in time")
                running.discard(call)


def translate_column(
    df: DataFrame,
    source: str,
    out: str,
    translate_fn: TranslateFn,
    delays: Sequence[float] = fixed.RETRY_DELAYS_SECONDS,
) -> DataFrame:
    """Adds ``out`` and ``<out>_error`` by calling the model on Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(source).to_pylist()
            answers, errors = each_or_none(translate_fn, texts, delays)
            yield _with_columns(batch, {out: answers, f"{out}_error": errors})

    return df.mapInArrow(run, _extended(df, out, f"{out}_error"))


def _with_columns(batch: pa.RecordBatch, added: dict[str, list]) -> pa.RecordBatch:
    """Append string columns; the columns that are there pass through untouched."""
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *[pa.array(values, pa.string()) for values in added.values()]],
        names=[*batch.schema.names, *added],
    )


def _extended(df: DataFrame, *names: str) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, T.StringType()) for n in names]])


def explode_pieces(units: DataFrame, text: str, unit_id: str, profile: str) -> DataFrame:
    """One row per piece a model gets, with everything needed to rebuild the text.

    ``prefix`` and ``suffix`` hold the edge whitespace, the placeholder that
    follows and the space between sentences; ``piece`` is null for blank segments.
    """
    parts = F.arrays_zip(
        tx.segments(F.col(text), profile).alias("part"),
        tx.placeholders(F.col(text), profile).alias("holder"),
    )
    segment = units.select(unit_id, F.posexplode(parts).alias("seg", "_p")).select(
        unit_id,
        "seg",
        F.col("_p.part").alias("_part"),
        F.coalesce("_p.holder", F.lit("")).alias("_holder"),
    )
    blank = tx.is_blank(F.col("_part"))
    pieces = F.when(~blank, tx.sentences(F.col("_part")))
    return (
        segment.withColumn("_pieces", pieces)
        .select(
            unit_id,
            "seg",
            "_part",
            "_holder",
            F.size("_pieces").alias("_n"),
            F.posexplode_outer("_pieces").alias("_sent", "piece"),
        )
        .select(
            unit_id,
            "seg",
            F.coalesce("_sent", F.lit(0)).alias("sent"),
            F.when(F.col("piece").isNull(), F.col("_part"))
            .when(F.col("_sent") == 0, tx.lead_space(F.col("_part")))
            .otherwise(F.lit(" "))
            .alias("prefix"),
            "piece",
            F.when(F.col("piece").isNull(), F.col("_holder"))
            .when(
                F.col("_sent") == F.col("_n") - 1,
                F.concat(tx.trail_space(F.col("_part")), F.col("_holder")),
            )
            .otherwise(F.lit(""))
            .alias("suffix"),
        )
    )


def translate_pieces(
    pieces: DataFrame,
    translate_fn: TranslateFn,
    lang: str,
    glossary: dict[str, str] | DataFrame | None = None,
    delays: Sequence[float] = fixed.RETRY_DELAYS_SECONDS,
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
    lexicon: DataFrame | None = None,
    inflections: dict | None = None,
) -> DataFrame:
    """(piece, translated, error, n) per distinct piece, with both quality guards.

    ``glossary`` is a small dictionary or a table (lang, term, replacement) of any
    size. Where terms were put back, the adjectives of ``inflections`` follow the nouns
    of the ``lexicon`` (see ``glossary.agree``).

    Each model pass is written to the shared checkpoint folder before anything
    reads it: a model need not answer twice the same, so a recomputed task must
    not ask again. Only pieces a guard flags are asked a second time.
    """
    terms = {} if glossary is None else glossary
    distinct = pieces.filter(F.col("piece").isNotNull()).groupBy("piece").agg(F.count("*").alias("n"))
    if isinstance(terms, DataFrame):
        spoken = materialise(distinct.withColumn("lang", F.lit(lang)))
        held = go.protect_terms(spoken, terms.filter(F.col("lang") == lang), go.longest_term(terms), "piece", "piece")
        protected = held.select("piece", "n", F.col("protected").alias("_protected"), F.col("tokens").alias("_tokens"))
    else:
        protected = distinct.select(
            "piece",
            "n",
            gl.protect(F.col("piece"), terms).alias("_protected"),
            (gl.replacements(F.col("piece"), terms) if terms else F.array().cast("array<string>")).alias(
                "_tokens"
            ),
        )
    has_terms = isinstance(terms, DataFrame) or bool(terms)

    def restored(raw: str) -> Column:
        return gl.restore(F.col(raw), F.col("_tokens")) if has_terms else F.col(raw)

    first = materialise(
        translate_column(protected, "_protected", "_raw", translate_fn, delays).select(
            "piece",
            "n",
            "_protected",
            "_tokens",
            restored("_raw").alias("translated"),
            F.col("_raw_error").alias("error"),
        )
    )
    columns = ["piece", "translated", "error", "n"]

    # another script in the answer: ask once more, take a clean second answer
    foreign = F.coalesce(cl.has_foreign_script(F.col("translated"), F.lit(lang)), F.lit(False))
    again = translate_column(
        first.filter(foreign), "_protected", "_raw", translate_fn, delays
    ).withColumn("_second", restored("_raw"))
    clean = F.col("_second").isNotNull() & ~cl.has_foreign_script(F.col("_second"), F.lit(lang))
    repaired = again.withColumn(
        "translated", F.when(clean, F.col("_second")).otherwise(F.col("translated"))
    ).select(*columns)
    script_checked = first.filter(~foreign).select(*columns).unionByName(repaired)
    if lang in fixed.FOREIGN_SCRIPT_TARGETS:
        script_checked = materialise(script_checked)

    if has_terms and inflections and lexicon is not None:
        spoken = script_checked.withColumn("lang", F.lit(lang))
        script_checked = materialise(
            go.agree(spoken, lexicon, inflections, "translated", "piece")
            .withColumn("translated", F.coalesce("agreed", "translated"))
            .select(*columns)
        )

    # far fewer words than the source: try without stand-ins, take it if longer
    short = F.coalesce(cl.is_truncated(F.col("piece"), F.col("translated")), F.lit(False))
    bare = translate_column(script_checked.filter(short), "piece", "_bare", translate_fn, delays)
    longer = F.col("_bare").isNotNull() & (
        tx.words(F.col("_bare")) > tx.words(F.col("translated"))
    )
    lengthened = bare.withColumn(
        "translated", F.when(longer, F.col("_bare")).otherwise(F.col("translated"))
    ).select(*columns)
    return materialise(script_checked.filter(~short).unionByName(lengthened))


def draft(
    units: DataFrame,
    translate_fn: TranslateFn,
    lang: str,
    glossary: dict[str, str] | DataFrame | None = None,
    text: str = "source_text",
    unit_id: str = "unit_id",
    profile: str = "braces",
    delays: Sequence[float] = fixed.RETRY_DELAYS_SECONDS,
    hot_rows: int = skew.HOT_ROWS,
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
    lexicon: DataFrame | None = None,
    inflections: dict | None = None,
) -> DataFrame:
    """Adds ``draft_text`` and ``draft_error``.

    Every distinct piece of the whole corpus is translated once, then looked up
    (spread over tasks where a piece is very frequent) and the texts are rebuilt.
    A unit with a failed piece has no draft. Blank text passes through.
    """
    pieces = explode_pieces(units.filter(~tx.is_blank(F.col(text))), text, unit_id, profile)
    known = translate_pieces(
        pieces, translate_fn, lang, glossary, delays, materialise, lexicon, inflections
    )
    # how often a piece occurs was counted when the pieces were made distinct
    counts = known.select(F.xxhash64("piece").alias("_hot"), F.col("n").alias("_n"))
    rows = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = skew.lookup(
        pieces, known.drop("n"), ["piece"], "left", hot=skew.hottest(counts, hot_rows), rows=rows
    )
    whole = skew.dealt(joined, rows, unit_id).groupBy(unit_id).agg(
        F.array_join(
            F.transform(
                F.sort_array(
                    F.collect_list(
                        F.struct(
                            "seg",
                            "sent",
                            F.concat(
                                "prefix", F.coalesce("translated", F.lit("")), "suffix"
                            ).alias("t"),
                        )
                    )
                ),
                lambda x: x["t"],
            ),
            "",
        ).alias("_draft"),
        F.max("error").alias("draft_error"),
    )
    return (
        units.join(whole, unit_id, "left")
        .withColumn(
            "draft_text",
            F.when(tx.is_blank(F.col(text)), F.col(text)).when(
                F.col("draft_error").isNull(), F.col("_draft")
            ),
        )
        .drop("_draft")
    )


def make_requests(
    units: DataFrame,
    size: int,
    group: list[str],
    buckets: list[str],
    order: list[str],
    fields: list[str],
    original: str = "source_text",
) -> DataFrame:
    """Consecutive units in fixed groups, trivial ones left out after grouping.

    One row per request: ``batch`` and ``items`` ARRAY<STRUCT<fields>>, whose
    1-based position is the number the model sees. Positions inside a package come
    from bucketed counts, so a package that holds much of the corpus is numbered by
    many tasks. A request has at most ``size`` items.
    """
    filled = units.filter(~tx.is_blank(F.col(original)))
    placed = skew.number_rows(filled, group, buckets, order, "_pos")
    return (
        placed.withColumn("batch", F.floor(F.col("_pos") / size))
        .filter(~cl.is_trivial(F.col(original)))
        .groupBy(*group, "batch")
        .agg(F.sort_array(F.collect_list(F.struct("_pos", *fields))).alias("_items"))
        .withColumn(
            "items",
            F.transform("_items", lambda x: F.struct(*[x[f].alias(f) for f in fields])),
        )
        .drop("_items")
    )


DEFAULT_ITEM = "{idx}. package: {package} | key: {key} | source: {original} | draft: {draft}"


def _render(template: str, values: dict[str, Column]) -> Column:
    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            parts.append(values[name])
    return F.concat(*parts)


def render_requests(
    requests: DataFrame,
    mode: str = REWRITE,
    template: str = DEFAULT_ITEM,
    fields: dict[str, str] | None = None,
    unknown: str = "unknown",
) -> DataFrame:
    """Adds ``prompt``, ``n_items``, ``answer_tokens`` and ``timeout_seconds``.

    ``fields`` says which struct field fills package, key, original and draft.
    """
    names = {"package": "pkg_id", "key": "key", "original": "source_text", "draft": "draft_text"}
    names.update(fields or {})

    def line(item: Column, i: Column) -> Column:
        def named(role: str) -> Column:
            return F.when(F.coalesce(item[names[role]].cast("string"), F.lit("")) == "", unknown).otherwise(
                item[names[role]].cast("string")
            )

        return _render(
            template,
            {
                "idx": (i + 1).cast("string"),
                "package": named("package"),
                "key": named("key"),
                "original": F.coalesce(item[names["original"]], F.lit("")),
                "draft": F.coalesce(item[names["draft"]], F.lit("")),
            },
        )

    count = F.size("items")
    tokens = F.lit(fixed.ANSWER_TOKENS_PER_ITEM) * count
    if mode == CHECK:
        tokens = F.floor(tokens / 2)
    seconds = F.lit(fixed.REQUEST_SECONDS) * F.greatest(F.lit(1), F.floor(count / 2))
    return requests.withColumns(
        {
            "n_items": count.cast("bigint"),
            "prompt": F.array_join(F.transform("items", line), "\n"),
            "answer_tokens": F.greatest(F.lit(fixed.MIN_ANSWER_TOKENS), tokens).cast("bigint"),
            "timeout_seconds": F.least(F.lit(fixed.MAX_REQUEST_SECONDS), seconds).cast("bigint"),
        }
    )


def call_requests(
    requests: DataFrame,
    call_fn: CallFn,
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
    parallel: int = fixed.PARALLEL_REQUESTS,
    per_call: int = 1,
) -> DataFrame:
    """Adds ``raw`` and ``call_error``; a failed request is a row, never an exception.

    Every task keeps up to ``parallel`` calls under way, each with ``per_call``
    requests, and goes on reading while they are: answers wait in a bounded buffer and
    leave in the order of the rows. A call that fails is halved until the faulty
    requests are alone; one that takes longer than the ``timeout_seconds`` of its
    requests is given up. Only these go without an answer.
    """
    wanted = ["prompt", "n_items", "answer_tokens", "timeout_seconds"]

    def asked(calls: list[dict]) -> tuple[list[str | None], list[str | None]]:
        return each_or_none(call_fn, calls, delays=())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun: deque[pa.RecordBatch] = deque()

        def chunks() -> Iterator[list[dict]]:
            for batch in batches:
                if batch.num_rows:
                    begun.append(batch)
                    calls = batch.select(wanted).to_pylist()
                    yield from (calls[i : i + per_call] for i in range(0, len(calls), per_call))

        raw: list[str | None] = []
        errors: list[str | None] = []
        for told in in_order(asked, chunks(), parallel, lambda c: sum(x["timeout_seconds"] for x in c)):
            if isinstance(told, BaseException):
                n = min(per_call, begun[0].num_rows - len(raw))
                told = ([None] * n, [f"{type(told).__name__}: {told}"] * n)
            raw += told[0]
            errors += told[1]
            if len(raw) == begun[0].num_rows:
                yield _with_columns(begun.popleft(), {"raw": raw, "call_error": errors})
                raw, errors = [], []

    return materialise(requests.mapInArrow(run, _extended(requests, "raw", "call_error")))


def parse_answers(responses: DataFrame, mode: str = REWRITE) -> DataFrame:
    """One row per item with ``k`` and ``answer`` (null where the model gave none)."""
    read = an.check_answers if mode == CHECK else an.rewrite_answers
    keep = [c for c in responses.columns if c not in ("items", "raw", "prompt")]
    return (
        responses.withColumn(
            "_answers", read(F.coalesce("raw", F.lit("")), F.size("items"))
        )
        .select(*keep, "_answers", F.posexplode("items").alias("_i", "item"))
        .withColumn("k", (F.col("_i") + 1).cast("bigint"))
        .withColumn("answer", F.element_at("_answers", F.col("k")))
        .drop("_answers", "_i")
    )


def apply_answers(
    items: DataFrame,
    original: str = "source_text",
    draft_text: str = "draft_text",
    profile: str = "braces",
) -> DataFrame:
    """Adds ``final_text`` and ``polished``: an answer counts if it says something
    and keeps all placeholders; otherwise the draft stays."""
    good = (
        F.col("answer").isNotNull()
        & (F.col("answer") != "")
        & tx.placeholders_kept(F.col(original), F.col("answer"), profile)
    )
    return items.withColumn("polished", F.coalesce(good, F.lit(False))).withColumn(
        "final_text", F.when(F.col("polished"), F.col("answer")).otherwise(F.col(draft_text))
    )


def polish(
    units: DataFrame,
    call_fn: CallFn,
    mode: str = REWRITE,
    size: int | None = None,
    group: list[str] | None = None,
    buckets: list[str] | None = None,
    order: list[str] | None = None,
    unit_id: str = "unit_id",
    template: str = DEFAULT_ITEM,
    profile: str = "braces",
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
    parallel: int = fixed.PARALLEL_REQUESTS,
) -> DataFrame:
    """Adds ``final_text`` and ``polished`` to units that carry a draft."""
    group = group or ["pkg_id"]
    fields = [unit_id, "pkg_id", "key", "source_text", "draft_text"]
    requests = make_requests(
        units,
        size or plan_run(True, True, mode),
        group,
        buckets or ["layer", "sort_path"],
        order or ["seq"],
        fields,
    )
    # the package is both a grouping column and a field of the items
    responses = call_requests(
        render_requests(requests, mode, template), call_fn, materialise=materialise, parallel=parallel
    )
    items = parse_answers(responses, mode).select("item.*", "answer")
    done = apply_answers(items, profile=profile).select(unit_id, "final_text", "polished")
    return (
        units.join(done, unit_id, "left")
        .withColumn("final_text", F.coalesce("final_text", "draft_text"))
        .withColumn("polished", F.coalesce("polished", F.lit(False)))
    )
