"""Exact dedup by sorting: equal texts become neighbours, the first of each run stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locale_lake.operators import skew
from locale_lake.session import cut_lineage

#: characters that do not count, `[\x20\x09-\x0D]`
SPACES = " \t\n\x0b\x0c\r"
# Bytes of a text that the splitters look at before its digest decides.
HEAD = 32
# Runs that go on in the next range (two a range, some 60 bytes each) are broadcast up to this.
BROADCAST_EDGES = 500_000
# Dropped ids (8 bytes each) are broadcast up to this.
BROADCAST_IDS = 1_000_000

_FIRST, _LAST = 1, 2


def normalised(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _runs():
    """Runs of equal neighbours in a sorted range; ``edge`` marks those at its ends, whose head keeps the text."""

    def rows_of(ids, digests, run, sizes, texts, lengths, edges, part, started) -> pa.RecordBatch:
        # run: number of each row's run; started: the first row of each run
        run = pa.array(run)
        head = np.zeros(len(run), dtype=bool)
        head[started] = True
        on_edge = pc.take(pa.array(edges > 0), run).to_numpy(zero_copy_only=False) & head
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": ids,
                "keep_id": pc.take(ids, pc.take(pa.array(started), run)),
                "group_size": pc.take(pa.array(sizes), run),
                "kept": pa.array(head),
                "digest": digests,
                "part": pa.array(np.full(len(run), part, dtype=np.int32)),
                "edge": pc.take(pa.array(edges), run),
                "length": pc.take(lengths, pc.take(pa.array(started), run)),
                "content": pc.if_else(pa.array(on_edge), pc.take(texts, run), pa.scalar(None, pa.large_string())),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []  # rows of the open run, without texts
        open_text, any_out = None, False

        def close(batches: list, text: pa.Scalar, last: bool) -> pa.RecordBatch:
            table = pa.Table.from_batches(batches).combine_chunks()
            n = table.num_rows
            edge = (0 if any_out else _FIRST) | (_LAST if last else 0)
            return rows_of(
                table.column("doc_id").combine_chunks(),
                table.column("digest").combine_chunks(),
                np.zeros(n, dtype=np.int64),
                np.array([n], dtype=np.int64),
                pa.array([text.as_py()], pa.large_string()),
                table.column("length").combine_chunks(),
                np.array([edge], dtype=np.int32),
                part,
                np.array([0]),
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("content").cast(pa.large_string())
            slim = batch.select(["doc_id", "digest", "length"])
            fresh = np.ones(batch.num_rows, dtype=bool)
            if batch.num_rows > 1:
                fresh[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
            fresh[0] = open_text is None or open_text.as_py() != texts[0].as_py()
            starts = np.flatnonzero(fresh)
            if not len(starts):
                held.append(slim)
                continue
            if open_text is not None:
                if starts[0]:
                    held.append(slim.slice(0, starts[0]))
                yield close(held, open_text, False)
                any_out = True
            first, last = int(starts[0]), int(starts[-1])
            if last > first:  # runs that begin and end in this batch
                started = starts[:-1] - first
                sizes = np.diff(starts)
                edges = np.zeros(len(sizes), dtype=np.int32)
                edges[0] = 0 if any_out else _FIRST
                done = slim.slice(first, last - first)
                yield rows_of(
                    done.column("doc_id"),
                    done.column("digest"),
                    np.repeat(np.arange(len(sizes)), sizes),
                    sizes,
                    texts.take(pa.array(starts[:-1])),
                    done.column("length"),
                    edges,
                    part,
                    started,
                )
                any_out = True
            held, open_text = [slim.slice(last)], texts[last]
        if open_text is not None:
            yield close(held, open_text, True)

    return run


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Which row stays of each group of texts that are equal without white space.

    Sampled splitters cut the rows into ranges of the normalised bytes, each range is
    sorted externally, and neighbours are compared in full. Splitters look at the
    first bytes, the digest, the length and the id, so a large group of equal texts is
    spread over several ranges; only its pieces' heads, at most two a range, meet
    again to make one group of it. In a run the row with the most code points in its
    original text comes first, then the smallest doc_id (null last): it stays.

    Returns for every row, dropped ones too, doc_id, keep_id (of the row that stays),
    group_size, kept and text_sha256 (hex, of the normalised text). Null texts count as
    empty ones. Of rows that agree in text and doc_id one stays. An empty table gives
    no rows; columns besides doc_id and text are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        "doc_id",
        normalised(F.col("text")).alias("content"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("length"),
    ).withColumn("digest", F.unhex(F.sha2("content", 256)))
    order = [F.substring("content", 1, HEAD), F.col("digest")]
    within = [F.col("length").desc(), F.col("doc_id").asc_nulls_last()]
    runs = cut_lineage(
        rows.repartitionByRange(*order, *within)
        .sortWithinPartitions(*order, "content", *within)
        .mapInArrow(
            _runs(),
            f"doc_id {id_type}, keep_id {id_type}, group_size bigint, kept boolean, digest binary, part int, edge int, length bigint, content string",
        )
    )
    ends = runs.filter("content IS NOT NULL").select("part", "edge", "content", "keep_id", "group_size", "length")
    rank = F.struct((-F.col("length")).alias("shorter"), F.col("keep_id").isNull().alias("last"), "keep_id", "part", "edge")
    whole = ends.groupBy("content").agg(
        F.min(rank).alias("best"), F.sum("group_size").alias("in_all"), F.collect_list(F.struct("part", "edge")).alias("pieces")
    )
    # a piece per range: as many as ranges at most
    joined = whole.filter(F.size("pieces") > 1).select("best", "in_all", F.explode("pieces").alias("piece"))
    joined = joined.select("best", "in_all", "piece.part", "piece.edge")
    found = skew.lookup(runs.drop("content"), joined, ["part", "edge"], "left", broadcast_rows=BROADCAST_EDGES)
    first = F.col("best").isNull() | ((F.col("best.part") == F.col("part")) & (F.col("best.edge") == F.col("edge")))
    return found.select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("keep_id")).otherwise(F.col("best.keep_id")).alias("keep_id"),
        F.coalesce("in_all", "group_size").alias("group_size"),
        (F.col("kept") & first).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops.

    Rows that share a doc_id share the decision: they stay if one of them does. Rows
    without doc_id stay.
    """
    told = exact_duplicates(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = cut_lineage(told.filter("NOT kept").select("doc_id"))
    if skew.has_at_most(gone, BROADCAST_IDS):
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
