"""Exact substring dedup by hashes of lines or paragraphs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locale_lake.llm import rawtext
from locale_lake.llm.sampling import unused
from locale_lake.operators import skew
from locale_lake.session import cut_lineage, rewritten

#: characters after which white space ends a clause
STOPS = ".,;:!?|"
_STOP = rawtext._class(*[(ord(c), ord(c)) for c in STOPS])
BREAKS = {"line": re.compile("\n"), "paragraph": re.compile(r"\n[\x20\x09\x0B-\x0D]*\n\s*")}
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_CAPITALS = {c: c + 32 for c in range(65, 91)}
# A table of repeated digests (16 bytes and an id each) up to this is broadcast.
BROADCAST_DIGESTS = 200_000
# Ids of texts with repeated runs (8 bytes each) are broadcast up to this.
BROADCAST_IDS = 500_000


def pieces(text: str, kind: str) -> Iterator[tuple[int, int]]:
    """Start and end, in code points, of each unit without the break after it."""
    start = 0
    for gap in BREAKS[kind].finditer(text):
        yield start, gap.start()
        start = gap.end()
    yield start, len(text)


def normalised(unit: str) -> list[str]:
    """Words of a unit with A-Z lower-cased; punctuation stays."""
    return [w for w in _SPACE.split(unit.translate(_CAPITALS)) if w]


def _units(kind: str, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rawtext.slices(batch, "text"):
                found: list[list] = [[], [], [], [], []]
                for i, text in enumerate(rows.column("text").to_pylist()):
                    for start, end in pieces(text or "", kind):
                        words = normalised(text[start:end]) if end > start else []
                        if len(words) >= min_words:
                            digest = md5(" ".join(words).encode("utf-8", "surrogatepass"), usedforsecurity=False).digest()
                            for column, value in zip(found, (i, start, end, len(words), digest), strict=True):
                                column.append(value)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id").take(pa.array(found[0], pa.int64())),
                        "start": pa.array(found[1], pa.int64()),
                        "end": pa.array(found[2], pa.int64()),
                        "n_words": pa.array(found[3], pa.int64()),
                        "digest": pa.array(found[4], pa.binary()),
                    }
                )

    return run


def repeated_units(docs: DataFrame, kind: str = "line", min_words: int = 20) -> DataFrame:
    """The units to remove: every occurrence of a unit but the earliest.

    A unit is a line (or paragraph) of at least ``min_words`` words; two are the same
    if their words are, with A-Z lower-cased and white space evened out. Occurrences
    rank by doc_id, null last, then by place. Digests are counted before they are
    shuffled, and the occurrences of a digest are never brought together.

    Returns doc_id, start, end (code points of the original text, end exclusive),
    n_words, kept_doc_id and kept_start. Null and empty texts have no units. Rows
    that share a doc_id count as one text: the same place in both is one occurrence.
    Columns besides doc_id and text are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = cut_lineage(
        docs.select("doc_id", "text").mapInArrow(
            _units(kind, min_words), f"doc_id {id_type}, start bigint, end bigint, n_words bigint, digest binary"
        )
    )
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start")
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("other"))
    first = first.filter("first <> other").select("digest", "first")
    return (
        skew.lookup(found, first, ["digest"], "inner", broadcast_rows=BROADCAST_DIGESTS)
        .filter(rank != F.col("first"))
        .select(
            "doc_id",
            "start",
            "end",
            "n_words",
            F.col("first.doc_id").alias("kept_doc_id"),
            F.col("first.start").alias("kept_start"),
        )
    )


def _breaks(data: np.ndarray, kind: str) -> np.ndarray:
    """Bytes that end a unit: line feeds, and for clauses white space after a stop."""
    breaks = data == 10
    if kind == "clause":
        breaks[1:] |= _STOP[data[:-1]] & ~rawtext.NOT_SPACE[data[1:]]
    return breaks


def _windows(min_words: int, kind: str, thin: bool = False):
    """Least runs of units with ``min_words`` words: from each unit on, and up to each unit.

    ``thin``: of the first kind only, and half a digest instead of places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rawtext.slices(batch, "text"):
                texts = rawtext.Texts(rows.column("text"))
                words = texts.words(rawtext.NOT_SPACE)
                breaks = _breaks(texts.data, kind)
                breaks[texts.offsets[1:] - 1] = True  # the space after each text
                line = np.cumsum(breaks)[words.starts] if len(words.starts) else np.zeros(0, np.int64)
                before = np.flatnonzero(np.diff(line, prepend=-1))  # lines that have words, by their first one
                upto = np.append(before[1:], len(line))[: len(before)]
                row = np.searchsorted(words.offsets, before, side="right") - 1
                numbers = np.arange(len(before))
                last = np.searchsorted(upto, before + min_words)
                on = last < len(before)
                on[on] = row[last[on]] == row[on]
                if thin:
                    digests = rawtext.runs(words.hashes(), before[on], upto[last[on]])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": rows.column("doc_id").take(pa.array(row[on], pa.int64())),
                            "half": pa.array(digests[:, 0].astype(np.int64), pa.int64()),
                        }
                    )
                    continue
                first = np.searchsorted(before, upto - min_words, side="right") - 1
                back = first >= 0
                back[back] = row[first[back]] == row[back]
                pairs = np.concatenate([np.stack([numbers, last], 1)[on], np.stack([first, numbers], 1)[back]])
                first, last = np.unique(pairs, axis=0).T if len(pairs) else (numbers[:0], numbers[:0])
                digests = rawtext.runs(words.hashes(), before[first], upto[last])
                ends = np.flatnonzero(breaks)
                starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
                points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
                row, zero = row[first], points[texts.offsets[row[first]]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id").take(pa.array(row, pa.int64())),
                        "start": pa.array(points[starts[line[before[first]]]] - zero, pa.int64()),
                        "end": pa.array(points[ends[line[before[last]]]] - zero, pa.int64()),
                        "before": pa.array(before[first] - words.offsets[row], pa.int64()),
                        "upto": pa.array(upto[last] - words.offsets[row], pa.int64()),
                        "digest": pa.array([d.tobytes() for d in digests], pa.binary()),
                    }
                )

    return run


def repeated_passages(docs: DataFrame, min_words: int = 20, kind: str = "line") -> DataFrame:
    """The passages to remove: runs of lines, of any length, that repeat an earlier place.

    A passage is a run of units with at least ``min_words`` words together. Units are
    lines or, with the kind ``clause``, what lies between line feeds and the white
    space after one of ``.,;:!?|``: long lines are cut, short ones joined. Units
    without words are passed over, words compare as in ``repeated_units``. Every run
    that occurs twice is covered by its least runs of ``min_words`` words, taken from
    each unit on and up to each unit: these are digested, their earliest occurrence
    (by doc_id, null last, then place) stays, and the others are joined to passages
    where they overlap. A unit that goes has a copy at an earlier place, so one stays.
    A passage that begins or ends inside a unit counts with its whole units only.

    A repeated run holds the least run from its first unit on, so 8 bytes of those
    digests are counted first, inside the tasks as far as they meet there. Only texts
    in which one occurs again are cut into all their least runs, with places.

    Returns doc_id, start, end (code points of the original text, end exclusive),
    n_words, and kept_doc_id and kept_start, the earliest place of the first least
    run of the passage. Odd rows are treated as in ``repeated_units``.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text")
    halves = rewritten(texts.mapInArrow(_windows(min_words, kind, thin=True), f"doc_id {id_type}, half bigint"))
    several = cut_lineage(halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half"))
    touched = skew.lookup(halves, several, ["half"], "inner", broadcast_rows=BROADCAST_DIGESTS).select("doc_id").distinct()
    touched = cut_lineage(touched)
    near = F.broadcast(touched) if skew.has_at_most(touched, BROADCAST_IDS) else touched
    again = texts.join(near, texts["doc_id"].eqNullSafe(near["doc_id"]), "left_semi")
    found = rewritten(
        again.mapInArrow(
            _windows(min_words, kind), f"doc_id {id_type}, start bigint, end bigint, before bigint, upto bigint, digest binary"
        )
    )
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start")
    first = found.groupBy("digest").agg(F.min(rank).alias("first"), F.max(rank).alias("other"))
    first = cut_lineage(first.filter("first <> other").select("digest", "first"))
    again = skew.lookup(found, first, ["digest"], "inner", broadcast_rows=BROADCAST_DIGESTS).filter(rank != F.col("first"))
    in_order = W.partitionBy("doc_id").orderBy("start", "end")
    reached = F.max("end").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    begins = F.coalesce((F.col("start") >= reached), F.lit(True)).cast("int")
    return (
        again.withColumn("begins", begins)
        .withColumn("passage", F.sum("begins").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("doc_id", "passage")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            (F.max("upto") - F.min("before")).alias("n_words"),
            F.min_by("first", F.struct("start", "end")).alias("first"),
        )
        .select(
            "doc_id", "start", "end", "n_words", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start")
        )
    )


def _without(text: str | None, cuts: list) -> str | None:
    out, done = [], 0
    for start, end in sorted({(c["start"], c["end"]) for c in cuts}):
        out.append(text[done:start])
        done = end + 1 if text[end : end + 1] == "\n" else end
    return "".join([*out, text[done:]])


def without_units(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the removed units cut from the texts; ``removed`` keeps their offsets.

    Null texts stay null; rows that share a doc_id, null included, lose the same
    places; columns may have any names.
    """
    own, cut = unused(docs, "id_of_cuts"), unused(docs, "cuts")
    cuts = removed.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set(F.struct("start", "end")).alias(cut))
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                _without(t, c) if c and t is not None else t
                for t, c in zip(batch.column("text").to_pylist(), batch.column(cut).to_pylist(), strict=True)
            ]
            place = batch.schema.get_field_index("text")
            batch = batch.set_column(place, batch.schema.field(place), pa.array(texts, batch.column(place).type))
            yield batch.select(kept)

    joined = docs.join(cuts, F.col("doc_id").eqNullSafe(F.col(own)), "left").select(*docs.columns, cut)
    return joined.mapInArrow(run, docs.schema)
