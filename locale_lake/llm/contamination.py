"""Benchmark decontamination with a generalised suffix automaton of the items' words."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locale_lake.llm import rawtext
from locale_lake.llm.sampling import unused
from locale_lake.session import cut_lineage

# One automaton holds the items up to so many bytes of text, or one item; more items
# make more automata, each for a pass of its own over the documents.
AUTOMATON_BYTES = 600_000

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SPANS, _ITEMS = pa.list_(_SPAN), pa.list_(pa.string())


class Automaton:
    """Suffix automaton of many word sequences; a state knows the items it occurs in."""

    def __init__(self, window: int = 10):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[int, int] = {}
        self.names: list[str] = []
        self.sequences: list[list[int]] = []
        self.words = 0

    def add(self, name: str, hashes: list[int]) -> None:
        tokens = [self.vocabulary.setdefault(h, len(self.vocabulary)) for h in hashes]
        self.names.append(name)
        self.sequences.append(tokens)
        self.words += len(tokens)
        last = 0
        for token in tokens:
            last = self._extend(last, token)

    def _extend(self, last: int, token: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        there = nexts[last].get(token)
        if there is not None:  # an earlier item has this substring
            return there if length[there] == length[last] + 1 else self._split(last, there, token)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and token not in nexts[p]:
            nexts[p][token] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nexts[p][token]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, q, token)
        return new

    def _state(self, length: int, nexts: dict[int, int]) -> int:
        self.next.append(nexts)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, token: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def finish(self) -> None:
        """Work out per state which items its window, or a short item ending in it, stands for."""
        n = len(self.next)
        order = sorted(range(1, n), key=self.length.__getitem__)
        within: list[list[int]] = [[] for _ in range(n)]
        seen = [-1] * n
        short: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for item, tokens in enumerate(self.sequences):
            state = 0
            for token in tokens:
                state = self.next[state][token]
                up = state
                while up > 0 and seen[up] != item and self.length[up] >= self.window:
                    seen[up] = item
                    within[up].append(item)
                    up = self.link[up]
            if 0 < len(tokens) < self.window:
                short[state].append((len(tokens), item))
        at_window = [0] * n
        for state in order:  # links come before the states they belong to
            up = self.link[state]
            if self.length[state] >= self.window:
                at_window[state] = at_window[up] if self.length[up] >= self.window else state
            if up > 0 and short[up]:
                short[state] = short[state] + short[up]
        self.items_at = [within[s] for s in at_window]
        self.short = short
        self.least = min([self.window, *(len(t) for t in self.sequences if t)])
        known = np.fromiter(self.vocabulary, dtype=np.uint64, count=len(self.vocabulary))
        by_hash = np.argsort(known)
        self.known, self.ids = known[by_hash], by_hash.astype(np.int64)
        self.sequences, self.vocabulary = [], {}

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Word ids, -1 for words of no item."""
        if not len(self.known):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.ids[at], -1)

    def walk(self, tokens: list[int], offset: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        """Stream known words; add the spans of windows and short items that end at each."""
        nexts, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for place, token in enumerate(tokens, offset + 1):
            while state and token not in nexts[state]:
                state = link[state]
                matched = length[state]
            state = nexts[state].get(token, 0)
            matched = matched + 1 if state else 0
            if matched >= window:
                spans.append((place - window, place))
                items.update(self.items_at[state])
            for size, item in self.short[state]:
                if size <= matched:
                    spans.append((place - size, place))
                    items.add(item)


@dataclass(frozen=True)
class Shard:
    """Items that share an automaton, as word hashes: what a task needs to build it."""

    names: list[str]
    counts: list[int]
    hashes: bytes

    def automaton(self, window: int) -> Automaton:
        built, hashes, at = Automaton(window), np.frombuffer(self.hashes, dtype=np.uint64).tolist(), 0
        for name, count in zip(self.names, self.counts, strict=True):
            built.add(name, hashes[at : at + count])
            at += count
        built.finish()
        return built


def shards(items: DataFrame, size: int = AUTOMATON_BYTES) -> Iterator[Shard]:
    """The items in shards of about ``size`` bytes; the driver holds one at a time. At least one, maybe empty."""
    rows = items.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // size))
    rows = rows if n == 1 else rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for k in range(n):
        some = rows.collect() if n == 1 else rows.filter(F.col("shard") == k).collect()
        found = rawtext.Texts(pa.array([r["text"] for r in some], pa.large_string())).words(rawtext.ALNUM)
        yield Shard([r["item_id"] for r in some], found.counts.tolist(), found.hashes().tobytes())


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def scan(words: rawtext.Words, automaton: Automaton) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """Per text with hits: merged spans in words, and the names of the items."""
    ids = automaton.lookup(words.hashes())
    n = len(ids)
    known = ids >= 0
    first = np.zeros(n + 1, dtype=bool)
    first[words.offsets] = True
    before = np.concatenate([[False], known[:-1]]) if n else known
    starts = np.flatnonzero(known & (first[:n] | ~before))
    after = np.concatenate([known[1:], [False]]) if n else known
    ends = np.flatnonzero(known & (first[1:] | ~after)) + 1
    long = (ends - starts) >= automaton.least
    starts, ends = starts[long], ends[long]
    texts = np.searchsorted(words.offsets, starts, side="right") - 1
    found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
    for start, end, text in zip(starts.tolist(), ends.tolist(), texts.tolist(), strict=True):
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        automaton.walk(ids[start:end].tolist(), start - int(words.offsets[text]), spans, items)
        if spans:
            have = found.setdefault(text, ([], set()))
            have[0].extend(spans)
            have[1].update(items)
    return {t: (merged(s), {automaton.names[i] for i in items}) for t, (s, items) in found.items()}


def _digest(texts: pa.Array) -> pa.Array:
    """16 bytes that stand for each text; null counts as empty."""
    return pa.array([md5((t or "").encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for t in texts.to_pylist()], pa.binary())


def _pass(shard: Shard, window: int, every: bool, named: bool):
    """Spans and items of each text; of those without any only if ``every``; ``named`` by their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shard.automaton(window)
        for batch in batches:
            for rows in rawtext.slices(batch, "text"):
                words = rawtext.Texts(rows.column("text")).words(rawtext.ALNUM)
                found = scan(words, automaton)
                at = list(range(rows.num_rows)) if every else sorted(found)
                spans = [[{"start": a, "end": b} for a, b in found[i][0]] if i in found else [] for i in at]
                items = [sorted(found[i][1]) if i in found else [] for i in at]
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id").take(take),
                        **({"digest": _digest(rows.column("text").take(take))} if named else {}),
                        "n_words": pa.array(words.counts, pa.int64()).take(take),
                        "spans": pa.array(spans, _SPANS),
                        "items": pa.array(items, _ITEMS),
                    }
                )

    return run


_FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _hits(docs: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """doc_id, digest, spans and items of the texts that any pass found something in."""
    every = functools.reduce(DataFrame.unionByName, parts).filter(F.size("spans") > 0)
    per_text = every.groupBy("doc_id", "digest").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )  # a row a pass
    joined = F.aggregate(
        "spans",
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when(
            F.coalesce(s["start"] <= F.try_element_at(acc, F.lit(-1))["end"], F.lit(False)),
            F.concat(
                F.slice(acc, F.lit(1), F.size(acc) - 1),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return per_text.withColumn("spans", joined)


def find_spans(docs: DataFrame, items: DataFrame, window: int = 10, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Words of each document that stand inside an occurrence of an item's window.

    A window is ``window`` consecutive words of an item; an item with fewer words,
    but not none, is one window. Returns doc_id, n_words, spans (start and end in
    words, merged, end exclusive) and items (sorted ids as strings) for every row of
    ``docs``. Null and empty texts have no words; items without words never occur;
    rows of ``items`` without item_id are left out, rows that share one count as one
    item; repeated documents are answered each. Columns besides doc_id and text
    (item_id and text) are ignored.

    Items are sharded by bytes of text. A pass over the documents takes one shard,
    whose automaton its tasks build; where there are several, each pass leaves the
    texts it found something in, and these meet by id and digest.
    """
    frame, id_type = docs.select("doc_id", "text"), docs.schema["doc_id"].dataType.simpleString()
    parts: list[DataFrame] = []
    held: Shard | None = None
    for shard in shards(items, automaton_bytes):
        if held is not None:
            kind = f"doc_id {id_type}, digest binary, {_FOUND}"
            parts.append(cut_lineage(frame.mapInArrow(_pass(held, window, not parts, True), kind)))
        held = shard
    if not parts:
        return frame.mapInArrow(_pass(held, window, True, False), f"doc_id {id_type}, {_FOUND}")
    parts.append(cut_lineage(frame.mapInArrow(_pass(held, window, False, True), f"doc_id {id_type}, digest binary, {_FOUND}")))
    hits = _hits(docs, parts).withColumnsRenamed({"doc_id": "_id", "digest": "_digest", "spans": "_spans", "items": "_items"})
    rows = parts[0].select("doc_id", "digest", "n_words")
    return rows.join(hits, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("_spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
        F.coalesce("_items", F.array().cast("array<string>")).alias("items"),
    )


def cut(words: rawtext.Words, k: int, spans: list[tuple[int, int]], span_words: int, coverage: float) -> tuple[str | None, bool]:
    """Text ``k`` without the spans that reach a limit, None if it goes as a whole; and whether it changed."""
    at, end = int(words.offsets[k]), int(words.offsets[k + 1])
    if sum(b - a for a, b in spans) >= coverage * (end - at):
        return None, True
    gone = [(a, b) for a, b in spans if b - a >= span_words]
    base = int(words.texts.offsets[k])
    raw = words.texts.data[base : int(words.texts.offsets[k + 1]) - 1].tobytes()
    pieces, done = [], 0
    for a, b in gone:
        pieces.append(raw[done : int(words.starts[at + a]) - base])
        done = int(words.starts[at + b] if at + b < end else words.ends[at + b - 1]) - base
    pieces.append(raw[done:])
    return b"".join(pieces).decode("utf-8"), bool(gone)


def cleaned(texts: pa.Array, automaton: Automaton, span_words: int, coverage: float) -> list[str | None]:
    """Texts without the spans that reach a limit; None for texts to drop."""
    out: list[str | None] = texts.to_pylist()
    todo = list(range(len(out)))
    while todo:
        words = rawtext.Texts(pa.array([out[i] or "" for i in todo], pa.large_string())).words(rawtext.ALNUM)
        again = []
        for k, (spans, _) in scan(words, automaton).items():
            out[todo[k]], changed = cut(words, k, spans, span_words, coverage)
            if changed and out[todo[k]] is not None:
                again.append(todo[k])
        todo = again  # what has moved together may form a window anew
    return out


def _changed(rows: pa.RecordBatch, new: list[str | None], columns: list[str]) -> pa.RecordBatch:
    """The rows with new texts (and ``n_chars``), without those whose text is gone."""
    texts = rows.column("text")
    old = texts.to_pylist()
    keep = pa.array([x is None or y is not None for x, y in zip(old, new, strict=True)], pa.bool_())
    place = rows.schema.get_field_index("text")
    rows = rows.set_column(place, rows.schema.field(place), pa.array(new, texts.type))
    if "n_chars" in columns:
        place = rows.schema.get_field_index("n_chars")
        counts = [
            len(t) if t != o and t is not None else n for t, o, n in zip(new, old, rows.column("n_chars").to_pylist(), strict=True)
        ]
        rows = rows.set_column(place, rows.schema.field(place), pa.array(counts, rows.schema.field(place).type))
    return rows.filter(keep)


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = 10, span_words: int = 1, coverage: float = 0.5, automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """The documents without contaminated spans, with all their columns.

    Spans of at least ``span_words`` words go (from the first word of the span to the
    word after it); a document whose contaminated words are ``coverage`` of all its
    words or more goes as a whole. Documents without a hit stay as they are, null and
    empty texts included; ``n_chars``, where there is one, follows the text. Rows that
    repeat are cut each; columns may have any names.

    With one shard of items a task cuts a text until nothing is left to cut; with
    several the passes are repeated over the texts that the last round changed.
    """
    columns, types = docs.columns, docs.schema
    every = list(itertools.islice(shards(items, automaton_bytes), 2))
    if len(every) == 1:
        shard = every[0]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = shard.automaton(window)
            for batch in batches:
                for rows in rawtext.slices(batch, "text"):
                    yield _changed(rows, cleaned(rows.column("text"), automaton, span_words, coverage), columns)

        return docs.mapInArrow(run, types)

    digest, spans, own = (unused(docs, n) for n in ("digest_of_text", "spans_of_text", "id_of_text"))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rawtext.slices(batch, "text"):
                words = rawtext.Texts(rows.column("text")).words(rawtext.ALNUM)
                told = rows.column(spans).to_pylist()
                new = [cut(words, k, [(x["start"], x["end"]) for x in told[k]], span_words, coverage)[0] for k in range(rows.num_rows)]
                yield _changed(rows.select(columns), new, columns)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    todo, done = docs, []
    while True:
        frame = todo.select("doc_id", "text")
        parts = [
            cut_lineage(frame.mapInArrow(_pass(shard, window, False, True), f"doc_id {id_type}, digest binary, {_FOUND}"))
            for shard in shards(items, automaton_bytes)
        ]
        long = F.exists("spans", lambda s: s["end"] - s["start"] >= span_words)
        size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
        words = functools.reduce(DataFrame.unionByName, parts).groupBy("doc_id", "digest").agg(F.max("n_words").alias("n"))
        hits = _hits(docs, parts).join(words.withColumnsRenamed({"doc_id": "_id"}), "digest").filter(F.col("doc_id").eqNullSafe(F.col("_id")))
        hits = cut_lineage(
            hits.filter(long | (size >= coverage * F.col("n"))).select(F.col("doc_id").alias(own), F.col("digest").alias(digest), F.col("spans").alias(spans))
        )
        if hits.isEmpty():
            return functools.reduce(DataFrame.unionByName, [*done, todo])
        named = todo.withColumn(spans + "_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
        joined = named.join(hits, (F.col(spans + "_key") == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(own)), "left")
        done.append(joined.filter(F.col(spans).isNull()).select(*columns))
        todo = cut_lineage(joined.filter(F.col(spans).isNotNull()).select(*columns, spans).mapInArrow(once, types))
