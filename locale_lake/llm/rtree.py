"""Hard negatives by best-first search of R-trees packed by sort-tile-recursive."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locale_lake.llm import integers
from locale_lake.session import cut_lineage

# Rows and components of one tree, at most.
BLOCK_ROWS, BLOCK_VALUES = 16_384, 2**22
LEAF_ROWS, FANOUT = 64, 16
# Queries that meet a tree in one task, about.
QUERY_ROWS = 1_024

INDEX = "block bigint, ids binary, labels binary, q binary, dims int, starts binary, wide array<string>"
FOUND = "query bigint, anchor_id bigint, positive_id bigint, positive_score bigint, vec_id bigint, score bigint, exact binary"


def packed(values: np.ndarray, labels: np.ndarray, leaf_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows in leaves and the first row of each leaf.

    Rows are sorted by label first; a run of one label that needs several leaves is
    sorted by its widest component and cut into slabs, each slab by the next one, and
    so on. Short runs share leaves.
    """
    leaves: list[np.ndarray] = []
    order = np.argsort(labels, kind="stable")
    edges = np.flatnonzero(np.diff(labels[order], prepend=labels[order][0] - 1)).tolist() if len(order) else []
    short: list[np.ndarray] = []
    for start, end in zip(edges, [*edges[1:], len(order)], strict=True):
        run = order[start:end]
        if short and sum(map(len, short)) + len(run) > leaf_rows:
            leaves.append(np.concatenate(short))
            short = []
        if len(run) <= leaf_rows:
            short.append(run)
            continue
        pages = -(-len(run) // leaf_rows)
        spread = values[run].max(axis=0) - values[run].min(axis=0)
        axes = np.argsort(-spread, kind="stable")[: max(1, int(pages - 1).bit_length())].tolist()
        stack = [(run, axes)]
        while stack:
            rows, rest = stack.pop()
            if len(rows) <= leaf_rows:
                leaves.append(rows)
                continue
            rows = rows[np.argsort(values[rows, rest[0]], kind="stable")] if rest else rows
            pages = -(-len(rows) // leaf_rows)
            slabs = max(2, round(pages ** (1 / len(rest)))) if len(rest) > 1 else pages
            size = -(-pages // slabs) * leaf_rows
            stack += [(rows[i : i + size], rest[1:]) for i in reversed(range(0, len(rows), size))]
    if short:
        leaves.append(np.concatenate(short))
    starts = np.cumsum([0, *map(len, leaves)])[:-1]
    return (np.concatenate(leaves) if leaves else order), starts.astype(np.int64)


def _blocks(scale: int):
    """Cut a sorted range into blocks of bounded size and pack each; equal rows count once."""

    def packed_block(held: list[tuple], number: int) -> pa.RecordBatch:
        ids, labels, q, wide = zip(*held, strict=True)
        values = integers.matrix(pa.array(q, pa.list_(pa.int32())), pa.array(wide, pa.list_(pa.float64())), scale)
        labels = np.array(labels, dtype=np.int64)
        order, starts = packed(values, labels, LEAF_ROWS)
        narrow = values.dtype != object
        text = None if narrow else [",".join(map(str, v)) for v in values[order].tolist()]
        return pa.RecordBatch.from_pydict(
            {
                "block": pa.array([TaskContext.get().partitionId() * 2**32 + number], pa.int64()),
                "ids": pa.array([np.array(ids, dtype=np.int64)[order].tobytes()], pa.binary()),
                "labels": pa.array([labels[order].tobytes()], pa.binary()),
                "q": pa.array([values[order].astype(np.int32).tobytes() if narrow else None], pa.binary()),
                "dims": pa.array([values.shape[1]], pa.int32()),
                "starts": pa.array([starts.tobytes()], pa.binary()),
                "wide": pa.array([text], pa.list_(pa.string())),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        before, longest, number = None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "q", "wide")), strict=True):
                if row == before:
                    continue
                before = row
                longest = max(longest, len(row[2] if row[2] is not None else row[3]))
                if held and (len(held) >= BLOCK_ROWS or (len(held) + 1) * longest > BLOCK_VALUES):
                    yield packed_block(held, number)
                    held, number, longest = [], number + 1, len(row[2] if row[2] is not None else row[3])
                held.append(row)
        if held:
            yield packed_block(held, number)

    return run


class Best:
    """The k highest scores of a window so far, equal ones by the smaller id."""

    def __init__(self, low, high, k: int):
        self.low, self.high, self.k = low, high, k
        self.scores: list = []
        self.ids: list = []

    @property
    def least(self):
        """Nothing below this can enter."""
        return self.low if len(self.scores) < self.k else max(self.low, self.scores[-1])

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        rows = sorted([*zip(self.scores, self.ids, strict=True), *zip(scores.tolist(), ids.tolist(), strict=True)], key=lambda r: (-r[0], r[1]))
        self.scores, self.ids = [r[0] for r in rows[: self.k]], [r[1] for r in rows[: self.k]]


class Tree:
    """Boxes over the leaves of a packed block, level by level up to one root.

    A box holds the least and largest value of each component and of the label. With
    a query's positive and negative parts it bounds every inner product below it.
    """

    def __init__(self, values: np.ndarray, labels: np.ndarray, ids: np.ndarray, starts: np.ndarray):
        self.values, self.labels, self.ids = values, labels, ids
        self.starts = np.append(starts, len(values))
        low, high = np.minimum.reduceat(values, starts, axis=0), np.maximum.reduceat(values, starts, axis=0)
        first, last = np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts)
        self.levels = [(low, high, first, last)]
        while len(low) > 1:
            at = np.arange(0, len(low), FANOUT)
            low, high = np.minimum.reduceat(low, at, axis=0), np.maximum.reduceat(high, at, axis=0)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.levels.append((low, high, first, last))
        self.most = max(abs(int(v)) for v in (values.min(), values.max())) if values.size else 0
        self.doubles: tuple | None = None

    def _as(self, kind) -> tuple:
        if kind is not np.float64:
            return self.values.astype(kind, copy=False), self.levels
        if self.doubles is None:
            levels = [(low.astype(kind), high.astype(kind), first, last) for low, high, first, last in self.levels]
            self.doubles = (self.values.astype(kind), levels)
        return self.doubles

    def search(self, query: np.ndarray, own: int, label: int, same: bool, windows: list[Best]) -> None:
        """Fill the windows with rows of the same (or of another) label than the query's; ``own`` is no candidate."""
        width = max(self.values.shape[1], len(query))
        largest = self.most * max((abs(int(v)) for v in query), default=0) * max(1, width)
        # products that a double (or 64 bits) holds exactly need no larger integers
        kind = np.float64 if largest < 2**52 else np.int64 if largest < 2**62 else object
        values, levels = self._as(kind)
        q = np.zeros(self.values.shape[1], dtype=kind)
        d = min(len(query), len(q))
        q[:d] = query[:d]
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        queue: list[tuple] = []

        def offer(level: int, first: int, last: int) -> None:
            low, high, one, two = (x[first:last] for x in levels[level])
            tops = (high @ up + low @ down).tolist()
            bottoms = (low @ up + high @ down).tolist()
            fits = (one <= label) & (two >= label) if same else (one != label) | (two != label)
            for i in np.flatnonzero(fits).tolist():
                if any(tops[i] >= w.least and bottoms[i] <= w.high for w in windows):
                    heapq.heappush(queue, (-tops[i], level, first + i, bottoms[i]))

        offer(len(levels) - 1, 0, 1)
        while queue:
            top, level, node, bottom = heapq.heappop(queue)
            if -top < min(w.least for w in windows):
                break  # all boxes that are left end lower still
            wanting = [w for w in windows if -top >= w.least and bottom <= w.high]
            if not wanting:
                continue
            if level:
                offer(level - 1, node * FANOUT, min((node + 1) * FANOUT, len(levels[level - 1][0])))
                continue
            rows = slice(self.starts[node], self.starts[node + 1])
            scores = values[rows] @ q
            fits = ((self.labels[rows] == label) if same else (self.labels[rows] != label)) & (self.ids[rows] != own)
            for w in wanting:
                some = fits & (scores >= w.least) & (scores <= w.high)
                if some.any():
                    w.add(scores[some], self.ids[rows][some])


def _trees(index: pa.Table) -> Iterator[Tree]:
    for row in index.to_pylist():
        ids, labels, starts = (np.frombuffer(row[c], dtype=np.int64) for c in ("ids", "labels", "starts"))
        if row["q"] is not None:
            values = np.frombuffer(row["q"], dtype=np.int32).reshape(len(ids), row["dims"]).astype(np.int64)
        else:
            values = np.array([[int(v) for v in t.split(",") if v] for t in row["wide"]], dtype=object).reshape(len(ids), row["dims"])
        yield Tree(values, labels, ids, starts)


def _search(k: int, same: bool, scale: int, low: int, high: int):
    """Meet trees and queries; a query without windows looks for its label, else each window for the others."""

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {n.split()[0]: [] for n in FOUND.split(", ")}
        asked = queries.select(["query", "vec_id", "label", "q", "wide", "windows"]).to_pylist()
        vectors = [q["q"] if q["q"] is not None else [integers.exact_floor(v, scale) for v in q["wide"]] for q in asked]
        for tree in _trees(index) if asked else ():
            for q, vector in zip(asked, vectors, strict=True):
                windows = [(None, None, Best(float("-inf"), float("inf"), k))] if q["windows"] is None else []
                for w in q["windows"] or ():
                    score = integers.told(w["score"], w["exact"])
                    if low * score <= high * score:
                        windows.append((w["vec_id"], w["score"], Best(-(-low * score // 100), high * score // 100, k)))
                if not windows:
                    continue
                tree.search(np.array(vector, dtype=object), q["vec_id"], q["label"], same, [w[2] for w in windows])
                for positive, positive_score, best in windows:
                    for row, score in zip(best.ids, best.scores, strict=True):
                        score = int(score)
                        told = (q["query"], q["vec_id"], positive, positive_score, row, integers.clipped(score), integers.sortable(score))
                        for column, value in zip(out.values(), told, strict=True):
                            column.append(value)
        kinds = {"exact": pa.binary()}
        return pa.table({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()})

    return run


def tree_index(rows: DataFrame, scale: int) -> DataFrame:
    """Packed blocks of the rows: ranges of label and first component, each cut and packed in its task."""
    first = F.coalesce(F.get("q", 0).cast("double"), F.get("wide", 0) * scale)
    dealt = rows.select("*", first.alias("x"), F.xxhash64("vec_id", "q", "wide").alias("h"))
    order = ["label", "x", "h", "vec_id"]
    return cut_lineage(
        dealt.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "label", "q", "wide").mapInArrow(_blocks(scale), INDEX)
    )


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, scale: int = 256, low: int = 30, high: int = 90
) -> DataFrame:
    """For each anchor and each of its positives the best rows of other labels inside a window of scores.

    Both tables have ``vec_id``, ``embedding`` and an integer ``label``; other columns
    are ignored. Components become floor(scale x component), a score is the integer
    inner product with the anchor. An anchor's positives are its ``positives`` other
    rows of its label with the highest scores. The negatives of a positive are the
    ``negatives`` highest rows of other labels whose score s meets low x p <= 100 s <=
    high x p, p being the positive's score. Equal scores go to the smaller id.

    Rows are packed into R-trees of bounded size (label, then widest component first).
    A box of least and largest components bounds the scores below it; a queue opens
    the highest box first and leaves out boxes whose labels do not fit, that lie
    outside all windows, or end strictly below the k-th score so far. Every block of
    trees meets every block of anchors, a stated query set; the k best of each block
    meet per anchor.

    Rows without id, label or vector, or with a null or non-finite component, take no
    part; rows that repeat count once; a row with the anchor's id is no candidate;
    shorter vectors are filled with zeros. An anchor without positives, or a positive
    without negatives, gives no rows, as does an empty table. Scores beyond a BIGINT
    are compared exactly and show its largest or least value.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.
    """
    usable = lambda df: integers.quantised(
        df.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding").filter(
            "vec_id IS NOT NULL AND label IS NOT NULL"
        ),
        scale,
        "label",
    )
    index = tree_index(usable(vectors), scale)
    asked = cut_lineage(
        usable(anchors).dropDuplicates().withColumn("query", F.xxhash64("vec_id", "label", "q", "wide"))
    )
    slots = max(1, index.count())
    parts = max(1, -(-asked.count() // QUERY_ROWS))
    places = F.sequence(F.lit(0), F.lit(slots - 1))
    stored = index.withColumn("slot", F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    )

    def found(queries: DataFrame, k: int, same: bool) -> DataFrame:
        dealt = queries.withColumn("part", F.pmod("query", F.lit(parts)).cast("int")).withColumn("slot", F.explode(places))
        met = stored.groupBy("slot", "part").cogroup(dealt.groupBy("slot", "part")).applyInArrow(_search(k, same, scale, low, high), FOUND)
        best = W.partitionBy("query", "anchor_id", "positive_id", "positive_score").orderBy(F.col("score").desc(), F.col("exact").desc(), "vec_id")
        return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    no_windows = F.lit(None).cast("array<struct<vec_id:bigint,score:bigint,exact:binary>>")
    own = found(asked.withColumn("windows", no_windows), positives, True)
    windows = own.groupBy("query", F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list(F.struct("vec_id", "score", "exact")).alias("windows")  # ``positives`` at most
    )
    return found(asked.join(windows, ["query", "vec_id"]), negatives, False).select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
