"""Exact top-k by integer inner product over a bit-sliced index."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from locale_lake.llm import integers

# Rows in a block of the index (a slice of a block is a bitmap of 2 KB), and
# queries that a task holds at once.
BLOCK_ROWS = 16_384
QUERY_ROWS = 2_048

INDEX = "block int, n int, dims int, ids binary, low binary, width int, slices binary"
QUERIES = "part int, n int, dims int, ids binary, vectors binary, large boolean"
FOUND = "query_id bigint, vec_id bigint, score bigint, exact binary"
# Sums of this many bits are added up in 64-bit integers.
_BITS = 60


def quantised(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and integer components (``integers.quantised``), one row per distinct pair."""
    return integers.quantised(vectors.filter("vec_id IS NOT NULL"), scale).dropDuplicates()


def _matrix(rows: pd.DataFrame, scale: int) -> np.ndarray:
    q = pa.array([None if v is None else list(v) for v in rows["q"]], pa.list_(pa.int32()))
    return integers.matrix(q, pa.array([None if v is None else list(v) for v in rows["wide"]], pa.list_(pa.float64())), scale)


def _bits(value: int) -> int:
    return int(value).bit_length()


def _index_block(rows: pd.DataFrame, scale: int) -> pd.DataFrame:
    """Slices of a block: component minus the block's least value, bit by bit, one bitmap each."""
    rows = rows.sort_values("vec_id", kind="stable")
    values = _matrix(rows, scale)
    n, dims = values.shape
    low = values.min(axis=0)
    above = values - low
    width = max(1, _bits(above.max()) if above.size else 1)
    padded = np.zeros((-(-n // 64) * 64, dims), dtype=values.dtype)
    padded[:n] = above
    slices = [np.packbits(((padded.T >> b) & 1).astype(np.uint8), axis=1, bitorder="little") for b in range(width)]
    return pd.DataFrame(
        {
            "block": [rows["block"].iloc[0]],
            "n": [n],
            "dims": [dims],
            "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()],
            "low": [",".join(map(str, low.tolist())).encode()],
            "width": [width],
            "slices": [np.stack(slices, axis=1).tobytes()],  # dims x width x bytes
        }
    )


def _query_part(rows: pd.DataFrame, scale: int) -> pd.DataFrame:
    values = _matrix(rows, scale)
    large = values.dtype == object
    return pd.DataFrame(
        {
            "part": [rows["part"].iloc[0]],
            "n": [values.shape[0]],
            "dims": [values.shape[1]],
            "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()],
            "vectors": [",".join(map(str, values.ravel().tolist())).encode() if large else values.tobytes()],
            "large": [large],
        }
    )


def add_slices(weighted: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Sum of bitmaps: ``weighted[w]`` holds bitmaps that each count 2**w; slices of the sum, lowest first.

    Carry-save addition: three bitmaps of a weight become one of it and a carry of
    the next, until one is left.
    """
    out, w, words = [], 0, next(iter(weighted.values())).shape[1] if weighted else 0
    while weighted:
        rows = weighted.pop(w, np.zeros((0, words), dtype=np.uint64))
        carries = []
        while len(rows) > 1:
            if len(rows) == 2:
                carries.append((rows[0] & rows[1])[None])
                rows = (rows[0] ^ rows[1])[None]
                break
            m = len(rows) // 3
            a, b, c = rows[:m], rows[m : 2 * m], rows[2 * m : 3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            rows = np.concatenate([half ^ c, rows[3 * m :]])
        out.append(rows[0] if len(rows) else np.zeros(words, dtype=np.uint64))
        w += 1
        if carries:
            weighted[w] = np.concatenate([*([weighted[w]] if w in weighted else []), *carries])
    return out


def select_top(slices: list[np.ndarray], members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the rows surely among the k highest, and of those that tie for the rest."""
    sure, tied = np.zeros_like(members), members
    for one in reversed(slices):
        taken = sure | (tied & one)
        n = int(np.bitwise_count(taken).sum())
        if n > k:
            tied = tied & one
        else:
            sure, tied = (taken, tied & ~one)
            if n == k:
                return sure, np.zeros_like(members)
    return sure, tied


def _rows(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class Block:
    """A block of the index as bitmaps of 64-bit words."""

    def __init__(self, row: pd.Series):
        self.n, self.width, self.dims = int(row["n"]), int(row["width"]), int(row["dims"])
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.low = [int(v) for v in row["low"].decode().split(",") if v]
        words = -(-self.n // 64)
        self.slices = np.frombuffer(row["slices"], dtype=np.uint64).reshape(self.dims, self.width, words)
        bits = np.zeros(words * 64, dtype=np.uint8)
        bits[: self.n] = 1
        self.members = np.packbits(bits, bitorder="little").view(np.uint64)

    def sums(self, factors: np.ndarray) -> list[np.ndarray]:
        """Slices of the sum of factor x (component - low), for factors of 0 or more."""
        weighted: dict[int, list[np.ndarray]] = {}
        for bit in range(_bits(factors.max()) if len(factors) else 0):
            chosen = self.slices[np.flatnonzero((factors >> bit) & 1)]
            if len(chosen):
                for b in range(self.width):
                    weighted.setdefault(bit + b, []).append(chosen[:, b])
        return add_slices({w: np.concatenate(x) for w, x in weighted.items()})

    def top(self, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row ids and scores of the k best; equal scores go to the smaller id."""
        d = min(self.dims, len(query))
        factors = np.zeros(self.dims, dtype=query.dtype)
        factors[:d] = query[:d]
        # a negative factor f counts as |f| x (2**width - 1 - value), whose bits are the flipped bits
        sign = factors < 0
        flipped = self
        if sign.any():
            flipped = object.__new__(Block)
            flipped.__dict__.update(self.__dict__)
            flipped.slices = np.where(sign[:, None, None], self.slices ^ self.members, self.slices)
        slices = flipped.sums(np.abs(factors)) or [np.zeros_like(self.members)]
        factors_told = factors.tolist()
        base = sum(f * v for f, v in zip(factors_told, self.low, strict=True)) + (2**self.width - 1) * sum(f for f in factors_told if f < 0)
        members = self.members
        own = np.searchsorted(self.ids, [query_id, query_id + 1])
        if own[0] < own[1]:
            members = members.copy()
            for row in range(own[0], own[1]):
                members[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        sure, tied = select_top(slices, members, k)
        first = _rows(sure)
        rest = _rows(tied)[: k - len(first)]  # ids ascend with the rows
        found = np.concatenate([first, rest])
        small = len(slices) < _BITS and _bits(base) < _BITS
        scores = np.full(len(found), base, dtype=np.int64 if small else object)
        word, bit = found // 64, (found % 64).astype(np.uint64)
        for w, one in enumerate(slices):
            scores += ((one[word] >> bit) & np.uint64(1)).astype(scores.dtype) << w
        return self.ids[found], scores


def _told(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores as a BIGINT shows them, and bytes that order those beyond it."""
    if scores.dtype == np.int64:
        return scores, np.full(len(scores), None, dtype=object)
    exact = np.empty(len(scores), dtype=object)
    exact[:] = [integers.sortable(v) for v in scores]
    return np.array([integers.clipped(int(v)) for v in scores], dtype=np.int64), exact


def _search(k: int):
    def search(_, index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, row in index.iterrows():
            block = Block(row)
            for _, part in queries.iterrows():
                ids = np.frombuffer(part["ids"], dtype=np.int64)
                shape = (int(part["n"]), int(part["dims"]))
                if part["large"]:
                    vectors = np.array([int(v) for v in part["vectors"].decode().split(",") if v], dtype=object).reshape(shape)
                else:
                    vectors = np.frombuffer(part["vectors"], dtype=np.int64).reshape(shape)
                for query_id, vector in zip(ids.tolist(), vectors, strict=True):
                    rows, scores = block.top(vector, query_id, k)
                    found.append((np.full(len(rows), query_id, dtype=np.int64), rows, *_told(scores)))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "exact": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "exact": object})
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "exact"), columns, strict=True)))

    return search


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64) -> DataFrame:
    """Each query's k rows of highest integer inner product, ties to the smaller id.

    Components become floor(scale x component). Rows are dealt by a digest into
    blocks of about ``BLOCK_ROWS``; a block keeps a bitmap per component and bit. A
    task adds one block's bitmaps for some queries by carry-save addition, takes the
    rows that lead from the highest slice of the sum downward, and resolves the rows
    that tie at the edge. The k best of each block then meet per query.

    Both tables have ``vec_id`` and ``embedding``; other columns are ignored. A row
    with the query's own id is no candidate. Vectors that are null, or hold null or
    non-finite components, and rows without id take no part; repeated rows count
    once; shorter vectors are filled with zeros. Components of any size count: vectors
    with one beyond 2**24 after scaling are dealt into blocks of their own, whose
    bitmaps are as many as their bits. Scores beyond a BIGINT are compared exactly and
    show its largest or least value. An empty table gives no rows; with fewer than k
    candidates a query gets all.

    Returns query_id, rank (from 1), vec_id, score.
    """
    rows, asked = quantised(vectors, scale), quantised(queries, scale)
    n_rows, n_asked = vectors.count(), queries.count()
    blocks, parts = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_asked // QUERY_ROWS))
    # large vectors keep to themselves, or their bits would be everyone's
    deal = lambda n: F.pmod(F.xxhash64("vec_id", "q", "wide"), F.lit(n)).cast("int") + F.when(F.col("q").isNull(), n).otherwise(0)
    index = rows.withColumn("block", deal(blocks)).groupBy("block").applyInPandas(lambda df: _index_block(df, scale), INDEX)
    packed = asked.withColumn("part", deal(parts)).groupBy("part").applyInPandas(lambda df: _query_part(df, scale), QUERIES)
    large = lambda df: 1 if integers.quantised(df, scale).filter("q IS NULL").isEmpty() else 2
    blocks, parts = large(vectors) * blocks, large(queries) * parts
    everywhere = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    found = (
        everywhere(index, parts, "part")
        .groupBy("block", "part")
        .cogroup(everywhere(packed, blocks, "block").groupBy("block", "part"))
        .applyInPandas(_search(k), FOUND)
    )
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("exact").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
