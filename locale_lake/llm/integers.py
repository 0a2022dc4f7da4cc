"""Embeddings as exact integer vectors, and integers of any size as sortable columns."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Components up to this travel as 32-bit integers; vectors with a larger one keep their
# doubles and are worked on with integers of any size.
NARROW = 2**24
#: what a BIGINT column shows for an integer that is beyond it
MOST, LEAST = 2**63 - 1, -(2**63)
_MAX_DIMS = 4096


def quantised(vectors: DataFrame, scale: int, *others: str, dims: int | None = None) -> DataFrame:
    """vec_id, ``others``, and floor(scale x component): ``q``, or the doubles themselves as ``wide``.

    Vectors that are null or hold a null, NaN or infinite component are left out, with
    ``dims`` also those with another number of components.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    small = (F.size(x) <= _MAX_DIMS) & F.forall(x, lambda v: F.abs(v.cast("double")) <= NARROW / scale)
    rows = vectors.filter(x.isNotNull() & fine)
    if dims is not None:
        rows = rows.filter(F.size(x) == dims)
    return rows.select(
        "vec_id",
        *others,
        F.when(small, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int"))).alias("q"),
        F.when(~small, x.cast("array<double>")).alias("wide"),
    )


def exact_floor(x: float, scale: int) -> int:
    """floor(scale x value), also where the product is beyond a double."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def matrix(q: pa.Array, wide: pa.Array, scale: int, dims: int | None = None) -> np.ndarray:
    """One row per vector, short ones filled with zeros; of objects only where 64 bits could overflow."""
    q, wide = (a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in (q, wide))
    lengths = pc.coalesce(pc.list_value_length(q), pc.list_value_length(wide)).to_pylist()
    if wide.null_count == len(wide) and len(set(lengths)) == 1:
        return q.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(q), lengths[0])
    n = max(lengths, default=0) if dims is None else dims
    out = np.zeros((len(q), n), dtype=object if wide.null_count < len(wide) else np.int64)
    for i, (narrow, doubles) in enumerate(zip(q.to_pylist(), wide.to_pylist(), strict=True)):
        if narrow is not None:
            out[i, : len(narrow)] = narrow
        else:
            out[i, : len(doubles)] = [exact_floor(v, scale) for v in doubles]
    return out


def clipped(value: int) -> int:
    return max(LEAST, min(MOST, value))


def sortable(value: int) -> bytes | None:
    """Bytes that order as the integers do; none for those that a BIGINT tells apart."""
    value = int(value)
    if LEAST < value < MOST:
        return None
    size = abs(value).bit_length() // 8 + 1
    told = size.to_bytes(4, "big") + abs(value).to_bytes(size, "big")
    return b"\x01" + told if value > 0 else b"\x00" + bytes(255 - b for b in told)


def told(clip: int, key: bytes | None) -> int:
    """The integer of a clipped BIGINT and its sortable bytes."""
    if key is None:
        return clip
    body = key[5:] if key[0] else bytes(255 - b for b in key[5:])
    value = int.from_bytes(body, "big")
    return value if key[0] else -value
