"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locale_lake.llm import rawtext, sampling

# Hashed words are features 0 .. WORDS - 1; the statistics follow them.
WORDS = 1 << 16
RANK = 8
# Labelled texts to learn from, per class (the documented bound of the sample).
PER_CLASS = 3000

_CLASSES = {
    "upper": rawtext._class((0x41, 0x5A)),
    "lower": rawtext._class((0x61, 0x7A)),
    "digits": rawtext._class((0x30, 0x39)),
    "spaces": rawtext._class((0x20, 0x20), (0x09, 0x0D)),
    "stops": rawtext._class((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B)),
    "shouts": rawtext._class((0x21, 0x21), (0x3F, 0x3F)),
    "marks": rawtext._class((0x23, 0x26), (0x2A, 0x2B), (0x3C, 0x40), (0x5B, 0x60), (0x7B, 0x7E)),
    "others": rawtext._class((0x80, 0xFF)),
    "breaks": rawtext._class((0x0A, 0x0A)),
}
STATISTICS = (*_CLASSES, "bytes", "words", "word_bytes", "distinct", "repeats", "shingles", "n_chars", "n_chars_missing")


def _distinct_share(owner: np.ndarray, hashes: np.ndarray, rows: int, counts: np.ndarray) -> np.ndarray:
    pairs = np.unique((owner.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    distinct = np.bincount((pairs >> np.uint64(40)).astype(np.int64), minlength=rows)
    return distinct / np.maximum(counts, 1)


def features(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, word, value) of the hashed words, ordered by owner, and the matrix of statistics."""
    texts = rawtext.Texts(rows.column("text"))
    words = texts.words(rawtext.NOT_SPACE)
    hashes, counts, n = words.hashes(), words.counts, rows.num_rows
    owner = np.repeat(np.arange(n), counts)
    pairs, times = np.unique(owner * WORDS + (hashes & np.uint64(WORDS - 1)).astype(np.int64), return_counts=True)
    row, word = pairs // WORDS, pairs % WORDS
    value = 1 + np.log(times)
    norm = np.sqrt(np.bincount(row, value * value, minlength=n))
    value = value / norm[row]

    size = np.maximum(np.diff(texts.offsets) - 1, 0)
    share = [
        (np.add.reduceat(table[texts.data].astype(np.int32), texts.offsets[:-1]) - (name == "spaces")) / np.maximum(size, 1)
        for name, table in _CLASSES.items()
    ] if n else [np.zeros(0)] * len(_CLASSES)
    same = np.zeros(len(hashes), dtype=np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    repeats = np.bincount(owner, same, minlength=n) / np.maximum(counts, 1)
    threes = np.zeros(max(0, len(hashes) - 2), dtype=np.uint64)
    for k in range(3):
        threes += hashes[k : len(hashes) - 2 + k] * rawtext._PLACE[k] if len(threes) else 0
    inside = owner[2:] == owner[:-2] if len(threes) else np.zeros(0, dtype=bool)
    shingles = _distinct_share(owner[: len(threes)][inside], rawtext.mix(threes)[inside], n, np.maximum(counts - 2, 0))
    declared = rows.column("n_chars").to_pylist() if "n_chars" in rows.schema.names else [None] * n
    statistics = np.stack(
        [
            *share,
            np.log1p(size),
            np.log1p(counts),
            np.bincount(owner, words.ends - words.starts, minlength=n) / np.maximum(counts, 1),
            _distinct_share(owner, hashes, n, counts),
            repeats,
            shingles,
            np.array([np.log1p(max(0, x or 0)) for x in declared]),
            np.array([float(x is None) for x in declared]),
        ],
        axis=1,
    ) if n else np.zeros((0, len(STATISTICS)))
    return row, word, value, statistics


@dataclass
class Machine:
    """bias + w.x + the sum over pairs of features of <v_i, v_j> x_i x_j."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def entries(self, row, word, value, statistics):
        """All features of the texts as (owner, feature, value), ordered by owner."""
        n, k = statistics.shape
        dense = np.clip((statistics - self.mean) / self.scale, -4, 4) / np.sqrt(k)
        owner = np.concatenate([row, np.repeat(np.arange(n), k)])
        order = np.argsort(owner, kind="stable")
        feature = np.concatenate([word, np.tile(np.arange(WORDS, WORDS + k), n)])[order]
        return owner[order], feature, np.concatenate([value, dense.reshape(-1)])[order].astype(np.float32)

    def outputs(self, owner, feature, value, n: int):
        """Outputs and the sums that the gradient needs.

        The pairs of all features take linear time: half of the square of the sum
        less the sum of the squares, per factor.
        """
        starts = np.searchsorted(owner, np.arange(n))
        weighted = self.v[feature] * value[:, None]
        sums = np.add.reduceat(weighted, starts, axis=0)
        squares = np.add.reduceat((weighted * weighted).sum(axis=1), starts)
        linear = np.add.reduceat(self.w[feature] * value, starts)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, rows: pa.RecordBatch) -> np.ndarray:
        found = features(rows)
        entries = self.entries(*found)
        return _sigmoid(self.outputs(*entries, rows.num_rows)[0].astype(np.float64))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(row, word, value, statistics, y, weights, updates: int = 1200, batch: int = 64, rate: float = 0.05, decay: float = 1e-4) -> Machine:
    """Adagrad on the weighted log loss; the order of texts is drawn from a fixed seed; as many updates for any number of texts."""
    draw = np.random.default_rng(11)
    n, k = statistics.shape
    scale = statistics.std(axis=0)
    v = draw.normal(0, 0.05, (WORDS + k, RANK)).astype(np.float32)
    machine = Machine(0.0, np.zeros(WORDS + k, np.float32), v, statistics.mean(axis=0), np.where(scale > 1e-9, scale, 1.0))
    owner, feature, value = machine.entries(row, word, value, statistics)
    starts = np.searchsorted(owner, np.arange(n + 1))
    seen_w, seen_v, seen_b = np.full(WORDS + k, 1e-3, np.float32), np.full((WORDS + k, RANK), 1e-3, np.float32), 1e-3
    order = np.concatenate([draw.permutation(n) for _ in range(-(-updates * batch // n))])
    for first in range(0, updates * batch, batch):
        some = order[first : first + batch]
        at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in some])
        sizes = starts[some + 1] - starts[some]
        local, f, x = np.repeat(np.arange(len(some)), sizes), feature[at], value[at]
        out, sums = machine.outputs(local, f, x, len(some))
        slope = (weights[some] * (_sigmoid(out) - y[some])).astype(np.float32) / len(some)
        g = slope[local] * x
        used, place = np.unique(f, return_inverse=True)
        gw = np.bincount(place, g, minlength=len(used)).astype(np.float32) + decay * machine.w[used]
        each = g[:, None] * (sums[local] - machine.v[f] * x[:, None])
        by = np.argsort(place, kind="stable")
        gv = np.add.reduceat(each[by], np.searchsorted(place[by], np.arange(len(used))), axis=0) + decay * machine.v[used]
        seen_w[used] += gw * gw
        seen_v[used] += gv * gv
        machine.w[used] -= rate * gw / np.sqrt(seen_w[used])
        machine.v[used] -= rate * gv / np.sqrt(seen_v[used])
        seen_b += float(slope.sum()) ** 2
        machine.bias -= rate * float(slope.sum()) / seen_b**0.5
    trained = np.zeros(WORDS + k, dtype=bool)
    trained[feature] = True
    machine.v[~trained] = 0  # words that no example has say nothing
    return machine


def _example_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in rawtext.slices(batch, "text"):
            row, word, value, statistics = features(rows)
            ends = np.searchsorted(row, np.arange(rows.num_rows + 1))
            pieces = list(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column("doc_id"),
                    "y": rows.column("y"),
                    "words": pa.array([word[a:b].astype(np.int32).tobytes() for a, b in pieces], pa.binary()),
                    "values": pa.array([value[a:b].astype(np.float32).tobytes() for a, b in pieces], pa.binary()),
                    "statistics": pa.array([s.astype(np.float64).tobytes() for s in statistics], pa.binary()),
                }
            )


def _inputs(docs: DataFrame) -> list:
    declared = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    return ["text", declared.alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, per_class: int = PER_CLASS) -> Machine | None:
    """Learn from up to ``per_class`` labelled texts of each class outside the held-out fold.

    Their features, not their texts, come to the driver. Both classes weigh the same in
    the fit, so a score is the probability of label 1 where both are as frequent. None
    without examples.
    """
    able = sampling.labelled(labels, "quality", modulus, held_out)
    picked = sampling.bounded(able, "y", [0, 1], per_class)
    texts = docs.select("doc_id", *_inputs(docs)).join(F.broadcast(picked), "doc_id")  # at most 2 x per_class rows
    rows = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "y", "text", "n_chars").mapInArrow(
        _example_features, "doc_id bigint, y int, words binary, values binary, statistics binary"
    )
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], bytes(r["statistics"])))
    if not rows:
        return None
    words = [np.frombuffer(r["words"], np.int32) for r in rows]
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    ones = max(1.0, y.sum())
    weights = np.where(y == 1, 1 / ones, 1 / max(1.0, len(y) - ones))
    return fit(
        np.repeat(np.arange(len(rows)), [len(w) for w in words]),
        np.concatenate(words).astype(np.int64),
        np.concatenate([np.frombuffer(r["values"], np.float32) for r in rows]),
        np.stack([np.frombuffer(r["statistics"], np.float64) for r in rows]),
        y,
        weights / weights.mean(),
    )


def scored(docs: DataFrame, machine: Machine | None, modulus: int = 5, held_out: int = 0) -> DataFrame:
    """doc_id, held_out, score (probability of label 1) and predicted for every row.

    Null and empty texts are scored by their statistics, which are all zero. Without a
    machine every score is 0.5. Texts are read whole; rows that repeat are answered
    each. Inputs are the text and ``n_chars``; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rawtext.slices(batch, "text"):
                score = machine.scores(rows) if machine else np.full(rows.num_rows, 0.5)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id"),
                        "held_out": rows.column("held_out"),
                        "score": pa.array(score, pa.float64()),
                        "predicted": pa.array((score >= 0.3).astype(np.int32), pa.int32()),
                    }
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    fold = (sampling.fold(F.col("doc_id"), modulus) == held_out).alias("held_out")
    return docs.select("doc_id", *_inputs(docs), fold).mapInArrow(
        run, f"doc_id {id_type}, held_out boolean, score double, predicted int"
    )
