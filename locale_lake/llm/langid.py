"""Language identification with string kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locale_lake.llm import rawtext, sampling
from locale_lake.session import cut_lineage

# Letters: ASCII letters and every character beyond ASCII.
_LETTERS = rawtext._class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
# n-grams of 1 to LONGEST bytes are told apart by BITS bits of a hash.
LONGEST, BITS = 4, 15
DIMS = 1 << BITS
# Texts whose presence vectors are held at once.
BLOCK = 128


def presence(condensed: rawtext.Condensed, first: int, last: int) -> np.ndarray:
    """Rows ``first:last`` of the 0/1 matrix of n-grams that a text holds."""
    start, end = int(condensed.offsets[first]), int(condensed.offsets[last])
    data = condensed.data[start:end].astype(np.uint32)
    offsets = condensed.offsets[first : last + 1] - start
    out = np.zeros((last - first, DIMS), dtype=np.uint8)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(last - first, dtype=np.int64) * DIMS, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes up to the text's end
    code = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, LONGEST + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        code = (code[:m] << np.uint32(8)) | data[n - 1 :]
        hashed = ((code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
        inside = left[:m] >= n
        flat[row[:m][inside] + hashed[inside]] = 1
    return out


def _blocks(rows: pa.RecordBatch) -> Iterator[np.ndarray]:
    condensed = rawtext.Condensed(rawtext.Texts(rows.column("text")), _LETTERS)
    for first in range(0, rows.num_rows, BLOCK):
        yield presence(condensed, first, min(first + BLOCK, rows.num_rows))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@dataclass
class Model:
    """Languages, weights of the n-grams (landmarks times their coefficients) and means."""

    languages: list[str]
    weights: np.ndarray
    means: np.ndarray

    def scores(self, found: np.ndarray) -> np.ndarray:
        """One-versus-rest outputs of a block.

        The kernel is an inner product of presence vectors, so the product with the
        landmarks and that with their coefficients are one matrix.
        """
        norms = np.sqrt(np.maximum(found.sum(axis=1, dtype=np.int64), 1)).astype(np.float32)
        return (found.astype(np.float32) @ self.weights) / norms[:, None] + self.means


def _unit(bits: np.ndarray) -> np.ndarray:
    """Presence vectors of length one, from bitmaps."""
    out = np.unpackbits(bits, axis=1).astype(np.float32)
    out /= np.sqrt(np.maximum(out.sum(axis=1, keepdims=True), 1))
    return out


def fit(bits: np.ndarray, languages: list[str], landmarks: int, ridge: float) -> Model:
    """Kernel ridge regression on Nyström features of the normalised presence kernel.

    ``bits`` holds a bitmap per text; only the landmarks and a block of texts are
    unpacked at a time.
    """
    names = sorted(set(languages))
    y = np.array([[float(x == name) for name in names] for x in languages]).reshape(len(languages), len(names))
    # landmarks: the first rows of each language in turn
    turn, met = {}, Counter()
    for i, x in enumerate(languages):
        turn[i] = met[x]
        met[x] += 1
    marks = _unit(bits[sorted(turn, key=lambda i: (turn[i], languages[i]))[:landmarks]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max(initial=1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    kernel = [_unit(bits[first : first + BLOCK]) @ marks.T for first in range(0, len(bits), BLOCK)]
    features = np.concatenate(kernel).astype(np.float64) @ root
    means = y.mean(axis=0)
    gram = features.T @ features + ridge * np.eye(features.shape[1])
    beta = np.linalg.solve(gram, features.T @ (y - means))
    weights = marks.T @ (root @ beta).astype(np.float32)
    return Model(names, weights, means.astype(np.float32))


def _presence_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in rawtext.slices(batch, "text"):
            bits = [np.packbits(x).tobytes() for block in _blocks(rows) for x in block]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": rows.column("doc_id"), "lang": rows.column("lang"), "bits": pa.array(bits, pa.binary())}
            )


def train(
    docs: DataFrame,
    modulus: int = 3,
    held_out: int = 1,
    per_language: int = 300,
    landmarks: int = 256,
    ridge: float = 0.1,
    languages: int = 200,
) -> Model | None:
    """Learn from up to ``per_language`` texts of each language outside the held-out fold.

    Only the n-gram bitmaps (4 KB each) of the ``languages`` most frequent ones come to
    the driver. Texts without a letter teach nothing. None if there is nothing to
    learn from.
    """
    able = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    able = able.filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (sampling.fold(F.col("doc_id"), modulus) != held_out)
    )
    sizes = able.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    # thin large languages before any text is sorted; twice what is wanted is enough
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1_000_000
    thin = able.join(F.broadcast(cut_lineage(sizes)), "lang").filter(share < 2.0 * per_language / F.col("n") + 1e-4)
    draw = W.partitionBy("lang").orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(2024)), "doc_id")
    ranked = thin.filter(has_letter(F.col("text"))).select("doc_id", "text", "lang", F.row_number().over(draw).alias("rank"))
    sample = ranked.filter(F.col("rank") <= per_language)
    rows = sample.mapInArrow(_presence_bits, "doc_id bigint, lang string, bits binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], bytes(r["bits"])))
    if not rows:
        return None
    bits = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1)
    return fit(bits, [r["lang"] for r in rows], landmarks, ridge)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (0 to 1).

    The score is the winning output's share of all positive outputs. A text that is
    null or has no letter is ``und`` with score 0, and so is every text without a
    model. Ties go to the language that sorts first. Whole texts are read, however
    long; rows that repeat are answered each. Columns that have the two names before
    are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    kept, letter = docs.columns, sampling.unused(docs, "letter")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rawtext.slices(batch, "text"):
                able = rows.column(letter).to_pylist()
                names, shares = ["und"] * rows.num_rows, [0.0] * rows.num_rows
                if model:
                    outputs = np.concatenate([model.scores(b) for b in _blocks(rows)])
                    best = outputs.argmax(axis=1)
                    positive = np.clip(outputs, 0, None).astype(np.float64)
                    total = positive.sum(axis=1)
                    top = positive[np.arange(len(best)), best]
                    share = np.divide(top, total, out=np.full(len(best), 1 / len(model.languages)), where=total > 0)
                    for i, ok in enumerate(able):
                        if ok:
                            names[i], shares[i] = model.languages[best[i]], float(share[i])
                columns = [rows.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names, pa.string()), pa.array(shares, pa.float64())],
                    names=[*kept, "lang_pred", "score"],
                )

    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.withColumn(letter, has_letter(F.col("text"))).mapInArrow(run, schema)


def identified(docs: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """The documents whose language is told with a score of ``least`` or more, columns as before.

    Null and empty texts go; rows that repeat are told each; columns may have any names.
    """
    held = {c: sampling.unused(docs, f"own_{c}") for c in docs.columns if c.lower() in ("lang_pred", "score")}
    told = predict(docs.withColumnsRenamed(held), train(docs, **options))
    told = told.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).drop("lang_pred", "score")
    return told.withColumnsRenamed({v: k for k, v in held.items()}).select(*docs.columns)
