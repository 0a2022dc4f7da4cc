"""Toxicity from the nearest labelled examples by TF-IDF cosine over a block-max index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locale_lake.llm import rawtext, sampling

# Labelled examples to index, toxic and other (the documented bound of the sample).
TOXIC, OTHER = 1500, 4500
# Examples in a block of the index.
BLOCK = 64
# Cosines are told apart to this step, so that ties do not hang on rounding.
STEP = 1e-5
# A word in more than this part of the examples has its list in blocks with maxima.
FREQUENT = 16
# Postings of the other lists that are added up at once.
MEET = 1_000_000
# What a word counts that tells nothing, and the chi-square at which one counts half.
LEAST, CHI2 = 0.02, 15.0


def _counts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    words = rawtext.Texts(texts).words(rawtext.ALNUM)
    hashes = words.hashes()
    for start, end in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True):
        yield np.unique(hashes[start:end], return_counts=True)


def _example_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in rawtext.slices(batch, "text"):
            found = list(_counts(rows.column("text")))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": rows.column("doc_id"),
                    "y": rows.column("y"),
                    "words": pa.array([w.tobytes() for w, _ in found], pa.binary()),
                    "counts": pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary()),
                }
            )


def word_weights(words: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all words of the examples, and how much each counts.

    A word that toxic examples hold beyond chance counts more, up to 1; none is dropped:
    LEAST is what a word counts whose classes are as chance would have them.
    """
    all_words, n = np.unique(np.concatenate(words), return_counts=True)
    toxic = np.concatenate([np.zeros(0, np.uint64), *[w for w, t in zip(words, y, strict=True) if t]])
    in_toxic = np.bincount(np.searchsorted(all_words, toxic), minlength=len(all_words))
    expected = n * y.mean()
    beyond = np.where(in_toxic > expected, (in_toxic - expected) ** 2 / np.maximum(expected, 0.5), 0.0)
    lift = in_toxic / np.maximum(n, 1)  # few of the examples are toxic: a word of theirs alone says most
    return all_words, LEAST + (1 - LEAST) * lift * beyond / (beyond + CHI2)


@dataclass
class Rows:
    """Sparse vectors: those of row ``i`` are ``ends[i]:ends[i + 1]`` of words and weights."""

    ends: np.ndarray
    words: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, matrix: np.ndarray) -> Rows:
        owner, words = np.nonzero(matrix)
        return cls(np.searchsorted(owner, np.arange(len(matrix) + 1)), words, matrix[owner, words].astype(np.float32))

    def __len__(self) -> int:
        return len(self.ends) - 1

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends))

    def take(self, numbers: np.ndarray) -> Rows:
        counts = np.diff(self.ends)[numbers]
        at = _spans(self.ends[numbers], counts)
        return Rows(np.concatenate([[0], np.cumsum(counts)]), self.words[at], self.weights[at])


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of the spans from ``starts`` on, one span after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(counts.sum())


class Vectors:
    """TF-IDF vectors of unit length over a sorted vocabulary of word hashes.

    Words outside the vocabulary have no example to meet; they count in the length
    only, each as ``other`` (the weight of a word in no document).
    """

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, other: float = 0.0):
        self.vocabulary, self.idf, self.other = vocabulary, idf, other

    def of(self, words: np.ndarray, owner: np.ndarray, rows: int) -> tuple[Rows, np.ndarray]:
        """``rows`` vectors, and whether each has any word of the vocabulary."""
        v = len(self.vocabulary)
        at = np.minimum(np.searchsorted(self.vocabulary, words), v - 1)
        known = self.vocabulary[at] == words
        pairs, counts = np.unique(owner[known] * v + at[known], return_counts=True)
        who, at = pairs // v, pairs % v
        weights = (1 + np.log(counts)) * self.idf[at]
        squares = np.bincount(who, weights**2, minlength=rows)
        strange, counts = np.unique(np.stack([owner[~known].astype(np.uint64), words[~known]], 1), axis=0, return_counts=True)
        if len(strange):
            squares += np.bincount(strange[:, 0].astype(np.int64), ((1 + np.log(counts)) * self.other) ** 2, minlength=rows)
        weights = (weights / np.sqrt(squares)[who]).astype(np.float32)
        ends = np.searchsorted(who, np.arange(rows + 1))
        return Rows(ends, at, weights), np.diff(ends) > 0


@dataclass
class Index:
    """Posting lists of all words over examples in blocks.

    Lists that hold more than a FREQUENTth of the examples are kept block by block as
    rows of ``hot``, with their largest weight in each block; of the others, ``ends``,
    ``examples`` and ``weights`` are the postings.
    """

    vectors: Vectors
    place: np.ndarray  # row of a word in hot, -1 for the others
    hot: np.ndarray
    largest: np.ndarray  # hot words x blocks
    ends: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    y: np.ndarray
    ids: np.ndarray
    slope: float = 0.0
    shift: float = 0.0
    unseen: float = 0.0  # score of a text without words
    strange: float = 0.0  # score of a text that shares no word with any example

    @classmethod
    def build(cls, vectors: Vectors, rows: Rows | np.ndarray, y: np.ndarray, ids: np.ndarray) -> Index:
        rows = rows if isinstance(rows, Rows) else Rows.of(rows)
        owner = rows.owner
        # examples that lead with the same word share blocks, which keeps bounds low elsewhere
        by_weight = np.lexsort((rows.words, -rows.weights, owner))
        lead = np.full(len(rows), -1)
        most = np.zeros(len(rows))
        some = np.flatnonzero(np.diff(rows.ends))
        lead[some], most[some] = rows.words[by_weight[rows.ends[some]]], rows.weights[by_weight[rows.ends[some]]]
        order = np.lexsort((ids, -most, lead))
        rows, y, ids = rows.take(order), y[order], ids[order]
        total, v = len(rows), len(vectors.vocabulary)
        held = np.bincount(rows.words, minlength=v)
        frequent = held > max(1, total // FREQUENT)
        place = np.where(frequent, np.cumsum(frequent) - 1, -1)
        owner, often = rows.owner, frequent[rows.words]
        hot = np.zeros((int(frequent.sum()), total), dtype=np.float32)
        hot[place[rows.words[often]], owner[often]] = rows.weights[often]
        blocks = range(0, total, BLOCK)
        largest = np.stack([hot[:, b : b + BLOCK].max(axis=1) for b in blocks], axis=1)
        by_word = np.flatnonzero(~often)
        by_word = by_word[np.argsort(rows.words[by_word], kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.where(frequent, 0, held))])
        return cls(vectors, place, hot, largest, ends, owner[by_word].astype(np.int32), rows.weights[by_word], y, ids)

    @property
    def matrix(self) -> np.ndarray:
        """All weights, words x examples (for small indexes)."""
        out = np.zeros((len(self.place), len(self.ids)))
        out[self.place >= 0] = self.hot
        out[np.repeat(np.arange(len(self.place)), np.diff(self.ends)), self.examples] = self.weights
        return out

    def nearest(self, queries: Rows | np.ndarray, k: int, leave_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples, exactly; ties to the smaller number."""
        queries = queries if isinstance(queries, Rows) else Rows.of(queries)
        k = min(k, len(self.ids))
        met = np.concatenate([[0], np.cumsum(np.diff(self.ends)[queries.words])])[queries.ends]
        found, cosines, start = [np.zeros((0, k), np.int64)], [np.zeros((0, k))], 0
        while start < len(queries):
            end = min(int(np.searchsorted(met, met[start] + MEET, side="right")) - 1, start + BLOCK)
            end = max(end, start + 1)
            part = self._nearest(queries.take(np.arange(start, end)), k, None if leave_out is None else leave_out[start:end])
            found.append(part[0])
            cosines.append(part[1])
            start = end
        return np.concatenate(found), np.concatenate(cosines)

    def _nearest(self, queries: Rows, k: int, leave_out: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The short lists are added up; then blocks are visited by their bound, and a query
        skips a block whose bound lies below its k-th best cosine so far."""
        n, total, owner = len(queries), len(self.ids), queries.owner
        often = self.place[queries.words] >= 0
        hot = np.zeros((n, len(self.hot)))
        hot[owner[often], self.place[queries.words[often]]] = queries.weights[often]
        words, weights = queries.words[~often], queries.weights[~often].astype(np.float64)
        counts = self.ends[words + 1] - self.ends[words]
        at = _spans(self.ends[words], counts)
        cell = np.repeat(owner[~often] * total, counts) + self.examples[at]
        short = np.bincount(cell, np.repeat(weights, counts) * self.weights[at], minlength=n * total).reshape(n, total)
        bounds = hot @ self.largest + np.maximum.reduceat(short, np.arange(0, total, BLOCK), axis=1)
        best = np.full((n, k), -1, dtype=np.int64)  # cosine in steps, then number, in one key
        for b in np.argsort(-bounds.max(axis=0), kind="stable"):
            floor = best.min(axis=1) >> 24
            active = np.flatnonzero((bounds[:, b] + STEP) / STEP >= floor)
            if not len(active):
                continue
            first = int(b) * BLOCK
            cosines = hot[active] @ self.hot[:, first : first + BLOCK].astype(np.float64) + short[active, first : first + BLOCK]
            numbers = np.arange(first, first + cosines.shape[1])
            keys = (np.rint(np.clip(cosines, 0, 2) / STEP).astype(np.int64) << 24) | ((1 << 24) - 1 - numbers)
            if leave_out is not None:
                keys[leave_out[active][:, None] == numbers] = -1
            both = np.concatenate([best[active], keys], axis=1)
            best[active] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        best = -np.sort(-best, axis=1)
        found = np.where(best >= 0, (1 << 24) - 1 - (best & ((1 << 24) - 1)), 0)
        return found, np.where(best >= 0, (best >> 24) * STEP, 0.0)

    def votes(self, found: np.ndarray, cosines: np.ndarray) -> np.ndarray:
        """Share of the toxic among the nearest, weighted by the square of the cosine."""
        weights = cosines**2 + 1e-9
        return (weights * self.y[found]).sum(axis=1) / weights.sum(axis=1)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * votes + self.shift)))


def calibrate(votes: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through the votes (Newton's method, a little ridge)."""
    a, b = 4.0, -2.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * votes + b)))
        g = np.array([(weights * (p - y) * votes).sum() + 0.01 * a, (weights * (p - y)).sum() + 0.01 * b])
        h = weights * p * (1 - p)
        hess = np.array([[(h * votes * votes).sum() + 0.01, (h * votes).sum()], [(h * votes).sum(), h.sum() + 0.01]])
        step = np.clip(np.linalg.solve(hess, g), -5, 5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 0.0), b


def _document_counts(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows_seen = np.zeros(len(vocabulary), dtype=np.int64), 0
        for batch in batches:
            for rows in rawtext.slices(batch, "text"):
                words = rawtext.Texts(rows.column("text")).words(rawtext.ALNUM)
                hashes = words.hashes()
                at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[at] == hashes
                owner = np.repeat(np.arange(rows.num_rows), words.counts)[known]
                pairs = np.unique(owner * len(vocabulary) + at[known])
                counts += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
                rows_seen += rows.num_rows
        numbers = np.append(np.flatnonzero(counts), len(vocabulary))
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(numbers, pa.int32()), "n": pa.array(np.append(counts[counts > 0], rows_seen), pa.int64())}
        )

    return run


def train(
    docs: DataFrame, labels: DataFrame, k: int = 30, modulus: int = 4, held_out: int = 2, toxic: int = TOXIC, other: int = OTHER
) -> Index | None:
    """Index of up to ``toxic`` and ``other`` labelled examples outside the held-out fold.

    Every word of the examples is indexed, and words that toxic examples hold beyond
    chance weigh more, so the cosine is one of label-weighted vectors. A word's document frequency is counted over all
    documents. The logistic curve is fitted to the votes each example gets from the
    others, with both classes weighted to their shares among all labels. None if the
    examples have no words or none is toxic.
    """
    able = sampling.labelled(labels, "toxic", modulus, held_out)
    shares = {r["y"]: r["count"] for r in able.groupBy("y").count().collect()}
    picked = sampling.bounded(able, "y", [1], toxic).unionByName(sampling.bounded(able, "y", [0], other))
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most toxic + other rows
    rows = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "y", "text").mapInArrow(
        _example_words, "doc_id bigint, y int, words binary, counts binary"
    )
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], bytes(r["words"])))
    words = [np.frombuffer(r["words"], np.uint64) for r in rows]
    counts = [np.frombuffer(r["counts"], np.int32) for r in rows]
    y, ids = np.array([r["y"] for r in rows]), np.array([r["doc_id"] for r in rows], dtype=np.int64)
    rate = {v: shares.get(v, 0) / max(1, int((y == v).sum())) for v in (0, 1)}
    weights = np.where(y == 1, rate[1], rate[0])
    if not y.any() or not any(map(len, words)):
        return None
    vocabulary, tells = word_weights(words, y)
    sums = docs.select("text").mapInArrow(_document_counts(vocabulary), "word int, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # one row per word of the vocabulary
    held = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    held[found.column("word").to_numpy()] = found.column("n").to_numpy()
    n = max(int(held[-1]), 1)
    vectors = Vectors(vocabulary, tells * np.log(1 + n / np.maximum(held[:-1], 1)), LEAST * np.log(1 + n))
    flat = np.concatenate([np.repeat(w, c) for w, c in zip(words, counts, strict=True)])
    owner = np.repeat(np.arange(len(rows)), [int(c.sum()) for c in counts])
    matrix, some = vectors.of(flat, owner, len(rows))
    matrix = matrix.take(np.flatnonzero(some))
    # rows are numbered while the index is made: an id may have several
    index = Index.build(vectors, matrix, y[some], np.arange(int(some.sum())))
    own = np.argsort(index.ids)
    index.ids = ids[some][index.ids]
    votes = index.votes(*index.nearest(matrix, k, leave_out=own))
    index.slope, index.shift = calibrate(votes, y[some], weights[some] / weights.mean())
    bare = ~some
    index.unseen = float((weights[bare] * y[bare]).sum() / max(weights[bare].sum(), 1.0)) if bare.any() else 0.0
    index.strange = float((weights * y).sum() / weights.sum())
    return index


_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("toxic", pa.int32()), ("cosine", pa.float64())]))


def scored(docs: DataFrame, index: Index | None, k: int = 30, modulus: int = 4, held_out: int = 2, evidence: int = 3) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (the nearest examples) for every row.

    A text that shares no word with any example gets the rate of toxic ones among all
    labels and no evidence, a text without words that among examples without words;
    without an index every score is 0. Texts are read whole; rows that repeat are answered each.
    Labels, lang and source are no inputs; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rawtext.slices(batch, "text"):
                n = rows.num_rows
                score, shown = np.full(n, index.unseen if index else 0.0), [[] for _ in range(n)]
                if index:
                    words = rawtext.Texts(rows.column("text")).words(rawtext.ALNUM)
                    owner = np.repeat(np.arange(n), words.counts)
                    matrix, some = index.vectors.of(words.hashes(), owner, n)
                    score[words.counts > 0] = index.strange
                    if some.any():
                        found, cosines = index.nearest(matrix.take(np.flatnonzero(some)), k)
                        score[some] = index.calibrated(index.votes(found, cosines))
                        for i, numbers, near in zip(np.flatnonzero(some), found, cosines, strict=True):
                            shown[i] = [
                                {"doc_id": int(index.ids[e]), "toxic": int(index.y[e]), "cosine": float(c)}
                                for e, c in zip(numbers[:evidence], near[:evidence], strict=True)
                                if c > 0
                            ]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id"),
                        "held_out": rows.column("held_out"),
                        "score": pa.array(score, pa.float64()),
                        "predicted": pa.array((score >= 0.3).astype(np.int32), pa.int32()),
                        "evidence": pa.array(shown, _EVIDENCE),
                    }
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    fold = (sampling.fold(F.col("doc_id"), modulus) == held_out).alias("held_out")
    return docs.select("doc_id", "text", fold).mapInArrow(
        run,
        f"doc_id {id_type}, held_out boolean, score double, predicted int, "
        "evidence array<struct<doc_id:bigint,toxic:int,cosine:double>>",
    )
