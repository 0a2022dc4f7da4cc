"""License scan: fuzzy search of short notices from exact seeds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from locale_lake.llm import rawtext


@dataclass(frozen=True)
class Notice:
    """Words of a notice, its label, and how many edits of letters it may have."""

    phrase: str
    label: str
    edits: int


BASE = (
    Notice("under the mit license", "mit", 2),
    Notice("apache license version 2", "apache-2", 2),
    Notice("cc by nc", "cc-by-nc", 0),
)
MORE = (
    Notice("gnu general public license version 3", "gpl-3", 3),
    Notice("gnu general public license version 2", "gpl-2", 3),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("mozilla public license version 2", "mpl-2", 3),
    Notice("bsd 3 clause license", "bsd-3", 2),
    Notice("permission is hereby granted free of charge", "mit", 3),
    Notice("creative commons attribution noncommercial", "cc-by-nc", 3),
)
NOTICES = BASE + MORE

_SEEN = pa.struct(
    [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("start_word", pa.int64()), ("edits", pa.int32())]
)


def seeds(notice: Notice) -> list[tuple[int, bytes]]:
    """The phrase cut into edits + 1 pieces: with no more edits, one of them stands unchanged."""
    phrase, parts = notice.phrase.encode(), notice.edits + 1
    cuts = [len(phrase) * k // parts for k in range(parts + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Normalised:
    """Texts as lower-case words, each followed by one space, in one buffer."""

    def __init__(self, texts: rawtext.Texts):
        condensed = rawtext.Condensed(texts, rawtext.ALNUM)
        self.source, self.offsets = condensed.source, condensed.offsets
        self.bytes = condensed.data.tobytes()
        self.texts = texts

    def find(self, needle: bytes) -> np.ndarray:
        places, at = [], self.bytes.find(needle)
        while at >= 0:
            places.append(at)
            at = self.bytes.find(needle, at + 1)
        return np.array(places, dtype=np.int64)

    def text_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, side="right") - 1

    def word_at(self, text: int, place: int) -> int:
        return self.bytes.count(b" ", int(self.offsets[text]), place)

    def code_point(self, text: int, place: int) -> int:
        """Offset in the original text, in code points, of a place in the buffer."""
        raw = self.texts.data[int(self.texts.offsets[text]) : int(self.source[place])]
        return int(((raw & 0xC0) != 0x80).sum())


def exact(words: Normalised, phrase: str) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of every place where the phrase's words stand consecutively."""
    needle = phrase.encode() + b" "
    places = words.find(needle)
    for place, text in zip(places.tolist(), words.text_of(places).tolist(), strict=True):
        start = int(words.offsets[text])
        if (place == start or words.bytes[place - 1] == 32) and place + len(needle) <= int(words.offsets[text + 1]):
            yield text, place, place + len(needle) - 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def fuzzy(words: Normalised, notice: Notice, pattern: regex.Pattern) -> Iterator[tuple[int, int, int, int]]:
    """(text, start, end, edits) of whole words that read as the notice with few edits.

    Digits must be those of the notice: a version number is no slip.
    """
    length = len(notice.phrase.encode())
    windows: dict[int, set[tuple[int, int]]] = {}
    for offset, seed in seeds(notice):
        places = words.find(seed)
        for place, text in zip(places.tolist(), words.text_of(places).tolist(), strict=True):
            first, last = int(words.offsets[text]), int(words.offsets[text + 1])
            begin = max(first, place - offset - notice.edits)
            begin = max(first, words.bytes.rfind(b" ", first, begin + 1) + 1)
            end = words.bytes.find(b" ", min(last, place - offset + length + notice.edits), last)
            windows.setdefault(text, set()).add((begin, last - 1 if end < 0 else end))
    for text, spans in windows.items():
        seen = set()
        for begin, end in sorted(spans):
            window = words.bytes[begin:end].decode("utf-8", "replace")
            for m in pattern.finditer(window):
                if _digits(m.group()) != _digits(notice.phrase):
                    continue
                start = begin + len(window[: m.start()].encode())
                found = (start, begin + len(window[: m.end()].encode()))
                if found not in seen:
                    seen.add(found)
                    yield text, *found, sum(m.fuzzy_counts)


def _scanner(base: tuple[Notice, ...], notices: tuple[Notice, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {
            n: regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(n.phrase)}){{e<={n.edits}}}(?!\S)") for n in notices if n.edits
        }
        for batch in batches:
            for rows in rawtext.slices(batch, "text"):
                texts = rawtext.Texts(rows.column("text"))
                words = Normalised(texts)
                n = rows.num_rows
                ends = np.flatnonzero(np.frombuffer(words.bytes, np.uint8) == 32)
                counts = np.diff(np.searchsorted(ends, words.offsets))
                bases: list[list[tuple[int, str]]] = [[] for _ in range(n)]
                seen: list[dict] = [{} for _ in range(n)]
                for notice in notices:
                    for text, start, end in exact(words, notice.phrase):
                        if notice in base:
                            bases[text].append((words.word_at(text, start), notice.label))
                        seen[text][(start, end, notice.label)] = (1.0, 0)
                    if notice.edits:
                        for text, start, end, edits in fuzzy(words, notice, patterns[notice]):
                            key, told = (start, end, notice.label), (1 - edits / len(notice.phrase), -edits)
                            seen[text][key] = max(told, seen[text].get(key, told))
                shown = [
                    [
                        {
                            "label": label,
                            "start": words.code_point(i, start),
                            "end": words.code_point(i, end - 1) + 1,
                            "start_word": words.word_at(i, start),
                            "edits": -edits,
                        }
                        for (start, end, label), (_, edits) in sorted(found.items())
                    ]
                    for i, found in enumerate(seen)
                ]
                score = [max((told for told, _ in found.values()), default=0.0) for found in seen]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id"),
                        "n_words": pa.array(counts, pa.int64()),
                        "n_base": pa.array([len(x) for x in bases], pa.int64()),
                        "first_word": pa.array([min(x)[0] if x else None for x in bases], pa.int64()),
                        "last_word": pa.array([max(x)[0] if x else None for x in bases], pa.int64()),
                        "base_labels": pa.array([",".join(sorted({y[1] for y in x})) for x in bases], pa.string()),
                        "labels": pa.array([",".join(sorted({y["label"] for y in x})) for x in shown], pa.string()),
                        "score": pa.array(score, pa.float64()),
                        "notices": pa.array(shown, pa.list_(_SEEN)),
                    }
                )

    return run


def find_notices(docs: DataFrame, base: tuple[Notice, ...] = BASE, more: tuple[Notice, ...] = MORE) -> DataFrame:
    """License notices in every text, exact and with a few edits.

    Words are maximal runs of ASCII letters and digits and of all characters beyond
    ASCII, with A-Z lower-cased. Exact places of the ``base`` notices are counted; the
    labels also hold what the fuzzy search finds: an exact piece of a notice (it is
    cut into one piece more than the edits it may have) locates a candidate, and the
    pattern library's bounded-error match verifies it and gives span and edits.

    Returns for every row doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (1 less the share of edited letters of the best notice, 0 without
    one) and notices (label, span in code points of the text, first word, edits).
    Null counts as empty: no words, null first and last word. Rows that repeat are
    answered each; other columns are ignored.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _scanner(base, base + more),
        f"doc_id {id_type}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, notices array<struct<label:string,start:bigint,end:bigint,start_word:bigint,edits:int>>",
    )
