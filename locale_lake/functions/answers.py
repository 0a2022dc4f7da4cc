"""Column functions that read model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locale_lake.functions import text as tx

_BODY = r"(?is)<ans>(.*?)</ans>"
_NUMBERED = r"(?sU)^\s*(\d+)\s*:\s*(.*)$"
_LINE_END = r"\r\n|\n|\r"


def answer_body(raw: Column) -> Column:
    """What stands between the answer tags; without tags, everything."""
    return F.when(raw.rlike(_BODY), F.regexp_extract(raw, _BODY, 1)).otherwise(raw)


def _unquote(line: Column) -> Column:
    return F.regexp_replace(tx.strip(line), '^"+|"+$', "")


def numbered_lines(raw: Column) -> Column:
    """``N: text`` lines of an answer as ARRAY<STRUCT<n, text>>, in order."""
    lines = F.filter(
        F.split(answer_body(raw), _LINE_END, -1), lambda line: line.rlike(_NUMBERED)
    )
    return F.transform(
        lines,
        lambda line: F.struct(
            F.regexp_extract(line, _NUMBERED, 1).try_cast("bigint").alias("n"),
            _unquote(F.regexp_extract(line, _NUMBERED, 2)).alias("text"),
        ),
    )


def rewrite_answers(raw: Column, count: Column) -> Column:
    """MAP<n, text> of a rewrite answer: only 1..count, a repeated number: last."""
    kept = F.filter(
        numbered_lines(raw),
        lambda line: line["n"].between(F.lit(1), count.cast("bigint")),
    )
    return _last_wins(kept)


def check_answers(raw: Column, count: Column) -> Column:
    """MAP<n, text> of corrections; a number that is absent means "no error"."""
    kept = F.filter(
        numbered_lines(raw),
        lambda line: line["n"].between(F.lit(1), count.cast("bigint"))
        & (line["text"] != ""),
    )
    return _last_wins(kept)


def _last_wins(lines: Column) -> Column:
    """Fold the (short) list of one answer into a map; later lines replace earlier."""
    numbers = F.array_distinct(F.transform(lines, lambda line: line["n"]))
    return F.map_from_arrays(
        numbers,
        F.transform(
            numbers,
            lambda n: F.element_at(F.filter(lines, lambda line: line["n"] == n), -1)["text"],
        ),
    )


def single_answer(raw: Column) -> Column:
    """Tag body, or else the last line that is not blank."""
    lines = F.filter(F.split(raw, _LINE_END, -1), lambda line: ~tx.is_blank(line))
    last = _unquote(F.get(lines, F.size(lines) - 1))
    return F.when(
        raw.rlike(_BODY), tx.strip(F.regexp_extract(raw, _BODY, 1))
    ).otherwise(F.coalesce(last, F.lit("")))
