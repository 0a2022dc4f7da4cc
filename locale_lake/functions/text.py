"""Column functions over text: placeholders, segments, sentences, escaping.

Everything here is a Column -> Column expression, so it stays inside the JVM.
Patterns carry ``(?U)`` because Java's classes are ASCII-only without it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from locale_lake.functions import fixed


def _pattern(profile: str) -> str:
    return f"(?U)({fixed.MARKUP[profile]})"


def strip(text: Column) -> Column:
    """Trim every kind of whitespace (``F.trim`` only trims spaces).

    Works on the UTF-8 bytes from both ends; a regex would decode the whole text.
    """
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def words(text: Column) -> Column:
    """Number of whitespace-separated words."""
    stripped = strip(text)
    return F.when(stripped == "", F.lit(0)).otherwise(
        F.size(F.split(stripped, r"(?U)\s+"))
    )


def placeholders(text: Column, profile: str = "braces") -> Column:
    """All markup of the profile, in order."""
    return F.regexp_extract_all(text, F.lit(_pattern(profile)), F.lit(1))


def segments(text: Column, profile: str = "braces") -> Column:
    """The text around the markup: one more part than there are placeholders."""
    return F.split(text, _pattern(profile), -1)


def rebuild(parts: Column, holders: Column) -> Column:
    """Interleave parts and placeholders again."""
    return F.array_join(
        F.zip_with(
            parts, holders, lambda part, holder: F.concat(part, F.coalesce(holder, F.lit("")))
        ),
        "",
    )


def lead_space(text: Column) -> Column:
    return F.regexp_extract(text, r"(?U)^(\s*)", 1)


def trail_space(text: Column) -> Column:
    """Whitespace at the end; a blank text counts as all lead, no trail."""
    return F.when(is_blank(text), F.lit("")).otherwise(
        F.regexp_extract(text, r"(?U)(\s*)\z", 1)
    )


def sentences(text: Column) -> Column:
    """Pieces a model gets for one segment: long text is cut at sentence ends."""
    stripped = strip(text)
    cut = F.filter(
        F.split(stripped, r"(?U)(?<=[.!?])\s+", -1), lambda piece: piece != ""
    )
    return F.when(F.length(stripped) > fixed.LONG_TEXT_CHARS, cut).otherwise(
        F.array(stripped)
    )


def join_sentences(pieces: Column) -> Column:
    return F.array_join(pieces, " ")


def xml_escape(text: Column) -> Column:
    """Ampersand first; quotes stay."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def xml_comment(text: Column) -> Column:
    """Text that may stand inside a comment: no double hyphen, none at the end."""
    spaced = F.regexp_replace(text, "-(?=-)", "- ")
    return F.when(F.endswith(spaced, F.lit("-")), F.concat(spaced, F.lit(" "))).otherwise(
        spaced
    )


def language_folder(code: Column) -> Column:
    """Folder name of a language; an unknown code is capitalised."""
    known = F.create_map(
        *[F.lit(x) for pair in fixed.LANGUAGE_FOLDERS.items() for x in pair]
    )
    capitalised = F.concat(
        F.upper(F.substring(code, 1, 1)), F.lower(F.substring(code, 2, 1 << 30))
    )
    return F.coalesce(F.element_at(known, F.lower(code)), capitalised)


def is_rule_string(tag: Column, text: Column) -> Column:
    return (F.lower(tag) == fixed.RULE_LIST_TAG) & text.rlike("(?sU)" + fixed.RULE_STRING)


def rule_parts(text: Column) -> Column:
    """(key with its parameters, text after the arrow)."""
    pattern = "(?sU)" + fixed.RULE_STRING
    return F.struct(
        F.regexp_extract(text, pattern, 1).alias("rule_key"),
        F.regexp_extract(text, pattern, 2).alias("rule_text"),
    )


def placeholders_kept(source: Column, answer: Column, profile: str = "braces") -> Column:
    """Does the answer hold every placeholder at least as often as the source?"""
    both = F.struct(
        placeholders(source, profile).alias("needed"), placeholders(answer, profile).alias("got")
    )

    def times(holders: Column, holder: Column) -> Column:
        return F.size(F.filter(holders, lambda x: x == holder))

    return let(
        both,
        lambda found: F.forall(
            F.array_distinct(found["needed"]),
            lambda holder: times(found["got"], holder) >= times(found["needed"], holder),
        ),
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named.

    An expression that a lambda mentions is evaluated for every element; a lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def case(branches: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """``when`` chain over a list that may be empty."""
    if not branches:
        return otherwise
    chain = F.when(*branches[0])
    for condition, value in branches[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(otherwise)
