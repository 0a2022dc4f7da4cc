"""Is a value human text? One ``when`` chain that returns the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from locale_lake.functions import fixed, text as tx


def is_denied(tag: Column, extra: tuple[str, ...] = ()) -> Column:
    """Tags that never hold text, by name or by ending."""
    names = fixed.DENIED_TAGS + tuple(name.lower() for name in extra)
    endings = "|".join(fixed.DENIED_SUFFIXES)
    return F.lower(tag).isin(*names) | tag.rlike(f"({endings})$")


def is_number(text: Column) -> Column:
    return text.rlike("(?U)" + fixed.NUMBER)


def is_boolean(text: Column) -> Column:
    return F.lower(text).isin("true", "false")


def has_no_letter(text: Column) -> Column:
    return ~text.rlike(r"\p{L}")


def is_underscore_word(text: Column) -> Column:
    return F.contains(text, F.lit("_")) & ~has_space(text)


def is_path(text: Column) -> Column:
    has_separator = F.contains(text, F.lit("/")) | F.contains(text, F.lit("\\"))
    return has_separator & text.rlike("(?U)" + fixed.PATH)


def is_hex_colour(text: Column) -> Column:
    return text.rlike(fixed.HEX_COLOUR)


def is_dotted_identifier(text: Column) -> Column:
    return text.rlike(fixed.DOTTED_IDENTIFIER)


def has_space(text: Column) -> Column:
    return F.contains(text, F.lit(" "))


def is_humped_identifier(text: Column) -> Column:
    """A capital first and another one later, with nothing but letters and digits."""
    return text.rlike("^[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*$")


def classify_value(text: Column) -> Column:
    """Reason code for the value alone; ``text`` means translatable.

    A value with a space in it can only be text or free of letters, because no
    other shape admits a space. Asking that first keeps long texts away from the
    patterns.
    """
    value = tx.strip(text)
    return (
        F.when(tx.is_blank(text), "blank")
        .when(
            has_space(value),
            F.when(has_no_letter(value), "no_letter").otherwise("text"),
        )
        .when(is_number(value), "number")
        .when(is_boolean(value), "boolean")
        .when(has_no_letter(value), "no_letter")
        .when(is_underscore_word(value), "underscore_word")
        .when(is_path(value), "path")
        .when(is_hex_colour(value), "hex_colour")
        .when(is_dotted_identifier(value), "dotted_identifier")
        .when(is_humped_identifier(value), "humped_identifier")
        .otherwise("text")
    )


def classify(tag: Column, text: Column, extra_denied: tuple[str, ...] = ()) -> Column:
    """Reason code for a field: the tag decides before the value does."""
    return F.when(is_denied(tag, extra_denied), "denied_tag").otherwise(classify_value(text))


def is_translatable(tag: Column, text: Column, extra_denied: tuple[str, ...] = ()) -> Column:
    return classify(tag, text, extra_denied) == "text"


def is_trivial(text: Column) -> Column:
    """At most twelve characters and one word: nothing a model could improve."""
    stripped = tx.strip(text)
    # two words: a second run of word characters after a gap
    return (
        (F.length(stripped) <= fixed.TRIVIAL_MAX_CHARS)
        & (stripped != "")
        & ~stripped.rlike(r"(?U)\w\W+\w")
    )


def has_foreign_script(text: Column, lang: Column) -> Column:
    return lang.isin(*fixed.FOREIGN_SCRIPT_TARGETS) & text.rlike(fixed.FOREIGN_SCRIPT)


def is_truncated(source: Column, output: Column) -> Column:
    source_words = tx.words(source)
    return (source_words >= fixed.TRUNCATION_MIN_WORDS) & (
        tx.words(output) < source_words * fixed.TRUNCATION_RATIO
    )
