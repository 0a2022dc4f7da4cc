"""Column functions that shield glossary terms from a model and put them back.

For glossaries small enough to be one pattern (a few hundred terms). Larger ones
go through the join in ``operators.glossary``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from locale_lake.functions import fixed
from locale_lake.functions import text as tx

_TOKEN = rf"(?U)\s*-?\s*{fixed.TERM_TOKEN}([0-9]+)\s*-?\s*"


def term_pattern(terms: dict[str, str]) -> str:
    """Whole words, any case, longest term first."""
    longest_first = sorted(terms, key=lambda term: (-len(term), term))
    return r"(?iuU)\b(" + "|".join(rf"\Q{term}\E" for term in longest_first) + r")\b"


def hits(text: Column, terms: dict[str, str]) -> Column:
    """Matched terms as they stand in the text, in order."""
    return F.regexp_extract_all(text, F.lit(term_pattern(terms)), F.lit(1))


def replacements(text: Column, terms: dict[str, str]) -> Column:
    """What each hit stands for, capitalised where the hit is."""
    dictionary = F.create_map(
        *[F.lit(x) for term, value in terms.items() for x in (term.lower(), value)]
    )
    return F.transform(
        hits(text, terms),
        lambda hit: follow_capital(hit, F.element_at(dictionary, F.lower(hit))),
    )


def follow_capital(hit: Column, replacement: Column) -> Column:
    first = F.upper(F.substring(replacement, 1, 1))
    return F.when(
        hit.rlike(r"^\p{Lu}") & replacement.rlike(r"^\p{Ll}"),
        F.concat(first, F.substring(replacement, 2, 1 << 30)),
    ).otherwise(replacement)


def protect(text: Column, terms: dict[str, str]) -> Column:
    """The text with numbered stand-ins for its terms. Numbers start at 0 per text."""
    if not terms:
        return text
    parts = F.split(text, term_pattern(terms), -1)
    return F.array_join(
        F.transform(
            parts,
            lambda part, i: F.when(
                i > 0,
                F.concat(
                    F.lit(f" {fixed.TERM_TOKEN}"), (i - 1).cast("string"), F.lit(" "), part
                ),
            ).otherwise(part),
        ),
        "",
    )


def restore(text: Column, tokens: Column) -> Column:
    """Stand-ins back to terms; unknown numbers stay as they are."""
    parts = F.split(text, _TOKEN, -1)
    terms = F.transform(
        F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)),
        lambda raw: F.coalesce(
            F.concat(
                F.lit(" "),
                F.get(tokens, F.regexp_extract(raw, "([0-9]+)", 1).try_cast("int")),
                F.lit(" "),
            ),
            raw,
        ),
    )
    joined = tx.rebuild(parts, terms)
    single_spaced = tx.strip(F.regexp_replace(joined, " {2,}", " "))
    return F.regexp_replace(single_spaced, r"(?U)\s+([.,!?;:])", "$1")


def by_language(
    lang: Column,
    glossaries: dict[str, dict[str, str]],
    function: Callable[[dict[str, str]], Column],
    otherwise: Column,
) -> Column:
    """Apply a column function with the glossary of each row's language."""
    branches = [
        (lang == code, function(terms)) for code, terms in sorted(glossaries.items()) if terms
    ]
    return tx.case(branches, otherwise)
