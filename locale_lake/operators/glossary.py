"""Glossary operators that need a join: large term tables, adjective agreement."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locale_lake.functions import fixed
from locale_lake.functions import glossary as gl
from locale_lake.functions import text as tx
from locale_lake.operators import skew

# A term table is broadcast only after counting that it has no more rows than this.
BROADCAST_TERMS = 50_000
_WORDS_AND_GAPS = r"(?U)(\w+|\W+)"
# the same in tasks; this library's words have marks in them, as the JVM's have
_WALKED = 64
_PIECE, _WORD = regex.compile(r"\w+|\W+"), regex.compile(r"\w")


def find_terms(
    units: DataFrame,
    glossary: DataFrame,
    max_words: int,
    text: str = "text",
    unit_id: str = "unit_id",
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Leftmost-longest whole-word hits of a term table of any size.

    ``glossary`` has (lang, term, replacement); terms of more than ``max_words`` words
    are left out. A text is its words and the gaps between them. Up to BROADCAST_TERMS
    terms become a tree of words that goes to the tasks, and every text is walked
    along it once. More terms meet the texts by a join: each word that starts a term
    starts candidate spans, which meet the table by equality; frequent words make hot
    keys, so that join is spread. One row per unit with a hit: ``hits``
    ARRAY<STRUCT<start, size, hit, replacement>>, start and size counted in pieces
    (words and gaps).
    """
    terms = glossary.groupBy("lang", F.lower("term").alias("_span")).agg(
        F.min("replacement").alias("replacement")
    )
    if skew.has_at_most(terms, BROADCAST_TERMS):
        return _walked(units, terms, max_words, text, unit_id)
    pieces = F.regexp_extract_all(F.col(text), F.lit(_WORDS_AND_GAPS), F.lit(1))
    # words and gaps alternate, so words sit at every second place
    first_word = F.when(F.get("_pieces", F.lit(0)).rlike(r"(?U)^\w"), 1).otherwise(2)
    places = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size("_pieces"), F.lit(1))),
        lambda i: ((i - first_word) % 2 == 0) & (i <= F.size("_pieces")),
    )

    # a row per word with the pieces that a term from here on could take; most words
    # start no term, and only the others are spelled out as spans
    window = lambda i: F.struct(i.alias("start"), F.slice("_pieces", i, 2 * max_words - 1).alias("_window"))
    starts = (
        units.select(unit_id, "lang", pieces.alias("_pieces"))
        .select(unit_id, "lang", F.explode(F.transform(places, window)).alias("_w"))
        .select(unit_id, "lang", "_w.*", F.lower(F.get("_w._window", F.lit(0))).alias("_first"))
    )
    firsts = terms.select("lang", F.regexp_extract("_span", _WORDS_AND_GAPS, 1).alias("_first")).distinct()
    some = skew.lookup(starts, firsts, ["lang", "_first"], "inner", hot_rows, broadcast_rows=BROADCAST_TERMS)
    spans_at = F.transform(
        F.sequence(F.lit(1), F.size("_window"), F.lit(2)),
        lambda size: F.struct(size.alias("size"), F.array_join(F.slice("_window", F.lit(1), size), "").alias("hit")),
    )
    spans = some.select(unit_id, "lang", "start", F.explode(spans_at).alias("_s")).select(
        unit_id, "lang", "start", "_s.*", F.lower("_s.hit").alias("_span")
    )
    found = skew.lookup(
        spans, terms, ["lang", "_span"], "inner", hot_rows, broadcast_rows=BROADCAST_TERMS
    )
    grouped = found.groupBy(unit_id).agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "start",
                    (-F.col("size")).alias("_longest"),
                    "hit",
                    gl.follow_capital(F.col("hit"), F.col("replacement")).alias("replacement"),
                )
            )
        ).alias("_found")
    )
    return grouped.select(unit_id, _without_overlaps(F.col("_found")).alias("hits"))


def term_trees(terms: list[tuple[str, str, str]], max_words: int) -> dict[str, dict]:
    """Per language a tree of pieces; the key "" of a node holds the replacement of the term that ends there."""
    trees: dict[str, dict] = {}
    for lang, term, replacement in terms:
        pieces = _PIECE.findall(term)
        if not pieces or len(pieces) > 2 * max_words - 1 or not (_WORD.match(pieces[0]) and _WORD.match(pieces[-1])):
            continue
        node = trees.setdefault(lang, {})
        for piece in pieces:
            node = node.setdefault(piece, {})
        node[""] = replacement
    return trees


def walk_terms(text: str, tree: dict) -> list[dict]:
    """Hits of a text, leftmost first and each as long as can be; the next begins behind it."""
    pieces = _PIECE.findall(text)
    hits: list[dict] = []
    place = 0
    while place < len(pieces):
        node, end, replacement = tree.get(pieces[place].lower()), 0, None
        reach = place + 1
        while node is not None:
            if "" in node:
                end, replacement = reach, node[""]
            node = node.get(pieces[reach].lower()) if reach < len(pieces) else None
            reach += 1
        if end:
            hits.append({"start": place + 1, "size": end - place, "hit": "".join(pieces[place:end]), "replacement": replacement})
        place = end or place + 1
    return hits


def _walked(units: DataFrame, terms: DataFrame, max_words: int, text: str, unit_id: str) -> DataFrame:
    trees = term_trees([(r["lang"], r["_span"], r["replacement"]) for r in terms.collect()], max_words)
    id_type = units.schema[unit_id].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("hit", pa.string()), ("replacement", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few texts at a time, as a batch of long ones is many times as large in Python
        for batch in (b.slice(at, _WALKED) for b in batches for at in range(0, b.num_rows, _WALKED)):
            found = [
                walk_terms(said, trees[lang]) if said and lang in trees else []
                for lang, said in zip(batch.column("_lang").to_pylist(), batch.column("_said").to_pylist(), strict=True)
            ]
            some = pa.array([i for i, hits in enumerate(found) if hits], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_unit").take(some), pa.array([h for h in found if h], kind)], names=[unit_id, "hits"]
            )

    said = units.select(F.col(unit_id).alias("_unit"), F.col("lang").alias("_lang"), F.col(text).alias("_said"))
    found = said.mapInArrow(run, f"`{unit_id}` {id_type}, hits array<struct<start:int,size:int,hit:string,replacement:string>>")
    capital = F.transform(
        "hits",
        lambda h: F.struct(
            h["start"].alias("start"),
            h["size"].alias("size"),
            h["hit"].alias("hit"),
            gl.follow_capital(h["hit"], h["replacement"]).alias("replacement"),
        ),
    )
    return found.select(unit_id, capital.alias("hits"))


def longest_term(glossary: DataFrame) -> int:
    """Words of the longest term, 1 at least."""
    words = F.size(F.regexp_extract_all("term", F.lit(r"(?U)(\w+)"), F.lit(1)))
    return max(1, glossary.agg(F.max(words)).first()[0] or 1)


def _without_overlaps(found: Column) -> Column:
    """Keep a hit if it starts after the last kept one ended."""
    row = "struct<start:int,size:int,hit:string,replacement:string>"
    start = F.struct(
        F.lit(0).alias("end"), F.array().cast(f"array<{row}>").alias("kept")
    )

    def step(state: Column, x: Column) -> Column:
        size = -x["_longest"]
        kept = F.concat(
            state["kept"],
            F.array(
                F.struct(
                    x["start"].alias("start"),
                    size.alias("size"),
                    x["hit"].alias("hit"),
                    x["replacement"].alias("replacement"),
                ).cast(row)
            ),
        )
        return F.when(
            x["start"] >= state["end"],
            F.struct((x["start"] + size).alias("end"), kept.alias("kept")),
        ).otherwise(state)

    return F.aggregate(found, start, step, lambda state: state["kept"])


def protect_terms(
    units: DataFrame,
    glossary: DataFrame,
    max_words: int,
    text: str = "text",
    unit_id: str = "unit_id",
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Adds ``protected`` and ``tokens``; units without a hit keep their text."""
    hits = find_terms(units, glossary, max_words, text, unit_id, hot_rows)
    pieces = F.regexp_extract_all(F.col(text), F.lit(_WORDS_AND_GAPS), F.lit(1))
    number = F.transform(
        F.col("hits"), lambda h, i: F.struct(h["start"].alias("s"), h["size"].alias("n"))
    )
    before = F.transform(
        F.sequence(F.lit(0), F.size("hits")),
        lambda i: F.coalesce(F.get(number, i - 1)["s"] + F.get(number, i - 1)["n"], F.lit(1)),
    )
    gaps = F.transform(
        before,
        lambda begin, i: F.array_join(
            F.slice(
                F.col("_pieces"),
                begin,
                F.coalesce(F.get(number, i)["s"], F.size("_pieces") + 1) - begin,
            ),
            "",
        ),
    )
    protected = F.array_join(
        F.transform(
            gaps,
            lambda gap, i: F.when(
                i > 0,
                F.concat(
                    F.lit(f" {fixed.TERM_TOKEN}"), (i - 1).cast("string"), F.lit(" "), gap
                ),
            ).otherwise(gap),
        ),
        "",
    )
    return (
        units.join(hits, unit_id, "left")
        .withColumn("_pieces", F.when(F.col("hits").isNotNull(), pieces))
        .withColumn("protected", F.coalesce(protected, F.col(text)))
        .withColumn(
            "tokens",
            F.coalesce(
                F.transform("hits", lambda h: h["replacement"]),
                F.array().cast("array<string>"),
            ),
        )
        .drop("_pieces", "hits")
    )


def agree(
    units: DataFrame,
    lexicon: DataFrame,
    inflections: dict[str, dict[str, dict[tuple[str | None, str], str]]],
    text: str = "text",
    unit_id: str = "unit_id",
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Adds ``agreed``: adjectives in the form their neighbour noun asks for.

    ``lexicon`` (lang, noun, gender, number) may be large and is joined; the
    ``inflections`` ``{lang: {adjective: {(gender or None, number): form}}}`` cover
    a handful of one-word adjectives and become expressions. A noun the lexicon does
    not know leaves the adjective alone. Only units that hold a pair are exploded.

    A text is its words and the gaps between them. A word beside an adjective, with
    nothing but space between, is its noun if it is made of noun letters and no
    article; of two pairs that share a word the first one counts.
    """
    if not inflections:
        return units.withColumn("agreed", F.col(text))
    by_lang = sorted(inflections.items())

    def per_language(expression: Callable[[str, list[str]], Column], otherwise: Column) -> Column:
        return tx.case(
            [(F.col("lang") == lang, expression(lang, sorted(a.lower() for a in table))) for lang, table in by_lang], otherwise
        )

    def noun_like(word: Column) -> Column:
        def test(lang: str, _: list[str]) -> Column:
            letters = word.rlike(f"^{fixed.NOUN_LETTERS.get(lang, fixed.NOUN_LETTERS_LATIN)}$")
            return letters & ~F.lower(word).isin(*fixed.NON_NOUNS.get(lang, ("",)))

        return per_language(test, F.lit(False))

    def adjective(word: Column) -> Column:
        return per_language(lambda _, table: F.lower(word).isin(*table), F.lit(False))

    pieces = F.col("_pieces")

    def pair_at(i: Column) -> Column:
        first, gap, second = (F.get(pieces, i + k) for k in range(3))
        beside = (adjective(first) & noun_like(second)) | (noun_like(first) & adjective(second))
        # most words are no adjectives, which is told without a pattern
        named = adjective(first) | adjective(second)
        return F.coalesce(named & gap.rlike(r"^(?U)\s+$") & beside, F.lit(False))

    # words and gaps alternate, so a pair is three pieces; one that starts on the last
    # word of the pair before is left out
    places = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), pair_at)
    apart = F.aggregate(
        places,
        F.array().cast("array<int>"),
        lambda kept, i: F.when(F.coalesce(F.try_element_at(kept, F.lit(-1)) + 2 >= i, F.lit(False)), kept).otherwise(
            F.concat(kept, F.array(i))
        ),
    )
    lowered = F.lower(F.col(text))
    some = per_language(
        lambda _, table: F.array_contains(F.transform(F.array(*map(F.lit, table)), lambda a: F.contains(lowered, a)), True),
        F.lit(False),
    )
    split = F.regexp_extract_all(F.col(text), F.lit(_WORDS_AND_GAPS), F.lit(1))
    holding = units.filter(some & F.col(text).isNotNull()).select(unit_id, "lang", split.alias("_pieces"))
    pairs = (
        holding.withColumn("_at", F.explode(apart))
        .select(unit_id, "lang", "_at", *[F.get(pieces, F.col("_at") + k).alias(f"_{n}") for k, n in ((0, "first"), (2, "second"))])
        .withColumn("adjective_first", adjective(F.col("_first")) & noun_like(F.col("_second")))
        .withColumn("adjective", F.when(F.col("adjective_first"), F.col("_first")).otherwise(F.col("_second")))
        .withColumn("noun", F.when(F.col("adjective_first"), F.col("_second")).otherwise(F.col("_first")))
        .withColumn("_noun", F.lower("noun"))
    )
    nouns = (
        lexicon.groupBy("lang", F.lower("noun").alias("_noun"))
        .agg(F.min(F.struct("gender", "number")).alias("_form"))
        .select("lang", "_noun", "_form.*")
    )
    known = skew.lookup(
        pairs, nouns, ["lang", "_noun"], "left", hot_rows, broadcast_rows=BROADCAST_TERMS
    )
    form = gl.follow_capital(F.col("adjective"), _form(inflections))
    noun = F.col("noun")
    pair = F.when(F.col("adjective_first"), F.concat_ws(" ", form, noun)).otherwise(F.concat_ws(" ", noun, form))
    per_unit = known.groupBy(unit_id).agg(
        F.sort_array(F.collect_list(F.struct("_at", pair.alias("_pair")))).alias("_pairs")
    )
    # what stands between the pairs, each with the pair that follows it

    def stretch(k: Column) -> Column:
        begin = F.coalesce(F.get("_pairs", k - 1)["_at"] + 3, F.lit(0))
        end = F.coalesce(F.get("_pairs", k)["_at"], F.size("_pieces"))
        between = F.array_join(F.slice("_pieces", begin + 1, end - begin), "")
        return F.concat(between, F.coalesce(F.get("_pairs", k)["_pair"], F.lit("")))

    written = F.array_join(F.transform(F.sequence(F.lit(0), F.size("_pairs")), stretch), "")
    return (
        units.join(per_unit, unit_id, "left")
        .withColumn("_pieces", F.when(F.col("_pairs").isNotNull(), split))
        .withColumn("agreed", F.when(F.col("_pairs").isNotNull(), written).otherwise(F.col(text)))
        .drop("_pairs", "_pieces")
    )


def _form(inflections) -> Column:
    """Inflected adjective; a form without a gender serves every gender."""
    adjective = F.lower("adjective")
    branches = []
    for lang, table in sorted(inflections.items()):
        for base, forms in sorted(table.items()):
            here = (F.col("lang") == lang) & (adjective == base.lower())
            # forms of one gender come before the form for every gender
            for (gender, number), form in sorted(
                forms.items(), key=lambda x: (x[0][0] is None, str(x[0]))
            ):
                fits = F.col("number") == number
                if gender is not None:
                    fits = fits & (F.col("gender") == gender)
                branches.append((here & fits, F.lit(form)))
    return tx.case(branches, adjective)
