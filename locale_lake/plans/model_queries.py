"""Glossary and batch inference over the shared tables."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locale_lake.functions import answers as an
from locale_lake.functions import classify as cl
from locale_lake.functions import glossary as gl
from locale_lake.functions import fixed
from locale_lake.functions import text as tx
from locale_lake.operators import glossary as go
from locale_lake.operators import inference as inf
from locale_lake.plans.registry import query, table

# Sample glossaries: words that occur in the documents of each language.
GLOSSARIES = {
    "en": {"the": "THE-T", "that": "that-t", "is on": "is-on-t", "with": "with-t", "on": "on-t"},
    "de": {"der": "der-t", "die": "die-t", "das": "das-t", "der die": "der-die-t", "ist": "ist-t"},
    "fr": {"le": "le-t", "la": "la-t", "des": "des-t", "qui": "qui-t"},
}


def _glossary_sql(text: str, function: str) -> str:
    """CASE over languages with one RE2 alternation each, longest term first.

    RE2's word boundary is ASCII; accented letters are replaced for matching.
    """
    cases = []
    for lang, terms in GLOSSARIES.items():
        ordered = sorted(terms, key=lambda t: (-len(t), t))
        cases.append(f"WHEN '{lang}' THEN " + function.format(
            text=text, pattern=r"(?i)\b(" + "|".join(ordered) + r")\b"))
    return " ".join(cases)


_PLAIN = "regexp_replace(text, '[À-ÖØ-öø-ÿßẞ]', 'z', 'g')"


@query(
    "glossary_hits",
    f"""WITH hits AS (
      SELECT lang, unnest(CASE lang {_glossary_sql(_PLAIN, "regexp_extract_all({text}, '{pattern}')")}
        ELSE [] END) AS hit FROM documents)
    SELECT lang, hit, count(*) AS n FROM hits GROUP BY 1, 2""",
)
def glossary_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = gl.by_language(
        F.col("lang"),
        GLOSSARIES,
        lambda terms: gl.hits(F.col("text"), terms),
        F.array().cast("array<string>"),
    )
    return (
        table(spark, folder, "documents", spread=True)
        .select("lang", F.explode(hits).alias("hit"))
        .groupBy("lang", "hit")
        .agg(F.count("*").alias("n"))
    )


@query(
    "glossary_join",
    f"""WITH hits AS (
      SELECT doc_id, unnest(CASE lang {_glossary_sql(_PLAIN, "regexp_extract_all({text}, '{pattern}')")}
        ELSE [] END) AS hit FROM documents)
    SELECT doc_id, lower(hit) AS hit, count(*) AS n FROM hits GROUP BY 1, 2""",
)
def glossary_join(spark: SparkSession, folder: str) -> DataFrame:
    """The same hits through the join that serves term tables of any size."""
    rows = [(lang, term, value) for lang, terms in GLOSSARIES.items() for term, value in terms.items()]
    glossary = spark.createDataFrame(rows, "lang string, term string, replacement string")
    hits = go.find_terms(table(spark, folder, "documents", spread=True), glossary, 2, "text", "doc_id")
    return (
        hits.select("doc_id", F.explode("hits").alias("h"))
        .groupBy("doc_id", F.lower("h.hit").alias("hit"))
        .agg(F.count("*").alias("n"))
    )



_ACCENTED = "àâáãçèéêëíîïñóôöùúûüÿœæäßÀÂÁÃÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜŸŒÆÄẞ"


def _encode_sql(text: str) -> str:
    """Accented letters as ASCII words, so that RE2 sees no boundary at them."""
    for i, letter in enumerate(_ACCENTED):
        text = f"replace({text}, '{letter}', 'zq{i:02d}qz')"
    return text


def _decode_sql(text: str) -> str:
    for i, letter in enumerate(_ACCENTED):
        text = f"replace({text}, 'zq{i:02d}qz', '{letter}')"
    return text


def _swap_sql(text: str, wrap: str) -> str:
    """Every term put between single spaces, as protect and restore leave it."""
    cases = []
    for lang, terms in GLOSSARIES.items():
        alternation = "|".join(sorted(terms, key=lambda t: (-len(t), t)))
        cases.append(
            rf"WHEN '{lang}' THEN regexp_replace({text}, '(?i){wrap}\b({alternation})\b{wrap}', ' \1 ', 'g')"
        )
    return f"CASE lang {' '.join(cases)} END"


_RESTORED_SQL = (
    r"regexp_replace(regexp_replace(regexp_replace("
    + _swap_sql("enc", r"\s*-?\s*")
    + r", ' {2,}', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\s+([.,!?;:])', '\1', 'g')"
)

# The same terms standing for themselves: protect and restore leave them in place.
_SELF = {lang: {t: t for t in terms} for lang, terms in GLOSSARIES.items()}


@query(
    "protect_restore",
    f"""WITH low AS (SELECT doc_id, lang, lower(text) AS text FROM documents),
    encoded AS (SELECT doc_id, lang, text, {_encode_sql("text")} AS enc FROM low)
    SELECT doc_id, CASE WHEN lang IN ('en', 'de', 'fr') THEN {_decode_sql(_RESTORED_SQL)} ELSE text END AS restored
    FROM encoded""",
)
def protect_restore(spark: SparkSession, folder: str) -> DataFrame:
    """Protect, an echo for a model, restore: terms stay, spacing is normalised."""
    text, lang, none = F.col("text"), F.col("lang"), F.array().cast("array<string>")
    staged = table(spark, folder, "documents", spread=True).select(
        "doc_id", "lang", F.lower("text").alias("text")
    )
    for name, function, otherwise in (
        ("tokens", lambda terms: gl.replacements(text, terms), none),
        ("echo", lambda terms: gl.protect(text, terms), text),
        ("restored", lambda terms: gl.restore(F.col("echo"), F.col("tokens")), text),
    ):
        staged = staged.withColumn(name, gl.by_language(lang, _SELF, function, otherwise))
    return staged.select("doc_id", "restored")


@query(
    "agreement_pairs",
    r"""
    WITH d AS (
        SELECT doc_id AS unit_id, lang, text,
               CASE lang WHEN 'de' THEN 'nicht' WHEN 'fr' THEN 'qui' END AS adj,
               CASE lang WHEN 'de' THEN 'nichter' WHEN 'fr' THEN 'quel' END AS masc,
               CASE lang WHEN 'de' THEN 'nichte' WHEN 'fr' THEN 'quelle' END AS fem,
               regexp_extract_all(text, '[\pL\pN\pM_]+|[^\pL\pN\pM_]+') AS p
        FROM documents
    ), e AS (
        SELECT unit_id, lang, text, adj, masc, fem, i, p[i] AS a, p[i + 2] AS b,
               regexp_full_match(p[i + 1], '\s+') AS near,
               lower(p[i]) = adj AS a_adj, lower(p[i + 2]) = adj AS b_adj,
               regexp_full_match(p[i], '[A-Za-zÀ-ÖØ-öø-ÿß]+') AND NOT list_contains(no, lower(p[i])) AS a_noun,
               regexp_full_match(p[i + 2], '[A-Za-zÀ-ÖØ-öø-ÿß]+') AND NOT list_contains(no, lower(p[i + 2])) AS b_noun
        FROM (SELECT *, unnest(range(1, len(p) - 1)) AS i,
                     CASE lang WHEN 'de' THEN string_split('der die das den dem des ein eine einer einem einen eines kein keine keiner keinem keinen keines', ' ')
                               ELSE string_split('le la les un une des du au aux ce cet cette ces', ' ') END AS no
              FROM d WHERE adj IS NOT NULL)
    ), c AS (
        SELECT *, (i - 2 * row_number() OVER (PARTITION BY unit_id ORDER BY i)) AS island
        FROM e WHERE near AND ((a_adj AND b_noun) OR (a_noun AND b_adj))
    ), k AS (
        SELECT *, a_adj AND b_noun AS ahead
        FROM c QUALIFY (row_number() OVER (PARTITION BY unit_id, island ORDER BY i)) % 2 = 1
    ), w AS (
        SELECT unit_id, i, CASE WHEN ahead THEN a ELSE b END AS x, CASE WHEN ahead THEN b ELSE a END AS noun,
               CASE WHEN lower(noun) LIKE '%e' THEN fem ELSE masc END AS bare,
               CASE WHEN x[1] <> lower(x[1]) THEN upper(bare[1]) || bare[2:] ELSE bare END AS form,
               CASE WHEN ahead THEN form || ' ' || noun ELSE noun || ' ' || form END AS pair
        FROM k
    ), m AS (
        SELECT unit_id, map(list(i ORDER BY i), list(pair ORDER BY i)) AS pairs FROM w GROUP BY unit_id
    )
    SELECT d.unit_id, d.lang,
           CASE WHEN pairs IS NULL THEN text ELSE array_to_string(list_transform(range(1, len(p) + 1), lambda i:
               coalesce(pairs[i], CASE WHEN pairs[i - 1] IS NULL AND pairs[i - 2] IS NULL THEN p[i] ELSE '' END)), '') END AS agreed
    FROM d LEFT JOIN m ON d.unit_id = m.unit_id
    """,
)
def agreement_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every German or French "word nicht/qui" pair, inflected by a lexicon that is
    built from the documents: words ending in -e are feminine, others masculine."""
    documents = table(spark, folder, "documents", spread=True).withColumnRenamed("doc_id", "unit_id")
    lexicon = (
        documents.filter(F.col("lang").isin("de", "fr"))
        .select("lang", F.explode(F.split(F.lower("text"), r"(?U)\W+")).alias("noun"))
        .filter("noun <> ''")
        .distinct()
        .select(
            "lang",
            "noun",
            F.when(F.col("noun").endswith("e"), "Fem").otherwise("Masc").alias("gender"),
            F.lit("Sing").alias("number"),
        )
    )
    forms = {
        "de": {"nicht": {("Masc", "Sing"): "nichter", ("Fem", "Sing"): "nichte"}},
        "fr": {"qui": {("Masc", "Sing"): "quel", ("Fem", "Sing"): "quelle"}},
    }
    return go.agree(documents, lexicon, forms).select("unit_id", "lang", "agreed")


def _swap_case(texts: list[str]) -> list[str]:
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pairs = str.maketrans(lower + upper, upper + lower)
    return [text.translate(pairs) for text in texts]


_SWAP_CASE_SQL = (
    "translate({0}, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz')"
)
_PIECE_SQL = (
    r"CASE WHEN length(regexp_replace(p, '^\s+|\s+$', '', 'g')) > 200 THEN "
    r"regexp_extract(p, '^\s*') || "
    + _SWAP_CASE_SQL.format(
        r"regexp_replace(regexp_replace(p, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1 ', 'g')"
    )
    + r" || regexp_extract(p, '\s*$') ELSE "
    + _SWAP_CASE_SQL.format("p")
    + " END"
)


@query(
    "draft_dedup",
    f"""WITH parts AS (
      SELECT page_id, string_split_regex(html, '<[^>]*>') AS parts, regexp_extract_all(html, '<[^>]*>') AS holders
      FROM pages)
    SELECT page_id AS unit_id, array_to_string(list_transform(
        list_zip(parts, list_append(holders, '')),
        lambda z: (SELECT {_PIECE_SQL} FROM (SELECT z[1] AS p)) || z[2]), '') AS draft_text
    FROM parts""".replace(
        "lambda z: (SELECT " + _PIECE_SQL + " FROM (SELECT z[1] AS p)) || z[2]",
        "lambda z: " + _PIECE_SQL.replace("(p,", "(z[1],").replace("(p ", "(z[1] ")
        + " || z[2]",
    ),
)
def draft_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Markup stays, each distinct piece of text goes through the model once."""
    units = table(spark, folder, "pages", spread=True).select(
        F.col("page_id").alias("unit_id"), F.col("html").alias("source_text")
    )
    return inf.draft(units, _swap_case, "xx", profile="html", delays=()).select(
        "unit_id", "draft_text"
    )


def _cut_when_protected(texts: list[str]) -> list[str]:
    """A model for long texts: it loses the tail of those with stand-ins."""
    return [
        " ".join(text.split()[:2]) if fixed.TERM_TOKEN in text else said
        for text, said in zip(texts, _slip(texts), strict=True)
    ]


def _slip(texts: list[str]) -> list[str]:
    """A model that slips into another script where it meets a comma."""
    return [text + "~" + ("漢" if "," in text else "") for text in texts]


_WORDS_SQL = r"len(string_split_regex(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+'))"


@query(
    "guards",
    "WITH "
    + r"""pieces AS (
      SELECT DISTINCT unnest(CASE WHEN length(s) > 200
        THEN list_filter(string_split(regexp_replace(s, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')
        ELSE [s] END) AS text
      FROM (SELECT regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM conversations)),"""
    + f"""encoded AS (SELECT text, 'en' AS lang, {_encode_sql("text")} AS enc FROM pieces),
    protected AS (SELECT *, {_swap_sql("enc", "")} AS prot FROM encoded)
    SELECT text AS piece, CASE
      WHEN prot = enc THEN text || '~' || CASE WHEN contains(text, ',') THEN '漢' ELSE '' END
      WHEN {_WORDS_SQL.format("prot")} >= 8 THEN text || '~' || CASE WHEN contains(text, ',') THEN '漢' ELSE '' END
      ELSE {_decode_sql(_RESTORED_SQL)} || CASE WHEN regexp_matches(text, '(?i)\\b(the|that|with|on)$') THEN ' ' ELSE '' END
        || '~' || CASE WHEN contains(text, ',') THEN '漢' ELSE '' END END AS translated
    FROM protected""",
)
def guards(spark: SparkSession, folder: str) -> DataFrame:
    """Both guards around models that cut and slip; one row per distinct piece.

    Long is a piece of eight words with its terms set apart. A stand-in is one word,
    whatever its term has, so length is told before terms are shielded.
    """
    pieces = table(spark, folder, "conversations", spread=True).select(
        F.explode(tx.sentences(F.col("text"))).alias("piece")
    )
    terms = _SELF["en"]
    is_long = tx.words(F.regexp_replace("piece", gl.term_pattern(terms), " $1 ")) >= 8
    long = inf.translate_pieces(pieces.filter(is_long), _cut_when_protected, "ru", terms, ())
    short = inf.translate_pieces(pieces.filter(~is_long), _slip, "ru", terms, ())
    return long.unionByName(short).select("piece", "translated")


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations", spread=True).select(
        F.col("role").alias("pkg_id"),
        F.concat_ws(".", "conv_id", "turn").alias("key"),
        "conv_id",
        "turn",
        F.floor(F.col("conv_id") / 1024).alias("conv_bucket"),
        F.col("text").alias("source_text"),
        F.concat(F.lit("tr:"), "text").alias("draft_text"),
    )


def _requests(spark: SparkSession, folder: str, size: int) -> DataFrame:
    return inf.make_requests(
        _turns(spark, folder),
        size,
        ["pkg_id"],
        ["conv_bucket", "conv_id"],
        ["turn"],
        ["pkg_id", "key", "source_text", "draft_text"],
    )


_REQUESTS_SQL = r"""
numbered AS (
  SELECT role, conv_id, turn, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM conversations),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS pos FROM numbered WHERE s <> ''),
kept AS (
  SELECT *, pos // {size} AS batch FROM placed
  WHERE NOT (length(s) <= 12 AND len(regexp_extract_all(s, '[\p{{L}}\p{{N}}_]+')) <= 1)),
items AS (
  SELECT *, row_number() OVER (PARTITION BY role, batch ORDER BY pos) AS k FROM kept)
"""


@query(
    "request_batches",
    "WITH "
    + _REQUESTS_SQL.format(size=12)
    + "SELECT role AS pkg_id, batch, k, conv_id || '.' || turn AS key FROM items",
)
def request_batches(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _requests(spark, folder, 12)
        .select("pkg_id", "batch", F.posexplode("items").alias("i", "item"))
        .select("pkg_id", "batch", (F.col("i") + 1).cast("bigint").alias("k"), "item.key")
    )


def _prompt_sql(mode: str, size: int, tokens: str) -> str:
    return (
        f"SELECT * FROM (WITH {_REQUESTS_SQL.format(size=size)} "
        f"""SELECT '{mode}' AS mode, role AS pkg_id, batch, count(*) AS n_items,
      CAST(greatest(200, {tokens}) AS BIGINT) AS answer_tokens,
      CAST(least(480, 120 * greatest(1, count(*) // 2)) AS BIGINT) AS timeout_seconds,
      string_agg(k || '. package: ' || role || ' | key: ' || conv_id || '.' || turn || ' | source: ' || text
        || ' | draft: tr:' || text, chr(10) ORDER BY k) AS prompt
    FROM items GROUP BY role, batch)"""
    )


@query(
    "prompt_budget",
    _prompt_sql("rewrite", 12, "60 * count(*)")
    + " UNION ALL "
    + _prompt_sql("check", 20, "60 * count(*) // 2"),
)
def prompt_budget(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        inf.render_requests(_requests(spark, folder, size), mode).select(
            F.lit(mode).alias("mode"),
            "pkg_id",
            "batch",
            "n_items",
            "answer_tokens",
            "timeout_seconds",
            "prompt",
        )
        for mode, size in ((inf.REWRITE, 12), (inf.CHECK, 20))
    ]
    return parts[0].unionAll(parts[1])


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    """Answers with tags or without, several lines, gaps, repeats and blanks."""
    number = (F.col("turn") + 1).cast("string")
    beyond = (F.col("turn") + 2).cast("string")
    body = F.concat(
        number, F.lit(': "'), "text", F.lit('"\n '), beyond, F.lit(" : beyond\n1:  \n"),
        F.when(F.col("role") == "user", F.concat(number, F.lit(": again "), "role")).otherwise(""),
    )
    return table(spark, folder, "conversations", spread=True).select(
        "conv_id",
        "turn",
        (F.col("turn") + 1).alias("count"),
        F.when(F.col("role") == "system", body)
        .otherwise(F.concat(F.lit("Well: <ANS>"), body, F.lit("</ans> 1: no")))
        .alias("raw"),
    )


_RESPONSES_SQL = r"""
responses AS (
  SELECT conv_id, turn, turn + 1 AS cnt, role,
    (turn + 1) || ': "' || text || '"' || chr(10) || ' ' || (turn + 2) || ' : beyond' || chr(10) || '1:  ' || chr(10)
      || CASE WHEN role = 'user' THEN (turn + 1) || ': again ' || role ELSE '' END AS body
  FROM conversations),
lines AS (
  SELECT conv_id, turn, cnt, unnest(string_split(body, chr(10))) AS line,
    generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM responses),
numbered AS (
  SELECT conv_id, turn, cnt, pos, TRY_CAST(regexp_extract(line, '^\s*(\d+)\s*:', 1) AS BIGINT) AS n,
    regexp_replace(regexp_replace(regexp_extract(line, '^\s*\d+\s*:\s*(.*)$', 1), '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g') AS text
  FROM lines WHERE regexp_matches(line, '^\s*\d+\s*:'))
"""


def _answers(spark: SparkSession, folder: str, read) -> DataFrame:
    return _responses(spark, folder).select(
        "conv_id", "turn", F.explode(read(F.col("raw"), F.col("count"))).alias("n", "answer")
    )


@query(
    "parse_rewrite",
    "WITH "
    + _RESPONSES_SQL
    + """SELECT conv_id, turn, n, arg_max(text, pos) AS answer FROM numbered
    WHERE n BETWEEN 1 AND cnt GROUP BY 1, 2, 3""",
)
def parse_rewrite(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder, an.rewrite_answers)


@query(
    "parse_check",
    "WITH "
    + _RESPONSES_SQL
    + """SELECT conv_id, turn, n, arg_max(text, pos) AS answer FROM numbered
    WHERE n BETWEEN 1 AND cnt AND text <> '' GROUP BY 1, 2, 3""",
)
def parse_check(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder, an.check_answers)


@query(
    "parse_single",
    r"""SELECT conv_id, turn, CASE WHEN role = 'system'
        THEN regexp_replace(list_extract(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '\S')), -1),
          '^\s+|\s+$', '', 'g')
        ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS answer FROM conversations""",
)
def parse_single(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.when(F.col("role") == "system", F.concat("text", F.lit("\n \n"))).otherwise(
        F.concat(F.lit("so <ans> "), "text", F.lit(" </ans> done"))
    )
    return table(spark, folder, "conversations", spread=True).select(
        "conv_id", "turn", an.single_answer(raw).alias("answer")
    )


@query(
    "answer_guard",
    """SELECT conv_id, turn, role <> 'user' AND text <> '' AS polished,
      CASE WHEN role = 'user' THEN 'draft' ELSE text || ' {' || turn || '} [x]' END AS final_text
    FROM conversations""",
)
def answer_guard(spark: SparkSession, folder: str) -> DataFrame:
    """User turns lose a placeholder in the answer, so their draft stays."""
    holder = F.concat(F.lit(" {"), F.col("turn").cast("string"), F.lit("}"))
    items = table(spark, folder, "conversations", spread=True).select(
        "conv_id",
        "turn",
        F.concat("text", holder).alias("source_text"),
        F.lit("draft").alias("draft_text"),
        F.concat(
            "text", F.when(F.col("role") == "user", "").otherwise(holder), F.lit(" [x]")
        ).alias("answer"),
    )
    return inf.apply_answers(items).select("conv_id", "turn", "polished", "final_text")


@query(
    "truncation_flags",
    """WITH d AS (SELECT doc_id, text, len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) AS n,
        regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' AS blank FROM documents),
    l AS (SELECT d.*, string_split(text, chr(10))[1] AS head FROM d)
    SELECT doc_id, NOT blank AND n >= 4 AND
      (CASE WHEN regexp_replace(head, '^\\s+|\\s+$', '', 'g') = '' THEN 0
       ELSE len(string_split_regex(regexp_replace(head, '^\\s+|\\s+$', '', 'g'), '\\s+')) END) < n * 0.7::DOUBLE AS truncated
    FROM l""",
)
def truncation_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Would the first line of a document pass as a whole translation of it?"""
    head = F.substring_index("text", "\n", 1)
    return table(spark, folder, "documents", spread=True).select(
        "doc_id", cl.is_truncated(F.col("text"), head).alias("truncated")
    )


def _fails_on_bars(requests: list[dict]) -> list[str]:
    """A model that fails as soon as one of its requests holds a bar."""
    if any("|" in r["prompt"] for r in requests):
        raise TimeoutError("no answer in time")
    return [r["prompt"].lower() for r in requests]


@query(
    "call_fallback",
    "SELECT doc_id, CASE WHEN contains(text, '|') THEN text ELSE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz') END AS final_text, CASE WHEN contains(text, '|') THEN 'TimeoutError: no answer in time' END "
    "AS call_error FROM (SELECT doc_id, translate(text, 'ÄÖÜÀÂÇÉÈÊËÎÏÔÙÛŒÁÍÓÚÑẞ', 'äöüàâçéèêëîïôùûœáíóúñß') AS text FROM documents)",
)
def call_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that fail keep their draft, and take no other request with them."""
    accents = ("ÄÖÜÀÂÇÉÈÊËÎÏÔÙÛŒÁÍÓÚÑẞ", "äöüàâçéèêëîïôùûœáíóúñß")
    requests = table(spark, folder, "documents", spread=True).select(
        "doc_id",
        F.translate("text", *accents).alias("prompt"),
        F.lit(1).alias("n_items"),
        F.lit(200).alias("answer_tokens"),
        F.lit(120).alias("timeout_seconds"),
    )
    called = inf.call_requests(requests, _fails_on_bars)
    return called.select("doc_id", F.coalesce("raw", "prompt").alias("final_text"), "call_error")


def _fails_on_marks(texts: list[str]) -> list[str]:
    if any("&&&" in t for t in texts):
        raise ValueError("cannot read this")
    return [t + "." for t in texts]


@query(
    "retry_rows",
    "SELECT doc_id, CASE WHEN NOT contains(text, '&&&') THEN text || '.' END AS answer, "
    "CASE WHEN contains(text, '&&&') THEN 'ValueError: cannot read this' END AS answer_error FROM documents",
)
def retry_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A fault of the model costs the texts at fault their answer and no other."""
    texts = table(spark, folder, "documents", spread=True).select("doc_id", "text")
    return inf.translate_column(texts, "text", "answer", _fails_on_marks, delays=()).drop("text")


def _reports_company(active: list) -> inf.CallFn:
    """A model that takes its time and says how many calls were under way meanwhile."""

    def model(requests: list[dict]) -> list[str]:
        active.append(1)
        time.sleep(0.03)
        company = len(active)
        active.pop()
        if any("?" in r["prompt"] for r in requests):
            raise ValueError("no questions")
        return [f"{company} {r['n_items']}" for r in requests]

    return model


@query(
    "call_overlap",
    "WITH "
    + _REQUESTS_SQL.format(size=40)
    + """, requests AS (SELECT role, batch, count(*) AS n, bool_or(contains(text, '?')) AS asks FROM items GROUP BY 1, 2)
    SELECT role AS pkg_id, batch, CASE WHEN NOT asks THEN n END AS answered,
      CASE WHEN asks THEN 'ValueError: no questions' END AS call_error, true AS together FROM requests""",
)
def call_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Up to four calls of a task at once; each answer stays with its request, a fault costs one."""
    requests = inf.render_requests(_requests(spark, folder, 40)).select(
        "pkg_id", "batch", "prompt", "n_items", "answer_tokens", "timeout_seconds"
    )
    # few tasks, so that each has several requests
    called = inf.call_requests(requests.repartition(2, "pkg_id", "batch"), _reports_company([]), parallel=4)
    told = F.split("raw", " ")
    most = called.agg((F.max(told[0].cast("int")) > 1).alias("together"))
    return called.select("pkg_id", "batch", told[1].cast("bigint").alias("answered"), "call_error").crossJoin(
        F.broadcast(most)  # one row
    )
