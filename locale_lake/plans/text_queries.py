"""Text functions and classification over the shared tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locale_lake.functions import classify as cl
from locale_lake.functions import fixed
from locale_lake.functions import text as tx
from locale_lake.plans.registry import query, table
from locale_lake.plans.reuse_queries import SENTENCES_SQL

# (table, column used as value, tag it stands under)
_VALUES = (
    ("part", "p_name", "label"),
    ("part", "p_brand", "brand"),
    ("part", "p_type", "description"),
    ("part", "p_size", "size"),
    ("pages", "url", "link"),
    ("events", "props", "props"),
    ("events", "event_type", "styles"),
    ("customer", "c_name", "customerName"),
    ("customer", "c_mktsegment", "slotTypeID"),
    ("nation", "n_name", "nation"),
    ("orders", "o_orderpriority", "priority"),
    ("documents", "text", "text"),
    ("conversations", "text", "rulesStrings"),
)


def _tagged_values(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        table(spark, folder, name, spread=name in ("documents", "conversations")).select(
            F.lit(tag).alias("tag"), F.col(column).cast("string").alias("value")
        )
        for name, column, tag in _VALUES
    ]
    return reduce(DataFrame.unionAll, parts)


_TAGGED_SQL = "tagged AS (" + " UNION ALL ".join(
    f"SELECT '{tag}' AS tag, CAST({column} AS VARCHAR) AS value FROM {name}"
    for name, column, tag in _VALUES
) + ")"


def _sql_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_DENIED_SQL = (
    f"(lower(tag) IN ({_sql_list(fixed.DENIED_TAGS)}) "
    "OR regexp_matches(tag, '(TypeID|SlotID|DefName)$'))"
)

_REASON_SQL = rf"""
CASE WHEN {_DENIED_SQL} THEN 'denied_tag'
  WHEN value IS NULL OR s = '' THEN 'blank'
  WHEN regexp_matches(s, '^-?\d+(\.\d+)?%?$') THEN 'number'
  WHEN lower(s) IN ('true', 'false') THEN 'boolean'
  WHEN NOT regexp_matches(s, '\p{{L}}') THEN 'no_letter'
  WHEN contains(s, '_') AND NOT contains(s, ' ') THEN 'underscore_word'
  WHEN regexp_matches(s, '^[\p{{L}}\p{{N}}_/\\.-]+$') AND regexp_matches(s, '[/\\]') THEN 'path'
  WHEN regexp_matches(s, '^#[0-9A-Fa-f]{{3,8}}$') THEN 'hex_colour'
  WHEN regexp_matches(s, '^[A-Za-z][A-Za-z0-9_]*(\.[A-Za-z][A-Za-z0-9_]*)+$') THEN 'dotted_identifier'
  WHEN contains(s, ' ') THEN 'text'
  WHEN regexp_matches(s, '^[A-Z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*$') THEN 'humped_identifier'
  ELSE 'text' END
"""

_STRIPPED_SQL = (
    r"stripped AS (SELECT tag, value, regexp_replace(value, '^\s+|\s+$', '', 'g') AS s FROM tagged)"
)


@query(
    "classify_reasons",
    f"""WITH {_TAGGED_SQL}, {_STRIPPED_SQL}
    SELECT tag, {_REASON_SQL} AS reason, count(*) AS n FROM stripped GROUP BY 1, 2""",
)
def classify_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _tagged_values(spark, folder)
        .groupBy("tag", cl.classify(F.col("tag"), F.col("value")).alias("reason"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "classify_words",
    r"""WITH words AS (
      SELECT 'word' AS tag, unnest(string_split_regex(text, '[ \n]+')) AS value FROM documents
      UNION ALL SELECT 'piece', unnest(string_split_regex(html, '[<>"]')) FROM pages),
    stripped AS (SELECT tag, value, regexp_replace(value, '^\s+|\s+$', '', 'g') AS s FROM words)
    SELECT tag, """
    + _REASON_SQL
    + " AS reason, count(*) AS n FROM stripped GROUP BY 1, 2",
)
def classify_words(spark: SparkSession, folder: str) -> DataFrame:
    """The same rules on every word of the documents and every piece of the pages."""
    words = table(spark, folder, "documents", spread=True).select(
        F.lit("word").alias("tag"), F.explode(F.split("text", r"[ \n]+", -1)).alias("value")
    )
    pieces = table(spark, folder, "pages", spread=True).select(
        F.lit("piece").alias("tag"), F.explode(F.split("html", '[<>"]', -1)).alias("value")
    )
    return (
        words.unionAll(pieces)
        .groupBy("tag", cl.classify(F.col("tag"), F.col("value")).alias("reason"))
        .agg(F.count("*").alias("n"))
    )


# fixed values: the denied names, written out for the SQL
_DENIED_NAMES_SQL = """
    'defname', 'class', 'parentname', 'workertype', 'compclass', 'thingclass', 'texpath',
    'graphicclass', 'shaderclass', 'soundtype', 'drawertype', 'researchviewx', 'researchviewy',
    'packageid', 'identifier', 'hediff', 'def', 'recipeuser', 'thingdef', 'damagedef', 'statdef',
    'verbclass', 'jobdef', 'workgiverdef', 'traitdef', 'genedef', 'driverclass', 'jobclass',
    'workgiverclass', 'mentalstateclass', 'incidentclass', 'gizmoclass', 'interactionclass', 'storeas',
    'tile', 'faction', 'sitepartdefs', 'worldobject', 'worldobjects', 'insignal', 'outsignal',
    'delayticks', 'value1', 'value2', 'storesitepartsparamsas', 'sitepartsparams', 'stuffcategories',
    'thingcategories', 'associatedmemes', 'conflictingmemes', 'styles', 'altitudelayer', 'impact',
    'installablesegmenttypes', 'installablemoduleslottypes', 'installablemoduletypes',
    'installablesegmentslottypes'
"""
_OTHER_TAGS = ("label", "slottypeid", "description", "defnames", "installedcomps", "path_to", "jobstring")


@query(
    "deny_tags",
    f"""WITH names AS (SELECT [{_DENIED_NAMES_SQL}] AS denied),
    tags AS (
      SELECT CASE p_type WHEN 'SMALL' THEN 'slotDefName' WHEN 'ECONOMY' THEN upper(w) WHEN 'LARGE' THEN w || 'TypeID'
        ELSE w END AS tag, denied
      FROM (SELECT p_type, denied, list_concat(denied, ['label', 'slottypeid', 'description', 'defnames',
              'installedcomps', 'path_to', 'jobstring'])[1 + p_partkey % (len(denied) + 7)] AS w FROM part, names))
    SELECT tag, list_contains(denied, lower(tag)) OR regexp_matches(tag, '(TypeID|SlotID|DefName)$') AS denied, count(*) AS n
    FROM tags GROUP BY ALL""",
)
def deny_tags(spark: SparkSession, folder: str) -> DataFrame:
    """Every denied name as it stands, in capitals and with an ending, and tags that must pass."""
    every = (*fixed.DENIED_TAGS, *_OTHER_TAGS)
    word = F.get(F.array(*map(F.lit, every)), F.col("p_partkey") % len(every))
    tag = (
        F.when(F.col("p_type") == "SMALL", "slotDefName")
        .when(F.col("p_type") == "ECONOMY", F.upper(word))
        .when(F.col("p_type") == "LARGE", F.concat(word, F.lit("TypeID")))
        .otherwise(word)
    )
    return (
        table(spark, folder, "part")
        .select(tag.alias("tag"))
        .groupBy("tag", cl.is_denied(F.col("tag")).alias("denied"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "rule_strings",
    r"""WITH rules AS (
      SELECT event_id, event_type || '(' || props || ') -> ' || event_type || ' done' AS value FROM events
      UNION ALL SELECT conv_id * 1000 + turn, text FROM conversations)
    SELECT regexp_matches(value, '(?s)^([\p{L}\p{N}_.\[\]]+(?:\([^)]*\))?\s*)->(.*)$') AS is_rule,
      count(*) AS n,
      CAST(sum(length(regexp_extract(value, '(?s)^([\p{L}\p{N}_.\[\]]+(?:\([^)]*\))?\s*)->(.*)$', 1))) AS BIGINT) AS key_chars,
      CAST(sum(length(regexp_extract(value, '(?s)^([\p{L}\p{N}_.\[\]]+(?:\([^)]*\))?\s*)->(.*)$', 2))) AS BIGINT) AS text_chars
    FROM rules GROUP BY 1""",
)
def rule_strings(spark: SparkSession, folder: str) -> DataFrame:
    rules = (
        table(spark, folder, "events")
        .select(
            F.concat(
                "event_type", F.lit("("), "props", F.lit(") -> "), "event_type", F.lit(" done")
            ).alias("value")
        )
        .unionAll(table(spark, folder, "conversations", spread=True).select(F.col("text").alias("value")))
    )
    parts = tx.rule_parts(F.col("value"))
    return (
        rules.select(
            tx.is_rule_string(F.lit("rulesStrings"), F.col("value")).alias("is_rule"),
            parts.alias("parts"),
        )
        .groupBy("is_rule")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.length("parts.rule_key").cast("bigint")).alias("key_chars"),
            F.sum(F.length("parts.rule_text").cast("bigint")).alias("text_chars"),
        )
    )


@query(
    "trivial_strings",
    r"""WITH items AS (
      SELECT 'part' AS kind, p_name AS value FROM part
      UNION ALL SELECT 'part_word', unnest(string_split(p_name, ' ')) FROM part
      UNION ALL SELECT 'nation', n_name FROM nation
      UNION ALL SELECT 'document', text FROM documents
      UNION ALL SELECT 'word', unnest(string_split_regex(text, '[ \n]+')) FROM documents)
    SELECT kind, s <> '' AND length(s) <= 12
        AND len(regexp_extract_all(s, '[\p{L}\p{N}_]+')) <= 1 AS trivial, count(*) AS n
    FROM (SELECT kind, regexp_replace(value, '^\s+|\s+$', '', 'g') AS s FROM items) GROUP BY 1, 2""",
)
def trivial_strings(spark: SparkSession, folder: str) -> DataFrame:
    part, documents = table(spark, folder, "part"), table(spark, folder, "documents", spread=True)

    def items(df: DataFrame, kind: str, value) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), value.alias("value"))

    values = reduce(
        DataFrame.unionAll,
        [
            items(part, "part", F.col("p_name")),
            items(part, "part_word", F.explode(F.split("p_name", " ", -1))),
            items(table(spark, folder, "nation"), "nation", F.col("n_name")),
            items(documents, "document", F.col("text")),
            items(documents, "word", F.explode(F.split("text", r"[ \n]+", -1))),
        ],
    )
    return values.groupBy("kind", cl.is_trivial(F.col("value")).alias("trivial")).agg(
        F.count("*").alias("n")
    )


@query(
    "placeholder_extract",
    """WITH found AS (SELECT unnest(regexp_extract_all(html, '<[^>]*>')) AS placeholder FROM pages)
    SELECT placeholder, count(*) AS n FROM found GROUP BY 1""",
)
def placeholder_extract(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "pages", spread=True)
        .select(F.explode(tx.placeholders(F.col("html"), "html")).alias("placeholder"))
        .groupBy("placeholder")
        .agg(F.count("*").alias("n"))
    )


@query(
    "placeholder_counts",
    """SELECT page_id, len(regexp_extract_all(html, '<[^>]*>')) AS n,
      list_aggregate(regexp_extract_all(html, '<[^>]*>'), 'string_agg', '') AS joined FROM pages""",
)
def placeholder_counts(spark: SparkSession, folder: str) -> DataFrame:
    found = tx.placeholders(F.col("html"), "html")
    return table(spark, folder, "pages", spread=True).select(
        "page_id",
        F.size(found).cast("bigint").alias("n"),
        F.array_join(found, "").alias("joined"),
    )


@query(
    "placeholder_braces",
    r"""WITH marked AS (
      SELECT doc_id, lang || '_rule(x=1) -> {' || doc_id || '} ' || text || ' [tok_' || lang || ']\n<color=#33d733>'
        || source || '</color>' AS text FROM documents)
    SELECT doc_id, regexp_extract_all(text,
      '\{[\p{L}\p{N}_]+\}|\[[\p{L}\p{N}_]+\]|</?color(?:=[^>]*)?>|\\n|\\r|^[\p{L}\p{N}_.\[\]]+(?:\([^)]*\))?\s*->')
      AS placeholders
    FROM marked""",
)
def placeholder_braces(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", spread=True)
    marked = F.concat(
        "lang",
        F.lit("_rule(x=1) -> {"),
        F.col("doc_id").cast("string"),
        F.lit("} "),
        "text",
        F.lit(" [tok_"),
        "lang",
        F.lit(r"]\n<color=#33d733>"),
        "source",
        F.lit("</color>"),
    )
    return documents.select("doc_id", tx.placeholders(marked).alias("placeholders"))


@query(
    "placeholder_guard",
    r"""WITH answers AS (
      SELECT page_id, 'lost' AS kind, html, replace(html, '</b>', '') AS answer FROM pages
      UNION ALL SELECT page_id, 'extra', html, html || '<b>' FROM pages
      UNION ALL SELECT page_id, 'shout', html, upper(html) FROM pages),
    found AS (
      SELECT page_id, kind, 'need' AS side, unnest(regexp_extract_all(html, '<[^>]*>')) AS p FROM answers
      UNION ALL
      SELECT page_id, kind, 'got', unnest(regexp_extract_all(answer, '<[^>]*>')) FROM answers),
    per AS (
      SELECT page_id, kind, p, count(*) FILTER (side = 'need') AS need, count(*) FILTER (side = 'got') AS got
      FROM found GROUP BY 1, 2, 3)
    SELECT a.page_id, a.kind, coalesce(bool_and(got >= need), true) AS kept
    FROM answers a LEFT JOIN per USING (page_id, kind) GROUP BY 1, 2""",
)
def placeholder_guard(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages", spread=True)
    html = F.col("html")
    answers = (
        ("lost", F.replace(html, F.lit("</b>"), F.lit(""))),
        ("extra", F.concat(html, F.lit("<b>"))),
        ("shout", F.upper(html)),
    )
    return reduce(
        DataFrame.unionAll,
        [
            pages.select(
                "page_id",
                F.lit(kind).alias("kind"),
                tx.placeholders_kept(html, answer, "html").alias("kept"),
            )
            for kind, answer in answers
        ],
    )


@query(
    "segments",
    """WITH split AS (SELECT page_id, string_split_regex(html, '<[^>]*>') AS parts FROM pages)
    SELECT page_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS segment FROM split""",
)
def segments(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "pages", spread=True)
        .select("page_id", F.posexplode(tx.segments(F.col("html"), "html")).alias("pos", "segment"))
        .withColumn("pos", F.col("pos").cast("bigint"))
    )


@query(
    "rebuild_identity",
    """SELECT page_id, html AS rebuilt FROM pages""",
)
def rebuild_identity(spark: SparkSession, folder: str) -> DataFrame:
    html = F.col("html")
    return table(spark, folder, "pages", spread=True).select(
        "page_id",
        tx.rebuild(tx.segments(html, "html"), tx.placeholders(html, "html")).alias("rebuilt"),
    )


@query(
    "edges",
    r"""WITH split AS (SELECT unnest(string_split_regex(html, '<[^>]*>')) AS part FROM pages)
    SELECT regexp_extract(part, '^\s*') AS lead,
      CASE WHEN regexp_matches(part, '\S') THEN regexp_extract(part, '\s*$') ELSE '' END AS trail,
      count(*) AS n FROM split GROUP BY 1, 2""",
)
def edges(spark: SparkSession, folder: str) -> DataFrame:
    part = F.col("part")
    return (
        table(spark, folder, "pages", spread=True)
        .select(F.explode(tx.segments(F.col("html"), "html")).alias("part"))
        .groupBy(tx.lead_space(part).alias("lead"), tx.trail_space(part).alias("trail"))
        .agg(F.count("*").alias("n"))
    )


@query(
    "sentences",
    "WITH "
    + SENTENCES_SQL
    + """SELECT doc_id, generate_subscripts(sentences, 1) - 1 AS pos, unnest(sentences) AS sentence
    FROM pieces""",
)
def sentences(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "documents", spread=True)
        .select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
        .withColumn("pos", F.col("pos").cast("bigint"))
    )


@query(
    "long_only_split",
    "WITH "
    + SENTENCES_SQL
    + """SELECT doc_id, len(sentences) AS n, array_to_string(sentences, ' ') AS joined FROM pieces""",
)
def long_only_split(spark: SparkSession, folder: str) -> DataFrame:
    pieces = tx.sentences(F.col("text"))
    return table(spark, folder, "documents", spread=True).select(
        "doc_id",
        F.size(pieces).cast("bigint").alias("n"),
        tx.join_sentences(pieces).alias("joined"),
    )


@query(
    "xml_escape",
    """SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped
    FROM pages""",
)
def xml_escape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages", spread=True).select(
        "page_id", tx.xml_escape(F.col("html")).alias("escaped")
    )


@query(
    "comment_sanitise",
    r"""WITH raw AS (SELECT page_id, replace(html, '<', '--') || '---' AS t FROM pages),
    spaced AS (SELECT page_id, replace(replace(t, '--', '- -'), '--', '- -') AS t FROM raw)
    SELECT page_id, CASE WHEN t LIKE '%-' THEN t || ' ' ELSE t END AS comment FROM spaced""",
)
def comment_sanitise(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.replace("html", F.lit("<"), F.lit("--")), F.lit("---"))
    return table(spark, folder, "pages", spread=True).select(
        "page_id", tx.xml_comment(raw).alias("comment")
    )


@query(
    "language_folders",
    """SELECT lang, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French'
       WHEN 'es' THEN 'Spanish' END AS folder, count(*) AS n FROM documents GROUP BY 1, 2
    UNION ALL
    SELECT event_type, upper(event_type[1]) || event_type[2:], count(*) FROM events GROUP BY 1, 2""",
)
def language_folders(spark: SparkSession, folder: str) -> DataFrame:
    codes = table(spark, folder, "documents", spread=True).select("lang").unionAll(
        table(spark, folder, "events").select("event_type")
    )
    return codes.groupBy("lang", tx.language_folder(F.col("lang")).alias("folder")).agg(
        F.count("*").alias("n")
    )


@query(
    "line_lists",
    r"""WITH lines AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
    kept AS (
      SELECT *, NOT regexp_matches(text, '\S') OR regexp_matches(text, '^\s*//') AS is_comment FROM lines)
    SELECT 'Strings/' || doc_id || ':' || line_no AS key, text, is_comment FROM kept
    WHERE NOT is_comment
    UNION ALL
    SELECT '', text, is_comment FROM kept k
    WHERE is_comment AND EXISTS (SELECT 1 FROM kept o WHERE o.doc_id = k.doc_id AND NOT o.is_comment)""",
)
def line_lists(spark: SparkSession, folder: str) -> DataFrame:
    from locale_lake.sources.lists import split_lines

    files = table(spark, folder, "documents", spread=True).select(
        F.col("doc_id").alias("file_id"),
        F.concat(F.lit("Strings/"), F.col("doc_id").cast("string")).alias("prefix"),
        F.col("text").alias("content"),
    )
    return split_lines(files, ["file_id"]).select("key", "text", "is_comment")


@query(
    "kv_state",
    """SELECT event_id, unnest(json_keys(props)) AS key,
      unnest(list_transform(json_keys(props), lambda k: json_extract_string(props, k))) AS text FROM events""",
)
def kv_state(spark: SparkSession, folder: str) -> DataFrame:
    from locale_lake.sources.state import explode_json_map

    return explode_json_map(
        table(spark, folder, "events").select("event_id", "props"), "props"
    ).select("event_id", "key", "text")
