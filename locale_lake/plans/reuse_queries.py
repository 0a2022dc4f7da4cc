"""Reuse, edits, memory and layer merging over the shared tables.

The earlier state of a run is derived from ``labels``: a labelled document was
translated before, a low-quality one has changed since, a toxic one has no result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locale_lake import session
from locale_lake.functions import text as tx
from locale_lake.operators import layers, reuse, skew
from locale_lake.plans.registry import query, table
from locale_lake.sources.state import commit_run, read_state

KEY = ["pkg_id", "key"]


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("source").alias("pkg_id"),
        F.col("doc_id").alias("key"),
        "lang",
        F.col("text").alias("source_text"),
    )


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "key")
    return _documents(spark, folder).join(labels, "key")


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    earlier = _labelled(spark, folder)
    old_source = earlier.select(
        *KEY,
        F.when(F.col("quality") == 0, F.concat("source_text", F.lit("!")))
        .otherwise(F.col("source_text"))
        .alias("text"),
    )
    old_target = earlier.filter("toxic = 0").select(
        *KEY, F.concat(F.lit("tr:"), "source_text").alias("text")
    )
    edits = earlier.filter("toxic = 1").select(
        *KEY, F.concat(F.lit("edit "), F.col("key").cast("string")).alias("text")
    )
    memory = earlier.select(
        "lang",
        "source_text",
        F.concat(F.lit("tr:"), "source_text").alias("target_text"),
        F.col("key").alias("seq"),
    )
    documents = _documents(spark, folder)
    units = reuse.reuse_unchanged(documents, old_source, old_target, KEY)
    units = reuse.apply_overrides(units, edits, KEY)
    return reuse.resolve(reuse.lookup_memory(units, memory, ["lang"], texts=documents))


_RESOLVED_SQL = """
WITH earlier AS (
  SELECT d.source, d.doc_id, d.lang, d.text, l.quality, l.toxic
  FROM documents d JOIN labels l USING (doc_id)),
memory AS (SELECT lang, text, arg_max('tr:' || text, doc_id) AS target FROM earlier GROUP BY 1, 2),
resolved AS (
  SELECT d.source, d.doc_id, d.lang,
    CASE WHEN e.toxic = 1 THEN 'edit ' || d.doc_id END AS override_text,
    CASE WHEN e.toxic = 0 AND CASE WHEN e.quality = 0 THEN e.text || '!' ELSE e.text END = d.text
         THEN 'tr:' || e.text END AS reused_text,
    m.target
  FROM documents d
  LEFT JOIN earlier e ON e.doc_id = d.doc_id AND e.source = d.source
  LEFT JOIN memory m ON m.lang = d.lang AND m.text = d.text),
final AS (
  SELECT source, doc_id, lang, override_text, reused_text,
    CASE WHEN override_text IS NULL AND reused_text IS NULL THEN target END AS memory_text
  FROM resolved)
"""


@query(
    "worklist_by_lang",
    _RESOLVED_SQL
    + """SELECT lang,
      CASE WHEN override_text IS NOT NULL THEN 'override' WHEN reused_text IS NOT NULL THEN 'reuse'
           WHEN memory_text IS NOT NULL THEN 'memory' ELSE 'to_do' END AS origin,
      count(*) AS units,
      CAST(sum(length(coalesce(override_text, reused_text, memory_text))) AS BIGINT) AS settled_chars
    FROM final GROUP BY 1, 2""",
)
def worklist_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    """How much of the corpus is settled, and by what, per language."""
    return (
        _resolved(spark, folder)
        .groupBy("lang", F.coalesce("origin", F.lit("to_do")).alias("origin"))
        .agg(
            F.count("*").alias("units"),
            F.sum(F.length("settled_text").cast("bigint")).alias("settled_chars"),
        )
    )


@query(
    "pending_units",
    _RESOLVED_SQL
    + """SELECT doc_id AS key, lang FROM final
    WHERE coalesce(override_text, reused_text, memory_text) IS NULL""",
)
def pending_units(spark: SparkSession, folder: str) -> DataFrame:
    return reuse.pending(_resolved(spark, folder)).select("key", "lang")


@query(
    "reuse_summary",
    _RESOLVED_SQL
    + """SELECT source AS pkg_id, count(*) AS total,
      count(reused_text) AS unchanged, count(override_text) AS edits, count(memory_text) AS from_memory,
      count(*) FILTER (coalesce(override_text, reused_text, memory_text) IS NULL) AS to_do
    FROM final GROUP BY 1""",
)
def reuse_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reuse.reuse_summary(_resolved(spark, folder), ["pkg_id"])


@query(
    "snapshot_diff",
    """WITH old AS (
      SELECT doc_id, d.text || CASE WHEN l.toxic = 1 THEN '!' ELSE '' END AS text
      FROM documents d JOIN labels l USING (doc_id)),
    new AS (
      SELECT doc_id, text FROM documents
      WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))
    SELECT coalesce(old.doc_id, new.doc_id) AS key,
      CASE WHEN old.doc_id IS NULL THEN 'new' WHEN new.doc_id IS NULL THEN 'deleted'
           WHEN old.text = new.text THEN 'unchanged' ELSE 'changed' END AS status
    FROM old FULL JOIN new ON old.doc_id = new.doc_id""",
)
def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    earlier = _labelled(spark, folder)
    old = earlier.select(
        *KEY,
        F.concat("source_text", F.when(F.col("toxic") == 1, "!").otherwise("")).alias("text"),
    )
    new = (
        _documents(spark, folder)
        .join(earlier.filter("quality = 0").select("key"), "key", "left_anti")
        .select(*KEY, F.col("source_text").alias("text"))
    )
    return reuse.diff_snapshots(old, new, KEY).select("key", "status")


@query(
    "snapshot_source",
    """SELECT lang || '/' || source AS key, arg_max(text, doc_id) AS source_text
    FROM documents GROUP BY 1""",
)
def snapshot_source(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "documents").select(
        F.concat_ws("/", "lang", "source").alias("key"),
        F.col("text").alias("source_text"),
        F.col("doc_id").alias("seq"),
    )
    return reuse.snapshot_source(units, ["key"], ["seq"])


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select(
        F.concat_ws(".", "conv_id", "turn").alias("key"), "role", F.col("text").alias("raw")
    )


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    """Machine output has a prefix; short turns were edited; system turns are new."""
    turns = _turns(spark, folder)
    snapshot = turns.filter("role <> 'system'").select("key", F.concat(F.lit("tr:"), "raw").alias("text"))
    current = turns.select(
        "key",
        F.concat(
            F.concat(F.lit("tr:"), "raw"), F.when(F.length("raw") < 100, " (edited)").otherwise("")
        ).alias("text"),
    )
    return reuse.harvest_edits(current, snapshot, ["key"])


_EDITS_SQL = """
WITH turns AS (
  SELECT conv_id || '.' || turn AS key, role, text FROM conversations),
edits AS (
  SELECT key, 'tr:' || text || ' (edited)' AS text FROM turns
  WHERE role <> 'system' AND length(text) < 100)
"""


@query("edit_harvest", _EDITS_SQL + "SELECT key, text FROM edits")
def edit_harvest(spark: SparkSession, folder: str) -> DataFrame:
    return _edits(spark, folder)


@query(
    "override_upsert",
    _EDITS_SQL
    + """SELECT coalesce(e.key, s.key) AS key, coalesce(e.text, s.text) AS text
    FROM edits e FULL JOIN
      (SELECT key, 'stored ' || key AS text FROM turns WHERE role = 'assistant') s
    ON e.key = s.key""",
)
def override_upsert(spark: SparkSession, folder: str) -> DataFrame:
    stored = (
        _turns(spark, folder)
        .filter("role = 'assistant'")
        .select("key", F.concat(F.lit("stored "), "key").alias("text"))
    )
    return reuse.upsert_overrides(stored, _edits(spark, folder), ["key"])


SENTENCES_SQL = r"""
sentence_list AS (
  SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped FROM documents),
pieces AS (
  SELECT *, CASE WHEN length(stripped) > 200
    THEN list_filter(string_split(regexp_replace(stripped, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
                     lambda x: x <> '')
    ELSE [stripped] END AS sentences FROM sentence_list)
"""


# Labels go to the texts up to this (16 bytes each), else texts are shuffled to meet them.
_LABELS = 1_000_000


@query(
    "memory_propagation",
    "WITH "
    + SENTENCES_SQL
    + """, units AS (
      SELECT CAST(substr(source, 4) AS BIGINT) AS pkg_seq, doc_id,
        unnest(sentences) AS source_text, generate_subscripts(sentences, 1) AS pos
      FROM pieces),
    labelled AS (
      SELECT u.*, CASE WHEN l.quality = 1 THEN 'edit ' || u.doc_id END AS pinned_text,
        pkg_seq || ':' || source_text AS fresh_text
      FROM units u LEFT JOIN labels l USING (doc_id)),
    leaves AS (
      SELECT * FROM labelled
      QUALIFY row_number() OVER (PARTITION BY source_text, pkg_seq ORDER BY doc_id DESC, pos DESC) = 1)
    SELECT source_text, pkg_seq, pinned_text,
      coalesce(last_value(pinned_text IGNORE NULLS) OVER w, first_value(fresh_text IGNORE NULLS) OVER w)
        AS memory_text
    FROM leaves
    WINDOW w AS (PARTITION BY source_text ORDER BY pkg_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def memory_propagation(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents", spread=True)
    good = table(spark, folder, "labels").filter("quality = 1").select("doc_id", "quality")
    units = (
        skew.lookup(documents, good, ["doc_id"], "left", broadcast_rows=_LABELS)
        .select(
            F.expr("cast(substring(source, 4) as bigint)").alias("pkg_seq"),
            "doc_id",
            F.when(
                F.col("quality") == 1, F.concat(F.lit("edit "), F.col("doc_id").cast("string"))
            ).alias("pinned_text"),
            F.posexplode(tx.sentences(F.col("text"))).alias("pos", "source_text"),
        )
        .withColumn(
            "fresh_text",
            F.concat(F.col("pkg_seq").cast("string"), F.lit(":"), "source_text"),
        )
        .withColumn("seq", F.struct("doc_id", "pos"))
    )
    return reuse.propagate_memory(units).drop("fresh_text")


@query(
    "latest_wins",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1""",
)
def latest_wins(spark: SparkSession, folder: str) -> DataFrame:
    return skew.latest(
        table(spark, folder, "events"), ["user_id"], ["event_type"], ["ts", "event_id"]
    )


@query(
    "first_wins",
    """SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1""",
)
def first_wins(spark: SparkSession, folder: str) -> DataFrame:
    return skew.earliest(
        table(spark, folder, "events"), ["user_id"], ["event_type"], ["ts", "event_id"]
    )


@query(
    "coverage_fill",
    """WITH covered AS (
      SELECT DISTINCT source, lang FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT d.doc_id AS key, 'injected' AS layer FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1
    UNION ALL
    SELECT d.doc_id, 'definitions' FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.source = d.source AND c.lang = d.lang)""",
)
def coverage_fill(spark: SparkSession, folder: str) -> DataFrame:
    injected = _labelled(spark, folder).filter("toxic = 1").select(
        "pkg_id", F.col("lang").alias("def_type"), "key", F.lit("injected").alias("layer")
    )
    fields = _documents(spark, folder).select(
        "pkg_id", F.col("lang").alias("def_type"), "key", F.lit("definitions").alias("layer")
    )
    return layers.fill_uncovered(injected, fields, injected).select("key", "layer")


@query(
    "stale_refresh",
    """WITH fields AS (
      SELECT user_id AS key, arg_max(props, (ts, event_id)) AS current FROM events
      WHERE event_type = 'error' GROUP BY 1),
    units AS (SELECT user_id AS key, event_id, props FROM events WHERE event_type <> 'error')
    SELECT event_id, coalesce(current, props) AS source_text FROM units LEFT JOIN fields USING (key)""",
)
def stale_refresh(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("key"),
        "event_id",
        "ts",
        "event_type",
        F.col("props").alias("source_text"),
    )
    units = events.filter("event_type <> 'error'")
    fields = events.filter("event_type = 'error'")
    return layers.refresh_stale(units, fields, ["key"], ["ts", "event_id"]).select(
        "event_id", "source_text"
    )


@query(
    "patch_layers",
    """WITH units AS (SELECT c_custkey AS key, c_name AS source_text FROM customer),
    patches AS (SELECT user_id * 7 AS key, event_id AS seq, event_type || event_id AS source_text FROM events),
    last AS (SELECT key, arg_max(source_text, seq) AS t FROM patches GROUP BY 1),
    first AS (SELECT key, arg_min(source_text, seq) AS t FROM patches GROUP BY 1)
    SELECT key, coalesce(t, source_text) AS source_text FROM units LEFT JOIN last USING (key)
    UNION ALL
    SELECT key, t FROM first WHERE key NOT IN (SELECT key FROM units)""",
)
def patch_layers(spark: SparkSession, folder: str) -> DataFrame:
    units = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("source_text")
    )
    patches = table(spark, folder, "events").select(
        (F.col("user_id") * 7).alias("key"),
        F.col("event_id").alias("seq"),
        F.concat("event_type", F.col("event_id").cast("string")).alias("source_text"),
    )
    return layers.apply_patches(units, patches, ["key"], ["seq"]).select(
        "key", "source_text"
    )


@query(
    "layer_union",
    """SELECT channel, channel_rank, count(*) AS units FROM (
      SELECT 'keyed' AS channel, 1 AS channel_rank FROM pages
      UNION ALL SELECT 'injected', 2 FROM documents
      UNION ALL SELECT 'strings', 3 FROM conversations) GROUP BY 1, 2""",
)
def layer_union(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        table(spark, folder, name).select(F.lit(channel).alias("channel"))
        for name, channel in (
            ("conversations", "strings"),
            ("pages", "keyed"),
            ("documents", "injected"),
        )
    ]
    return (
        layers.union_layers(*parts)
        .groupBy("channel", "channel_rank")
        .agg(F.count("*").alias("units"))
    )


@query(
    "scan_summary",
    """WITH files AS (SELECT source, lang, doc_id, 1 + length(text) - length(replace(text, chr(10), '')) AS n
                     FROM documents)
    SELECT source AS pkg_id, lang AS channel, count(*) AS files, CAST(sum(n) AS BIGINT) AS strings
    FROM files GROUP BY ROLLUP (source, lang)""",
)
def scan_summary(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "documents").select(
        F.col("source").alias("pkg_id"),
        F.col("lang").alias("channel"),
        F.col("doc_id").alias("file_id"),
        F.explode(F.split("text", "\n", -1)).alias("line"),
    )
    return layers.scan_summary(lines)


@query(
    "state_carry",
    "SELECT source AS pkg_id, lang, doc_id::VARCHAR AS key, "
    "CASE WHEN lang = 'en' AND source < 'src15' THEN 'third:' WHEN lang IN ('de', 'en') AND source > 'src12' THEN 'second:' "
    "ELSE 'first:' END || text AS text FROM documents",
)
def state_carry(spark: SparkSession, folder: str) -> DataFrame:
    """State after three runs, of which the later two work on some packages and languages only."""
    session.ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/state-{uuid.uuid4().hex}"
    documents = table(spark, folder, "documents")
    none = F.lit(None).cast("string")
    runs = (
        ("first:", F.lit(True)),
        ("second:", F.col("lang").isin("de", "en") & (F.col("source") > "src12")),
        ("third:", (F.col("lang") == "en") & (F.col("source") < "src15")),
    )
    for run_id, (mark, chosen) in enumerate(runs):
        rows = documents.filter(chosen).select(
            F.lit("machine").alias("kind"),
            F.col("source").alias("pkg_id"),
            "lang",
            none.alias("channel"),
            none.alias("type_key"),
            F.col("doc_id").cast("string").alias("key"),
            F.concat(F.lit(mark), "text").alias("text"),
            none.alias("origin"),
            F.lit(False).alias("deleted"),
        )
        commit_run({"state": rows}, rows, path, run_id)
    return read_state(spark, path, "state").select("pkg_id", "lang", "key", "text")


@query(
    "memory_run",
    """WITH units AS (SELECT turn AS pkg_seq, conv_id, substr(text, 1, 3) AS source_text FROM conversations),
    fresh AS (
      SELECT *, CASE WHEN source_text LIKE '%e%' AND pkg_seq % 2 = 0 THEN 'fallback' ELSE 'draft' END AS own,
        min(pkg_seq) OVER (PARTITION BY source_text) AS first FROM units),
    leaders AS (
      SELECT source_text, arg_max(pkg_seq || ':' || conv_id || ':' || source_text, conv_id) AS text
      FROM fresh WHERE pkg_seq = first AND own <> 'fallback' GROUP BY 1)
    SELECT pkg_seq, conv_id, CASE WHEN pkg_seq > first AND text IS NOT NULL THEN 'memory' ELSE own END AS origin,
      CASE WHEN pkg_seq > first AND text IS NOT NULL THEN text WHEN own = 'fallback' THEN source_text
        ELSE pkg_seq || ':' || conv_id || ':' || source_text END AS final_text
    FROM fresh LEFT JOIN leaders USING (source_text)""",
)
def memory_run(spark: SparkSession, folder: str) -> DataFrame:
    """One run over packages (turns) that share texts: the first package's result serves the later ones,
    unless it got none."""
    units = table(spark, folder, "conversations").select(
        F.col("turn").cast("bigint").alias("pkg_seq"), "conv_id", F.substring("text", 1, 3).alias("source_text")
    )
    told = F.concat_ws(":", "pkg_seq", "conv_id", "source_text")

    def infer(todo: DataFrame) -> DataFrame:
        """A model whose answer depends on the unit, and that fails on some texts in even packages."""
        fails = F.col("source_text").contains("e") & (F.col("pkg_seq") % 2 == 0)
        return todo.withColumns(
            {"final_text": F.when(fails, F.col("source_text")).otherwise(told), "origin": F.when(fails, "fallback").otherwise("draft")}
        )

    return reuse.in_package_order(units, infer, ["conv_id"]).select("pkg_seq", "conv_id", "origin", "final_text")
