"""The queries of this subpackage with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locale_lake.llm import (
    bisector,
    bitsliced,
    contamination,
    content_sort,
    factorisation,
    langid,
    mixing,
    notices,
    rtree,
    sampling,
    secrets,
    toxicity,
    trie_join,
    units,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_factorisation_quality")
def factorisation_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return factorisation.scored(documents, factorisation.train(documents, table(spark, folder, "labels")))


@query(
    "op2_bit_sliced_top_k",
    """
    WITH v AS (
        SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
        SELECT a.vec_id AS query_id, b.vec_id,
               list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 20 = 0
    )
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM pairs
    QUALIFY rank <= 20
    """,
)
def bit_sliced_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return bitsliced.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20, scale=64)


@query("op3_nearest_toxicity")
def nearest_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.scored(documents, toxicity.train(documents, table(spark, folder, "labels")))


@query("op4_license_notices")
def license_notices(spark: SparkSession, folder: str) -> DataFrame:
    return notices.find_notices(table(spark, folder, "documents"))


@query("op5_secret_ledger")
def secret_ledger(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return secrets.digest(secrets.findings_by_row(documents, secrets.scanned_in_runs(documents)))


def passages_sql(text: str) -> str:
    """Runs of units with 20 words; ``text`` is the text with a line feed after every unit, as long as before."""
    return r"""
    WITH lines AS (
        SELECT doc_id, i, line, sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - len(line) - 1 AS start
        FROM (SELECT doc_id, unnest(string_split({text}, chr(10))) AS line, generate_subscripts(string_split({text}, chr(10)), 1) AS i
              FROM documents)
    ), l AS (
        SELECT doc_id, start, start + len(line) AS stop, (sum(n) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS upto, upto - n AS before
        FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines)
        WHERE n > 0
    ), least AS (
        SELECT a.doc_id, a.start, b.stop, a.before, b.upto
        FROM l a ASOF JOIN l b ON a.doc_id = b.doc_id AND a.before + 20 <= b.upto
        UNION
        SELECT b.doc_id, a.start, b.stop, a.before, b.upto
        FROM l b ASOF JOIN l a ON a.doc_id = b.doc_id AND b.upto - 20 >= a.before
    ), d AS (
        SELECT doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), u AS (
        SELECT least.*, md5(array_to_string(w[before + 1:upto], ' ')) AS unit FROM least JOIN d ON least.doc_id = d.doc_id
    ), ranked AS (
        SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start
        FROM u WINDOW w AS (PARTITION BY unit ORDER BY doc_id, start)
    ), again AS (
        SELECT *, coalesce(start < max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop
                                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS goes_on
        FROM ranked WHERE doc_id <> kept_doc_id OR start <> kept_start
    ), numbered AS (
        SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY start, stop
                                                                ROWS UNBOUNDED PRECEDING) AS passage
        FROM again
    )
    SELECT doc_id, min(start)::BIGINT AS start, max(stop)::BIGINT AS "end", (max(upto) - min(before))::BIGINT AS n_words,
           arg_min(kept_doc_id, (start, stop)) AS kept_doc_id, arg_min(kept_start, (start, stop))::BIGINT AS kept_start
    FROM numbered GROUP BY doc_id, passage
    """.replace("{text}", text)


@query("op6_repeated_lines", passages_sql(r"regexp_replace(text, '([.,;:!?|])[\x20\x09-\x0D]', '\1' || chr(10), 'g')"))
def repeated_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and pieces of lines, in runs of 20 words and more."""
    return units.repeated_passages(table(spark, folder, "documents"), min_words=20, kind="clause")


@query("op6_repeated_passages", passages_sql("text"))
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return units.repeated_passages(table(spark, folder, "documents"), min_words=20)


@query(
    "op6_long_lines",
    r"""
    WITH lines AS (
        SELECT doc_id, i, line, sum(len(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - len(line) - 1 AS start
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
              FROM documents)
    ), u AS (
        SELECT doc_id, start, start + len(line) AS stop, len(w) AS n_words, array_to_string(w, ' ') AS unit
        FROM (SELECT *, regexp_extract_all(
                  translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
              FROM lines)
        WHERE len(w) >= 20
    ), ranked AS (
        SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start
        FROM u WINDOW w AS (PARTITION BY unit ORDER BY doc_id, start)
    )
    SELECT doc_id, start::BIGINT AS start, stop::BIGINT AS "end", n_words, kept_doc_id, kept_start::BIGINT AS kept_start
    FROM ranked WHERE doc_id <> kept_doc_id OR start <> kept_start
    """,
)
def long_lines(spark: SparkSession, folder: str) -> DataFrame:
    return units.repeated_units(table(spark, folder, "documents"), kind="line", min_words=20)


@query(
    "op7_prefix_tree_join",
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
    ), n AS (
        SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ), links AS (
        SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * m >= 75 * (x.n + y.n - m)
    ), reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM d
        UNION
        SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
    )
    SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id
    FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN reach ON d.doc_id = reach.doc_id
    GROUP BY d.doc_id
    """,
)
def prefix_tree_join(spark: SparkSession, folder: str) -> DataFrame:
    return trie_join.near_duplicates(table(spark, folder, "documents"))


@query(
    "op7_prefix_tree_links",
    r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
    ), n AS (
        SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
    ), pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ), links AS (
        SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * m >= 75 * (x.n + y.n - m)
    ), reach(doc_id, other) AS (
        SELECT doc_id, doc_id FROM d
        UNION
        SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
    )
    SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id,
           coalesce(any_value(c.n_links), 0)::BIGINT AS n_links
    FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN reach ON d.doc_id = reach.doc_id
    LEFT JOIN (SELECT a, count(*) AS n_links FROM links GROUP BY a) c ON d.doc_id = c.a
    GROUP BY d.doc_id
    """,
)
def prefix_tree_links(spark: SparkSession, folder: str) -> DataFrame:
    return trie_join.near_duplicates(table(spark, folder, "documents"), count_links=True)


@query(
    "op8_suffix_automaton",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents
    ), b AS (
        SELECT item_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
    ), windows AS (
        SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
        FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i
              FROM b WHERE len(w) > 0)
    ), grams AS (
        SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i
              FROM d, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)
    ), hits AS (
        SELECT doc_id, i, grams.m, item_id FROM grams JOIN windows ON grams.g = windows.g AND grams.m = windows.m
    ), places AS (
        SELECT doc_id, count(DISTINCT place) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + m)) AS place FROM hits) GROUP BY doc_id
    ), items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
    )
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
    """,
)
def suffix_automaton(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.find_spans(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query("op9_string_kernel_language")
def string_kernel_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    told = langid.predict(documents.select("doc_id", "text"), langid.train(documents))
    return told.select("doc_id", (sampling.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


@query(
    "op10_mix_sources",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce('0' || source, '1') AS src,
               coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
               (('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
        FROM documents
    ), s AS (
        SELECT src, sum(size)::BIGINT AS source_size,
               [5, 2, 1][((row_number() OVER (ORDER BY src)) - 1) % 3 + 1] AS w
        FROM d GROUP BY src
    ), l AS (
        SELECT *, 3 * source_size AS most, (3 * source_size)::DOUBLE / w AS full_at,
               (((SELECT sum(source_size) FROM s)
                 - coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / w, src
                                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT)::DOUBLE
               / (sum(w) OVER (ORDER BY (3 * source_size)::DOUBLE / w, src
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level
        FROM s
    ), t AS (
        SELECT src, source_size,
               least(most::DOUBLE, (SELECT arg_min(level, (full_at, src)) FROM l WHERE full_at >= level) * w) AS target
        FROM l
    ), r AS (
        SELECT doc_id, d.src, size, u, source_size, target,
               CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
               floor(rate)::BIGINT AS whole, rate - whole AS chance, target - whole * source_size AS due,
               CASE WHEN chance > 0 THEN u / (1 - u) / (chance / (1 - chance)) ELSE 1e300 END AS q
        FROM d JOIN t ON d.src = t.src
    )
    SELECT doc_id, size, source_size, target,
           (size * (whole + CASE WHEN coalesce(sum(size) OVER (PARTITION BY src ORDER BY q, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + size / 2 <= due
                            THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM r
    """,
)
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"), weights=(5, 2, 1), copies=3)


@query(
    "op11_content_sort",
    r"""
    WITH n AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t, length(coalesce(text, '')) AS m
        FROM documents
    )
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t ORDER BY m DESC, doc_id)
    """,
)
def sorted_contents(spark: SparkSession, folder: str) -> DataFrame:
    return content_sort.exact_duplicates(table(spark, folder, "documents"))


@query(
    "op12_tree_negatives",
    """
    WITH v AS (
        SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), pairs AS (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
               list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score
        FROM pairs WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, positive_id,
           (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives p JOIN pairs n ON p.anchor_id = n.anchor_id
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    QUALIFY rank <= 10
    """,
)
def tree_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", moved)
    return rtree.hard_negatives(vectors, vectors.filter("vec_id % 100 = 0"), positives=5, negatives=10, scale=256, low=30, high=90)


def clusters_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds written out, one pair of steps after the other."""
    nearest = """
    a{r} AS MATERIALIZED (
        SELECT n, arg_min(c, (d, c)) AS c, min(d) AS d
        FROM (SELECT v.n, c.c, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
              FROM v, c{r} AS c)
        GROUP BY n
    )"""
    moved = """
    c{s} AS MATERIALIZED (
        SELECT old.c, coalesce(new.q, old.q) AS q
        FROM c{r} AS old LEFT JOIN (
            SELECT c, list(((s - ((s % m) + m) % m) // m)::BIGINT ORDER BY i) AS q
            FROM (SELECT c, i, sum(x) AS s, count(*) AS m
                  FROM (SELECT a.c, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS i FROM a{r} AS a JOIN v ON a.n = v.n)
                  GROUP BY c, i)
            GROUP BY c
        ) AS new ON old.c = new.c
    )"""
    steps = [nearest.format(r=r) + ("," + moved.format(r=r, s=r + 1) if r < rounds else "") for r in range(rounds + 1)]
    return f"""
    WITH v AS MATERIALIZED (
        SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
        FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY h) - 1 AS c, q
        FROM (SELECT q, sha256('2:' || vec_id::VARCHAR) AS h FROM v ORDER BY h LIMIT {k})
    ), {",".join(steps)}
    SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
           (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
    FROM a{rounds} AS a JOIN v ON a.n = v.n JOIN c{rounds} AS c ON a.c = c.c
    """


@query("op13_bisector_clusters", clusters_sql(40, 5))
def bisector_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return bisector.clustered(table(spark, folder, "embeddings"), k=40, rounds=5, scale=256, dims=64, seed="2")
