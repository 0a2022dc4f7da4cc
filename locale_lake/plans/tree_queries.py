"""Trees, inheritance and patches over documents derived from the shared tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locale_lake.functions import text as tx
from locale_lake.operators import inherit, patches, tree
from locale_lake.plans.registry import query, table
from locale_lake.plans.text_queries import _REASON_SQL
from locale_lake.session import cut_lineage, rewritten
from locale_lake.sources import files as fs
from locale_lake.sources import xml


def _element(tag: str, body: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))


def _text(tag: str, value: Column) -> Column:
    return _element(tag, tx.xml_escape(value))


def _lines(text: Column) -> Column:
    """A list element with one item per line."""
    items = F.transform(F.split(text, "\n", -1), lambda line: _text("li", line))
    return _element("lines", F.array_join(items, ""))


def _turn_files(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations", spread=True)
    body = F.concat(_text("role", F.col("role")), _lines(F.col("text")))
    return turns.select(
        F.concat_ws(".", "conv_id", "turn").alias("file_id"),
        _element("turn", body).cast("binary").alias("content"),
    )


@query(
    "node_table",
    """WITH turns AS (SELECT conv_id || '.' || turn AS file_id, role, string_split(text, chr(10)) AS l FROM conversations),
    items AS (SELECT file_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS i FROM turns)
    SELECT file_id, '' AS pos, 'turn' AS path, '' AS text FROM turns
    UNION ALL SELECT file_id, '0', 'turn.role', role FROM turns
    UNION ALL SELECT file_id, '1', 'turn.lines', '' FROM turns
    UNION ALL SELECT file_id, '1.' || i, 'turn.lines.li', text FROM items""",
)
def node_table(spark: SparkSession, folder: str) -> DataFrame:
    nodes = xml.shred_xml(_turn_files(spark, folder), ["file_id"])
    return nodes.select(
        "file_id",
        F.array_join(F.col("pos").cast("array<string>"), ".").alias("pos"),
        F.array_join("tags", ".").alias("path"),
        "text",
    )


@query(
    "keyed_entries",
    """SELECT conv_id || '.' || turn AS file_id, 'role' AS key, CAST(0 AS BIGINT) AS seq, role AS source_text FROM conversations
    UNION ALL SELECT conv_id || '.' || turn, 'lines', 1, '' FROM conversations""",
)
def keyed_entries(spark: SparkSession, folder: str) -> DataFrame:
    nodes = xml.shred_xml(_turn_files(spark, folder), ["file_id"], keep_comments=True)
    return xml.read_keyed(nodes).select("file_id", "key", "seq", "source_text")


def _definition_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One document per turn: a definition with a label and a list of lines."""
    turns = table(spark, folder, "conversations", spread=True)
    name = F.concat(F.lit(" t"), F.concat_ws("_", "conv_id", "turn"), F.lit(" "))
    body = F.concat(_text("defName", name), _text("label", F.col("role")), _lines(F.col("text")))
    definition = F.concat(
        F.lit("<TurnDef"),
        F.when(F.col("role") == "system", ' Abstract="TRUE"').otherwise(""),
        F.lit(">"),
        body,
        F.lit("</TurnDef>"),
    )
    files = turns.select(
        F.concat_ws(".", "conv_id", "turn").alias("file_id"),
        _element("Defs", definition).cast("binary").alias("content"),
    )
    return xml.shred_xml(files, ["file_id"])


@query(
    "field_paths",
    f"""WITH turns AS (
      SELECT 't' || conv_id || '_' || turn AS name, role, string_split(text, chr(10)) AS l
      FROM conversations WHERE role <> 'system'),
    items AS (SELECT name, unnest(l) AS value, generate_subscripts(l, 1) - 1 AS i FROM turns),
    tagged AS (
      SELECT name || '.label' AS key, 'label' AS tag, role AS value FROM turns
      UNION ALL SELECT name || '.lines.' || i, 'lines', value FROM items),
    stripped AS (SELECT *, regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS s FROM tagged)
    SELECT key, value AS text FROM stripped WHERE {_REASON_SQL} = 'text'""",
)
def field_paths(spark: SparkSession, folder: str) -> DataFrame:
    trees = tree.def_trees(_definition_nodes(spark, folder))
    concrete = tree.filter_defs(tree.def_heads(trees, ["file_id"]))
    fields = tree.walk_fields(trees).join(concrete, "tree_id")
    return fields.select(
        tree.unit_key(F.col("def_name"), F.col("field_path")).alias("key"), "text"
    )


@query(
    "list_index",
    """WITH items AS (
      SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS l FROM pages)
    SELECT page_id, generate_subscripts(l, 1) - 1 AS i, unnest(l) AS item FROM items""",
)
def list_index(spark: SparkSession, folder: str) -> DataFrame:
    """List items of the pages as a list element: parsed, numbered, read back."""
    items = F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), F.lit(1))
    body = F.array_join(F.transform(items, lambda item: _text("li", item)), "")
    files = table(spark, folder, "pages", spread=True).select(
        F.col("page_id").alias("file_id"), _element("nav", body).cast("binary").alias("content")
    )
    return xml.read_keyed(xml.shred_xml(files, ["file_id"], keep_comments=True)).select(
        F.col("file_id").alias("page_id"),
        F.col("seq").alias("i"),
        F.col("source_text").alias("item"),
    )


def _forest(spark: SparkSession, folder: str) -> DataFrame:
    """Every part hangs below the part with a quarter of its number."""
    up = F.expr("p_partkey div 4")
    return table(spark, folder, "part", spread=True).select(
        F.col("p_partkey").alias("id"),
        F.when(up > 0, up).alias("parent_id"),
        F.when(F.col("p_size") > 25, F.col("p_type")).alias("own_value"),
        "p_name",
    )


_CLOSURE_SQL = """
RECURSIVE forest AS (
  SELECT p_partkey AS id, CASE WHEN p_partkey // 4 > 0 THEN p_partkey // 4 END AS parent_id,
    CASE WHEN p_size > 25 THEN p_type END AS own_value, p_name FROM part),
closure AS (
  SELECT f.id, f.parent_id AS ancestor, 1 AS dist FROM forest f JOIN forest p ON p.id = f.parent_id
  UNION ALL
  SELECT c.id, f.parent_id, c.dist + 1 FROM closure c JOIN forest f ON f.id = c.ancestor
    JOIN forest p ON p.id = f.parent_id)
"""


@query("ancestor_closure", f"WITH {_CLOSURE_SQL} SELECT id, ancestor, dist FROM closure")
def ancestor_closure(spark: SparkSession, folder: str) -> DataFrame:
    return inherit.ancestors(_forest(spark, folder), "id", "parent_id")


@query(
    "inherit_fields",
    f"""WITH {_CLOSURE_SQL},
    donors AS (
      SELECT c.id, arg_min(f.own_value, c.dist) AS value FROM closure c JOIN forest f ON f.id = c.ancestor
      WHERE f.own_value IS NOT NULL GROUP BY 1)
    SELECT f.id, coalesce(f.own_value, d.value) AS value FROM forest f LEFT JOIN donors d USING (id)""",
)
def inherit_fields(spark: SparkSession, folder: str) -> DataFrame:
    """A part without a value of its own takes the nearest ancestor's."""
    forest = _forest(spark, folder)
    closure = inherit.ancestors(forest, "id", "parent_id")
    donors = forest.filter(F.col("own_value").isNotNull()).select(
        F.col("id").alias("ancestor"), F.col("own_value").alias("_value")
    )
    nearest = (
        closure.join(donors, "ancestor").groupBy("id").agg(F.min_by("_value", "dist").alias("_value"))
    )
    return forest.join(nearest, "id", "left").select(
        "id", F.coalesce("own_value", "_value").alias("value")
    )


@query(
    "inherit_merge",
    f"""WITH {_CLOSURE_SQL},
    line AS (SELECT id, id AS member, 0 AS dist FROM forest UNION ALL SELECT id, ancestor, dist FROM closure),
    steps AS (
      SELECT l.id, row_number() OVER (PARTITION BY l.id ORDER BY dist DESC) - 1 AS i, f.p_name AS text
      FROM line l JOIN forest f ON f.id = l.member),
    labels AS (
      SELECT l.id, arg_min(f.own_value, dist) AS text FROM line l JOIN forest f ON f.id = l.member
      WHERE f.own_value IS NOT NULL GROUP BY 1)
    SELECT id, 'steps.' || i AS field_path, text FROM steps
    UNION ALL SELECT id, 'label', 'type ' || text FROM labels""",
)
def inherit_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Whole trees: labels from the nearest ancestor, lists from the root down."""
    forest = _forest(spark, folder)
    node = "struct<pos:array<int>,tags:array<string>,tag:string,text:string>"

    def row(pos: list[int], tags: list[str], text: Column) -> Column:
        return F.struct(
            F.array(*[F.lit(p) for p in pos]),
            F.array(*[F.lit(t) for t in tags]),
            F.lit(tags[-1] if tags else "PartDef"),
            text,
        ).cast(node)

    rows = F.array(
        row([], [], F.lit("")),
        row([1], ["steps"], F.lit("")),
        row([1, 0], ["steps", "li"], F.col("p_name")),
        F.when(
            F.col("own_value").isNotNull(),
            row([0], ["label"], F.concat(F.lit("type "), "own_value")),
        ),
    )
    trees = (
        forest.select(F.col("id").cast("string").alias("tree_id"), F.explode(rows).alias("n"))
        .filter(F.col("n").isNotNull())
        .select("tree_id", "n.*", F.create_map().cast("map<string,string>").alias("attrs"))
    )
    chain = inherit.ancestors(forest, "id", "parent_id").select(
        F.col("id").cast("string").alias("tree_id"),
        F.col("ancestor").cast("string").alias("anc_id"),
        "dist",
    )
    return inherit.inherited_fields(trees, chain).select(
        F.col("tree_id").cast("bigint").alias("id"), "field_path", "text"
    )


_RULES_SQL = """
RECURSIVE heads AS (
  SELECT p_partkey AS id, 'n' || p_partkey AS name, CASE WHEN p_partkey % 11 <> 7 THEN 'n' || p_partkey // 4 ELSE 'nowhere' END AS up,
    p_partkey % 2 AS odd, p_size, p_name, p_type, p_partkey || '' AS tree FROM part
  UNION ALL
  SELECT p_partkey, 'n' || p_partkey, CASE WHEN p_partkey % 11 <> 7 THEN 'n' || p_partkey // 4 ELSE 'nowhere' END,
    p_partkey % 2, p_size, 'again ' || p_name, p_type, p_partkey || 'again' FROM part WHERE p_size > 40),
registry AS (SELECT name, arg_min(tree, tree) AS tree FROM heads GROUP BY name),
own AS (
  SELECT h.*, r.tree AS up_tree,
    CASE WHEN p_size % 5 <> 0 THEN p_type END AS label,
    CASE WHEN p_size % 7 = 0 THEN [] ELSE [p_name, p_type] END AS steps, p_size % 10 = 1 AS alone,
    CASE WHEN odd = 1 THEN p_name END AS a, CASE WHEN odd = 0 OR p_size % 3 = 0 THEN p_type END AS b, p_size % 10 = 2 AS cut
  FROM heads h LEFT JOIN registry r ON r.name = h.up AND r.tree <> h.tree),
done AS (
  SELECT tree, label, steps, a, b FROM own WHERE up_tree IS NULL
  UNION ALL
  SELECT o.tree, coalesce(o.label, d.label),
    CASE WHEN o.alone THEN o.steps WHEN len(o.steps) = 0 THEN d.steps ELSE d.steps || o.steps END,
    CASE WHEN o.cut THEN o.a ELSE coalesce(o.a, d.a) END, CASE WHEN o.cut THEN o.b ELSE coalesce(o.b, d.b) END
  FROM own o JOIN done d ON o.up_tree = d.tree)
"""


@query(
    "inherit_rules",
    f"""WITH {_RULES_SQL}
    SELECT tree AS tree_id, 'label' AS field_path, 'type ' || label AS text FROM done WHERE label IS NOT NULL
    UNION ALL SELECT tree, 'extra.a', 'a ' || a FROM done WHERE a IS NOT NULL
    UNION ALL SELECT tree, 'extra.b', 'b ' || b FROM done WHERE b IS NOT NULL
    UNION ALL SELECT tree, 'steps.' || (generate_subscripts(steps, 1) - 1), 'step ' || unnest(steps) FROM done""",
)
def inherit_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every rule of inheritance, from names to merged fields: the first definition of a name is
    the one that counts; lists are joined, refused, or taken over whole; elements meet by tag."""
    part = table(spark, folder, "part", spread=True)
    number = F.col("p_partkey").cast("string")
    again = part.filter("p_size > 40").withColumn("p_name", F.concat(F.lit("again "), "p_name"))
    every = part.withColumn("tree_id", number).unionByName(again.withColumn("tree_id", F.concat(number, F.lit("again"))))
    parent_name = F.concat(F.lit("n"), F.expr("p_partkey div 4").cast("string"))
    heads = every.select(
        F.lit("all").alias("pkg_id"),
        "tree_id",
        F.concat(F.lit("n"), number).alias("name"),
        F.when(F.col("p_partkey") % 11 != 7, parent_name).otherwise("nowhere").alias("parent_name"),
    )
    size, odd = F.col("p_size"), F.col("p_partkey") % 2 == 1
    node = "struct<pos:array<int>,tags:array<string>,tag:string,text:string,attrs:map<string,string>>"

    def row(pos: list[int], tags: list[str], text: Column, refuses: Column | None = None) -> Column:
        attrs = F.map_from_arrays(F.array(), F.array()).cast("map<string,string>")
        if refuses is not None:
            attrs = F.when(refuses, F.create_map(F.lit("Inherit"), F.lit("False"))).otherwise(attrs)
        return F.struct(
            F.array(*[F.lit(p) for p in pos]), F.array(*[F.lit(t) for t in tags]), F.lit(tags[-1] if tags else "PartDef"), text, attrs
        ).cast(node)

    said = lambda what, column: F.concat(F.lit(what), column)
    filled, has_b = size % 7 != 0, ~odd | (size % 3 == 0)
    rows = F.array(
        row([], [], F.lit("")),
        F.when(size % 5 != 0, row([0], ["label"], said("type ", F.col("p_type")))),
        row([1], ["steps"], F.lit(""), size % 10 == 1),
        F.when(filled, row([1, 0], ["steps", "li"], said("step ", F.col("p_name")))),
        F.when(filled, row([1, 1], ["steps", "li"], said("step ", F.col("p_type")))),
        row([2], ["extra"], F.lit(""), size % 10 == 2),
        F.when(odd, row([2, 0], ["extra", "a"], said("a ", F.col("p_name")))),
        F.when(has_b, row([2, 1], ["extra", "b"], said("b ", F.col("p_type")))),
    )
    trees = every.select("tree_id", F.explode(rows).alias("n")).filter("n IS NOT NULL").select("tree_id", "n.*")
    registry = rewritten(inherit.name_registry(heads, ["tree_id"]))
    chain = inherit.chains(heads, registry)
    return inherit.inherited_fields(trees, chain).select("tree_id", "field_path", "text")


@query(
    "dual_types",
    """WITH tags AS (
      SELECT CASE WHEN p_size > 25 THEN 'Ns.' || replace(p_brand, '#', '_') || '.' || p_type ELSE p_type END AS tag, p_brand AS stem
      FROM part),
    types AS (
      SELECT string_split(tag, '.')[-1] AS def_type, stem FROM tags
      UNION ALL SELECT tag, stem FROM tags WHERE contains(tag, '.'))
    SELECT 'DefInjected/' || def_type || '/' || stem || '.xml' AS out_path, count(*) AS n FROM types GROUP BY 1""",
)
def dual_types(spark: SparkSession, folder: str) -> DataFrame:
    full = F.concat(F.lit("Ns."), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("."), "p_type")
    tags = table(spark, folder, "part", spread=True).select(
        F.when(F.col("p_size") > 25, full).otherwise(F.col("p_type")).alias("type_tag"),
        F.col("p_brand").alias("stem"),
    )
    return (
        tree.assign_files(tree.emit_types(tags)).groupBy("out_path").agg(F.count("*").alias("n"))
    )


def _addresses(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses of every shape; some of them name no exact place."""
    shape = (
        F.when(F.col("p_type") == "SMALL", "/steps/li")
        .when(F.col("p_type") == "LARGE", "/steps/*/label")
        .when(F.col("p_type") == "ECONOMY", "")
        .otherwise(F.concat(F.lit("/steps/li["), F.col("p_size").cast("string"), F.lit("]/label")))
    )
    return table(spark, folder, "part", spread=True).select(
        "p_partkey",
        F.concat(
            F.when(F.col("p_size") > 40, " /Defs/").otherwise("Defs/"),
            F.when(F.col("p_size") > 25, "Ns.Sub.").otherwise(""),
            F.lit('PartDef[defName="'),
            "p_name",
            F.lit("\" or defName = 'x"),
            "p_brand",
            F.lit("']"),
            shape,
        ).alias("address"),
    )


@query(
    "address_parse",
    r"""WITH addresses AS (
      SELECT p_partkey, CASE WHEN p_size > 40 THEN ' /Defs/' ELSE 'Defs/' END || CASE WHEN p_size > 25 THEN 'Ns.Sub.' ELSE '' END
        || 'PartDef[defName="' || p_name || '" or defName = ''x' || p_brand || ''']'
        || CASE p_type WHEN 'SMALL' THEN '/steps/li' WHEN 'LARGE' THEN '/steps/*/label' WHEN 'ECONOMY' THEN ''
           ELSE '/steps/li[' || p_size || ']/label' END AS address FROM part),
    parsed AS (
      SELECT p_partkey, regexp_extract(trim(address), '^/?Defs/([\w.]+)\[([^\]]+)\](?:/(.+))?$', ['t', 'p', 'r']) AS m
      FROM addresses WHERE regexp_matches(trim(address), '^/?Defs/([\w.]+)\[([^\]]+)\](?:/(.+))?$')),
    named AS (
      SELECT p_partkey, string_split(m.t, '.')[-1] AS def_type, m.r AS rest,
        unnest(regexp_extract_all(m.p, 'defName\s*=\s*["'']([^"'']+)["'']', 1)) AS def_name FROM parsed)
    SELECT p_partkey, def_type, def_name, CASE WHEN rest = '' THEN ''
      ELSE array_to_string(list_transform(string_split(rest, '/'), lambda s: CASE WHEN regexp_matches(s, '^li\[\d+\]$')
        THEN CAST(CAST(regexp_extract(s, '\d+') AS BIGINT) - 1 AS VARCHAR) ELSE s END), '.') END AS path
    FROM named
    WHERE rest = '' OR len(list_filter(string_split(rest, '/'), lambda s: NOT
      (regexp_matches(s, '^li\[\d+\]$') OR (regexp_matches(s, '^\w+$') AND s <> 'li')))) = 0""",
)
def address_parse(spark: SparkSession, folder: str) -> DataFrame:
    return patches.parse_address(_addresses(spark, folder)).select(
        "p_partkey", "def_type", "def_name", F.array_join("segments", ".").alias("path")
    )


@query(
    "patch_fields",
    """WITH ops AS (
      SELECT p_partkey AS file_id, p_name, p_brand, p_size, p_type, CASE WHEN p_size > 25 THEN 'Add' ELSE 'Replace' END AS op FROM part),
    placed AS (
      SELECT *, CASE WHEN op = 'Add' THEN 'steps.' || (p_size - 1) || '.label.' ELSE 'steps.' || (p_size - 1) || '.' END AS prefix
      FROM ops)
    SELECT file_id, 'PartDef' AS def_type, n AS def_name, prefix || f AS field_path, t AS text FROM (
      SELECT file_id, prefix, unnest(['n' || file_id, 'm' || file_id]) AS n, p_name FROM placed) p
    CROSS JOIN LATERAL (SELECT unnest(['label', 'notes.0', 'notes.1']) AS f, unnest([p_name, 'a ' || p_name, 'b ' || p_name]) AS t)""",
)
def patch_fields(spark: SparkSession, folder: str) -> DataFrame:
    """One change document per part: nested, two targets, text and list payloads."""
    operation = F.when(F.col("p_size") > 25, "Add").otherwise("Replace")
    number = F.col("p_partkey").cast("string")
    address = F.concat(
        F.lit('Defs/PartDef[defName="n'), number, F.lit('" or defName="m'), number,
        F.lit('"]/steps/li['), F.col("p_size").cast("string"), F.lit("]/label"),
    )
    notes = _element(
        "notes",
        F.concat(
            _text("li", F.concat(F.lit("a "), "p_name")), _text("li", F.concat(F.lit("b "), "p_name"))
        ),
    )
    payload = F.concat(_text("label", F.col("p_name")), notes, F.lit("<li><x>left out</x></li><size>3</size>"))
    document = F.concat(
        F.lit('<Patch><Operation Class="PatchOperationSequence"><operations><li Class="Ns.PatchOperation'),
        operation,
        F.lit('">'),
        _text("xpath", address),
        _element("value", payload),
        F.lit("</li></operations></Operation></Patch>"),
    )
    files = table(spark, folder, "part", spread=True).select(
        F.col("p_partkey").alias("file_id"), document.cast("binary").alias("content")
    )
    nodes = cut_lineage(xml.shred_xml(files, ["file_id"]))
    return patches.patch_fields(nodes, ["file_id"]).select(
        "file_id", "def_type", "def_name", "field_path", "text"
    )


@query(
    "newest_version",
    """WITH versions AS (SELECT p_type, p_brand, p_size || '.' || p_partkey % 20 AS version FROM part)
    SELECT p_type, p_brand, arg_max(version, (CAST(split_part(version, '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT)))
      AS version FROM versions GROUP BY 1, 2""",
)
def newest_version(spark: SparkSession, folder: str) -> DataFrame:
    versions = table(spark, folder, "part", spread=True).select(
        "p_type",
        "p_brand",
        F.concat_ws(".", "p_size", (F.col("p_partkey") % 20)).alias("version"),
    )
    return fs.newest_by(versions, ["p_type", "p_brand"], "version")


_PATHS_SQL = """files AS (
      SELECT p_brand AS pkg_id, CASE p_type
        WHEN 'SMALL' THEN ['Sub', 'Languages', 'ENGLISH', 'Keyed', p_partkey || '.xml']
        WHEN 'ECONOMY' THEN ['1.' || p_size, 'Languages', 'English', 'Keyed', p_partkey || '.xml']
        WHEN 'LARGE' THEN ['1.' || p_size, 'Defs', p_partkey || '.xml']
        WHEN 'MEDIUM' THEN ['Mod' || p_size, 'Defs', p_partkey || '.xml']
        WHEN 'PROMO' THEN CASE WHEN p_size > 40 THEN ['Languages', 'German', p_partkey || '.txt'] ELSE ['About', 'About.xml'] END
        ELSE ['LoadFolders.xml'] END AS rel
      FROM part)"""
_ROOTS_SQL = """items AS (
      SELECT p_brand AS pkg_id, p_size, p_partkey, CASE WHEN p_retailprice % 2 < 1 THEN '1.' || p_size ELSE 'Mod' || (p_size % 9) END AS root
      FROM part WHERE p_type = 'STANDARD' AND p_brand < 'Brand#40'),
    best AS (SELECT pkg_id, max(p_size) AS p_size FROM items GROUP BY 1),
    named AS (
      SELECT pkg_id, root, min(p_partkey) AS root_rank, bool_and(p_partkey % 3 = 0) AS conditional
      FROM items JOIN best USING (pkg_id, p_size)
      WHERE (pkg_id, root) IN (SELECT pkg_id, rel[1] FROM files WHERE len(rel) > 1) GROUP BY 1, 2),
    roots AS (
      SELECT pkg_id, root, root_rank::INTEGER AS root_rank, conditional FROM named
      UNION ALL
      SELECT DISTINCT pkg_id, '', 0, false FROM files WHERE pkg_id NOT IN (SELECT pkg_id FROM named)
      UNION ALL
      SELECT pkg_id, arg_max(rel[1], rel[1][3:]::INTEGER), 1, false FROM files
      WHERE rel[1] LIKE '1.%' AND pkg_id NOT IN (SELECT pkg_id FROM named) GROUP BY 1)"""
_LANGUAGES_SQL = """spots AS (
      SELECT pkg_id, list_position(rel, 'Languages') AS spot, array_to_string(rel[1:spot], '/') AS languages, rel
      FROM files WHERE list_position(rel, 'Languages') < len(rel)),
    languages AS (
      SELECT pkg_id, arg_min(languages, (spot, languages)) AS languages FROM spots
      WHERE rel[1] NOT LIKE '1.%' OR spot = 1 OR (pkg_id, rel[1]) IN (SELECT pkg_id, root FROM roots) GROUP BY 1)"""


def _path_table(spark: SparkSession, folder: str) -> DataFrame:
    """Files of packages (one per brand) as the listing gives them."""
    name = F.concat(F.col("p_partkey").cast("string"), F.lit(".xml"))
    version = F.concat(F.lit("1."), F.col("p_size").cast("string"))
    words = lambda *parts: F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    german = words("Languages", "German", F.concat(F.col("p_partkey").cast("string"), F.lit(".txt")))
    rel = (
        F.when(F.col("p_type") == "SMALL", words("Sub", "Languages", "ENGLISH", "Keyed", name))
        .when(F.col("p_type") == "ECONOMY", words(version, "Languages", "English", "Keyed", name))
        .when(F.col("p_type") == "LARGE", words(version, "Defs", name))
        .when(F.col("p_type") == "MEDIUM", words(F.concat(F.lit("Mod"), F.col("p_size").cast("string")), "Defs", name))
        .when((F.col("p_type") == "PROMO") & (F.col("p_size") > 40), german)
        .when(F.col("p_type") == "PROMO", words("About", "About.xml"))
        .otherwise(words("LoadFolders.xml"))
    )
    files = table(spark, folder, "part").select(F.col("p_brand").alias("pkg_id"), rel.alias("rel"))
    return files.withColumn("rel_path", F.array_join("rel", "/"))


def _manifest_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest for some packages: a top node per version, an item per part."""
    part = table(spark, folder, "part").filter("p_type = 'STANDARD' AND p_brand < 'Brand#40'")
    size, key = F.col("p_size").cast("int"), F.col("p_partkey").cast("int")
    none = F.lit(None).cast("string")
    tops = part.select(
        F.col("p_brand").alias("pkg_id"), F.array(size).alias("pos"), F.concat(F.lit("v1."), size.cast("string")).alias("tag"),
        F.lit("").alias("text"),
    ).distinct().withColumn("attrs", F.expr("map()").cast("map<string,string>"))
    root = F.when(F.col("p_retailprice") % 2 < 1, F.concat(F.lit("/1."), size.cast("string"), F.lit("/"))).otherwise(
        F.concat(F.lit("Mod"), (size % 9).cast("string"))
    )
    attrs = F.when(key % 3 == 0, F.create_map(F.lit("IfModActive"), F.lit("x"))).otherwise(F.expr("map()").cast("map<string,string>"))
    items = part.select(F.col("p_brand").alias("pkg_id"), F.array(size, key).alias("pos"), F.lit("li").alias("tag"), root.alias("text"), attrs.alias("attrs"))
    return tops.unionByName(items).select("*", F.lit("LoadFolders.xml").alias("file_id"), none.alias("parse_error"))


@query("package_roots", f"WITH {_PATHS_SQL}, {_ROOTS_SQL} SELECT * FROM roots")
def package_roots(spark: SparkSession, folder: str) -> DataFrame:
    """Folders that count: by the manifest where one names a folder that is there, else by version."""
    return fs.newest_roots(_path_table(spark, folder), _manifest_nodes(spark, folder))


@query("language_root", f"WITH {_PATHS_SQL}, {_ROOTS_SQL}, {_LANGUAGES_SQL} SELECT * FROM languages")
def language_root(spark: SparkSession, folder: str) -> DataFrame:
    files = _path_table(spark, folder)
    return fs.language_roots(files, fs.newest_roots(files, _manifest_nodes(spark, folder)))


@query(
    "source_language",
    f"""WITH {_PATHS_SQL}, {_ROOTS_SQL}, {_LANGUAGES_SQL}
    SELECT pkg_id, languages || '/' || min(rel[spot + 1]) AS lang_dir
    FROM spots JOIN languages USING (pkg_id, languages) WHERE lower(rel[spot + 1]) = 'english' AND len(rel) > spot + 1
    GROUP BY pkg_id, languages""",
)
def source_language(spark: SparkSession, folder: str) -> DataFrame:
    files = _path_table(spark, folder)
    roots = fs.newest_roots(files, _manifest_nodes(spark, folder))
    return fs.source_language(files, fs.language_roots(files, roots))
