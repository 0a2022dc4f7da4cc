"""Queries on inputs that the shared tables are too small to hold."""

import __spark_entry__ as contract
import duckdb
import pyarrow as pa
from locale_lake.operators import inherit, skew
from locale_lake.operators import tree as tree_operators
from tests.oracle import compare


def _differs(spark, folder, name, table, rows):
    spark.createDataFrame(rows).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return compare(contract.queries()[name](spark, str(folder)), connection, contract.oracle_sql()[name])


def test_guards_counts_the_words_of_terms(compiled, tmp_path):
    """Eight words, seven with stand-ins: a term of two words, and one behind a line end."""
    texts = ["Ea tion wh, thor is on.\nThe ndre.", "Ea tion wh, thor on.\nThe ndre.", "is on the, is on Ndre. is on", "Ea is on the"]
    rows = [{"conv_id": i, "turn": 0, "role": "user", "text": text} for i, text in enumerate(texts)]
    assert _differs(compiled, tmp_path, "guards", "conversations", rows) is None


def _parts(n):
    kinds = ["SMALL", "LARGE", "ECONOMY"]
    return [{"p_partkey": i, "p_name": f"name {i}", "p_brand": "B#1", "p_type": kinds[i % 3], "p_size": i % 50 + 1} for i in range(n)]


def _folds(spark, folder, name):
    spark.createDataFrame(_parts(200)).coalesce(1).write.parquet(f"{folder}/part.parquet")
    plan = contract.queries()[name](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow")


def test_inherit_rules_folds_once(spark, tmp_path):
    """The fold was in the plan three times, once for each kind of field."""
    assert _folds(spark, tmp_path, "inherit_rules") == 1


def test_inherit_merge_folds_once(spark, tmp_path):
    assert _folds(spark, tmp_path, "inherit_merge") == 1


def test_folded_leaves_are_those_of_a_walk(spark):
    """Nested and mixed lists, blank texts, rules, lists at the top; heirs of one parent and of a chain."""
    def tree(name, rows):
        return [(name, pos, tags, tags[-1] if tags else "Def", text, {}) for pos, tags, text in rows]

    base = [
        ([], [], ""), ([0], ["label"], "a label"), ([1], ["li"], "top one"), ([2], ["steps"], ""), ([2, 0], ["steps", "li"], ""),
        ([2, 0, 0], ["steps", "li", "li"], "inner one"), ([2, 0, 1], ["steps", "li", "li"], ""),
        ([2, 0, 1, 0], ["steps", "li", "li", "li"], "third level"), ([2, 1], ["steps", "li"], ""),
        ([2, 1, 0], ["steps", "li", "note"], "a note"), ([3], ["mixed"], ""), ([3, 0], ["mixed", "li"], "is no list"),
        ([3, 1], ["mixed", "x"], ""), ([3, 1, 0], ["mixed", "x", "li"], "a member"), ([4], ["rulesStrings"], ""),
        ([4, 0], ["rulesStrings", "li"], "key->value"), ([5], ["blank"], " 　"),
    ]
    own = [([], [], ""), ([0], ["steps"], ""), ([0, 0], ["steps", "li"], "own step")]
    rows = tree("base", base) + tree("b", own) + tree("c", own) + tree("d", [([], [], "")]) + tree("e", own)
    trees = spark.createDataFrame(rows, "tree_id string, pos array<int>, tags array<string>, tag string, text string, attrs map<string,string>")
    chain = spark.createDataFrame(
        [("b", "base", 1), ("c", "base", 1), ("d", "base", 1), ("e", "b", 1), ("e", "base", 2)], "tree_id string, anc_id string, dist int"
    )
    columns = ["tree_id", "pos", "field_path", "test_tag", "text"]
    walked = tree_operators.walk_fields(inherit.merge_inherited(trees, chain)).select(columns).collect()
    folded = inherit.inherited_fields(trees, chain).select(columns).collect()
    assert sorted(map(str, folded)) == sorted(map(str, walked))
    assert {r["field_path"] for r in walked if r["tree_id"] == "e"} >= {"steps.0.li", "steps.2", "steps.3", "mixed.x.0", "rulesStrings.0"}


def test_patch_fields_tasks_follow_rows(spark, tmp_path, monkeypatch):
    """Tasks were made by compressed bytes, so their memory grew with the input."""
    monkeypatch.setattr(skew, "ROWS_A_TASK", 100)
    spark.createDataFrame(_parts(200)).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    plan = contract.queries()["patch_fields"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [tree_id" in plan


def test_rows_without_a_key_are_spread(spark):
    """Rows whose key is null met in one task, however many there were."""
    many = spark.range(2000).selectExpr("cast(null as string) AS k", "id")
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    joined = skew.lookup(many, one, ["k"], "left")
    plan = joined._jdf.queryExecution().analyzed().toString()
    assert "isnull(k#" in plan and joined.filter("v IS NULL").count() == 2000


def test_entry_lines_reads_a_file_in_blocks(spark, tmp_path):
    """A file was one row of one task; here it has many blocks, and what a reader of lines may lose."""
    texts = ["\ufeffmarked", "two\nlines", "return\rhere\r\n", "", "\u00fc" * 300, "\n\n", " <&> --"]
    rows = [
        {"conv_id": i, "turn": i % 6, "role": role, "text": text}
        for role in ("system", "user", "a b+c%20#\u00fc") for i, text in enumerate(texts * 20)
    ]
    schema = "conv_id bigint, turn int, role string, text string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = contract.queries()["entry_lines"](spark, str(tmp_path))
        assert compare(found, connection, contract.oracle_sql()["entry_lines"]) is None
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert "binaryFile" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_equal_texts_of_a_batch_are_made_once():
    """Trees above many heirs come again and again; each of their texts was made anew."""
    texts = [["a tag", None, "b tag"], None, ["a tag"], []]
    found = list(inherit._lists(pa.array(texts, pa.list_(pa.string()))))
    assert found == [x or [] for x in texts] and found[0][0] is found[2][0]
    assert list(inherit._lists(pa.array([[1, 2], [], None, [3]], pa.list_(pa.int32())))) == [[1, 2], [], [], [3]]
    assert list(inherit._lists(pa.array([[True, None], [False]], pa.list_(pa.bool_())))) == [[True, None], [False]]
