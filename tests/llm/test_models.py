"""The prefix-tree join against brute force, the trained models on held-out rows, and the pipeline."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from locale_lake.llm import factorisation, graph, langid, queries, rawtext, toxicity, trie_join
from tests.llm.test_simple import DOCS, ODD, brute_hits, docs

# ---- prefix-tree join ----------------------------------------------------------


def shingle_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_classes(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


def near_copies(draw):
    rows, base = [], [[draw.choice("abcdefghij") + str(draw.randint(0, 30)) for _ in range(60)] for _ in range(6)]
    for i in range(150):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 3, 4])):
            words[draw.randrange(len(words))] = f"new{draw.randint(0, 5)}"
        rows.append((1000 - i, " ".join(words)))
    boiler = " ".join(f"shared{k}" for k in range(40))
    rows += [(2000 + i, f"{boiler} " + " ".join(f"u{i}x{k}" for k in range(30))) for i in range(40)]
    rows += [(3000, "One two three"), (3001, "one  two\tTHREE"), (3002, "one two"), (3003, "a b c d e"), (3004, "a b c d e f")]
    return rows


@pytest.mark.parametrize("tree_sets", [1000, 20])
def test_classes_equal_brute_force(spark, monkeypatch, tree_sets):
    rows = [*near_copies(random.Random(4)), (1, None), (2, ""), (3, " \n"), (4, "long " * 30_000), (5, "LONG " * 30_000)]
    original = trie_join.links
    monkeypatch.setattr(trie_join, "links", lambda d, width: original(d, width, tree_sets))
    found = trie_join.near_duplicates(docs(spark, [(*r, "s") for r in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_classes(rows)
    assert len(found) == len(rows)


def test_join_tasks_stay_small_in_a_large_group(spark, monkeypatch):
    words = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join([*words, f"x{i}"]), "s") for i in range(200)]
    buckets = []
    monkeypatch.setattr(trie_join, "_join", lambda t: pa.table({"a": pa.array([str(t.num_rows).encode()]), "b": pa.array([b""]), "n": pa.array([0])}))
    deal = trie_join._deal
    monkeypatch.setattr(trie_join, "_deal", lambda width, n: buckets.append(n) or deal(width, n))
    monkeypatch.setattr(trie_join, "TASK_SETS", 20)
    monkeypatch.setattr(trie_join, "BUCKET_BYTES", 5000)
    # the stand-in links nothing, so every set still has to meet all other trees
    sizes = [int(r["a"]) for r in trie_join.links(docs(spark, rows), 5, 10).collect()]
    assert sum(sizes) >= 200 * 20 and max(sizes) < 200  # never the whole group
    size = sum(len(t) for _, t, _ in rows)
    assert buckets == [-(-size // 5000)]


def test_a_large_group_of_near_copies_is_linked_along_its_trees(spark, monkeypatch):
    words = [f"w{k}" for k in range(80)]
    rows = [(i, " ".join([*words, f"x{i}"]), "s") for i in range(200)]
    rows += [(500 + i, " ".join([f"x{i}", *words[: 58 + i]]), "s") for i in range(5)]  # candidates, some of them linked
    joined, original = [], trie_join._joins
    monkeypatch.setattr(trie_join, "_joins", lambda members: joined.append(members.count()) or original(members))
    found = {r["doc_id"]: r["component_id"] for r in trie_join.near_duplicates(docs(spark, rows)).collect()}
    want = {i: root for i, (_, root) in brute_classes([r[:2] for r in rows]).items()}
    assert len(joined) == 1 and found == want and len(set(want.values())) > 1
    joined.clear()
    links = trie_join.links
    monkeypatch.setattr(trie_join, "links", lambda d, width: links(d, width, 10))
    found = {r["doc_id"]: r["component_id"] for r in trie_join.near_duplicates(docs(spark, rows)).collect()}
    assert found == want
    assert len(joined) == 3 and sum(joined) < 205 * 4  # not once for every tree of the group


def _near(n, part):
    """Near copies, and half as many sets apart from them, as rows of a pair of trees."""
    draw = np.random.default_rng(part + 7)
    rows = []
    for i in range(n):
        tokens = np.arange(100, dtype=np.uint64)
        tokens = np.union1d(tokens[draw.random(100) < 0.97], np.uint64(1000 * (part + 1) + i)) if i % 3 else tokens[i % 7 :: 9]
        rows.append({"group": b"g", "one": 0, "two": 0, "part": part, "key": bytes([part, i]), "n": len(tokens), "tokens": tokens.tobytes()})
    return rows


@pytest.mark.parametrize("two", [0, 1])
def test_a_class_is_walked_once(monkeypatch, two):
    """Every near copy met every other one, so a tree of them took time by the square of their number."""
    rows = [r | {"two": two} for r in [*_near(60, 0), *_near(60, 1)] if two or not r["part"]]
    found, linked = [], trie_join.Tree.linked
    monkeypatch.setattr(trie_join.Tree, "linked", lambda tree, tokens, n: [found.append(k) or k for k in linked(tree, tokens, n)])
    pairs = [(r["a"], r["b"]) for r in trie_join._join(pa.Table.from_pylist(rows)).to_pylist()]
    assert len(found) == len(pairs) < len(rows)
    sets = {r["key"]: (r["part"], set(np.frombuffer(r["tokens"], np.uint64).tolist())) for r in rows}
    met = [
        (x, y) for x, (p, s) in sets.items() for y, (q, t) in sets.items()
        if x < y and (p != q or not two) and 100 * len(s & t) >= 75 * len(s | t)
    ]
    assert len(met) > 10 * len(pairs)

    def classes(links):
        root = {x: x for x in sets}
        for _ in range(len(sets)):
            for x, y in links:
                root[x] = root[y] = min(root[x], root[y])
        return root

    assert classes(pairs) == classes(met)


@pytest.mark.parametrize("tree_sets", [4, 1000])
def test_links_are_counted_whole(spark, monkeypatch, tree_sets):
    rows = near_copies(random.Random(3))
    rows += [(10_000 + i, t) for i, t in rows[:9]]  # equal texts
    original = trie_join.joined
    monkeypatch.setattr(trie_join, "joined", lambda d, width, copies: original(d, width, tree_sets, copies))
    found = trie_join.near_duplicates(docs(spark, [(*r, "s") for r in rows]), count_links=True).collect()
    sets = {i: shingle_set(t) for i, t in rows}
    want = {
        i: sum(j != i and bool(x) and 100 * len(x & y) >= 75 * len(x | y) for j, y in sets.items()) for i, x in sets.items()
    }
    assert {r["doc_id"]: r["n_links"] for r in found} == want and max(want.values()) > 2
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_classes(rows)


def test_classes_of_odd_rows(spark):
    rows = [*ODD, (None, "word", "b"), (7, "word", "b"), (7, "word", "b"), (None, "alone", "b"), (8, "x y", "b"), (8, "z", "b")]
    found = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in trie_join.near_duplicates(docs(spark, rows)).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (7, 1, 7), (7, 1, 7), (8, 1, 8), (8, 1, 8)]
    want += [(None, 1, 7), (None, 1, 7), (None, 1, None)]
    assert found == sorted(want, key=str)
    assert trie_join.near_duplicates(docs(spark, rows).limit(0)).count() == 0
    assert trie_join.one_of_each(docs(spark, rows)).columns == docs(spark, rows).columns


def test_tree_finds_what_overlaps():
    draw = np.random.default_rng(8)
    sets = [np.sort(draw.choice(60, size=draw.integers(1, 40), replace=False)).astype(np.uint64) for _ in range(80)]
    sets += sets[:5] + [np.append(s, np.uint64(99)) for s in sets[:20]]
    sizes = [len(s) + int(draw.integers(0, 3)) for s in sets]
    tree = trie_join.Tree(sets, sizes)
    for x, n in zip(sets, sizes, strict=True):
        want = {k for k, y in enumerate(sets) if 175 * len(np.intersect1d(x, y)) >= 75 * (n + sizes[k])}
        assert set(tree.linked(x, n)) == want


def test_components_of_a_long_path(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    found = graph.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in found} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# ---- language -------------------------------------------------------------------


def fold(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


def test_language_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.001"
    found = queries.QUERIES["op9_string_kernel_language"](spark, folder).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(found) == len(truth)
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in found)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_language_of_odd_texts(spark):
    rows = [(i, "der die und das nicht " * 3, "s") for i in range(20)] + [(i, "the and of that with " * 3, "s") for i in range(20, 40)]
    df = docs(spark, rows)
    from pyspark.sql import functions as F

    model = langid.train(df.withColumn("lang", F.when(F.col("doc_id") < 20, "de").otherwise("en")))
    assert model.languages == ["de", "en"]
    odd = [*ODD, (50, "123 !? ²", "s"), (51, "UND nicht die", "s"), (52, "и", "s"), (51, "UND nicht die", "s")]
    got = langid.predict(docs(spark, odd), model)
    assert got.columns == ["doc_id", "text", "source", "lang", "n_chars", "size", "key", "lang_pred", "score"]
    told = {r["doc_id"]: r["lang_pred"] for r in got.collect()}
    assert [told[i] for i in (1, 2, 3, 50)] == ["und"] * 4 and told[51] == "de" and told[52] in ("de", "en") and got.count() == 9
    assert langid.train(df.limit(0)) is None
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}


def test_presence_is_that_of_the_whole_text():
    texts = ["Ab, cd!", "", None, "ab cd", "é"]
    condensed = rawtext.Condensed(rawtext.Texts(pa.array(texts)), langid._LETTERS)
    found = langid.presence(condensed, 0, 5)
    assert (found[0] == found[3]).all() and found[1].sum() == found[2].sum() == 0
    assert found[0].sum() == 5 + 5 + 4 + 3  # a b c d space; pairs, threes and fours within "ab cd "


# ---- quality and toxicity ---------------------------------------------------------


def held_out_accuracy(spark, name, label, modulus, rest):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES[name](spark, folder).collect()
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (fold(r["doc_id"], modulus) == rest) for r in found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] in labels]
    return np.mean([r["predicted"] == labels[r["doc_id"]] for r in held])


def test_quality_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "op1_factorisation_quality", "quality", 5, 0) >= 0.9


def test_toxicity_on_held_out_rows(spark):
    assert held_out_accuracy(spark, "op3_nearest_toxicity", "toxic", 4, 2) >= 0.85


def test_pairs_equal_the_double_sum():
    draw = np.random.default_rng(3)
    k = len(factorisation.STATISTICS)
    machine = factorisation.Machine(
        0.3, draw.normal(size=factorisation.WORDS + k), draw.normal(size=(factorisation.WORDS + k, 4)), np.zeros(k), np.ones(k)
    )
    owner, feature = np.array([0, 0, 0, 1, 1]), np.array([5, 70, factorisation.WORDS + 1, 5, 9])
    value = np.array([0.5, 2.0, -1.0, 3.0, 1.0])
    out, _ = machine.outputs(owner, feature, value, 2)
    for row in (0, 1):
        f, x = feature[owner == row], value[owner == row]
        pairs = sum(machine.v[f[a]] @ machine.v[f[b]] * x[a] * x[b] for a in range(len(f)) for b in range(a))
        assert out[row] == pytest.approx(0.3 + machine.w[f] @ x + pairs)


def test_nearest_equals_a_full_scan():
    draw = np.random.default_rng(9)
    matrix = draw.random((300, 40)) * (draw.random((300, 40)) < 0.1)
    matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    matrix[100:140] = matrix[0]  # ties
    index = toxicity.Index.build(toxicity.Vectors(np.arange(40, dtype=np.uint64), np.ones(40)), matrix, np.arange(300) % 2, np.arange(300))
    found, cosines = index.nearest(matrix[:50], 10)
    every = np.rint(matrix[:50] @ index.matrix / toxicity.STEP).astype(np.int64)
    for row in range(50):
        want = sorted(range(300), key=lambda e, row=row: (-every[row, e], e))[:10]
        assert found[row].tolist() == want
        assert np.allclose(cosines[row], every[row, want] * toxicity.STEP)


def test_lists_of_any_length_give_the_same_neighbours(monkeypatch):
    draw = np.random.default_rng(4)
    matrix = np.maximum(draw.random((200, 90)) - 0.85, 0) * (np.arange(90) % 9 == draw.integers(0, 9, (200, 1)))
    matrix += np.maximum(draw.random((200, 90)) - 0.97, 0)
    vectors, y = toxicity.Vectors(np.arange(90, dtype=np.uint64), np.ones(90)), np.arange(200) % 2
    found = []
    for frequent in (1, 16, 10**6):  # no list in blocks, some, all with two examples
        monkeypatch.setattr(toxicity, "FREQUENT", frequent)
        index = toxicity.Index.build(vectors, matrix, y, np.arange(200))
        assert index.matrix.sum() == pytest.approx(matrix.sum(), rel=1e-5)
        found.append(index.nearest(matrix[:80], 7))
    assert all(np.array_equal(f[0], found[0][0]) and np.allclose(f[1], found[0][1], atol=2e-5) for f in found)


def test_rare_toxic_wording_has_neighbours(spark):
    rows = [(i, f"plain talk of things n{i} m{i}", "s") for i in range(300)]
    rows += [(1000 + i, f"plain talk slur{i // 4} vile{i // 4} of things", "s") for i in range(80)]  # 20 wordings
    rows += [(2000 + i, f"slur{i} vile{i}", "s") for i in range(20)] + [(3000, "nothing known", "s")]
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _, _ in rows if i < 2000], "doc_id bigint, toxic int")
    index = toxicity.train(docs(spark, rows), labels)
    assert len(index.vectors.vocabulary) > 400  # all words of the examples
    got = {r["doc_id"]: r for r in toxicity.scored(docs(spark, rows), index).collect()}
    able = {i // 4 for i in range(80) if fold(1000 + i, 4) != 2}
    for i in able:
        assert {(e["doc_id"] - 1000) // 4 for e in got[2000 + i]["evidence"][:1]} == {i}
    assert min(got[2000 + i]["score"] for i in able) > max(got[i]["score"] for i in range(300))
    assert got[3000]["evidence"] == [] and 0 < got[3000]["score"] < 1


def test_models_of_odd_rows(spark):
    rows = [*ODD, *[(100 + i, "fine words here " * 4 + f"n{i}", "s") for i in range(40)], *[(200 + i, "bad awful nasty " * 4 + f"m{i}", "s") for i in range(40)]]
    df = docs(spark, rows)
    labels = spark.createDataFrame(
        [(i, int(i < 200), int(i >= 200), "x") for i, _, _ in rows if i and i >= 100] + [(None, 1, 1, "x"), (101, None, None, "x")],
        "doc_id bigint, quality int, toxic int, text string",
    )
    index = toxicity.train(df, labels)
    got = {r["doc_id"]: r for r in toxicity.scored(df, index).collect()}
    assert got[100]["predicted"] == 0 and got[200]["predicted"] == 1 and got[1]["predicted"] == 0 and len(got) == 85
    assert all(e["toxic"] == 1 and e["doc_id"] >= 200 and e["cosine"] > 0.99 for e in got[200]["evidence"])
    assert len(got[200]["evidence"]) == 3 and got[2]["evidence"] == []
    machine = factorisation.train(df, labels)
    quality = {r["doc_id"]: r for r in factorisation.scored(df, machine).collect()}
    assert quality[100]["predicted"] == 1 and quality[200]["predicted"] == 0 and len(quality) == 85
    assert toxicity.train(df, labels.limit(0)) is None and factorisation.train(df, labels.limit(0)) is None
    assert {r["score"] for r in toxicity.scored(df, None).collect()} == {0.0}
    assert {r["score"] for r in factorisation.scored(df, None).collect()} == {0.5}
    assert factorisation.scored(df.limit(0), machine).count() == 0 and toxicity.scored(df.limit(0), index).count() == 0


# ---- pipeline ---------------------------------------------------------------------


def test_pipeline_against_plain_steps(spark, tmp_path):
    draw = random.Random(6)
    german, english = ["der", "die", "und", "nicht", "eine", "wir"], ["the", "and", "with", "that", "have", "this"]
    rows = []
    for i in range(60):
        own = [f"{draw.choice(german if i % 2 else english)}{draw.choice('abcdefgh')}" for _ in range(60)]
        rows.append((i, " ".join(own), ["a", "b", None][i % 3]))
    item = " ".join(f"item{k}" for k in range(12))
    secret = "password=abcdef123456"
    rows += [(100, rows[0][1], "a"), (101, rows[1][1] + " more", "b"), (102, f"{rows[2][1]} {item} {secret}", "a"), (103, "1234 !", "a"), (104, None, "b"), (105, item, "b")]
    df = docs(spark, rows).selectExpr("doc_id", "text", "IF(doc_id % 2 = 1, 'de', 'en') AS lang", "source", "n_chars", "score", "key")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "language_id" and corpus_pipeline.ORACLE_SQL is None
    done = df
    kept = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = done.columns
        stage(spark, done, str(tmp_path)).write.parquet(f"{tmp_path}/{number}")
        done = spark.read.parquet(f"{tmp_path}/{number}")
        kept.append({r["doc_id"]: r["text"] for r in done.select("doc_id", "text").collect()})
        assert done.columns == before if number < 4 else done.columns[: len(before)] == before
    assert {103, 104} & set(kept[0]) == set() and set(range(60)) <= set(kept[0])
    classes = brute_classes(list(kept[0].items()))
    assert set(kept[1]) == {i for i, (_, c) in classes.items() if i == c} and not {100, 101} & set(kept[1])
    assert 105 not in kept[2] and all(not brute_hits(t, [(1, item)])[1] for t in kept[2].values())
    assert {i for i in kept[1] if kept[1][i] != kept[2].get(i)} <= {102, 105}
    assert secret not in " ".join(kept[3].values()) and set(kept[3]) == set(kept[2])
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["taken"]) for r in final} == {(r["doc_id"], r["taken"]) for r in done.collect()}
    total = sum(len(t.split()) for t in kept[3].values())
    assert sum(r["taken"] for r in final) == pytest.approx(total, rel=0.1)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_join_task_gives_the_same_links_in_any_order():
    draw = np.random.default_rng(2)
    base = np.sort(draw.choice(500, size=60, replace=False)).astype(np.uint64)
    rows = []
    for i in range(30):
        tokens = np.unique(np.concatenate([base[draw.random(60) < 0.93], draw.choice(500, 3).astype(np.uint64)]))
        rows.append({"group": b"g", "one": 0, "two": 0, "part": 0, "key": bytes([i]), "n": len(tokens), "tokens": tokens.tobytes()})
    first = trie_join._join(pa.Table.from_pylist(rows)).to_pylist()
    assert len(first) > 5
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        assert trie_join._join(pa.Table.from_pylist(rows)).to_pylist() == first
