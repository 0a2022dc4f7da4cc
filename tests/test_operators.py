"""Joins, numbering, memory, glossary and inference against brute force."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from locale_lake.functions import glossary as gl
from locale_lake.operators import glossary as go
from locale_lake.operators import inference as inf
from locale_lake.operators import inherit, layers, reuse, skew
from locale_lake.sinks import files as sink
from locale_lake.sources import state as st
from tests.test_functions import GLOSSED, PROTECTED, TERMS, stand_in


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_equals_join_with_hot_keys(spark, how):
    rng = random.Random(1)
    many = spark.createDataFrame(
        [("hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", i) for i in range(600)],
        "k string, v int",
    )
    one = spark.createDataFrame(
        [("hot", 1), ("hot", 2)] + [(f"k{i}", i) for i in range(0, 60, 2)], "k string, w int"
    )
    expected = sorted(map(tuple, many.join(one, "k", how).select("k", "v", "w").collect()), key=str)
    for hot_rows, limit in ((20, None), (10**6, None), (20, 100), (20, 3)):
        ours = skew.lookup(many, one, ["k"], how, hot_rows, 8, limit).select("k", "v", "w")
        assert sorted(map(tuple, ours.collect()), key=str) == expected
    assert skew.hot_keys(many, ["k"], 100).count() == 1


def test_number_rows_over_levels(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.randrange(9), rng.randrange(50), i) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, x int, y int, z int").repartition(5)
    ours = {
        r.z: r.n
        for r in skew.number_rows(frame, ["g"], ["x", "y"], ["z"], "n").collect()
    }
    for g in "ab":
        ordered = sorted(r for r in rows if r[0] == g)
        assert [ours[r[3]] for r in ordered] == list(range(len(ordered)))


@pytest.mark.parametrize("bucket", [1, 3, 4096])
def test_memory_equals_a_sequential_run(spark, bucket):
    rng = random.Random(bucket)
    rows = []
    for package in range(12):
        for seq in range(rng.randrange(8)):
            rows.append((
                f"t{rng.randrange(4)}", package, seq,
                f"pin{package}.{seq}" if rng.random() < 0.3 else None,
                f"new{package}.{seq}" if rng.random() < 0.8 else None,
            ))
    frame = spark.createDataFrame(
        rows, "source_text string, pkg_seq long, seq long, pinned_text string, fresh_text string"
    ).repartition(4)
    ours = {
        (r.source_text, r.pkg_seq): r.memory_text
        for r in reuse.propagate_memory(frame, bucket_size=bucket).collect()
    }
    memory, expected = {}, {}
    for package in range(12):
        after = {}
        for text, _, seq, pinned, fresh in sorted(
            (r for r in rows if r[1] == package), key=lambda r: r[2]
        ):
            expected[text, package] = memory.get(text)
            after[text] = pinned or memory.get(text) or fresh
        memory.update({k: v for k, v in after.items() if v})
    assert ours == expected


def test_settling_order_and_tombstones(spark):
    keys = ["key"]
    units = spark.createDataFrame(
        [("a", "A"), ("b", "B"), ("c", "C"), ("d", "D"), ("e", "E"), ("f", "A2")], "key string, source_text string"
    )
    source = spark.createDataFrame([("a", "A"), ("b", "B old"), ("c", "C"), ("f", "A2")], "key string, text string")
    target = spark.createDataFrame(
        [("a", "ra", "draft"), ("b", "rb", "draft"), ("c", "rc", "draft"), ("f", "rf", "override")],
        "key string, text string, origin string",
    )
    edits = spark.createDataFrame(
        [("c", "edit c", False), ("e", "gone", True)], "key string, text string, deleted boolean"
    )
    memory = spark.createDataFrame(
        [("D", "old", 1), ("D", "md", 2), ("C", "mc", 1)], "source_text string, target_text string, seq long"
    )
    known = reuse.reuse_unchanged(units, source, target, keys)
    known = reuse.resolve(reuse.lookup_memory(reuse.apply_overrides(known, edits, keys), memory))
    assert {r.key: (r.settled_text, r.origin) for r in known.collect()} == {
        "a": ("ra", "reuse"), "b": (None, None), "c": ("edit c", "override"),
        "d": ("md", "memory"), "e": (None, None), "f": (None, None),
    }
    total = reuse.reuse_summary(known.withColumn("p", F.lit("p")), ["p"]).first()
    assert (total.total, total.unchanged, total.edits, total.from_memory, total.to_do) == (6, 2, 1, 1, 3)
    stored = spark.createDataFrame([("x", "1", True), ("y", "2", False)], "key string, text string, deleted boolean")
    fresh = spark.createDataFrame([("y", "3")], "key string, text string")
    assert [tuple(r) for r in reuse.upsert_overrides(stored, fresh, keys).collect()] == [("y", "3")]


def test_new_key_policy(spark):
    units = spark.createDataFrame([("k", "old")], "key string, source_text string")
    patches = spark.createDataFrame(
        [("k", "p1", 1), ("k", "p2", 2), ("n", "n1", 1), ("n", "n2", 2)],
        "key string, source_text string, seq int",
    )
    for policy, new in (("first", "n1"), ("last", "n2")):
        got = layers.apply_patches(units, patches, ["key"], ["seq"], policy)
        assert {r.key: r.source_text for r in got.collect()} == {"k": "p2", "n": new}


def test_closure_stops_at_cycles_and_gaps(spark):
    links = spark.createDataFrame(
        [(1, None), (2, 1), (3, 2), (4, 9), (5, 6), (6, 5), (7, 7)], "id int, up int"
    )
    found = {tuple(r) for r in inherit.ancestors(links, "id", "up").collect()}
    assert found == {(2, 1, 1), (3, 2, 1), (3, 1, 2), (5, 6, 1), (6, 5, 1)}


def test_term_join_equals_pattern(spark):
    glossary = spark.createDataFrame(
        [("en", k, v) for k, v in TERMS.items()], "lang string, term string, replacement string"
    )
    units = spark.createDataFrame(
        [(i, "en", t) for i, t in enumerate(GLOSSED)] + [(99, "xx", "door")],
        "unit_id int, lang string, text string",
    )
    for hot_rows in (1, 10**6):
        got = {r.unit_id: r for r in go.protect_terms(units, glossary, 3, hot_rows=hot_rows).collect()}
        for i, (_, text, tokens) in enumerate(PROTECTED):
            assert (got[i].protected, got[i].tokens) == (stand_in(text), tokens)
        assert (got[99].protected, got[99].tokens) == ("door", [])


FORMS = {
    "de": {"alt": {("Masc", "Sing"): "alter", ("Neut", "Sing"): "altes", (None, "Plur"): "alte"}},
    "ru": {"новый": {("Fem", "Sing"): "новая", (None, "Plur"): "новые"}},
}
NOUNS = [
    ("de", "Baum", "Masc", "Sing"), ("de", "Haus", "Neut", "Sing"), ("de", "Wege", "Masc", "Plur"),
    ("ru", "книга", "Fem", "Sing"), ("ru", "книги", "Fem", "Plur"),
]


@pytest.mark.parametrize(
    "lang, text, expected",
    [
        ("de", "Ein alt Baum", "Ein alter Baum"),
        ("de", "Alt  Haus neben Wege alt", "Altes Haus neben Wege alte"),
        ("de", "alt Fremdwort", "alt Fremdwort"),
        ("de", "der alt, Haus", "der alt, Haus"),
        ("de", "alt Baum alt Haus", "alter Baum altes Haus"),
        ("de", "nichts hier", "nichts hier"),
        ("ru", "книга новый, новый книги", "книга новая, новые книги"),
        ("xx", "alt Baum", "alt Baum"),
    ],
)
def test_agreement(spark, lang, text, expected):
    units = spark.createDataFrame([(1, lang, text)], "unit_id int, lang string, text string")
    nouns = spark.createDataFrame(NOUNS, "lang string, noun string, gender string, number string")
    assert go.agree(units, nouns, FORMS).first().agreed == expected


def shout(texts):
    return [t.upper() for t in texts]


def test_draft_keeps_markup_spaces_and_blanks(spark):
    long = "One sentence here.  " * 15
    texts = ["{0} hello  [x] you\\n", "  \t", "", "same", "same", "key->  text ", long + "{0} end"]
    units = spark.createDataFrame(list(enumerate(texts)), "unit_id int, source_text string")
    got = [r.draft_text for r in inf.draft(units, shout, "de", delays=()).orderBy("unit_id").collect()]
    assert got[:6] == ["{0} HELLO  [x] YOU\\n", "  \t", "", "SAME", "SAME", "key->  TEXT "]
    assert got[6] == " ".join(["ONE SENTENCE HERE."] * 15) + "  {0} END"


def test_each_distinct_piece_is_asked_once(spark, tmp_path):
    log = str(tmp_path / "log")

    def record(texts):
        with open(log, "a") as out:
            out.writelines(t + "\n" for t in texts)
        return texts

    units = spark.createDataFrame([(i, "same words") for i in range(50)], "unit_id int, source_text string")
    inf.draft(units, record, "de", delays=()).collect()
    assert open(log).read() == "same words\n"


def test_frequent_pieces_are_spread_not_lost(spark):
    texts = [f"{{0}} common [x] own {i % 9}" for i in range(60)]
    units = spark.createDataFrame(list(enumerate(texts)), "unit_id int, source_text string")
    got = inf.draft(units, shout, "de", delays=(), hot_rows=10).orderBy("unit_id").collect()
    assert [r.draft_text for r in got] == [f"{{0}} COMMON [x] OWN {i % 9}" for i in range(60)]


def test_script_guard_takes_a_clean_second_answer(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def slip(texts):
        import os
        out = []
        for t in texts:
            mark = f"{seen}.{abs(hash(t))}"
            out.append(t.upper() + ("" if os.path.exists(mark) else "漢"))
            open(mark, "w").close()
        return out

    units = spark.createDataFrame([(1, "one thing")], "unit_id int, source_text string")
    assert inf.draft(units, slip, "ru", delays=()).first().draft_text == "ONE THING"


def test_retry_then_error_row(spark):
    calls = []

    def flaky(batch):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("locked")
        return batch

    assert inf.call_with_retry(flaky, ["a"], (0, 0, 0)) == (["a"], None)
    assert inf.call_with_retry(lambda b: 1 / 0, ["a"], ())[1].startswith("ZeroDivisionError")
    assert inf.call_with_retry(lambda b: [], ["a"], ())[0] == [None]


def _units(spark, n=45):
    return spark.createDataFrame(
        [(f"u{i}", "p", f"k{i}", 0, f"f{i // 7}", i % 7, "Wall" if i % 9 == 0 else f"text number {i} {{0}}", f"draft {i} {{0}}")
         for i in range(n)],
        "unit_id string, pkg_id string, key string, layer int, sort_path string, seq long, source_text string, draft_text string",
    )


def answer_all(calls):
    out = []
    for call in calls:
        lines = call["prompt"].split("\n")
        assert call["n_items"] == len(lines)
        body = [f"{i}: better {i} {{0}}" for i in range(1, len(lines) + 1)]
        body[0] = "1: lost its placeholder"
        out.append("<ans>" + "\n".join(body) + "</ans>")
    return out


def test_polish_numbers_guards_and_falls_back(spark):
    got = inf.polish(_units(spark), answer_all).collect()
    by_key = {r.key: r for r in got}
    assert len(got) == 45
    batches = defaultdict(list)
    for i in range(45):
        if i % 9:
            batches[i // 12].append(i)
    for members in batches.values():
        for n, i in enumerate(members, 1):
            row = by_key[f"k{i}"]
            expected = f"draft {i} {{0}}" if n == 1 else f"better {n} {{0}}"
            assert (row.final_text, row.polished) == (expected, n > 1)
    assert all(not by_key[f"k{i}"].polished for i in range(0, 45, 9))

    def down(calls):
        raise TimeoutError("no server")

    lost = inf.polish(_units(spark, 5), down, mode=inf.CHECK).collect()
    assert {r.final_text for r in lost} == {f"draft {i} {{0}}" for i in range(5)}


def test_json_state(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text('{"k": "v", "n": 3}')
    (tmp_path / "s/b.json").write_text("not json")
    (tmp_path / "s/c.json").write_text("[1]")
    got = {(r.key, r.text) for r in st.read_json_state(spark, str(tmp_path / "s")).collect()}
    assert got == {("k", "v"), ("n", "3")}
    assert st.read_json_state(spark, str(tmp_path / "none")).count() == 0


def test_large_files_are_split_and_names_told_apart(spark, tmp_path):
    rows = [
        ("p", str(tmp_path / "p"), "keyed", "Keyed/K.xml", 0, "a", i, f"k{i}", False, False, "s", f"t{i}")
        for i in range(25)
    ]
    frame = spark.createDataFrame(
        rows,
        "pkg_id string, out_root string, channel string, out_path string, layer int, sort_path string, "
        "seq long, key string, is_comment boolean, has_bom boolean, source_text string, final_text string",
    )
    (written,) = sink.write_language_files(frame, "Russian").collect()
    assert written.lines == 25
    text = (tmp_path / "p/Languages/Russian/Keyed/K.xml").read_text()
    assert re.findall(r"<(k\d+)>", text) == [f"k{i}" for i in range(25)]
    packages = spark.createDataFrame([("/a/m",), ("/b/m",), ("/b/n",)], "pkg_id string")
    names = [r.out_root for r in sink.output_folders(packages, "/out", "ru").orderBy("pkg_id").collect()]
    assert len(set(names)) == 3 and names[2] == "/out/n_RU"


def test_glossary_of_no_language_changes_nothing(spark):
    frame = spark.createDataFrame([("xx", "a pipe")], "lang string, v string")
    out = gl.by_language(F.col("lang"), {"en": TERMS}, lambda t: gl.protect(F.col("v"), t), F.col("v"))
    assert frame.select(out.alias("o")).first().o == "a pipe"


def test_term_tree_and_term_join_find_the_same(spark, monkeypatch):
    from locale_lake.operators import glossary as go

    rows = [
        (1, "en", "The Oil Lamp, the oil lamp's oil; LAMP oil lamps"),
        (2, "en", "éa oil  lamp oil-lamp oil lamp"),
        (3, "de", "oil lamp Öl"),
        (4, "xx", "oil"),
        (5, "en", None),
        (6, "en", ""),
        (7, "en", "a b c d a b c a b"),
    ]
    units = spark.createDataFrame(rows, "unit_id int, lang string, text string")
    terms = [("en", "oil lamp", "lampe"), ("en", "oil", "huile"), ("en", "Oil-Lamp", "x-y"), ("de", "öl", "OIL"), ("en", "a b c d", "four"), ("en", "a b", "two"), ("en", "b c", "never"), ("en", "lamp", "lumière"), ("en", "a b c d a b c", "long")]
    glossary = spark.createDataFrame(terms, "lang string, term string, replacement string")
    shown = lambda max_words: sorted((r.unit_id, [tuple(h) for h in r.hits]) for r in go.find_terms(units, glossary, max_words).collect())
    walked = {n: shown(n) for n in (1, 2, 4)}
    monkeypatch.setattr(go, "BROADCAST_TERMS", 0)
    assert {n: shown(n) for n in (1, 2, 4)} == walked
    hits = dict(walked[4])
    assert [h[2:] for h in hits[1]] == [("Oil Lamp", "Lampe"), ("oil lamp", "lampe"), ("oil", "huile"), ("LAMP", "Lumière"), ("oil", "huile")]
    assert [h[2] for h in hits[7]] == ["a b c d", "a b", "a b"] and [h[3] for h in hits[3]] == ["OIL"]
    assert go.longest_term(glossary) == 7


def test_parser_streams_documents():
    import tracemalloc

    from locale_lake.sources.xml import node_rows

    text = b"\xef\xbb\xbf<a x='1'>t<!-- c -->u<b>v &amp; w</b>y<?pi z?><c/><!--d--></a><!--e-->"
    plain = [(r[0], r[1], r[2], r[3], r[4], r[5]) for r in node_rows(text, False)]
    assert plain == [
        ([], ["a"], "a", [("x", "1")], "tu", False), ([0], ["a", "b"], "b", [], "v & w", False), ([1], ["a", "c"], "c", [], "", False),
    ]
    spoken = [(r[0], r[2], r[4], r[5], r[6]) for r in node_rows(text, True)]
    assert spoken == [
        ([], "a", "t", False, True), ([0], None, " c ", True, True), ([1], "b", "v & w", False, True),
        ([2], "c", "", False, True), ([3], None, "d", True, True),
    ]
    errors = [list(node_rows(c, False)) for c in (b"", b"<a><b></a>", b"<a>&none;</a>", b"<a/><b/>")]
    assert all(len(e) == 1 and e[0][7] for e in errors)
    large = b"<r>" + b"".join(b"<i n='%d'><t>text %d</t></i>" % (i, i) for i in range(60_000)) + b"</r>"
    tracemalloc.start()
    try:
        assert sum(1 for _ in node_rows(large, False)) == 120_001
        assert tracemalloc.get_traced_memory()[1] < 8_000_000
    finally:
        tracemalloc.stop()


def test_ancestors_of_a_long_chain(spark):
    rows = [(i, i - 1 if i else None) for i in range(700)] + [(1000, 1001), (1001, 1002), (1002, 1001), (2000, 2000), (3000, 9999)]
    found = inherit.ancestors(spark.createDataFrame(rows, "n int, up int"), "n", "up").collect()
    told = {}
    for r in found:
        told.setdefault(r.n, []).append((r.dist, r.ancestor))
    assert sorted(told[699]) == [(d, 699 - d) for d in range(1, 700)] and len(told[1]) == 1 and 0 not in told
    assert sorted(told[1000]) == [(1, 1001), (2, 1002)] and told[1001] == [(1, 1002)] and told[1002] == [(1, 1001)]
    assert 2000 not in told and 3000 not in told and len(found) == 699 * 700 // 2 + 4


def test_terms_of_a_table_reach_the_model_and_come_back(spark):
    from locale_lake.operators import inference as inf

    units = spark.createDataFrame([("u1", "Red oil lamp here"), ("u2", "nothing")], "unit_id string, source_text string")
    glossary = spark.createDataFrame([("de", "oil lamp", "Öllampe"), ("fr", "nothing", "rien")], "lang string, term string, replacement string")
    lexicon = spark.createDataFrame([("de", "öllampe", "Fem", "Sing")], "lang string, noun string, gender string, number string")
    forms = {"de": {"rot": {("Fem", "Sing"): "rote"}}}
    asked = lambda texts: [t.replace("Red", "Rot").replace("here", "hier") for t in texts]
    told = {r.unit_id: r.draft_text for r in inf.draft(units, asked, "de", glossary, delays=(), lexicon=lexicon, inflections=forms).collect()}
    assert told == {"u1": "Rote Öllampe hier", "u2": "nothing"}
    plain = inf.draft(units, asked, "de", {"oil lamp": "Öllampe"}, delays=()).filter("unit_id = 'u1'").first()
    assert plain.draft_text == "Rot Öllampe hier"


def test_fold_and_levels_resolve_the_same_trees(spark, monkeypatch):
    draw = random.Random(12)

    def nodes(tree_id):
        out = [(tree_id, [], [], "Def", "", {})]

        def grow(pos, tags, depth):
            n = draw.choice([0, 1, 2, 3]) if depth < 4 else 0
            only_items = draw.random() < 0.4
            for i in range(n):
                tag = "li" if only_items else draw.choice(["a", "b", "c", "li"])
                here, way = [*pos, i], [*tags, tag]
                attrs = {"Inherit": draw.choice(["False", "true"])} if draw.random() < 0.2 else {}
                at = len(out)
                out.append(None)
                below = grow(here, way, depth + 1)
                text = draw.choice(["", " ", f"{tree_id}-{here}"]) if not below else ""
                out[at] = (tree_id, here, way, tag, text, attrs)
            return n

        grow([], [], 0)
        return out

    ups = {f"d{i}": f"d{draw.randrange(i)}" for i in range(1, 40)} | {"x": "y", "y": "z", "z": "y", "lone": "nowhere"}
    rows = [r for t in ["d0", *ups] for r in nodes(t)]
    trees = spark.createDataFrame(rows, "tree_id string, pos array<int>, tags array<string>, tag string, text string, attrs map<string,string>")
    links = spark.createDataFrame([("d0", None), *ups.items()], "tree_id string, up string")
    chain = inherit.ancestors(links, "tree_id", "up").select("tree_id", F.col("ancestor").alias("anc_id"), "dist")

    def shown():
        told = defaultdict(list)
        for r in inherit.merge_inherited(trees, chain).collect():
            told[r.tree_id].append((r.pos, r.tags, r.tag, r.text))
        return {t: [x[1:] for x in sorted(found, key=lambda x: x[0])] for t, found in told.items()}

    folded = shown()
    assert set(folded) == {"d0", *ups} and max(map(len, folded.values())) > 12
    monkeypatch.setattr(inherit, "FOLD_LEVELS", 0)
    assert shown() == folded
    monkeypatch.setattr(inherit, "FOLD_LEVELS", 3)
    assert shown() == folded


def test_a_small_run_shuffles_its_own_memory_only(spark, monkeypatch):
    memory = spark.createDataFrame([("t", f"s{i % 500}", f"r{i}", i) for i in range(1000)], "tgt_lang string, source_text string, target_text string, seq bigint")
    rows = [("t", "s1", None, None), ("t", "s499", None, None), ("u", "s1", None, None), ("t", "s2", "kept", None), ("t", "new", None, None)]
    units = spark.createDataFrame(rows, "tgt_lang string, source_text string, reused_text string, override_text string")
    shown = lambda: sorted((r.tgt_lang, r.source_text, r.memory_text or "") for r in reuse.lookup_memory(units, memory, ["tgt_lang"]).collect())
    told = shown()
    assert told == [("t", "new", ""), ("t", "s1", "r501"), ("t", "s2", ""), ("t", "s499", "r999"), ("u", "s1", "")]
    assert reuse._asked_for(memory, units, ["tgt_lang", "source_text"]).count() == 6
    monkeypatch.setattr(reuse, "BROADCAST_TEXTS", 0)
    assert reuse._asked_for(memory, units, ["tgt_lang", "source_text"]) is memory and shown() == told
