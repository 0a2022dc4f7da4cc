"""Column functions against literal cases and Python brute force."""

import re
from collections import Counter

from pyspark.sql import functions as F

from locale_lake.functions import answers as an
from locale_lake.functions import classify as cl
from locale_lake.functions import fixed
from locale_lake.functions import glossary as gl
from locale_lake.functions import text as tx


def apply(spark, values, function, schema="v string"):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "i int, " + schema)
    return [r[0] for r in frame.orderBy("i").select(function.alias("out")).collect()]


CLASSIFIED = [
    ("defName", "Any value", "denied_tag"), ("DEFNAME", "x y", "denied_tag"),
    ("driverClass", "x y", "denied_tag"), ("moduleTypeID", "kitchen", "denied_tag"),
    ("slottypeid", "kitchen", "text"), ("integrationDefName", "a b", "denied_tag"),
    ("installableSegmentTypes", "a b", "denied_tag"), ("installedComps", "a b", "text"),
    ("impact", "low", "denied_tag"), ("label", "", "blank"), ("label", None, "blank"),
    ("label", " \n\t", "blank"), ("label", "123", "number"), ("label", " -4.5% ", "number"),
    ("label", "true", "boolean"), ("label", "False", "boolean"), ("label", "(5,3)", "no_letter"),
    ("label", "(7.25; -3)", "no_letter"), ("label", "9 doors", "text"),
    ("label", "Iron_Gate", "underscore_word"), ("label", "rough_cut board", "text"),
    ("label", "Art/Rooms/Blue", "path"), ("label", "a.b.c/d-e", "path"),
    ("label", "red/green paint", "text"), ("label", "#0A1B2C", "hex_colour"),
    ("label", "Acme.TaskRunner", "dotted_identifier"), ("label", "Kitchen", "text"),
    ("label", "kitchen", "text"), ("label", "BoatEngine", "humped_identifier"),
    ("label", "QX", "humped_identifier"), ("label", "camelCase", "text"),
    ("label", "Лампа", "text"), ("label", "words\\n\\nmore words", "text"),
]


def test_classify(spark):
    ours = apply(
        spark, [(t, v) for t, v, _ in CLASSIFIED], cl.classify(F.col("tag"), F.col("v")),
        "tag string, v string",
    )
    assert ours == [reason for *_, reason in CLASSIFIED]


def test_rule_strings(spark):
    rows = [
        ("rulesStrings", "greeting->Good morning", True),
        ("RULESSTRINGS", "pick(kind=song)   ->words\nand more", True),
        ("label", "greeting->Good morning", False),
        ("rulesStrings", "no arrow", False),
    ]
    ours = apply(
        spark, [r[:2] for r in rows], tx.is_rule_string(F.col("t"), F.col("v")), "t string, v string"
    )
    assert ours == [r[2] for r in rows]
    (parts,) = apply(spark, ["pick(kind=b)   ->own words"], tx.rule_parts(F.col("v")))
    assert tuple(parts) == ("pick(kind=b)   ", "own words")


HELD = [
    "{0} and [ownerName] said \\n hello (rest of text)", "key->text {x}", "key(tag=x) -> a",
    "[x]->words", "<color=#123abc>green</color>\\r", "plain", "", "{не} [да]", "{a b} [c-d]",
    "{0}{1}", "  {0}  ", "a {0}\nb",
]
PATTERN = re.compile(
    r"\{\w+\}|\[\w+\]|</?color(?:=[^>]*)?>|\\n|\\r|^[\w.\[\]]+(?:\([^)]*\))?\s*->"
)


def test_placeholders_segments_rebuild(spark):
    v = F.col("v")
    assert apply(spark, HELD, tx.placeholders(v)) == [PATTERN.findall(t) for t in HELD]
    assert apply(spark, HELD, tx.segments(v)) == [PATTERN.split(t) for t in HELD]
    assert apply(spark, HELD, tx.rebuild(tx.segments(v), tx.placeholders(v))) == HELD


def test_guard(spark):
    pairs = [
        (s, a) for s in HELD for a in [s, s.replace("{0}", "", 1), s + " {0}", s.upper(), "", "{0} {0}"]
    ]

    def kept(source, answer):
        need, got = Counter(PATTERN.findall(source)), Counter(PATTERN.findall(answer))
        return all(got[k] >= n for k, n in need.items())

    ours = apply(spark, pairs, tx.placeholders_kept(F.col("s"), F.col("a")), "s string, a string")
    assert ours == [kept(s, a) for s, a in pairs]


def test_edges_and_sentences(spark):
    texts = ["  a b\t", "\n", "", "x", " y "]
    v = F.col("v")
    ours = apply(spark, texts, F.array(tx.lead_space(v), tx.strip(v), tx.trail_space(v)))
    for text, (lead, body, trail) in zip(texts, ours):
        assert body == text.strip()
        if body:
            assert lead + body + trail == text
    long = ("First one is here. " * 12 + "And! the?  last").strip()
    (pieces,) = apply(spark, [long], tx.sentences(v))
    assert pieces == [p for p in re.split(r"(?<=[.!?])\s+", long) if p]
    assert apply(spark, ["Short. Text."], tx.sentences(v)) == [["Short. Text."]]


def test_trivial_and_truncated(spark):
    words = ["Wall", "a b", "", " ", "a-b", "thirteenchars", "twelve chars", "...", "Лампа", "x_y"]

    def trivial(t):
        s = t.strip()
        return bool(s) and len(s) <= 12 and len(re.findall(r"\w+", s)) <= 1

    assert apply(spark, words, cl.is_trivial(F.col("v"))) == [trivial(w) for w in words]
    pairs = [(" ".join("a" * n), " ".join("b" * m)) for n in range(12) for m in range(12)]
    ours = apply(spark, pairs, cl.is_truncated(F.col("s"), F.col("o")), "s string, o string")
    assert ours == [
        len(s.split()) >= 4 and len(o.split()) < len(s.split()) * 0.7 for s, o in pairs
    ]


def test_foreign_script(spark):
    rows = [("ru", "текст"), ("ru", "текст 漢"), ("de", "漢"), ("ru", "かな"), ("ru", "한글")]
    ours = apply(spark, rows, cl.has_foreign_script(F.col("t"), F.col("l")), "l string, t string")
    assert ours == [False, True, False, True, True]


def test_escape_comment_folder(spark):
    v = F.col("v")
    assert apply(spark, ["a & <b> \"c\""], tx.xml_escape(v)) == ["a &amp; &lt;b&gt; \"c\""]
    assert apply(spark, ["a -- b", "---", "x-", "ok"], tx.xml_comment(v)) == [
        "a - - b", "- - - ", "x- ", "ok",
    ]
    assert apply(spark, ["ru", "UK", "zh", "eO"], tx.language_folder(v)) == [
        "Russian", "Ukrainian", "ChineseSimplified", "Eo",
    ]


TERMS = {"door": "Tür", "oak": "eichen", "oak door": "Eichentür", "Elm": "Ulme"}

# text, what a model gets (T stands for the stand-in word), and the replacements
PROTECTED = [
    ("Oak door and a door", " T0  and a  T1 ", ["Eichentür", "Tür"]),
    ("no terms", "no terms", []),
    ("DOOR, door.", " T0 ,  T1 .", ["Tür", "Tür"]),
    ("doorway door-post", "doorway  T0 -post", ["Tür"]),
    ("elm Oak", " T0   T1 ", ["Ulme", "Eichen"]),
    ("", "", []),
    ("Tür door", "Tür  T0 ", ["Tür"]),
    ("oak", " T0 ", ["eichen"]),
    ("xdoor doory (door)!", "xdoor doory ( T0 )!", ["Tür"]),
]
GLOSSED = [text for text, _, _ in PROTECTED]


def stand_in(text):
    return re.sub(r"T(\d)", rf"{fixed.TERM_TOKEN}\1", text)


def test_glossary_protect(spark):
    v = F.col("v")
    assert apply(spark, GLOSSED, gl.protect(v, TERMS)) == [stand_in(t) for _, t, _ in PROTECTED]
    assert apply(spark, GLOSSED, gl.replacements(v, TERMS)) == [r for _, _, r in PROTECTED]


def test_glossary_restore(spark):
    answers = [
        ("T0-Schloss and T1 .", ["t0", "t1"], "t0 Schloss and t1."),
        ("a  T7 b", ["t0"], "a T7 b"),
        ("T0 T0,x", ["t0"], "t0 t0,x"),
        ("none", [], "none"),
        (" T99999999999 ", ["t0"], "T99999999999"),
        ("a - T0 - b", ["t"], "a t b"),
    ]
    rows = [(stand_in(text), tokens) for text, tokens, _ in answers]
    ours = apply(spark, rows, gl.restore(F.col("v"), F.col("t")), "v string, t array<string>")
    assert ours == [stand_in(text) for _, _, text in answers]


RAW = [
    ("<ans>\n1: one\n2: \"two\"\n</ans>", 2, {1: "one", 2: "two"}, {1: "one", 2: "two"}, None),
    ("<ANS>2: b\n2: c\n5: x</Ans> 1: z", 3, {2: "c"}, {2: "c"}, None),
    ("1: a\nnoise\n 2 :  b ", 2, {1: "a", 2: "b"}, {1: "a", 2: "b"}, "2 :  b"),
    ("<ans></ans>", 2, {}, {}, ""), ("", 2, {}, {}, ""), ("1:\n", 1, {1: ""}, {}, "1:"),
    ("thinking\n\n\"last line\"\n \n", 1, {}, {}, "last line"),
    ("0: no\n99999999999999999999: no", 1, {}, {}, "99999999999999999999: no"),
]


def test_answers(spark):
    rows = [r[:2] for r in RAW]
    schema = "raw string, n int"
    assert apply(spark, rows, an.rewrite_answers(F.col("raw"), F.col("n")), schema) == [r[2] for r in RAW]
    assert apply(spark, rows, an.check_answers(F.col("raw"), F.col("n")), schema) == [r[3] for r in RAW]
    single = apply(spark, rows, an.single_answer(F.col("raw")), schema)
    for ours, row in zip(single, RAW):
        if row[4] is not None:
            assert ours == row[4]

