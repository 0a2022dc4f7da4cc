"""The scan, package by package, from one pass over all fixture packages."""

from collections import defaultdict

import pytest

from locale_lake.plans.scan import scan_corpus
from locale_lake.sources import files as fs
from tests import packages


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    packages.write(root)
    table = fs.packages_in(spark, str(root))
    scan = scan_corpus(spark, [str(root)], table)
    units = defaultdict(list)
    rows = scan.units.orderBy("pkg_id", "layer", "sort_path", "seq").collect()
    for row in rows:
        units[row.pkg_id.rsplit("/", 1)[1]].append(row)
    return {
        "units": units,
        "packages": {r.pkg_id.rsplit("/", 1)[1]: r for r in scan.packages.collect()},
        "quarantine": {r.file_id.split("/corpus0/")[-1] for r in scan.quarantine.collect()},
        "roots": [r.asDict() for r in scan.roots.collect()],
    }


def texts(scanned, name):
    return [(r.key, r.source_text) for r in scanned["units"][name] if not r.is_comment]


def test_unit_ids_are_unique(scanned):
    ids = [r.unit_id for rows in scanned["units"].values() for r in rows]
    assert len(ids) == len(set(ids))


@pytest.mark.parametrize(
    "name, expected",
    [
        ("defs_only", [("Lamp.label", "oil lamp"), ("Lamp.description", "It gives light.")]),
        ("keyed_plus_defs", [("Greeting", "Hello there"), ("Lamp.label", "oil lamp"), ("Lamp.description", "It glows.")]),
        ("partial_cover", [("Lamp.label", "oil lamp"), ("Cut.label", "cut wood")]),
        ("empty_cover", []),
        ("stale", [("Lamp.label", "Kitchen")]),
        ("nested_version", [("Lamp.label", "oil lamp")]),
        ("numeric_version", [("Lamp.label", "newest lamp")]),
        ("manifest", [("New.label", "new lamp")]),
        ("manifest_void", [("New.label", "new lamp")]),
        ("conditional", [("Base.label", "base lamp"), ("Extra.label", "extra lamp")]),
        ("old_language", [("K", "new text")]),
        ("root_language", [("K", "root text")]),
        ("inherit_files", [("Leaf.label", "leaf lamp"), ("Leaf.description", "From the base.")]),
        ("inherit_chain", [("Leaf.label", "mid lamp"), ("Leaf.description", "From grand.")]),
        ("inherit_list", [("Leaf.pack.rulesStrings.0", "a->parent one"), ("Leaf.pack.rulesStrings.1", "b->child two")]),
        ("inherit_self", [("Me.steps.0", "own step")]),
        ("patch_multi", [("Door.description", "Shared words here."), ("Wall.description", "Shared words here.")]),
        ("patch_nested", [("Throne.building.useLabel", "use the throne"), ("Throne.stages.1.label", "a label")]),
        ("patch_skip", []),
        ("patch_whole", [("Fresh.label", "fresh words")]),
        ("patches", [("Lamp.label", "patched lamp"), ("Wall.description", "A sturdy wall.")]),
        ("patch_order", [("Lamp.label", "other lamp"), ("New.label", "first new")]),
        ("quest", [("Q.label", "quest name"), ("Q.text", "some words")]),
        ("malformed", [("K", "good key"), ("Lamp.label", "good lamp")]),
        ("same_name", [("Twin.label", "thing twin"), ("Twin.label", "job twin")]),
        ("bom", [("A", "with bom")]),
        ("german", []),
        ("line_list", [("K", "some text"), ("Strings/Names/First.txt:1", "Anna"),
                       ("Strings/Names/First.txt:2", "Bert"), ("Strings/Names/First.txt:4", "Cleo")]),
    ],
)
def test_units(scanned, name, expected):
    ours = texts(scanned, name)
    if name == "inherit_chain" or name.startswith("patch_"):
        assert sorted(ours) == sorted(expected)
    else:
        assert ours == expected


def test_dotted_type_stands_under_both_names(scanned):
    rows = {(r.def_type, r.key, r.source_text, r.out_path) for r in scanned["units"]["dotted_type"]}
    assert rows == {
        ("FooDef", "One.label", "patched one", "DefInjected/FooDef/Foo.xml"),
        ("My.Ns.FooDef", "One.label", "patched one", "DefInjected/My.Ns.FooDef/Foo.xml"),
    }


def test_inheritance_rules(scanned):
    by_def = defaultdict(dict)
    for key, text in texts(scanned, "inherit_rules"):
        name, path = key.split(".", 1)
        assert path not in by_def[name] or path.startswith("many.x")
        by_def[name].setdefault(path, text)
    base = {
        "label": "base label", "steps.0": "first step", "steps.1": "second step",
        "stages.0.label": "stage one", "stages.0.note": "kept note",
        "inner.a": "deep text a", "inner.b": "deep text b",
        "many.x": "one x", "many.y": "only y",
    }
    # an empty label is its own value, an empty container takes the parent's
    assert by_def["Empty"] == {k: v for k, v in base.items() if k != "label"}
    assert by_def["Cut"] == {**{k: v for k, v in base.items() if k != "steps.1"}, "steps.0": "own step"}
    assert by_def["Text"] == {
        **{k: v for k, v in base.items() if not k.startswith("inner")}, "inner": "plain text"
    }
    assert by_def["Part"] == {
        **base, "inner.b": "own b", "inner.c": "own c", "many.x": "own x"
    }
    assert by_def["Alone"] == {"label": "alone lamp"}


def test_cycle_ends(scanned):
    assert sorted(texts(scanned, "inherit_cycle")) == [
        ("DefA.label", "label a"), ("DefA.note", "note b"),
        ("DefB.label", "label a"), ("DefB.note", "note b"),
    ]


def test_list_paths(scanned):
    assert texts(scanned, "lists") == [
        ("L.steps.0", "one step"), ("L.steps.2", "three steps"),
        ("L.mixed.li", "some item"), ("L.mixed.other", "other item"),
        ("L.stages.0.label", "stage one"), ("L.stages.1.label", "stage two"),
        ("L.nest.0.li", "inner item"), ("L.nest.0.li", "inner more"),
    ]


def test_comments_and_marks_stay(scanned):
    rows = scanned["units"]["keyed_plus_defs"]
    assert [(r.source_text, r.is_comment) for r in rows][0] == (" menu ", True)
    assert all(r.has_bom for r in scanned["units"]["bom"])
    lines = [r for r in scanned["units"]["line_list"] if r.channel == "strings"]
    assert [r.is_comment for r in lines] == [True, False, False, True, False]
    assert all(r.has_bom for r in lines)


def test_malformed_files_are_quarantined(scanned):
    assert {q.split("malformed/")[1] for q in scanned["quarantine"]} == {
        "Defs/Bad.xml", "Languages/English/Keyed/Bad.xml"
    }


def test_package_metadata(scanned):
    row = scanned["packages"]["defs_only"]
    assert (row.name, row.package_id, row.supported_versions) == (
        "Salt & Pepper", "salt.pepper", ["1.5", "1.6"]
    )
    assert row.source_lang_dir is None
    assert scanned["packages"]["stale"].source_lang_dir == "Languages/English"
    assert scanned["packages"]["stale"].name is None


def test_conditional_root_is_marked(scanned):
    marks = {r["root"]: r["conditional"] for r in scanned["roots"] if r["pkg_id"].endswith("/conditional")}
    assert marks == {"": False, "Mods/X": True}


def test_packages_are_numbered_by_name(scanned):
    ordered = sorted(scanned["packages"], key=lambda n: n)
    assert [scanned["packages"][n].pkg_seq for n in ordered] == list(range(len(ordered)))


def test_other_source_folder(spark, tmp_path):
    roots = packages.write(tmp_path, ["german"])
    scan = scan_corpus(spark, roots, fs.packages_from(spark, roots), source_folder="deutsch")
    assert [r.source_text for r in scan.units.collect()] == ["deutscher Text"]


def test_only_files_that_count_are_opened(spark, tmp_path, monkeypatch):
    from locale_lake.sources.existing import read_existing

    for path in (
        "a/Languages/English/Keyed/K [1].xml", "a/Languages/German/Keyed/K.xml", "a/Defs/T.xml", "a/Textures/t.xml",
        "a/About/About.xml", "a/notes.txt", "b/Languages/English/Strings/{x}.txt", "b/Languages/French/Strings/x.txt",
    ):
        (tmp_path / "in" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / path).write_text("line\n" if path.endswith("txt") else f"<LanguageData><k>of {path}</k></LanguageData>")
    corpus = f"{tmp_path}/in"
    opened: list[str] = []
    original = fs.read_corpus

    def recorded(session, locations, packages, content=None):
        found = original(session, locations, packages, content)
        if content and content != fs.MANIFEST:
            opened.extend(f.split("/in/", 1)[1] for f in found.inputFiles())
        return found

    monkeypatch.setattr(fs, "read_corpus", recorded)
    keys = lambda: sorted((r.key, r.source_text) for r in scan_corpus(spark, [corpus], fs.packages_in(spark, corpus)).units.collect())
    told = keys()
    names = {"a/Languages/English/Keyed/K%20%5B1%5D.xml", "a/Defs/T.xml", "a/About/About.xml", "b/Languages/English/Strings/%7Bx%7D.txt"}
    assert {f.replace(" ", "%20").replace("[", "%5B").replace("]", "%5D").replace("{", "%7B").replace("}", "%7D") for f in opened} == names
    assert sorted(t for _, t in told) == ["line", "of a/Languages/English/Keyed/K [1].xml"]
    monkeypatch.setattr(fs, "CHOSEN_FILES", 1)  # too many for a list: all are read, the result is the same
    assert keys() == told
    monkeypatch.undo()
    opened.clear()
    monkeypatch.setattr(fs, "read_corpus", recorded)
    packages = spark.createDataFrame([(f"{corpus}/a", f"{corpus}/a")], "pkg_id string, out_root string")
    assert [r.text for r in read_existing(spark, packages, "German", ["pkg_id", "key"]).collect()] == ["of a/Languages/German/Keyed/K.xml"]
    assert opened == ["a/Languages/German/Keyed/K.xml"]


def test_tags_that_a_user_denies_hold_no_text(spark, tmp_path):
    roots = packages.write(tmp_path / "in", ["defs_only"])
    found = lambda **k: sorted(r.key for r in scan_corpus(spark, roots, fs.packages_from(spark, roots), **k).units.collect())
    assert found() == ["Lamp.description", "Lamp.label"]
    assert found(denied_tags=("Description",)) == ["Lamp.label"]


def test_many_files_are_named_by_their_folders(spark, tmp_path, monkeypatch):
    """Spark lists every path that it is given in a task of its own: 10,000 files took 10,000 tasks, twice."""
    monkeypatch.setattr(fs, "CHOSEN_FILES", 3)
    for path in ("a/Defs/1.xml", "a/Defs/2.xml", "a/Defs/Sub/3.xml", "a/Defs-old/4.xml", "a [b]/Defs/5.xml", "a/Textures/t.xml"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(f"<Defs><T><defName>D{path[-5]}</defName><label>of {path[-5]}</label></T></Defs>")
    used = fs.read_corpus(spark, [str(tmp_path)], fs.packages_in(spark, str(tmp_path))).filter("file_id LIKE '%/Defs/%'")
    assert fs.chosen_files(used) == [f"{tmp_path}/a \\[b\\]/Defs", f"{tmp_path}/a/Defs"]
    units = scan_corpus(spark, [str(tmp_path)], fs.packages_in(spark, str(tmp_path))).units
    assert sorted(r.source_text for r in units.collect()) == ["of 1", "of 2", "of 3", "of 5"]


def test_small_files_share_tasks(spark, tmp_path):
    """Some 30 small files made a task, in the listing and in every step after it."""
    (tmp_path / "p").mkdir()
    for i in range(1200):
        (tmp_path / "p" / f"{i}.txt").write_text("x")
    cores = spark.sparkContext.defaultParallelism
    found = fs._listing(spark, [str(tmp_path)])
    assert found.rdd.getNumPartitions() > cores
    assert fs._packed(found).rdd.getNumPartitions() == cores
    assert fs.read_corpus(spark, [str(tmp_path)], fs.packages_in(spark, str(tmp_path)), "*.txt").count() == 1200
