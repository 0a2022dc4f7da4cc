"""Whole runs on fixture packages with a fake model."""

import pytest

from locale_lake.operators import inference as inf
from locale_lake.plans.scan import scan_corpus
from locale_lake.plans.translate import Options, RunCancelled, translate_corpus
from locale_lake.sources import files as fs
from locale_lake.sources.state import committed_run, compact, read_state, take_back
from locale_lake.streaming.queue import queue_report, run_queue
from tests import packages


def prefix(texts):
    return [f"RU:{t}" for t in texts]


def forbid(texts):
    if texts:
        raise AssertionError(f"the model was asked: {texts}")
    return []


def broken(texts):
    raise OSError("locked")


def run(spark, roots, out, state, run_id, translate=prefix, **options):
    scan = scan_corpus(spark, roots, fs.packages_from(spark, roots))
    return translate_corpus(
        spark, scan, str(out), str(state), run_id,
        Options(lang="ru", retry_delays=(), **options), translate,
    )


def rows(outcome):
    return {
        r.key: (r.final_text, r.origin)
        for r in outcome.results.filter("not is_comment").collect()
    }


def test_edit_cycle_with_files_and_state(spark, tmp_path):
    roots = packages.write(tmp_path / "in", ["keyed_plus_defs", "line_list"])
    out, state = tmp_path / "out", tmp_path / "state"
    first = run(spark, roots, out, state, 1, with_source=True)
    assert rows(first)["Lamp.label"] == ("RU:oil lamp", "draft")

    keyed = out / "keyed_plus_defs_RU/Languages/Russian/Keyed/Keys.xml"
    assert keyed.read_text() == (
        '<?xml version="1.0" encoding="utf-8"?>\n<LanguageData>\n  <!-- menu -->\n'
        "  <!--EN: Hello there-->\n  <Greeting>RU:Hello there</Greeting>\n</LanguageData>\n"
    )
    names = out / "line_list_RU/Languages/Russian/Strings/Names/First.txt"
    assert names.read_bytes() == b"\xef\xbb\xbf// note\nRU:Anna\nRU:Bert\n\nRU:Cleo\n"
    about = (out / "keyed_plus_defs_RU/About/About.xml").read_text()
    assert "<packageId>unknown.mod.RU.Translation</packageId>" in about
    assert "<li>1.6</li>" in about

    # an edit survives, unchanged text is reused, a changed source is translated
    things = out / "keyed_plus_defs_RU/Languages/Russian/DefInjected/ThingDef/Things.xml"
    things.write_text(things.read_text().replace("RU:oil lamp", "by hand"))
    source = tmp_path / "in/keyed_plus_defs/Defs/Things.xml"
    source.write_text(source.read_text().replace("It glows.", "It shines."))
    second = rows(run(spark, roots, out, state, 2, update=True))
    assert second["Lamp.label"] == ("by hand", "override")
    assert second["Greeting"] == ("RU:Hello there", "reuse")
    assert second["Strings/Names/First.txt:1"] == ("RU:Anna", "reuse")
    assert second["Lamp.description"] == ("RU:It shines.", "draft")
    assert committed_run(spark, str(state)) == 2
    kept = read_state(spark, str(state), "state").filter("kind = 'override'").collect()
    assert [(r.key, r.text) for r in kept] == [("Lamp.label", "by hand")]


def test_cancelled_run_leaves_no_state(spark, tmp_path):
    roots = packages.write(tmp_path / "in", ["defs_only"])
    scan = scan_corpus(spark, roots, fs.packages_from(spark, roots))
    with pytest.raises(RunCancelled):
        translate_corpus(
            spark, scan, str(tmp_path / "out"), str(tmp_path / "state"), 1,
            Options(lang="ru"), forbid, cancelled=lambda: True,
        )
    assert committed_run(spark, str(tmp_path / "state")) is None


def test_queue_shares_memory_and_records_failures(spark, tmp_path):
    roots = packages.write(tmp_path / "in", ["defs_only", "keyed_plus_defs", "patch_skip"])
    queue = tmp_path / "queue"
    queue.mkdir()
    (queue / "1.txt").write_text(roots[0] + "\n")
    (queue / "2.txt").write_text("\n".join([*roots[1:], str(tmp_path / "in/missing")]) + "\n")
    import os
    os.utime(queue / "1.txt", (1, 1))
    calls = str(tmp_path / "calls.txt")

    def record(texts):
        with open(calls, "a") as log:
            log.writelines(t + "\n" for t in texts)
        return prefix(texts)

    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = run_queue(
        spark, str(queue), out, state, str(tmp_path / "chk"),
        Options(lang="ru", retry_delays=()), record,
    )
    query.awaitTermination(300)
    assert query.exception() is None
    asked = open(calls).read().splitlines()
    assert sorted(asked) == ["Hello there", "It gives light.", "It glows.", "oil lamp"]
    report = {r.status: (r.packages, r.messages) for r in queue_report(spark, state).collect()}
    assert report == {
        "done": (2, []),
        "failed": (2, ["no translatable strings", "package folder not found"]),
    }
    text = (tmp_path / "out/keyed_plus_defs_RU/Languages/Russian/DefInjected/ThingDef/Things.xml").read_text()
    assert "RU:oil lamp" in text


def test_failed_engine_falls_back_and_is_not_remembered(spark, tmp_path):
    roots = packages.write(tmp_path / "in", ["stale"])
    out, state = tmp_path / "out", tmp_path / "state"
    assert rows(run(spark, roots, out, state, 1, broken)) == {
        "Lamp.label": ("Kitchen", "fallback")
    }
    assert read_state(spark, str(state), "memory").count() == 0
    again = rows(run(spark, roots, out, state, 2, prefix, update=True))
    assert again == {"Lamp.label": ("RU:Kitchen", "draft")}


def test_engine_options():
    assert inf.plan_run(True, False) == 12
    assert inf.plan_run(True, True, inf.CHECK) == 20
    assert inf.plan_run(False, True, batch=5) == 5
    with pytest.raises(ValueError):
        inf.plan_run(False, False)
    with pytest.raises(ValueError):
        inf.plan_run(False, True, inf.CHECK)


def _by_hand(folder, old, new):
    things = folder / "Languages/Russian/DefInjected/ThingDef/Things.xml"
    things.write_text(things.read_text().replace(old, new))


def test_state_of_other_packages_and_languages_stays(spark, tmp_path):
    roots = packages.write(tmp_path / "in", ["keyed_plus_defs", "line_list"])
    out, state = tmp_path / "out", tmp_path / "state"
    run(spark, roots[:1], out, state, 1)
    run(spark, roots[1:], out, state, 2)
    scan = scan_corpus(spark, roots[:1], fs.packages_from(spark, roots[:1]))
    translate_corpus(spark, scan, str(out), str(state), 3, Options(lang="de", retry_delays=()), prefix)
    _by_hand(out / "keyed_plus_defs_RU", "RU:oil lamp", "by hand")
    fourth = rows(run(spark, roots[:1], out, state, 4, update=True))
    assert fourth["Lamp.label"] == ("by hand", "override")
    assert fourth["Greeting"] == ("RU:Hello there", "reuse")
    table = read_state(spark, str(state), "state")
    assert {(r.lang, r.n) for r in table.groupBy("lang").agg({"pkg_id": "approx_count_distinct"}).toDF("lang", "n").collect()} == {("ru", 2), ("de", 1)}

    # compacted, the state is the same; an edit that is taken back is gone
    before = sorted(map(str, table.collect()))
    compact(spark, str(state))
    assert sorted(map(str, read_state(spark, str(state), "state").collect())) == before
    edits = table.filter("kind = 'override'")
    taken = take_back(spark, str(state), edits, ["pkg_id", "channel", "type_key", "key"])
    assert read_state(spark, str(state), "state").filter("kind = 'override'").count() == 0
    again = rows(run(spark, roots[:1], out, state, taken + 1, update=True))
    assert again["Lamp.label"][1] in ("draft", "memory") and again["Greeting"][1] == "reuse"


def test_queue_keeps_edits_and_goes_on_after_a_failure(spark, tmp_path):
    roots = packages.write(tmp_path / "in", ["keyed_plus_defs", "line_list"])
    queue, out, state = tmp_path / "queue", tmp_path / "out", tmp_path / "state"
    queue.mkdir()
    options = Options(lang="ru", update=True, retry_delays=())

    def work(name, lines, checkpoint):
        (queue / name).write_text("".join(f"{x}\n" for x in lines))
        run_queue(spark, str(queue), str(out), str(state), str(tmp_path / checkpoint), options, prefix).awaitTermination()

    work("1.txt", roots[:1], "a")
    work("2.txt", [*roots[1:], str(tmp_path / "nowhere")], "a")
    _by_hand(out / "keyed_plus_defs_RU", "RU:oil lamp", "by hand")
    work("3.txt", roots[:1], "a")
    text = (out / "keyed_plus_defs_RU/Languages/Russian/DefInjected/ThingDef/Things.xml").read_text()
    assert "by hand" in text
    assert committed_run(spark, str(state)) == 2
    # a new checkpoint starts its batches at 0 again, but not its runs
    work("4.txt", roots[:1], "b")
    assert committed_run(spark, str(state)) >= 3
    assert "by hand" in (out / "keyed_plus_defs_RU/Languages/Russian/DefInjected/ThingDef/Things.xml").read_text()
    failed = [r for r in queue_report(spark, str(state)).collect() if r.status == "failed"]
    assert failed[0].messages == ["package folder not found"]


def test_one_fault_costs_one_answer():
    def touchy(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [t.upper() for t in texts]

    texts = [*"abc", "bad", *"de"]
    answers, errors = inf.each_or_none(touchy, texts, ())
    assert answers == ["A", "B", "C", None, "D", "E"]
    assert [e is None for e in errors] == [True, True, True, False, True, True]


def test_calls_overlap_and_answers_stay_in_order():
    import threading
    import time

    active, most, lock = [0], [0], threading.Lock()

    def slow(item):
        with lock:
            active[0] += 1
            most[0] = max(most[0], active[0])
        time.sleep(0.05 if item % 3 else 0.15)
        with lock:
            active[0] -= 1
        if item == 7:
            raise OSError("gone")
        return item * 10

    start = time.monotonic()
    told = list(inf.in_order(slow, range(20), 4, lambda item: 30))
    assert time.monotonic() - start < 20 * 0.08 and most[0] == 4
    assert [t for i, t in enumerate(told) if i != 7] == [i * 10 for i in range(20) if i != 7]
    assert isinstance(told[7], OSError)
    # a call without an answer in its time is given up; the others are not held up by it
    hangs = threading.Event()
    told = list(inf.in_order(lambda i: hangs.wait(20) if i == 1 else i, range(6), 2, lambda i: 0.2))
    hangs.set()
    assert isinstance(told[1], TimeoutError) and [told[i] for i in (0, 2, 3, 4, 5)] == [0, 2, 3, 4, 5]
    # what is drawn ahead of the next result is bounded
    drawn = []
    results = inf.in_order(lambda i: time.sleep(0.2 if i == 0 else 0), (drawn.append(i) or i for i in range(100)), 2, lambda i: 9, ahead=5)
    next(results)
    assert len(drawn) <= 6 and len(list(results)) == 99
    assert list(inf.in_order(slow, [], 3, lambda i: 1)) == []


def test_faulty_requests_lose_only_their_own_answer(spark):
    def model(requests):
        if any(r["prompt"] == "hang" for r in requests):
            import time

            time.sleep(5)
        if any("bad" in r["prompt"] for r in requests):
            raise ValueError("no")
        return [r["prompt"].upper() for r in requests]

    prompts = ["bad 1"] + [f"p{i}" for i in range(30)] + ["hang", "q"]
    rows = [(i, p, 1, 200, 1) for i, p in enumerate(prompts)]
    df = spark.createDataFrame(rows, "i int, prompt string, n_items int, answer_tokens int, timeout_seconds int").coalesce(1)
    for per_call in (1, 4):
        told = {r.prompt: (r.raw, r.call_error) for r in inf.call_requests(df, model, parallel=3, per_call=per_call).collect()}
        assert len(told) == 33 and told["bad 1"] == (None, "ValueError: no")
        if per_call == 1:
            assert told["hang"] == (None, "TimeoutError: no answer in time")
            assert all(told[p] == (p.upper(), None) for p in prompts if p not in ("bad 1", "hang"))


def test_equal_texts_of_two_packages_are_asked_once(spark, tmp_path):
    roots = packages.write(tmp_path / "in", ["defs_only", "keyed_plus_defs"])  # both have "oil lamp"
    calls = str(tmp_path / "calls.txt")

    def call(requests):
        with open(calls, "a") as log:
            log.writelines(r["prompt"] + "\n" for r in requests)
        return [f"<ANS>1: polished {r['prompt'].split('key: ')[1].split(' ')[0]}</ANS>" for r in requests]

    scan = scan_corpus(spark, roots, fs.packages_from(spark, roots))
    outcome = translate_corpus(
        spark, scan, str(tmp_path / "out"), str(tmp_path / "state"), 1,
        Options(lang="ru", retry_delays=(), batch_size=1), prefix, call,
    )
    prompts = [line for line in open(calls).read().splitlines() if "oil lamp" in line]
    assert len(prompts) == 1
    texts = {(r.pkg_id.rsplit("/", 1)[1], r.key): (r.final_text, r.origin) for r in outcome.results.filter("not is_comment").collect()}
    assert texts["defs_only", "Lamp.label"] == ("polished Lamp.label", "polished")
    assert texts["keyed_plus_defs", "Lamp.label"] == ("polished Lamp.label", "memory")
    found = {r.pkg_id.rsplit("/", 1)[1]: r.from_memory for r in outcome.summary.collect()}
    assert found == {"defs_only": 0, "keyed_plus_defs": 1}


def test_a_file_is_written_by_several_tasks(spark, tmp_path):
    from locale_lake.sinks import files as sink

    rows = [
        (f"{tmp_path}/o#1 é", "keyed", path, i % 3, f"{i:05d}", i, f"k{i}", False, path == "Keyed/a.xml", f"s{i}", f"<t{i}>")
        for path, n in (("Keyed/a.xml", 900), ("Keyed/b.xml", 3), ("Keyed/c.xml", 400))
        for i in range(n)
    ]
    schema = "out_root string, channel string, out_path string, layer int, sort_path string, seq bigint, key string, is_comment boolean, has_bom boolean, source_text string, final_text string"
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        written = sink.write_language_files(spark.createDataFrame(rows, schema).repartition(3), "Tongue").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    folder = tmp_path / "o#1 é/Languages/Tongue/Keyed"
    assert sorted(f.name for f in folder.iterdir()) == ["a.xml", "b.xml", "c.xml"]  # no pieces are left
    assert {r.file.rsplit("/", 1)[1]: r.lines for r in written} == {"a.xml": 900, "b.xml": 3, "c.xml": 400}
    for name, n in (("a.xml", 900), ("b.xml", 3), ("c.xml", 400)):
        order = sorted(range(n), key=lambda i: (i % 3, i))
        want = sink.XML_HEAD + "".join(f"  <k{i}>&lt;t{i}&gt;</k{i}>\n" for i in order) + sink.XML_FOOT
        assert (folder / name).read_bytes() == (b"\xef\xbb\xbf" if name == "a.xml" else b"") + want.encode()
