"""Content sort, bisector tournament and R-tree negatives against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locale_lake.llm import bisector, content_sort, integers, rtree

DOCS = "doc_id bigint, text string, digest string, part int, content string, kept string"
VECTORS = "vec_id bigint, embedding array<double>, label int, q string, cluster string, slot int, query int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], DOCS)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", 1, 2) for i, v, label in rows], VECTORS)


# ---- content sort --------------------------------------------------------------


def brute_duplicates(rows):
    spaces = {ord(c): None for c in " \t\n\x0b\x0c\r"}
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault((t or "").translate(spaces), []).append((-len(t or ""), i is None, i or 0, n, i))
    out = []
    for text, members in groups.items():
        members.sort(key=lambda m: m[:4])
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(m[4], members[0][4], len(members), k == 0, digest) for k, m in enumerate(members)]
    return sorted(out, key=repr)


def test_equal_contents_of_any_kind(spark):
    draw = random.Random(3)
    words = ["añb", "b　c", "x" * 70, "日本", "d"]
    rows = [(i, draw.choice(" \t\n").join(draw.choices(words, k=draw.randint(0, 3)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, " \n"), (None, "d d"), (None, None), (5, "zz"), (5, "zz"), (6, "ab " * 60_000), (7, "ab" * 60_000)]
    got = sorted(map(tuple, content_sort.exact_duplicates(docs(spark, rows)).collect()), key=repr)
    assert got == brute_duplicates(rows)
    assert content_sort.exact_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_a_large_group_goes_through_several_ranges(spark):
    rows = [(i, "same text" + " " * (i % 7)) for i in range(900)] + [(1000 + i, f"other {i}") for i in range(300)]
    df = docs(spark, rows).repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = content_sort.exact_duplicates(df)
        got = sorted(map(tuple, told.collect()), key=repr)
        kept = sorted(r["doc_id"] for r in content_sort.deduplicated(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == brute_duplicates(rows)
    assert kept == sorted(r[0] for r in got if r[3]) and 6 in kept
    assert content_sort.deduplicated(df).columns == df.columns


def test_ranges_share_a_hot_text(spark):
    """The splitters cut inside a group of equal texts: no range holds most of the rows."""
    rows = docs(spark, [(i, "hot") for i in range(4000)]).repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        order = [F.col("text"), F.lit("d"), F.lit(3).desc(), F.col("doc_id").asc_nulls_last()]
        sizes = [r["count"] for r in rows.repartitionByRange(*order).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) > 4 and max(sizes) < 1500


# ---- bisector tournament -------------------------------------------------------


def brute_clusters(rows, k, rounds, scale=256, dims=4):
    kept = [
        (i, [integers.exact_floor(x, scale) for x in v])
        for i, v, _ in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    digest = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "z"
    centroids = [q for _, q in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda q: min(range(len(centroids)), key=lambda c: (far(q, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(q) for _, q in kept]
        for c in range(len(centroids)):
            of = [q for (_, q), o in zip(kept, own, strict=True) if o == c]
            if of:
                centroids[c] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    told = [(i, nearest(q), far(q, centroids[nearest(q)])) for i, q in kept]
    sums = {c: sum(d for _, o, d in told if o == c) for _, c, _ in told}
    top = integers.MOST
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, min(d, top), min(sums[c], top), min(sum(sums.values()), top), names[c]) for i, c, d in told), key=repr)


ODD = [(900, None, 1), (901, [1.0, None, 1.0, 1.0], 1), (902, [float("nan")] * 4, 1), (903, [1.0] * 3, 1), (904, [float("inf")] * 4, 1)]


def test_clusters_equal_plain_rounds(spark):
    draw = random.Random(8)
    rows = [(i, [draw.choice([-0.5, -0.01, 0.0, 0.25, 0.7]) for _ in range(4)], None) for i in range(180)]
    rows += [rows[3], rows[3], (None, [0.1, 0.2, 0.3, 0.4], 2), *ODD]
    got = sorted(map(tuple, bisector.clustered(vectors(spark, rows), k=9, dims=4).collect()), key=repr)
    assert got == brute_clusters(rows, 9, 5)


def test_clusters_of_huge_and_of_few_vectors(spark):
    rows = [(i, [float(i), -1.0, 2.0**i, 1e300 if i == 7 else 0.0], None) for i in range(12)]
    got = sorted(map(tuple, bisector.clustered(vectors(spark, rows), k=3, rounds=2, dims=4).collect()), key=repr)
    assert got == brute_clusters(rows, 3, 2)
    few = sorted(map(tuple, bisector.clustered(vectors(spark, rows[:2]), k=40, dims=4).collect()), key=repr)
    assert few == brute_clusters(rows[:2], 40, 5)
    assert bisector.clustered(vectors(spark, ODD), k=3, dims=4).count() == 0


def test_a_tournament_finds_the_first_of_the_nearest():
    draw = np.random.default_rng(4)
    centroids = draw.integers(-3, 4, (11, 3)).tolist() + [[0, 0, 0], [0, 0, 0]]
    x = draw.integers(-4, 5, (5000, 3))
    far = ((x[:, None, :] - np.array(centroids)[None]) ** 2).sum(axis=2)
    for large in (False, True):
        rows = x.astype(object) if large else x
        assert bisector.Bisectors(centroids, large).nearest(rows).tolist() == far.argmin(axis=1).tolist()


# ---- R-tree --------------------------------------------------------------------


def brute_negatives(rows, every, n_positive=5, n_negative=10):
    kept = {
        (i, tuple(integers.exact_floor(x, 256) for x in v), label)
        for i, v, label in rows
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)
    }
    clip, out = integers.clipped, []
    for a, q, label in kept:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, w, strict=False)), i, o) for i, w, o in kept if i != a)
        for minus, positive, _ in [s for s in scored if s[2] == label][:n_positive]:
            fit = [(-m, i) for m, i, o in scored if o != label and 30 * -minus <= 100 * -m <= 90 * -minus][:n_negative]
            out += [(a, positive, rank + 1, i, clip(-minus), clip(s)) for rank, (s, i) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block", [16_384, 40])
def test_negatives_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(rtree, "BLOCK_ROWS", block)
    monkeypatch.setattr(rtree, "LEAF_ROWS", 4)
    monkeypatch.setattr(rtree, "FANOUT", 3)
    monkeypatch.setattr(rtree, "QUERY_ROWS", 3)
    draw = random.Random(6)
    rows = [(i, [draw.choice([-0.3, 0.0, 0.2, 0.5, 0.9]) for _ in range(5)], draw.choice([0, 1, 1, 1, 2])) for i in range(260)]
    rows += [rows[5], (None, [1.0] * 5, 1), (300, [0.5] * 3, 0), (310, [], 1), (320, [0.9] * 5, None), *ODD]
    df = vectors(spark, rows)
    got = sorted(map(tuple, rtree.hard_negatives(df, df.filter("vec_id % 20 = 0")).collect()))
    assert got == brute_negatives(rows, 20)
    assert rtree.hard_negatives(df.limit(0), df.limit(0)).count() == 0


def test_negatives_of_huge_components(spark):
    rows = [(i, [1e300 * (i % 5), 2.0**40 * i, 1.0 + i], i % 3) for i in range(40)]
    df = vectors(spark, rows)
    got = sorted(map(tuple, rtree.hard_negatives(df, df.filter("vec_id % 10 = 0")).collect()))
    assert got == brute_negatives(rows, 10) and got


def test_leaves_hold_every_row_once_and_boxes_bound_them():
    draw = np.random.default_rng(2)
    values, labels = draw.integers(-50, 50, (700, 6)), np.sort(draw.integers(0, 90, 700))
    labels[:300] = 7
    order, starts = rtree.packed(values, labels, 8)
    assert sorted(order.tolist()) == list(range(700))
    assert np.diff(np.append(starts, 700)).max() <= 8
    tree = rtree.Tree(values[order], labels[order], np.arange(700), starts)
    for low, high, first, last in tree.levels:
        assert (low <= high).all() and (first <= last).all()
    assert len(tree.levels[-1][0]) == 1


def test_large_integers_sort_as_bytes():
    values = [-(10**30), -(2**63) - 1, -(2**63), -5, 0, 7, 2**63 - 1, 2**63, 10**40]
    keys = [(integers.clipped(v), integers.sortable(v)) for v in values]
    assert [integers.told(*k) for k in keys] == values
    assert sorted(keys, key=lambda k: (k[0], k[1] or b"")) == keys


def test_a_bucket_is_counted_in_ranges():
    """A bucket of tokens was sorted as a whole: four times its packed size at once in a Python worker."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from locale_lake.llm import trie_join

    words = np.random.default_rng(7).integers(0, 3000, (2000, 300))
    texts = [" ".join(map(str, row)) for row in words] + [" ".join(map(str, row[:-1])) for row in words[:50]]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts)})
    table = pa.Table.from_batches(list(trie_join._deal(5, 1)(iter([batch]))))
    trie_join._count(1)(table)
    tracemalloc.start()
    counted = trie_join._count(1)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3.3 * table["tokens"].nbytes
    kept = np.frombuffer(b"".join(counted["tokens"].to_pylist()), dtype=np.uint64)
    sets = [s >> np.uint64(8) for s in trie_join._sets(batch, 5)]
    tokens, n = np.unique(np.concatenate(sets), return_counts=True)
    assert len(kept) == n[n > 1].sum()
    assert np.array_equal(np.unique(kept & np.uint64((1 << 56) - 1)), tokens[n > 1])
