"""Set-similarity join of word shingles over prefix trees, and the classes it links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locale_lake.llm import graph, rawtext
from locale_lake.operators import skew
from locale_lake.session import cut_lineage, rewritten

# Two sets link if FINE x overlap >= SHARE x union.
SHARE, FINE = 75, 100
# Shingles that a task gathers before it deals them out.
DEAL_SHINGLES = 500_000
# Sets and bytes of tokens in one tree; larger groups of candidates are joined tree by tree.
TREE_SETS, TREE_BYTES = 1000, 4_000_000
# Rows and bytes of one task, about: two trees, or small groups of candidates.
TASK_SETS, TASK_BYTES = 2000, 16_000_000
# Bytes of text whose shingles share a bucket while they are counted.
BUCKET_BYTES = 12_000_000
# A bucket is counted in 2 to this power ranges, one after the other.
COUNT_BITS = 3
BROADCAST_IDS = 1_000_000

_KEPT_BITS = np.uint64(8)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _key(found: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    one, two = rawtext.mix(found), rawtext.mix(found ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return np.array([one.sum(dtype=np.uint64), (two * (one | np.uint64(1))).sum(dtype=np.uint64)], dtype=np.uint64).tobytes()


def _sets(rows: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    words = rawtext.Texts(rows.column("text")).words(rawtext.NOT_SPACE)
    return rawtext.shingles(words.hashes(), words.offsets, width)


def set_keys(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles and key (equal sets, equal keys; null for the empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rawtext.slices(batch, "text"):
                sizes, keys = [], []
                for found in _sets(rows, width):
                    sizes.append(len(found))
                    keys.append(_key(found) if len(found) else None)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": rows.column("doc_id"),
                        "n_shingles": pa.array(sizes, pa.int64()),
                        "key": pa.array(keys, pa.binary()),
                    }
                )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n_shingles bigint, key binary")


def _pack7(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :7]).tobytes()


def _unpacked(packed: list, width: int) -> np.ndarray:
    """Tokens of ``width`` bytes each as one array."""
    out = np.zeros((sum(map(len, packed)) // width, 8), dtype=np.uint8)
    at = 0
    for piece in packed:
        rows = len(piece) // width
        out[at : at + rows, :width] = np.frombuffer(piece, dtype=np.uint8).reshape(-1, width)
        at += rows
    return out.reshape(-1).view(np.uint64)


DEALT = "bucket int, keys binary, sizes binary, counts binary, tokens binary"


def _deal(width: int, n: int):
    """Cut every set by n ranges of its tokens; a row holds what some sets have in one range."""

    def rows_of(sets: list[np.ndarray], keys: list[bytes]) -> pa.RecordBatch:
        tokens = np.concatenate(sets) >> _KEPT_BITS
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        bucket = (((tokens >> np.uint64(24)) * np.uint64(n)) >> np.uint64(32)).astype(np.uint16 if n < 65_536 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        tokens, owner, bucket = tokens[order], owner[order], bucket[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        ends = np.append(starts[1:], len(bucket))
        all_keys = np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)
        all_sizes = np.array([len(s) for s in sets], dtype=np.int32)
        out: dict[str, list] = {"bucket": [], "keys": [], "sizes": [], "counts": [], "tokens": []}
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            own = owner[start:end]
            first = np.flatnonzero(np.diff(own, prepend=np.int32(-1)))
            who = own[first]
            out["bucket"].append(int(bucket[start]))
            out["keys"].append(all_keys[who].tobytes())
            out["sizes"].append(all_sizes[who].tobytes())
            out["counts"].append(np.diff(first, append=len(own)).astype(np.int32).tobytes())
            out["tokens"].append(_pack7(tokens[start:end]))
        return pa.RecordBatch.from_pydict(
            {k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in out.items()}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, keys, held = [], [], 0
        seen: set[bytes] = set()  # 16 bytes for each text of the task
        for batch in batches:
            for rows in rawtext.slices(batch, "text"):
                for found in _sets(rows, width):
                    if not len(found) or (key := _key(found)) in seen:
                        continue  # copies meet here already, as far as they can
                    seen.add(key)
                    sets.append(found)
                    keys.append(key)
                    held += len(found)
                    if held >= DEAL_SHINGLES:
                        yield rows_of(sets, keys)
                        sets, keys, held = [], [], 0
        if sets:
            yield rows_of(sets, keys)

    return run


def _gathered(table: pa.Table, token_bytes: int):
    """The rows of a bucket: set keys as dense numbers, their sizes, and owner, token per entry."""
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=np.uint64).reshape(-1, 2)
    sizes = np.frombuffer(b"".join(table.column("sizes").to_pylist()), dtype=np.int32)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.int32)
    tokens = _unpacked([piece.as_buffer() for piece in table.column("tokens")], token_bytes)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    number = np.empty(len(order), dtype=np.int32)
    number[order] = np.cumsum(new) - 1
    firsts = order[new]
    return keys[firsts], sizes[firsts], np.repeat(number, counts), tokens


def _rarity(sets_with: np.ndarray) -> np.ndarray:
    """A byte that grows with the number of sets that have a token, by eighths of a power of two."""
    return np.minimum(np.floor(8 * np.log2(sets_with)), 255).astype(np.uint64)


def _shared(tokens: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that several sets have, with their rarity, and the sets that have them; by token, then by set."""
    order = np.argsort(tokens)
    tokens = tokens[order]
    owner = owner[order]
    del order
    same = tokens[1:] == tokens[:-1]
    twice = np.zeros(len(tokens), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    tokens, owner = tokens[twice], owner[twice]
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    fresh = np.ones(len(tokens), dtype=bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, owner = tokens[fresh], owner[fresh]
    first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    sets_with = np.diff(first, append=len(tokens))
    several = np.repeat(sets_with > 1, sets_with)
    # the order of all tokens: rare before frequent, then by hash
    tokens = ((np.repeat(_rarity(sets_with), sets_with) << np.uint64(56)) | tokens)[several]
    return tokens, owner[several]


def _count(n: int):
    """Keep the tokens that several sets have; the row says for each how rare it is."""

    def run(table: pa.Table) -> pa.Table:
        keys, sizes, owner, tokens = _gathered(table, 7)
        # a range of the bucket at a time: what is sorted is a small part of it
        part = np.empty(len(tokens), dtype=np.uint8)
        for at in range(0, len(tokens), 65_536):
            place = (tokens[at : at + 65_536] >> np.uint64(24)) * np.uint64(n) & np.uint64(0xFFFFFFFF)
            part[at : at + 65_536] = place >> np.uint64(32 - COUNT_BITS)
        shared = [_shared(tokens[own], owner[own]) for k in range(1 << COUNT_BITS) if (own := np.flatnonzero(part == k)).size]
        del part
        tokens = np.concatenate([x[0] for x in shared]) if shared else tokens
        owner = np.concatenate([x[1] for x in shared]) if shared else owner
        place = (rawtext.mix(keys[:, 0] ^ keys[:, 1]) % np.uint64(n)).astype(np.int64)
        order = np.lexsort((owner, place[owner]))
        tokens, owner = tokens[order], owner[order]
        bucket = place[owner]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        out: dict[str, list] = {"bucket": [], "keys": [], "sizes": [], "counts": [], "tokens": []}
        for start, end in zip(starts.tolist(), np.append(starts[1:], len(bucket))[: len(starts)].tolist(), strict=True):
            own = owner[start:end]
            at = np.flatnonzero(np.diff(own, prepend=np.int32(-1)))
            out["bucket"].append(int(bucket[start]))
            out["keys"].append(keys[own[at]].tobytes())
            out["sizes"].append(sizes[own[at]].tobytes())
            out["counts"].append(np.diff(at, append=len(own)).astype(np.int32).tobytes())
            out["tokens"].append(tokens[start:end].tobytes())
        return pa.table({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in out.items()})

    return run


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Two sets that link share one of the first n - ceil(0.75 n) + 1 tokens in the common order."""
    return n - (SHARE * n + FINE - 1) // FINE + 1


SETS = "key binary, n int, prefix int, tokens binary"


def _collect(table: pa.Table) -> pa.Table:
    """Sets that can link at all, with their shared tokens in order."""
    keys, sizes, owner, tokens = _gathered(table, 8)
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    have = np.bincount(owner, minlength=len(keys))
    ends = np.cumsum(have)
    # tokens of this set alone come first in the order and link with nothing
    prefix = prefix_length(sizes.astype(np.int64)) - (sizes - have)
    some = np.flatnonzero((prefix > 0) & (have > 0))
    return pa.table(
        {
            "key": pa.array([keys[i].tobytes() for i in some], pa.binary()),
            "n": pa.array(sizes[some], pa.int32()),
            "prefix": pa.array(np.minimum(prefix, have)[some], pa.int32()),
            "tokens": pa.array([tokens[ends[i] - have[i] : ends[i]].tobytes() for i in some], pa.binary()),
        }
    )


class Tree:
    """Path-compressed prefix tree of token sequences in the common order."""

    def __init__(self, sequences: list[np.ndarray], sizes: list[int]):
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">u8").tobytes())
        self.sequences = [sequences[i] for i in order]
        self.sizes, self.order = [sizes[i] for i in order], order
        shared = [0]
        for x, y in zip(self.sequences, self.sequences[1:], strict=False):
            m = min(len(x), len(y))
            differ = np.flatnonzero(x[:m] != y[:m])
            shared.append(int(differ[0]) if len(differ) else m)
        self.shared = shared
        # node: (tokens, children, sets that end here, longest rest below, least size below, sets left below, node above)
        self.ends: list = [None] * len(order)
        self.root = self._node(0, len(order), 0)

    def _node(self, first: int, last: int, depth: int):
        """The node of sets first..last, which agree on their tokens before ``depth``."""
        stack: list = []
        root = [self.sequences[first][:0], [], [], 0, 0, 0, None]
        stack.append((root, first, last, depth))
        nodes = []
        while stack:
            node, first, last, depth = stack.pop()
            nodes.append((node, first, last, depth))
            k = first
            while k < last and len(self.sequences[k]) == depth:
                node[2].append(k)
                self.ends[self.order[k]] = node, k
                k += 1
            while k < last:
                end = k + 1
                while end < last and self.shared[end] > depth:
                    end += 1
                reach = min([len(self.sequences[k]), *self.shared[k + 1 : end]])
                child = [self.sequences[k][depth:reach], [], [], 0, 0, 0, node]
                node[1].append(child)
                stack.append((child, k, end, reach))
                k = end
        for node, first, last, depth in nodes:
            node[3] = max(len(s) for s in self.sequences[first:last]) - depth
            node[4] = min(self.sizes[first:last])
            node[5] = last - first
        return root

    def take(self, number: int) -> None:
        """Leave a set out of the walks to come."""
        node, k = self.ends[number]
        node[2].remove(k)
        while node is not None:
            node[5] -= 1
            node = node[6]

    def linked(self, tokens: np.ndarray, size: int) -> Iterator[int]:
        """Numbers of the sets that link with the given one, of those not taken.

        One walk serves all sets below a node: its overlap so far is theirs, and the
        walk turns back where not even the longest rest could make up the overlap
        that the smallest set below calls for.
        """
        n = len(tokens)
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            path = node[0]
            used = 0
            if len(path):
                at = np.searchsorted(tokens, path)
                overlap += int((tokens[np.minimum(at, n - 1)] == path).sum()) if n else 0
                used = int(np.searchsorted(tokens, path[-1], side="right"))
            if (SHARE + FINE) * (overlap + min(node[3], n - used)) < SHARE * (size + node[4]):
                continue
            for k in node[2]:
                if (SHARE + FINE) * overlap >= SHARE * (size + self.sizes[k]):
                    yield self.order[k]
            for child in node[1]:
                if child[5]:
                    stack.append((child, overlap))


class Forest:
    """Union-find that keeps the links which joined something."""

    def __init__(self, n: int):
        self.up, self.links = list(range(n)), []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.links.append((x, y))


def _binaries(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Views of the 64-bit tokens of each row, without copies."""
    out = []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk):
            held = memoryview(data) if data else memoryview(b"")
            out += [np.frombuffer(held[x:y], dtype=np.uint64) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def _reached(sequences: list[np.ndarray], sizes: list[int], build: list[int], probe: list[int]) -> list[tuple[int, int]]:
    """What links inside a tree, or between two, as pairs of a class's first set and another of it.

    A class is walked from set to set, and a set that is reached leaves its tree: all that it
    links with is met from it. So near copies, however many, are found once each, and the
    pairs of a class have no long path among them.
    """
    tree_of = lambda numbers: Tree([sequences[i] for i in numbers], [sizes[i] for i in numbers])
    inside = build == probe
    trees = {True: tree_of(build)}
    trees[False] = trees[True] if inside else None  # of the probes, when something links
    sides = {True: build, False: probe}
    taken, links = set(), []
    for k, start in enumerate(probe):
        if start in taken:
            continue
        if trees[False] is not None:
            trees[False].take(k)
        waiting = [(k, False)]
        while waiting:
            k, is_build = waiting.pop()
            i, other = sides[is_build][k], inside or not is_build
            if trees[other] is None:
                trees[other] = tree_of(probe)
                trees[other].take(probe.index(start))
            for m in list(trees[other].linked(sequences[i], sizes[i])):
                trees[other].take(m)
                taken.add(sides[other][m])
                links.append((start, sides[other][m]))
                waiting.append((m, other))
    return links


def _met(table: pa.Table, counting: bool) -> pa.Table:
    """Join the sets of each (group, tree, tree): pairs a and b that span what is linked.

    When ``counting``, rows without b say how many copies the sets have that link with a, in
    this pair of trees, and every link is looked at. Sets come in the order of their keys: the
    same links however often a task is run.
    """
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("group", "one", "two", "key")])
    table = table.take(order)
    groups, one, two, part, sizes = (table.column(c).to_pylist() for c in ("group", "one", "two", "part", "n"))
    keys, sequences = table.column("key"), _binaries(table.column("tokens"))
    copies = table.column("copies").to_pylist() if "copies" in table.column_names else [1] * len(sizes)
    starts = [i for i in range(len(sizes)) if not i or (groups[i], one[i], two[i]) != (groups[i - 1], one[i - 1], two[i - 1])]
    a, b, n = [], [], []
    for start, end in zip(starts, [*starts[1:], len(sizes)], strict=True):
        build = [i for i in range(start, end) if part[i] == one[start]]
        probe = [i for i in range(start, end) if part[i] == two[start]]
        if not build or not probe:
            continue
        if not counting:
            for x, y in _reached(sequences, sizes, build, probe):
                a.append(x)
                b.append(y)
                n.append(0)
            continue
        tree, forest = Tree([sequences[i] for i in build], [sizes[i] for i in build]), Forest(end - start)
        met = [0] * (end - start)
        for i in probe:
            for k in tree.linked(sequences[i], sizes[i]):
                j = build[k]
                if j != i:
                    forest.link(i - start, j - start)
                    met[i - start] += copies[j]
                    if one[start] != two[start]:  # inside one tree the other direction has its own turn
                        met[j - start] += copies[i]
        for x, y in forest.links:
            a.append(start + x)
            b.append(start + y)
            n.append(0)
        for i, m in enumerate(met):
            if m:
                a.append(start + i)
                b.append(None)
                n.append(m)
    take = lambda at: pa.chunked_array(keys.take(pa.array(at, pa.int64())).chunks, pa.binary())
    return pa.table({"a": take(a), "b": take(b), "n": pa.array(n, pa.int64())})


def _join(table: pa.Table) -> pa.Table:
    return _met(table, counting=False)


def _count_links(table: pa.Table) -> pa.Table:
    return _met(table, counting=True)


def candidate_sets(docs: DataFrame, width: int = 5) -> DataFrame:
    """Distinct sets that share a token of their prefixes with another: key, n, prefix, tokens.

    Tokens are shuffled once, in packed arrays by range of their hash, to count the
    sets that have each; only those that several have travel back to their sets.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a set's key goes to every bucket: no more of them than memory, or some tasks a core, call for
    cores = docs.sparkSession.sparkContext.defaultParallelism
    buckets = max(1, -(-size // BUCKET_BYTES), min(4 * cores, size // 4_000_000))
    dealt = docs.select("text").mapInArrow(_deal(width, buckets), DEALT)
    counted = dealt.groupBy("bucket").applyInArrow(_count(buckets), DEALT)
    return cut_lineage(counted.groupBy("bucket").applyInArrow(_collect, SETS))


def _first_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prefix = batch.column("prefix").to_pylist()
        first = [np.frombuffer(t, dtype=np.int64)[:p] for t, p in zip(batch.column("tokens").to_pylist(), prefix, strict=True)]
        keys = batch.column("key").take(pa.array(np.repeat(np.arange(len(first)), prefix)))
        tokens = np.concatenate(first) if first else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"key": keys, "token": pa.array(tokens, pa.int64())})


def candidate_groups(sets: DataFrame) -> DataFrame:
    """key and group: sets that are connected by tokens of their prefixes."""
    entries = sets.select("key", "prefix", "tokens").mapInArrow(_first_tokens, "key binary, token bigint")
    leaders = entries.groupBy("token").agg(F.min("key").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    pairs = entries.join(leaders.select("token", "leader"), "token").select(F.col("key").alias("a"), F.col("leader").alias("b"))
    return graph.components(pairs.distinct()).select(F.col("node").alias("key"), F.col("root").alias("group"))


def links(docs: DataFrame, width: int = 5, tree_sets: int = TREE_SETS) -> DataFrame:
    """Pairs of distinct sets, of one class each, that span all that are linked: a and b, keys of sets.

    Small groups of candidates take one tree. A large one is first joined inside its
    trees; one set of each tree's largest class then meets those of the other trees.
    Only sets that are not in the group's largest class by then still meet all other
    trees: near copies, however many, are linked once along the trees, and every pair
    of sets that could join two classes is looked at.
    """
    members = _members(docs, width, tree_sets)
    inside = _joins(members.filter("one = two AND part = one"))
    # written as tables, as most tasks find nothing and a checkpoint keeps a part of each
    inside = rewritten(inside.select("a", "b"))
    large = members.filter("trees > 1 AND one = two AND part = one")
    large = cut_lineage(large.select("group", "part", "band", "key", "n", "copies", "tokens", "near"))
    if large.isEmpty():
        return inside
    heads = _classes(large, inside).groupBy("group", "part", "band", "root").agg(F.count("*").alias("m"), F.min("key").alias("key"))
    heads = heads.groupBy("group", "part").agg(F.max_by("key", F.struct("m", "key")).alias("key"))
    met = large.join(heads.select("key"), "key", "left_semi")
    several = met.groupBy("group").agg(F.ceil(F.count("*") / tree_sets).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("key"), F.col("shares")).cast("int")
    met = met.join(several, "group").withColumn("part", share).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    met = met.withColumns({"one": F.least("part", "with"), "two": F.greatest("part", "with")})
    across = inside.unionByName(rewritten(_joins(met).select("a", "b")))
    placed = cut_lineage(_classes(large, across).select("group", "key", "root"))
    main = placed.groupBy("group", "root").agg(F.count("*").alias("m")).groupBy("group").agg(F.max_by("root", F.struct("m", "root")).alias("main"))
    apart = placed.join(main, "group").filter("root <> main").select("key")
    probes = cut_lineage(large.join(apart, "key", "left_semi"))
    if probes.isEmpty():
        return across
    chunks = probes.groupBy("group").agg(F.ceil(F.count("*") / tree_sets).cast("int").alias("chunks"))
    chunk = -1 - F.pmod(F.xxhash64("key", F.lit(3)), F.col("chunks")).cast("int")
    asked = probes.join(chunks, "group").withColumn("two", chunk).withColumn("one", F.explode("near")).filter("one <> part")
    asked = asked.withColumn("part", F.col("two")).drop("chunks")
    trees = large.join(chunks, "group").withColumn("one", F.col("part")).withColumn("two", F.explode(F.sequence(-F.col("chunks"), F.lit(-1)))).drop("chunks")
    rest = _joins(asked.unionByName(trees.select(*asked.columns))).select("a", "b")
    return across.unionByName(rewritten(rest))


def _classes(sets: DataFrame, links: DataFrame) -> DataFrame:
    """The sets with the root of their class so far, their own key where nothing is linked."""
    roots = graph.components(links.join(sets.select(F.col("key").alias("a")), "a", "left_semi"))
    return sets.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))


def _members(docs: DataFrame, width: int, tree_sets: int, copies: DataFrame | None = None) -> DataFrame:
    """A row per set and pair of trees (one, two) that it has to be in.

    A group with more than ``tree_sets`` sets or TREE_BYTES of tokens is cut by length
    first: linked sets are in the same band of lengths (powers of 4/3) or in the next.
    A band is dealt into as many trees as it needs.
    """
    sets = candidate_sets(docs, width)
    groups = cut_lineage(candidate_groups(sets))
    sets = sets.withColumn("copies", F.lit(1).cast("bigint")) if copies is None else sets.join(copies.select("key", F.col("n").alias("copies")), "key")
    # a base just above 4/3 keeps rounding out of the way
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.3334))).cast("int")
    sets = cut_lineage(sets.join(groups, "key").withColumn("band", band))
    cost = F.greatest(F.col("n") / tree_sets, F.col("bytes") / TREE_BYTES)
    bands = (
        sets.groupBy("group", "band")
        .agg(F.count("*").alias("n"), F.sum(F.octet_length("tokens")).alias("bytes"))
        .withColumn("parts", F.ceil(cost).cast("int"))
    )
    each = F.struct("band", "parts")
    whole = bands.groupBy("group").agg(
        (F.ceil(F.greatest(F.sum("n") / tree_sets, F.sum("bytes") / TREE_BYTES))).cast("int").alias("trees"), F.collect_list(each).alias("bands")
    )
    own = F.aggregate("bands", F.lit(1), lambda acc, x: F.when(x["band"] == F.col("band"), x["parts"]).otherwise(acc))
    number = lambda band, part: band * 2**20 + part
    close = F.filter("bands", lambda x: F.abs(x["band"] - F.col("band")) <= 1)
    near = F.flatten(F.transform(close, lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda p: number(x["band"], p))))
    single = F.col("trees") == 1
    return (
        sets.join(whole, "group")
        .withColumn("part", F.when(single, 0).otherwise(number(F.col("band"), F.pmod(F.xxhash64("key"), own).cast("int"))))
        .withColumn("near", F.when(single, F.array(F.lit(0))).otherwise(near))
        .withColumn("with", F.explode("near"))
        .withColumns({"one": F.least("part", "with"), "two": F.greatest("part", "with")})
        .drop("bands", "with", "prefix")
    )


def _joins(members: DataFrame, counting: bool = False) -> DataFrame:
    """Join every (group, one, two): tasks follow the replicated rows and their bytes."""
    told = members.agg(F.count("*").alias("rows"), F.sum(F.octet_length("tokens")).alias("bytes")).first()
    tasks = max(told["rows"] // TASK_SETS, (told["bytes"] or 0) // TASK_BYTES, _partitions(members.sparkSession))
    task = F.pmod(F.xxhash64("group", "one", "two"), F.lit(tasks)).cast("bigint")
    return (
        members.select(task.alias("task"), "group", "one", "two", "part", "key", "n", "copies", "tokens")
        # joining costs CPU, so partitions are not merged by their bytes
        .repartition(int(min(tasks, 16 * _partitions(members.sparkSession))), "task")
        .groupBy("task")
        .applyInArrow(_count_links if counting else _join, "a binary, b binary, n bigint")
    )


def joined(docs: DataFrame, width: int = 5, tree_sets: int = TREE_SETS, copies: DataFrame | None = None) -> DataFrame:
    """Spanning links a and b, and rows (a, no b, n) whose n add up to the copies linked with a.

    To count links every two trees of a group that may hold linked sets are joined, in
    tasks of their own. ``copies`` has key and n, the rows that have a set (1 each
    without it).
    """
    return _joins(_members(docs, width, tree_sets, copies), counting=True)


def near_duplicates(docs: DataFrame, width: int = 5, count_links: bool = False) -> DataFrame:
    """Classes of documents whose shingle sets link, directly or through others.

    A set holds the distinct shingles of ``width`` words (maximal runs of other than
    space, tab, line breaks; A-Z lower-cased), or the whole sequence where there are
    fewer words. Two sets link if 100 x overlap >= 75 x union. Shingles are compared
    by 64-bit hashes.

    Equal sets are one set from the start. The others are ordered by how many sets
    have a token; two that link share a token of their prefixes. Sets connected that
    way are joined over prefix trees.

    Returns for every row doc_id, n_shingles and component_id (the smallest doc_id
    that can be reached, its own included). Null and empty texts have no shingles and
    link with nothing. A null doc_id never names a class; it stays null if its class
    has no other. Rows that repeat are answered each; other columns are ignored.
    With ``count_links`` n_links follows: the other rows whose sets are equal or link.
    """
    keyed = cut_lineage(set_keys(docs, width))
    classes = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    if count_links:
        classes = cut_lineage(classes)
        all_links = cut_lineage(joined(docs, width, copies=classes))
        spanning = all_links.filter("b IS NOT NULL").select("a", "b")
    else:
        spanning = links(docs, width)
    roots = graph.components(spanning).withColumnRenamed("node", "key")
    placed = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    several = placed.join(named, "root").filter("n > 1 OR root <> key OR component_id <> least").select("key", "component_id")
    found = skew.lookup(keyed, several, ["key"], "left", broadcast_rows=BROADCAST_IDS // 10)
    answer = ["doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")]
    if not count_links:
        return found.select(*answer)
    met = all_links.filter("b IS NULL").select(F.col("a").alias("key"), "n").unionByName(classes.select("key", (F.col("n") - 1).alias("n")))
    met = met.groupBy("key").agg(F.sum("n").alias("n_links")).filter("n_links > 0")
    counted = skew.lookup(found, met, ["key"], "left", broadcast_rows=BROADCAST_IDS // 10)
    return counted.select(*answer, F.coalesce("n_links", F.lit(0)).alias("n_links"))


def one_of_each(docs: DataFrame, width: int = 5) -> DataFrame:
    """The documents that name their class; rows without doc_id stay, rows that share one share the decision."""
    drop = near_duplicates(docs, width).filter("doc_id <> component_id").select("doc_id").distinct()
    drop = cut_lineage(drop)
    if skew.has_at_most(drop, BROADCAST_IDS):  # 8 bytes a row
        drop = F.broadcast(drop)
    return docs.join(drop, "doc_id", "left_anti").select(*docs.columns)
