"""Secret scans with an incremental ledger of content-addressed blobs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locale_lake.llm import rawtext
from locale_lake.llm.sampling import unused
from locale_lake.operators import skew
from locale_lake.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """A pattern, what a text that matches must contain in lower case, and what a match must pass."""

    kind: str
    version: int
    pattern: str
    needles: tuple[str, ...]
    group: int = 0
    least: int = 1
    flags: int = re.A

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule(
        "assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        ("password", "passwd", "secret", "token", "apikey", "api_key"), group=2, least=12, flags=re.A | re.I,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", ("akia",), least=18),
    Rule("hex", 1, r"[0-9a-f]{16,}", ()),  # runs are maximal, shorter ones fail
)
MORE = (
    Rule("private_key", 1, r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", ("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", ("eyj",)),
    Rule("forge_token", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,})", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-")),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("url_password", 1, r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{3,100}@", ("://",)),
)
RULES = BASE + MORE
#: the rules before the last change: assignments had fewer names
EARLIER = (
    Rule("assign", 0, r"""(password|token)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", ("password", "token"), group=2, least=12, flags=re.A | re.I),
    *RULES[1:],
)
# Blobs with findings (some 200 bytes each) are broadcast up to this.
BROADCAST_BLOBS = 200_000

_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_HEX = rawtext._class((0x30, 0x39), (0x61, 0x66))


def matches(rule: Rule, pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches in code points; those that are too short are dropped after."""
    return [m.span() for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _holding(texts: rawtext.Texts, rule: Rule, lower: bytes) -> np.ndarray:
    """Texts of the slice in which the rule can match at all."""
    if rule.needles:
        places = []
        for needle in rule.needles:
            sought = needle.encode()
            at = lower.find(sought)
            while at >= 0:
                places.append(at)
                at = lower.find(sought, at + 1)
        places = np.array(places, dtype=np.int64)
    else:
        edges = np.diff(_HEX[texts.data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        places = starts[ends - starts >= 16]
    return np.unique(np.searchsorted(texts.offsets, places, side="right") - 1)


def _scanner(rules: tuple[Rule, ...]):
    by_key = {r.key: (i, r) for i, r in enumerate(rules)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {r.key: re.compile(r.pattern, r.flags) for r in rules}
        for batch in batches:
            for rows in rawtext.slices(batch, "text"):
                texts = rawtext.Texts(rows.column("text"))
                lower = rawtext.LOWER[texts.data].tobytes()
                todo = [set(x) for x in rows.column("todo").to_pylist()]
                found: list[list] = [[] for _ in range(rows.num_rows)]
                for key, (place, rule) in by_key.items():
                    for i in _holding(texts, rule, lower).tolist():
                        if key in todo[i]:
                            text = rows.column("text")[i].as_py()
                            found[i] += [(s, place, e) for s, e in matches(rule, patterns[key], text)]
                out = [[{"kind": rules[p].kind, "start": s, "end": e} for s, p, e in sorted(x)] for x in found]
                yield pa.RecordBatch.from_pydict(
                    {"blob": rows.column("blob"), "todo": rows.column("todo"), "findings": pa.array(out, pa.list_(_FINDING))}
                )

    return run


def blobs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with ``blob``, the SHA-256 of the text (null: empty)."""
    return docs.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)))


def _signs(rules: tuple[Rule, ...]):
    """Null in place of every text without a sign of any rule: such a text need not travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in rawtext.slices(batch, "text"):
                texts = rawtext.Texts(rows.column("text"))
                lower = rawtext.LOWER[texts.data].tobytes()
                some = np.zeros(rows.num_rows, dtype=bool)
                for rule in rules:
                    some[_holding(texts, rule, lower)] = True
                kept = rows.column("text").take(pa.array(np.arange(rows.num_rows), mask=~some))
                yield pa.RecordBatch.from_arrays([rows.column("blob"), kept], names=["blob", "text"])

    return run


def scan_unseen(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan every (blob, rule and version) that the ledger lacks, each once.

    A text is scanned once however many rows or versions of a path hold it. Copies
    are dropped inside each task before they are shuffled, so a blob that makes up
    much of the table meets in one row per task; a text without a sign of any rule
    goes as its digest alone. ``ledger`` has blob and rule (``kind@version``), as from
    ``ledger_rows``. Returns blob, todo (rules applied) and findings (kind, start, end
    in code points, end exclusive; by start, then in the order of the rules). Null
    counts as the empty text, which has no findings. Columns besides text are ignored.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    unseen = blobs(docs.select(F.coalesce("text", F.lit("")).alias("text")))
    unseen = unseen.select("blob", "text").mapInArrow(_signs(rules), "blob binary, text string").dropDuplicates(["blob"])
    if ledger is None:
        unseen = unseen.withColumn("todo", keys)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        unseen = unseen.join(seen, "blob", "left").withColumn(
            "todo", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
        )
    return (
        unseen.filter(F.size("todo") > 0)
        .select("blob", "text", "todo")
        .mapInArrow(
            _scanner(rules), "blob binary, todo array<string>, findings array<struct<kind:string,start:bigint,end:bigint>>"
        )
    )


def ledger_rows(scanned: DataFrame) -> DataFrame:
    """What to append to the ledger after a scan."""
    return scanned.select("blob", F.explode("todo").alias("rule"))


def scanned_in_runs(docs: DataFrame, runs: tuple[tuple[Rule, ...], ...] = (EARLIER, RULES)) -> DataFrame:
    """Scans under one set of rules after the other; each run scans what the ledger so far lacks.

    After a change of one rule only that rule is applied again. Scans are written to
    the shared checkpoint folder, as a ledger outlives its run.
    """
    scanned, ledger = None, None
    for rules in runs:
        found = cut_lineage(scan_unseen(docs, ledger, rules))
        scanned = found if scanned is None else scanned.unionByName(found)
        ledger = ledger_rows(scanned)
    return scanned


def current(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and findings, one row per blob: of each rule the newest version that was applied.

    What an older version of a rule found goes, and so do kinds that ``rules`` lack.
    """

    def newest(place: int, kind: str) -> Column:
        def told(run: Column) -> Column:
            version = F.transform(
                F.filter(run["todo"], lambda key: F.substring_index(key, "@", 1) == kind), lambda key: F.substring_index(key, "@", -1).cast("int")
            )
            of_kind = F.transform(
                F.filter(run["findings"], lambda f: f["kind"] == kind), lambda f: F.struct(f["start"], F.lit(place).alias("place"), f["end"], f["kind"])
            )
            return F.struct(F.coalesce(F.array_max(version), F.lit(-1)).alias("version"), of_kind.alias("found"))

        return F.array_max(F.transform("runs", told))["found"]

    kinds = list(dict.fromkeys(r.kind for r in rules))
    found = F.sort_array(F.concat(*[newest(k, kind) for k, kind in enumerate(kinds)]))
    return (
        scanned.groupBy("blob")
        .agg(F.collect_list(F.struct("todo", "findings")).alias("runs"))  # a row per scan
        .filter(F.exists("runs", lambda r: F.size(r["findings"]) > 0))
        .select("blob", F.transform(found, lambda f: F.struct(f["kind"].alias("kind"), f["start"].alias("start"), f["end"].alias("end"))).alias("findings"))
        .filter(F.size("findings") > 0)
    )


def findings_by_row(docs: DataFrame, scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the findings of its text, for every row; [] if there are none."""
    hits = cut_lineage(current(scanned, rules))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    keyed = blobs(docs.select("doc_id", "text")).select("doc_id", "blob")
    return skew.lookup(keyed, hits, ["blob"], broadcast_rows=BROADCAST_BLOBS).select(
        "doc_id", F.coalesce("findings", none).alias("findings")
    )


def redacted(docs: DataFrame, scanned: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with every finding replaced by ``mark``, all columns kept; ``n_chars`` follows the text.

    Overlapping findings become one mark. Texts without findings stay as they are,
    null and empty ones among them; rows that repeat are redacted each; columns may
    have any names.
    """
    columns = docs.columns
    blob, spans, new = (unused(docs, n) for n in ("blob", "findings", "redacted"))
    hits = cut_lineage(current(scanned, rules)).select(F.col("blob").alias(blob), F.col("findings").alias(spans))
    # findings come by start: cut between the end of all before and the start of the next
    step = F.aggregate(
        spans,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("done")),
        lambda acc, f: F.struct(
            F.when(
                f["start"] >= acc["done"],
                F.concat(
                    acc["out"],
                    F.substring(F.col("text"), (acc["done"] + 1).cast("int"), (f["start"] - acc["done"]).cast("int")),
                    F.lit(mark),
                ),
            ).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["done"], f["end"]).alias("done"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["done"] + 1).cast("int"), F.length("text"))),
    )
    keyed = docs.withColumn(blob, F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    changed = F.col(spans).isNotNull()
    out = skew.lookup(keyed, hits, [blob], broadcast_rows=BROADCAST_BLOBS).withColumn(new, F.when(changed, step).otherwise(F.col("text")))
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length(new).cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(new).alias("text") if c == "text" else F.col(c) for c in columns])


def digest(findings: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text, per row."""
    kind_in = lambda kinds: F.filter("findings", lambda f: f["kind"].isin(kinds))
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ","
    )
    return findings.select(
        "doc_id",
        *[F.size(kind_in([r.kind])).cast("bigint").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(shown(kind_in([r.kind for r in BASE])), 256).alias("base_sha256"),
        shown(F.col("findings")).alias("spans"),
    )
