"""XML files to node rows. Parsing is the one step that needs Python."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOM = b"\xef\xbb\xbf"
_FLUSH_ROWS = 8192
_FEED_BYTES = 65_536
_NODE = pa.schema(
    [
        ("pos", pa.list_(pa.int32())),
        ("tags", pa.list_(pa.string())),
        ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())),
        ("text", pa.string()),
        ("is_comment", pa.bool_()),
        ("has_bom", pa.bool_()),
        ("parse_error", pa.string()),
    ]
)
_NODE_FIELDS = T.StructType(
    [
        T.StructField("pos", T.ArrayType(T.IntegerType())),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("tag", T.StringType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        T.StructField("text", T.StringType()),
        T.StructField("is_comment", T.BooleanType()),
        T.StructField("has_bom", T.BooleanType()),
        T.StructField("parse_error", T.StringType()),
    ]
).fields


class _Rows:
    """Parser target that turns events into node rows; it holds the open elements and nothing else.

    An element's row waits for its text, which ends at its first child or its end, so
    rows come in document order.
    """

    def __init__(self, keep_comments: bool, has_bom: bool):
        self.rows: list[tuple] = []
        self.has_bom, self.keep_comments = has_bom, keep_comments
        self.pos: list[int] = []
        self.tags: list[str] = []
        self.children: list[int] = []  # of each open element, so far
        self.waiting: tuple[str, dict] | None = None
        self.said: list[str] = []

    def _leave(self) -> None:
        if self.waiting is not None:
            tag, attrs = self.waiting
            row = (list(self.pos), list(self.tags), tag, list(attrs.items()), "".join(self.said), False, self.has_bom, None)
            self.rows.append(row)
            self.waiting, self.said = None, []

    def _place(self) -> None:
        if self.children:
            self.pos.append(self.children[-1])
            self.children[-1] += 1

    def start(self, tag: str, attrs: dict) -> None:
        self._leave()
        self._place()
        self.tags.append(tag)
        self.children.append(0)
        self.waiting = (tag, attrs)

    def data(self, text: str) -> None:
        if self.waiting is not None:
            self.said.append(text)

    def comment(self, text: str) -> None:
        if self.keep_comments and self.children:  # those outside the root are of no node
            self._leave()
            place = [*self.pos, self.children[-1]]
            self.children[-1] += 1
            self.rows.append((place, [*self.tags, ""], None, [], text, True, self.has_bom, None))

    def end(self, tag: str) -> None:
        self._leave()
        self.tags.pop()
        self.children.pop()
        if self.pos:
            self.pos.pop()

    def close(self) -> None:
        pass


class _Nothing:
    def close(self) -> None:
        pass


def _fed(target: object, content: memoryview) -> Iterator[None]:
    """Feed a document to a parser in steps; a malformed one raises."""
    parser = ET.XMLParser(target=target)
    for at in range(0, len(content), _FEED_BYTES):
        parser.feed(content[at : at + _FEED_BYTES])
        yield
    parser.close()


def node_rows(content: bytes, keep_comments: bool) -> Iterator[tuple]:
    """Pre-order node rows of one document; a malformed one gives one error row.

    The document is read as a stream of events, first only to see that it is well
    formed, so memory is bound by the depth of the tree, whatever its size.
    """
    has_bom = content.startswith(_BOM)
    body = memoryview(content)[len(_BOM) if has_bom else 0 :]
    try:
        for _ in _fed(_Nothing(), body):
            pass
    except (ET.ParseError, ValueError, LookupError) as error:
        yield None, None, None, None, None, None, has_bom, str(error)
        return
    target = _Rows(keep_comments, has_bom)
    for _ in _fed(target, body):
        yield from target.rows
        target.rows = []
    yield from target.rows


def shred_xml(
    files: DataFrame, keep: list[str], keep_comments: bool | str = False
) -> DataFrame:
    """One row per node with the ``keep`` columns of its file.

    ``keep_comments`` may name a boolean column among ``keep``.

    ``pos`` is the Dewey label below the document root (the root has ``[]``).
    Files are parsed one by one inside tasks; rows leave in small batches, so a
    large file is never held as one Arrow table.
    """
    source = files.select(*keep, "content")
    schema = T.StructType([*files.select(*keep).schema.fields, *_NODE_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = batch.select(keep)
            contents = batch.column("content")
            if isinstance(keep_comments, str):
                comments = batch.column(keep_comments).to_pylist()
            else:
                comments = [keep_comments] * batch.num_rows
            rows: list[tuple] = []
            owners: list[int] = []
            for i in range(batch.num_rows):
                for row in node_rows(contents[i].as_py() or b"", comments[i]):
                    rows.append(row)
                    owners.append(i)
                    if len(rows) == _FLUSH_ROWS:
                        yield _batch(carried, owners, rows)
                        rows, owners = [], []
            if rows:
                yield _batch(carried, owners, rows)

    return source.mapInArrow(run, schema)


def _batch(carried: pa.RecordBatch, owners: list[int], rows: list[tuple]) -> pa.RecordBatch:
    """Node rows with the columns of the files they belong to."""
    at = pa.array(owners)
    same = [column.take(at) for column in carried.columns]
    values = [
        pa.array(list(column), field.type) for column, field in zip(zip(*rows), _NODE)
    ]
    return pa.RecordBatch.from_arrays(
        [*same, *values], names=[*carried.schema.names, *_NODE.names]
    )


def quarantine(nodes: DataFrame, keep: list[str]) -> DataFrame:
    """Files that could not be parsed."""
    return nodes.filter(F.col("parse_error").isNotNull()).select(*keep, "parse_error")


def read_keyed(nodes: DataFrame) -> DataFrame:
    """Children of the root as key/value rows in order; comments stay as rows."""
    return (
        nodes.filter(F.size("pos") == 1)
        .withColumn("key", F.coalesce("tag", F.lit("")))
        .withColumn("seq", F.col("pos")[0].cast("bigint"))
        .withColumnRenamed("text", "source_text")
        .drop("pos", "tags", "tag", "attrs", "parse_error")
    )
