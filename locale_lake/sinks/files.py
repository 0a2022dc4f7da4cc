"""Writing ordered files: the JVM builds and sorts the lines, tasks stream them out."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locale_lake.functions import fixed
from locale_lake.functions import text as tx
from locale_lake.operators import skew
from locale_lake.session import cut_lineage, qualified

# fixed values: the frame of a language file
XML_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<LanguageData>\n'
XML_FOOT = "</LanguageData>\n"

_COPY_BYTES = 4_000_000
_PIECES = "file string, lines bigint, path string, is_list boolean, has_bom boolean, part int"
_PIECES_ARROW = pa.schema(
    [("file", pa.string()), ("lines", pa.int64()), ("path", pa.string()), ("is_list", pa.bool_()), ("has_bom", pa.bool_()), ("part", pa.int32())]
)
_WRITTEN = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("lines", T.LongType())]
)


def output_folders(packages: DataFrame, out: str, lang: str) -> DataFrame:
    """Adds ``out_root``: base name and language, told apart where names repeat.

    A path without a scheme is one of the default file system, not of a task's disk.
    """
    out = qualified(packages.sparkSession, out)
    base = F.element_at(F.split("pkg_id", "/"), -1)
    named = packages.withColumn("_base", base)
    shared = (
        named.groupBy("_base").agg(F.count("*").alias("_n")).filter("_n > 1").select("_base", F.lit(True).alias("_shared"))
    )
    mark = F.when(
        F.col("_shared"), F.concat(F.lit("-"), F.sha2("pkg_id", 256))
    ).otherwise(F.lit(""))
    return (
        skew.lookup(named, shared, ["_base"], "left")
        .withColumn(
            "out_root",
            F.concat(F.lit(out.rstrip("/") + "/"), "_base", mark, F.lit("_" + lang.upper())),
        )
        .drop("_base", "_shared")
    )


def entry_line(with_source: bool = False) -> Column:
    """One entry of a language file as text, with its line end."""
    comment = F.concat(F.lit("  <!--"), tx.xml_comment(F.col("source_text")), F.lit("-->\n"))
    entry = F.concat(
        F.lit("  <"), "key", F.lit(">"), tx.xml_escape(F.col("final_text")), F.lit("</"), "key", F.lit(">\n")
    )
    if with_source:
        changed = F.col("final_text") != F.col("source_text")
        source = F.concat(F.lit("  <!--EN: "), tx.xml_comment(F.col("source_text")), F.lit("-->\n"))
        entry = F.concat(F.when(changed, source).otherwise(F.lit("")), entry)
    return F.when(F.col("is_comment"), comment).otherwise(entry)


def write_language_files(
    results: DataFrame,
    lang_folder: str,
    with_source: bool = False,
    materialise: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    """Write all channels; returns (file, lines).

    ``results``: units with ``final_text`` and ``out_root``; comment rows included.
    Rows are cut into ranges of (file, place), sorted inside them (which spills) and
    streamed out, so neither a file nor a package has to fit into memory or one task.
    A file that lies inside a range is written whole; the first and the last file of
    a range are written as numbered pieces, which are put together as bytes. A file
    appears under its name only when it is complete, so a repeated task replaces it.
    """
    is_list = F.col("channel") == "strings"
    plain = F.coalesce(F.when(~F.col("is_comment"), F.col("final_text")), F.col("source_text"))
    lines = results.select(
        F.concat_ws("/", "out_root", F.lit("Languages"), F.lit(lang_folder), "out_path").alias("file"),
        "layer",
        "sort_path",
        "seq",
        is_list.alias("is_list"),
        F.coalesce("has_bom", F.lit(False)).alias("has_bom"),
        F.when(is_list, F.concat(plain, F.lit("\n"))).otherwise(entry_line(with_source)).alias("line"),
    )
    # layers come in order; a mark on the first row is the mark of its source file
    placed = (
        lines.repartitionByRange("file", "layer", "sort_path", "seq")
        .sortWithinPartitions("file", "layer", "sort_path", "seq")
        .select("file", "is_list", "has_bom", "line")
    )
    pieces = materialise(placed.mapInArrow(_write_sorted(uuid.uuid4().hex), _PIECES))
    piece = F.struct("part", "path", "is_list", "has_bom", "lines")
    edges = pieces.filter("path IS NOT NULL").groupBy("file").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    joined = materialise(edges.mapInArrow(_assemble, _WRITTEN))
    # pieces go when every file that needs them is there, so a repeated task finds them
    pieces.filter("path IS NOT NULL").select("path").mapInArrow(_remove, "path string").write.format("noop").mode("overwrite").save()
    return pieces.filter("path IS NULL").select("file", "lines").unionByName(joined)


def write_texts(
    texts: DataFrame, materialise: Callable[[DataFrame], DataFrame] = cut_lineage
) -> DataFrame:
    """Write (file, content) rows, one file each.

    Small rows are many files, so their tasks are as many as cores at least.
    """
    spark = texts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = texts.select(
        "file", F.lit(True).alias("is_list"), F.lit(False).alias("has_bom"), F.col("content").alias("line")
    )
    return materialise(
        rows.repartition(tasks, "file").sortWithinPartitions("file").mapInArrow(_write_sorted(None), _PIECES).select("file", "lines")
    )


def _opened(file: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path and the path in it; paths without a scheme are local ones."""
    scheme, _, rest = file.partition("://")
    if not rest:
        return arrow_fs.LocalFileSystem(), os.path.abspath(file.removeprefix("file:"))
    if scheme == "file":
        return arrow_fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, slash, path = rest.partition("/")
    return arrow_fs.FileSystem.from_uri(f"{scheme}://{host}{slash}{quote(path)}")


class _Target:
    """One output file, written beside its place; complete, or a piece to be put together later."""

    def __init__(self, row: dict) -> None:
        self.file, self.is_list, self.has_bom, self.lines = row["file"], row["is_list"], row["has_bom"], 0
        self.system, self.path = _opened(self.file)
        self.system.create_dir(os.path.dirname(self.path), recursive=True)
        self.partial = f"{self.path}.{uuid.uuid4().hex}.part"
        self.stream = self.system.open_output_stream(self.partial)
        self.stream.write(_head(self.is_list, self.has_bom))

    def add(self, line: str) -> None:
        self.stream.write(line.encode())
        self.lines += 1

    def close(self, piece: str | None = None) -> dict:
        """End the file, or leave it open ended under the name of a piece."""
        if piece is None and not self.is_list:
            self.stream.write(XML_FOOT.encode())
        self.stream.close()
        self.system.move(self.partial, self.path + (f".{piece}" if piece else ""))
        return {
            "file": self.file, "lines": self.lines, "path": f"{self.file}.{piece}" if piece else None,
            "is_list": self.is_list, "has_bom": self.has_bom,
        }


def _head(is_list: bool, has_bom: bool) -> bytes:
    return (b"\xef\xbb\xbf" if has_bom else b"") + (b"" if is_list else XML_HEAD.encode())


def _write_sorted(stamp: str | None):
    """Stream sorted lines into files; with a stamp the first and the last file of a task stay pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        piece = f"{stamp}-{part:09d}" if stamp else None
        target: _Target | None = None
        is_first, done = True, []
        for batch in batches:
            for row in batch.to_pylist():
                if target is None or target.file != row["file"]:
                    if target is not None:
                        done.append(target.close(piece if is_first else None))
                        is_first = False
                    target = _Target(row)
                target.add(row["line"])
            if done:
                yield _pieces(done, part)
                done = []
        if target is not None:
            yield _pieces([target.close(piece)], part)

    return run


def _pieces(done: list[dict], part: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([d | {"part": part} for d in done], schema=_PIECES_ARROW)


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the pieces of each file together, in order, as a stream of bytes."""
    for batch in batches:
        lines = []
        for row in batch.to_pylist():
            first = row["pieces"][0]
            head = _head(first["is_list"], first["has_bom"])
            system, path = _opened(row["file"])
            partial = f"{path}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(partial) as out:
                out.write(head)
                for piece in row["pieces"]:
                    with system.open_input_file(_opened(piece["path"])[1]) as held:
                        held.seek(len(_head(piece["is_list"], piece["has_bom"])))
                        while block := held.read(_COPY_BYTES):
                            out.write(block)
                if not first["is_list"]:
                    out.write(XML_FOOT.encode())
            system.move(partial, path)
            lines.append(sum(p["lines"] for p in row["pieces"]))
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(lines, pa.int64())], names=["file", "lines"])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, name = _opened(path)
            if system.get_file_info(name).type != arrow_fs.FileType.NotFound:
                system.delete_file(name)
        yield batch


def descriptor(packages: DataFrame, lang: str, author: str = "locale_lake") -> DataFrame:
    """(file, content): the descriptor of each translated package."""
    folder = fixed.LANGUAGE_FOLDERS.get(lang.lower(), lang.capitalize())
    name = tx.xml_escape(F.coalesce("name", F.lit("Unknown Mod")))
    original = tx.xml_escape(F.coalesce("package_id", F.lit("unknown.mod")))

    def element(tag: str, body: Column, indent: int) -> Column:
        return F.concat(F.lit("  " * indent + f"<{tag}>"), body, F.lit(f"</{tag}>\n"))

    def block(tag: str, body: Column, indent: int) -> Column:
        space = "  " * indent
        return F.concat(F.lit(f"{space}<{tag}>\n"), body, F.lit(f"{space}</{tag}>\n"))

    versions = F.when(
        F.size("supported_versions") > 0, F.col("supported_versions")
    ).otherwise(F.array(F.lit(fixed.DEFAULT_VERSION)))
    listed = F.array_join(
        F.transform(versions, lambda v: element("li", tx.xml_escape(v), 2)), ""
    )
    about = F.concat(
        element("name", F.concat(name, F.lit(f" - {folder}")), 1),
        element("author", F.lit(author), 1),
        element("description", F.concat(F.lit(f"{folder} translation of "), name), 1),
        element("packageId", F.concat(original, F.lit(f".{lang.upper()}.Translation")), 1),
        block("supportedVersions", listed, 1),
        block(
            "modDependencies",
            block(
                "li", F.concat(element("packageId", original, 3), element("displayName", name, 3)), 2
            ),
            1,
        ),
        block("loadAfter", element("li", original, 2), 1),
    )
    return packages.select(
        F.concat("out_root", F.lit("/About/About.xml")).alias("file"),
        F.concat(
            F.lit('<?xml version="1.0" encoding="utf-8"?>\n'), block("ModMetaData", about, 0)
        ).alias("content"),
    )
