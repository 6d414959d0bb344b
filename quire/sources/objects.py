"""JSON objects out of files that hold one, one on each line, or several over many lines each.

Files are read as lines, so Spark cuts large ones into splits. A line can't tell by itself whether it
begins an object, but JSON can: within an object, another may only begin after ``[``, ``,`` or ``:``.
So a line that begins with a brace after anything else begins a new object, whatever was broken
before, and each split finds its own objects from the first such line on. What lies before it, and
what is still open at a split's end, are fragments; those of a file are put together in order, a few
for each split, and are cut again.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from itertools import chain, islice

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.session import staged
from quire.sources.json_text import source_file
from quire.sources.object_files import entries, opened

# The splitter travels with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ESCAPE, _STRING, _OPEN_STRING = re.compile(r"\\."), re.compile(r'"[^"]*"'), re.compile(r'"[^"]*$')
_OTHER = re.compile(r"[^\[\]{},:\s]+")
_LINE, _FOLLOWING = re.compile(r"\n\{"), re.compile(r"\}\s*\{")
_BETWEEN = " \t\r\n,"

#: Names that Spark's readers pass over, patterns in a path, files that are packed, and ends of lines.
_HIDDEN = re.compile(r"^\.|^_(?!metadata|common_metadata|[^=]*=)|\._COPYING_$")
_PATTERN = re.compile(r"[*?\[\]{}\\,]")
_PACKED = r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$"
_ENDS = re.compile(r"\r\n|\n|\r")

#: Small files that a task opens, and bytes it reads, at least, before there are more tasks than cores.
OPENED, READ = 10_000, 64 << 20

#: What an object within another comes after.
INSIDE = "[,:"

COMPLETE, HEAD, TAIL = 0, 1, 2

RECORDS = "file string, block long, kind int, text string, complete long, whole boolean"


def skeleton(line: str) -> str:
    """The line's brackets, commas and colons, with ``s`` for each string or other value. A string
    ends with its line at the latest, since JSON has no line breaks in them."""
    bare = _OPEN_STRING.sub("s", _STRING.sub("s", _ESCAPE.sub("", line)))
    return "".join(_OTHER.sub("s", bare).split())


class Splitter:
    """Cuts lines into objects. ``certain`` says that the first line begins something; if not, lines
    are kept as ``head`` until one surely does."""

    def __init__(self, certain: bool) -> None:
        self.certain, self.head = certain, []
        self.lines: list[str] = []
        self.depth, self.last = 0, ""

    def feed(self, line: str) -> Iterator[str]:
        bones = skeleton(line)
        begins = bones[:1] == "{" and self.last not in tuple(INSIDE)
        if not self.certain and not (begins and self.last):
            self.head.append(line)
            self.last = bones[-1:] or self.last
            return
        self.certain = True
        if not bones:
            if self.lines:
                self.lines.append(line)
            return
        if begins and self.depth > 0:  # what came before was never closed
            yield from self._cut()
        self.lines.append(line)
        self.depth += bones.count("{") + bones.count("[") - bones.count("}") - bones.count("]")
        self.last = bones[-1]
        if self.depth <= 0:
            yield from self._cut()

    def rest(self) -> list[str]:
        """The lines of what is still open."""
        return self.lines

    def end(self) -> Iterator[str]:
        yield from self._cut()

    def _cut(self) -> Iterator[str]:
        lines, self.lines, self.depth, self.last = self.lines, [], 0, self.last or "s"
        if lines:
            yield from pieces("\n".join(lines))


def pieces(text: str) -> Iterator[str]:
    """The objects of a text, those of a list one by one, and what is left between them."""
    text = text.strip()
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        found = None
    if isinstance(found, dict):
        yield text
    elif isinstance(found, list) and found and all(isinstance(each, dict) for each in found):
        yield from (json.dumps(each, ensure_ascii=False) for each in found)
    else:
        yield from _several(text)


def _several(text: str) -> Iterator[str]:
    """Objects that follow each other, and stretches of anything else as they are. Where no object
    can be read, the next may begin a line or follow a closing brace."""
    decoder, start, at = json.JSONDecoder(), 0, 0
    while at < len(text):
        try:
            end = decoder.raw_decode(text, at)[1] if text[at] == "{" else at
        except (ValueError, RecursionError):
            end = at
        if end == at:
            places = [found.end() - 1 for found in (_LINE.search(text, at), _FOLLOWING.search(text, at)) if found]
            at = min(places, default=len(text))
            continue
        if text[start:at].strip(_BETWEEN):
            yield text[start:at].strip()
        yield text[at:end]
        start = at = end
        while at < len(text) and text[at] in _BETWEEN:
            at += 1
    if text[start:].strip(_BETWEEN):
        yield text[start:].strip()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """The rows of each stretch with one file and split."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(name).to_pylist() for name in ("file", "block", "length", "size", "value")))

    state: dict = {"next": None, "rows": rows()}

    def lines(key: tuple) -> Iterator[str]:
        for *own, value in chain([state["next"]], state["rows"]):
            if tuple(own) != key:
                state["next"] = (*own, value)
                return
            yield value
        state["next"] = None

    state["next"] = next(state["rows"], None)
    while state["next"] is not None:
        key = tuple(state["next"][:-1])
        yield key, lines(key)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete objects of every split, and its fragments. Rows of many small files go on together."""
    held: list[tuple[str, int, int, str, int, bool]] = []

    def out() -> pa.RecordBatch:
        columns = [list(column) for column in zip(*held)]
        held.clear()
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)],
            names=["file", "block", "kind", "text", "complete", "whole"],
        )

    for (file, block, length, size), lines in _blocks(batches):
        alone = block == 0 and length >= size
        splitter, count = Splitter(certain=block == 0), 0
        for line in lines:
            for text in splitter.feed(line):
                if len(held) >= 256:
                    yield out()
                count += 1
                held.append((file, block, COMPLETE, text, 0, False))
        if alone:
            last = list(splitter.end())
            count += len(last)
            held += [(file, block, COMPLETE, text, 0, False) for text in last]
            if count == 1:  # the file's only one
                held[-1] = (*held[-1][:-1], True)
        else:
            if splitter.head:
                held.append((file, block, HEAD, "\n".join(splitter.head), 0, False))
            if splitter.certain:
                held.append((file, block, TAIL, "\n".join(splitter.rest()), count, False))
        if len(held) >= 256:
            yield out()
    if held:
        yield out()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Objects of the fragments that belong together."""
    for batch in batches:
        for file, text, single in zip(*(batch.column(name).to_pylist() for name in ("file", "text", "single"))):
            splitter = Splitter(certain=True)
            found = [each for line in text.split("\n") for each in splitter.feed(line)]
            found += splitter.end()
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(found), pa.string()), pa.array(found, pa.string()), pa.array([single and len(found) == 1] * len(found))],
                    names=["file", "value", "whole"],
                )


def _never_cut(spark: SparkSession) -> int:
    """Bytes of a file that Spark reads in one split whatever else there is to read."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    return min(size(spark.conf.get(name)) for name in names)


def _listed(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]] | None:
    """A folder's files that are never cut, dealt to tasks as ``path``, and the others; None where ``path``
    is no plain folder of files, for which Spark has rules of its own."""
    try:
        system, at = opened(path)
        plain = not _PATTERN.search(path) and system.get_file_info(at).type == fs.FileType.Directory
    except (OSError, ValueError):  # a file system that only Spark knows
        plain = False
    if not plain:
        return None

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, folder = opened(path)
            found = ((name, is_file, size) for name, is_file, size in entries(system, folder) if not _HIDDEN.search(name))
            while part := list(islice(found, 4096)):
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*part)], names=["name", "is_file", "size"])

    files = staged(spark.range(0, 1, 1, 1).mapInArrow(names, "name string, is_file boolean, size long"), "listed")
    whole = F.col("is_file") & (F.col("size") <= _never_cut(spark)) & ~F.col("name").rlike(_PACKED)
    large = [(r.name, r.is_file) for r in files.filter(~whole).collect()]
    if not all(is_file and not _PATTERN.search(name) for name, is_file in large):
        return None
    n, size = files.filter(whole).agg(F.count("*"), F.sum("size")).first()
    tasks = max(1, min(n, spark.sparkContext.defaultParallelism), n // OPENED, (size or 0) // READ)
    base = path.rstrip("/")
    return files.filter(whole).select(F.concat(F.lit(f"{base}/"), "name").alias("path")).repartition(tasks), [f"{base}/{name}" for name, _ in large]


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The objects of small files, each of which is read whole."""
    def out() -> pa.RecordBatch:
        columns = [list(column) for column in zip(*held)]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, (pa.string(), pa.string(), pa.bool_()))], names=["file", "value", "whole"]
        )

    held: list[tuple[str, str, bool]] = []
    for batch in batches:
        for path in batch.column("path").to_pylist():
            system, at = opened(path)
            with system.open_input_stream(at, compression=None) as file:
                text = file.read().removeprefix(b"\xef\xbb\xbf").decode(errors="replace")
            splitter = Splitter(certain=True)
            lines = _ENDS.split(text)
            found = [each for line in (lines if lines[-1] else lines[:-1]) for each in splitter.feed(line)]
            found += splitter.end()
            held += [(path.rsplit("/", 1)[-1], each, len(found) == 1) for each in found]
            if len(held) >= 256:
                yield out()
    if held:
        yield out()


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``value`` and ``whole`` of every object below ``path``: the file's name, the object's
    text, and whether it is all that its file holds.

    Objects may be on a line each, go over many lines, follow each other on one line or be the
    entries of a list. What is no object comes as a row of its own, with its text, and costs no other:
    an object that is cut off ends where the next one begins. (One that is cut off right after a
    comma or an opening bracket may still take the next line's object for one of its own; that is
    told apart when the whole is found broken.) Files without any text have no rows.

    A split's lines are worked on in the task that reads them; only fragments at its ends are
    shuffled, and a single object is held in memory. Files that may be cut are read twice, once for
    their objects and once for fragments; all smaller ones once. A folder is listed at once, by a task:
    the driver only knows files that may be cut.
    """
    files = _listed(spark, path)
    small, large = (None, [path]) if files is None else files
    text = spark.read.text(large) if large else spark.read.schema("value string").text(large)
    lines = text.select(
        source_file().alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_path").alias("path"), "value",
    )
    # Files of one name in several folders are told apart by their paths.
    named = lines.select(F.concat_ws("\n", "path", "file").alias("file"), "block", "length", "size", "value")
    done = named.mapInArrow(_split, RECORDS).where(F.col("kind") == COMPLETE).select("file", F.col("text").alias("value"), "whole")
    # Only files that are cut into splits have fragments; the others are not opened a second time.
    some = lines.where(F.col("size") > _never_cut(spark)).where("block > 0 OR length < size")
    cut = some.select(F.concat_ws("\n", "path", "file").alias("file"), "block", "length", "size", "value").mapInArrow(_split, RECORDS)
    ordered = Window.partitionBy("file").orderBy("block", "kind")
    fragments = cut.where(F.col("kind") != COMPLETE).withColumn("part", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(ordered))
    parts = fragments.groupBy("file", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "kind", "text"))), lambda f: f["text"]), "\n").alias("text"),
        F.sum("complete").alias("complete"),
    )
    whole = Window.partitionBy("file")
    single = (F.sum("complete").over(whole) == 0) & (F.sum(F.when(F.length("text") > 0, 1).otherwise(0)).over(whole) == 1)
    stitched = parts.withColumn("single", single).mapInArrow(_joined, "file string, value string, whole boolean")
    both = done.unionByName(stitched).select(F.substring_index("file", "\n", -1).alias("file"), "value", "whole")
    return both if small is None else both.unionByName(small.mapInArrow(_opened, "file string, value string, whole boolean"))
