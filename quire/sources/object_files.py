"""A sink that makes one file of each row."""

from __future__ import annotations

import hashlib
import os
import re
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice
from urllib.parse import quote

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

# The sink travels with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a file's name, less those of its ending.
LONGEST = 240


def file_name(name: str, ending: str = ".json") -> str:
    """The name itself where a file can have it; else its odd characters are percent-encoded, and one
    that is too long is cut and told apart by a digest."""
    if re.search(OneFileEach.PLAIN, name):
        return name + ending
    safe = quote(name, safe=" !#$&'()+,;=@[]{}~")
    safe = "%2E" + safe[1:] if safe.startswith(".") else "%5F" + safe[1:] if safe.startswith("_") else safe
    if len(safe.encode()) > LONGEST:
        safe = f"{safe[:LONGEST - 33]}-{hashlib.md5(name.encode()).hexdigest()}"
    return safe + ending


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def entries(system: fs.FileSystem, folder: str) -> Iterator[tuple[str, bool, int]]:
    """Name, whether it is a file, and size of what lies right in a folder; a local folder's come as they
    are read."""
    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder)):
            yield info.base_name, info.type == fs.FileType.File, info.size or 0
        return
    with os.scandir(folder) as found:
        for each in found:
            yield each.name, each.is_file(), each.stat().st_size


def _names(system: fs.FileSystem, folder: str, most: int = 4096) -> Iterator[list[str]]:
    """Names of a folder's files, so many at a time."""
    found = (name for name, is_file, _ in entries(system, folder) if is_file)
    while names := list(islice(found, most)):
        yield names


@dataclass
class Written(WriterCommitMessage):
    folder: str


class OneFileEach(DataSource):
    """Rows of ``name`` and ``value`` as files ``<name>.json`` right below the path.

    Each attempt of a task writes to a folder of its own. Only those of attempts that Spark commits
    are moved to their place, so a repeated or speculative attempt leaves no second file, and a job
    that fails leaves what was there. Overwriting takes the folder's other ``.json`` files away,
    appending replaces those of the same names. Of rows that share a name one stays."""

    #: Names that are a file's name as they are.
    PLAIN = r"^(?![._])[^/\\%:*?\"<>|\x00-\x1f]{1,60}$"

    @classmethod
    def name(cls) -> str:
        return "one_file_each"

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if schema.names != ["name", "value"]:
            raise ValueError(f"one_file_each writes name and value, not {schema.names}")
        return OneFileEachWriter(self.options["path"], overwrite)


class OneFileEachWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        system, at = opened(folder)
        system.create_dir(at)
        for name, value in iterator:
            if name is None:
                raise ValueError("a row without a name has no file")
            with system.open_output_stream(f"{at}/{file_name(name)}") as out:
                out.write((value or "").encode())
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        """Names are held a few thousand at a time, however many files there are."""
        system, target = opened(self.path)
        system.create_dir(target)
        with ThreadPoolExecutor(16) as pool:
            if self.overwrite:
                for names in _names(system, target):
                    list(pool.map(lambda name: system.delete_file(f"{target}/{name}"), [name for name in names if name.endswith(".json")]))
            for message in messages:
                if message is not None:
                    _, at = opened(message.folder)
                    for names in _names(system, at):
                        list(pool.map(lambda name: system.move(f"{at}/{name}", f"{target}/{name}"), names))
        self._clear(system)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(opened(self.path)[0])

    def _clear(self, system: fs.FileSystem) -> None:
        _, at = opened(self.staging)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)
