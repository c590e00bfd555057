"""A data source that walks a folder: one row per text file, for batch and streaming reads.

The driver lists names only and deals them to partitions by size; executors read. Folders on a list of build and version
control names, and those that begin with a dot, are skipped; symbolic links to folders are followed once; files with a NUL
byte near their start are skipped as binary; a file that cannot be read is a row with an error. The folder must be
visible to driver and executors (a shared mount); a path in another store is read with Spark's own file source, which
also leaves out files whose names begin with a dot or an underscore.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.grammar import Grammar
from ..operators.search import search_hits, search_lines

# Folders that are not searched.
SKIPPED = (
    "node_modules", ".git", ".svn", ".hg", "dist", "build", "out", "target", ".next", ".nuxt", ".cache", "__pycache__",
    "coverage", ".output", ".turbo",
)
SNIFFED = 8192
PARTITION_BYTES = 64 << 20
SCHEMA = "file string, text string, error string"


def glob_regex(glob: str) -> re.Pattern:
    """`*` is any run but /, `**` any run, `?` one character but /; all else stands for itself."""
    made = {"**/": ".*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return re.compile("".join(made.get(p) or re.escape(p) for p in re.split(r"(\*\*/?|\*|\?)", glob)))


def walk(folder: str) -> Iterator[str]:
    seen, todo = set(), [folder]
    while todo:
        here = todo.pop()
        real = os.path.realpath(here)
        if real in seen:
            continue
        seen.add(real)
        try:
            entries = sorted(os.scandir(here), key=lambda e: e.name)
        except OSError:
            continue
        for entry in entries:
            if entry.is_dir():
                if not entry.name.startswith(".") and entry.name not in SKIPPED:
                    todo.append(entry.path)
            elif entry.is_file(follow_symlinks=False):
                yield entry.path


def listed(folder: str, glob: str | None) -> list[tuple[str, int, float]]:
    """(path, size, time of change) of the files of a folder, or of one file."""
    want = glob_regex(glob) if glob else None
    found = []
    for path in walk(folder) if os.path.isdir(folder) else [folder]:
        if want is None or want.fullmatch(os.path.basename(path)):
            try:
                stat = os.stat(path)
                found.append((path, stat.st_size, stat.st_mtime))
            except OSError:
                found.append((path, 0, 0.0))
    return found


def read_file(path: str) -> tuple[str, str | None, str | None] | None:
    try:
        with open(path, "rb") as f:
            data = f.read()
    except OSError as e:
        return path, None, str(e)
    return None if b"\0" in data[:SNIFFED] else (path, data.decode("utf-8", "replace"), None)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def dealt(found: list[tuple[str, int]]) -> list[Files]:
    """Paths with their sizes, dealt to partitions."""
    out, held = [], 0
    for path, size in found:
        if not out or held + size > PARTITION_BYTES:
            out.append(Files([]))
            held = 0
        out[-1].paths.append(path)
        held += size
    return out or [Files([])]


def read_files(partition: Files) -> Iterator[tuple]:
    return (row for path in partition.paths if (row := read_file(path)) is not None)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob")

    def partitions(self) -> list[Files]:
        return dealt([(path, size) for path, size, _ in listed(self.path, self.glob)])

    def read(self, partition: Files) -> Iterator[tuple]:
        return read_files(partition)


class SeenLog:
    """Files seen so far, as numbered entries in a folder: each holds the files that were new or changed when it was written.

    Every COMPACT entries all files of the log are written as one, so that opening it reads few files. Entries never change,
    so what lies between two numbers can be read again.
    """

    COMPACT = 64

    def __init__(self, folder: str):
        self.folder, self.number, self.seen = folder, 0, {}
        os.makedirs(folder, exist_ok=True)
        names = os.listdir(folder)
        whole = max((int(n.removesuffix(".all")) for n in names if n.endswith(".all")), default=0)
        if whole:
            self._take(f"{whole}.all", whole)
        for n in sorted(int(n.removesuffix(".new")) for n in names if n.endswith(".new")):
            if n > whole:
                self._take(f"{n}.new", n)

    def _take(self, name: str, number: int) -> None:
        self.seen |= {path: (size, at) for path, size, at in self._read(name)}
        self.number = number

    def _read(self, name: str) -> list[list]:
        with open(os.path.join(self.folder, name), encoding="utf-8") as f:
            return [json.loads(line) for line in f]

    def _write(self, name: str, rows: list) -> None:
        """Whole or not at all."""
        path = os.path.join(self.folder, name)
        with open(path + ".part", "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
        os.replace(path + ".part", path)

    def add(self, found: list[tuple[str, int, float]]) -> int:
        """Enter what is new among these files; the number of the last entry."""
        new = [(path, size, at) for path, size, at in found if self.seen.get(path) != (size, at)]
        if new:
            self._write(f"{self.number + 1}.new", new)
            self.number += 1
            self.seen |= {path: (size, at) for path, size, at in new}
            if self.number % self.COMPACT == 0:
                self._write(f"{self.number}.all", [(path, *rest) for path, rest in self.seen.items()])
        return self.number

    def between(self, start: int, end: int) -> list[tuple[str, int]]:
        """Files of the entries after start up to end, each once."""
        return sorted({path: size for n in range(start + 1, end + 1) for path, size, _ in self._read(f"{n}.new")}.items())


class LoggedFolderStream(DataSourceStreamReader):
    """New and changed files since the last batch, remembered in a log of files; an offset is a number of that log."""

    def __init__(self, options: dict):
        self.path, self.glob, self.log = options["path"], options.get("glob"), SeenLog(options["log"])

    def initialOffset(self) -> dict:
        return {"log": 0}

    def latestOffset(self) -> dict:
        return {"log": self.log.add(listed(self.path, self.glob))}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt(self.log.between(start["log"], end["log"]))

    def read(self, partition: Files) -> Iterator[tuple]:
        return read_files(partition)


class FolderStream(DataSourceStreamReader):
    """New and changed files since the last batch. An offset holds each path with its size and time of change, so a batch
    can be replayed, and a file that comes late with an old time is new all the same. Offsets grow with the folder's list of
    names; for folders of very many files give a folder for a log, which keeps them out of the offsets."""

    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob")

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": {path: [size, at] for path, size, at in listed(self.path, self.glob)}}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt([(path, now[0]) for path, now in sorted(end["files"].items()) if start["files"].get(path) != now])

    def read(self, partition: Files) -> Iterator[tuple]:
        return read_files(partition)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "grammar_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LoggedFolderStream(self.options) if "log" in self.options else FolderStream(self.options)


def read_folder(spark: SparkSession, path: str, glob: str | None = None, stream: bool = False, log: str | None = None) -> DataFrame:
    """file, text and error of the files of a folder or of one file.

    log, for streams: a folder of the stream's own, outside path, on a file system that the driver sees, in which the files
    seen are remembered; a checkpoint then holds a number a batch instead of the list of all files.
    """
    scheme, _, rest = path.partition(":")
    if rest.startswith("//") and scheme != "file":
        return _stored(spark, path, glob, stream)
    spark.dataSource.register(FolderSource)
    reader = (spark.readStream if stream else spark.read).format("grammar_folder").option("path", rest.removeprefix("//") if scheme == "file" and rest else path)
    reader = reader.option("log", log.removeprefix("file://")) if log and stream else reader
    return (reader.option("glob", glob) if glob else reader).load()


def not_skipped(file: Column, path: str) -> Column:
    """Whether no folder between path and a file in it is on the list, or begins with a dot."""
    store = "^[A-Za-z0-9+.-]+:(//[^/]*)?"  # written in more than one way
    parts, above = F.split(F.regexp_replace(file, store, ""), "/"), len(re.sub(store, "", path.rstrip("/")).split("/"))
    return ~F.exists(F.slice(parts, F.lit(above + 1), F.greatest(F.size(parts) - above - 1, F.lit(0))), lambda name: name.startswith(".") | name.isin(*SKIPPED))


def _stored(spark: SparkSession, path: str, glob: str | None, stream: bool) -> DataFrame:
    """The same of a folder in a store that only Spark reads."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    binary = F.instr(F.decode(F.substring("content", 1, SNIFFED), "ISO-8859-1"), "\0") > 0
    return files.filter(not_skipped(F.col("path"), path) & ~binary).select(F.col("path").alias("file"), F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("string").alias("error"))


def search_folder(spark: SparkSession, grammar: Grammar, path: str, glob: str | None = None, start_line: int | None = None, end_line: int | None = None, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """(lines with hits, files with errors) of a folder or one file; a line's hits are its column matches."""
    files = read_folder(spark, path, glob, stream)
    lines = search_lines(files.filter("text is not null"), grammar, "text", F.col("file"), start_line, end_line)
    return lines, files.filter("error is not null").select("file", "error")


def search_folder_hits(spark: SparkSession, grammar: Grammar, path: str, glob: str | None = None, start_line: int | None = None, end_line: int | None = None, stream: bool = False) -> DataFrame:
    """One row per hit in a folder or one file: file, line (from 1), col and end_col (from 0, in bytes of the line)."""
    files = read_folder(spark, path, glob, stream).filter("text is not null")
    return search_hits(files, grammar, "text", F.col("file"), start_line=start_line, end_line=end_line)
