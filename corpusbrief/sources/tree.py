"""Repository trees on a shared file system as a files table.

Spark's ``binaryFile`` source leaves out names that start with ``_`` or ``.``, ``__init__.py``
among them, so trees get their own reader. Two ways in, over one small walker:

* ``spark.read.format("repository_trees")`` for a handful of roots named in options;
* :func:`scan_trees` for a DataFrame of roots, with listing and reading both done in tasks.

Each file row carries ``head`` (the first 1,024 bytes, for the binary sniff) and ``content``, read
only for files of an acceptable size that don't look binary. What cannot be read gives a row with
``read_error`` and never hides what lies beside it: a file, a folder, a missing root (path ``.``), or a name that is
not UTF-8, whose bytes are then escaped in ``path``.
"""

from __future__ import annotations

import itertools
import json
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, StringEndsWith, StringStartsWith,
)

from ..functions import rules
from ..functions.paths import extension, file_name, is_code, is_important, keep_dir, keep_ext, keep_name
from ..session import landed, ship_package

FILES_SCHEMA = "repo_id string, path string, size long, head binary, content binary, read_error string"
_FOUND_SCHEMA = "repo_id string, root string, path string, folder boolean, read_error string"
_FILES_PER_BATCH = 64
_BYTES_PER_BATCH = 8 << 20
_PATHS_PER_BATCH = 10_000
#: Entries a task lists of one unit before it hands the folders left over to other tasks.
_ENTRIES_PER_UNIT = 50_000
_IGNORED_DIRS = frozenset(rules.IGNORED_DIRECTORIES)
_IGNORED_EXTS = frozenset(rules.IGNORED_EXTENSIONS)
_TEXT_EXTS = frozenset(rules.TEXT_EXTENSIONS + rules.CODE_EXTENSIONS)


def _told(error: OSError) -> str:
    return f"{type(error).__name__}: {error.strerror}"


def _is_dir(entry: os.DirEntry, follow: bool) -> bool:
    """What cannot be told, such as a link to itself, is no folder."""
    try:
        return entry.is_dir(follow_symlinks=follow)
    except OSError:
        return False


def _entries(folder: str, prune: bool) -> tuple[list[str], list[str], str | None]:
    """Sorted sub-directory and file names, and what went wrong; linked directories are not entered."""
    dirs, files, error = [], [], None
    try:
        with os.scandir(folder) as found:
            for entry in found:
                if _is_dir(entry, follow=False):
                    hidden = entry.name.startswith(".") or entry.name.lower() in _IGNORED_DIRS
                    if not (prune and hidden):
                        dirs.append(entry.name)
                elif not _is_dir(entry, follow=True):
                    files.append(entry.name)
    except OSError as broken:
        error = _told(broken)
    return sorted(dirs), sorted(files), error


def _printable(path: str) -> tuple[str, str | None]:
    """The path, with bytes that are not UTF-8 escaped, and the error they are."""
    try:
        path.encode()
        return path, None
    except UnicodeEncodeError:
        return os.fsencode(path).decode("utf-8", "backslashreplace"), "UnicodeDecodeError: name is not UTF-8"


def _skipped(path: str) -> bool:
    name = os.path.basename(path)
    return name.startswith(".") or PurePosixPath(name).suffix.lower() in _IGNORED_EXTS


def _file_row(repo_id: str, root: str, path: str, error: str | None = None) -> tuple:
    if error is not None:
        return repo_id, path, None, None, None, error
    full = os.path.join(root, path)
    size = None
    try:
        size = os.stat(full).st_size
        with open(full, "rb") as stream:
            head = stream.read(rules.SNIFF_BYTES)
            fits = rules.MIN_FILE_BYTES <= size <= rules.MAX_FILE_BYTES
            binary = b"\0" in head and PurePosixPath(path).suffix.lower() not in _TEXT_EXTS
            content = head + stream.read() if fits and not binary else None
        return repo_id, path, size, head, content, None
    except OSError as error:
        return repo_id, path, size, None, None, _told(error)


def _walk(
    root: str, sub: str, prune: bool, limit: int | None = None, deep: bool = True, enter: Callable[[str], bool] | None = None,
) -> Iterator[tuple[str, bool, str | None]]:
    """(path, folder, error) of the files of a folder and below; once ``limit`` entries were listed,
    the folders still to be listed. A folder whose name is not UTF-8 is always listed here, as its
    name cannot travel. Folders that ``enter`` refuses are left out."""
    pending, listed = [sub], 0
    while pending:
        here = pending.pop()
        label, unnamed = _printable(here)
        if unnamed is None and here != sub and (not deep or (limit is not None and listed >= limit)):
            yield here, True, None
            continue
        dirs, files, error = _entries(os.path.join(root, here), prune)
        listed += len(dirs) + len(files) + 1
        if error is not None:
            yield label or ".", False, error
        for name in files:
            path = os.path.join(here, name)
            shown, unnamed = _printable(path)
            yield shown, False, unnamed
        below = [os.path.join(here, name) for name in reversed(dirs)]
        pending.extend(below if enter is None else filter(enter, below))


class _Unit(InputPartition):
    def __init__(self, repo_id: str, root: str, sub: str, deep: bool):
        self.repo_id, self.root, self.sub, self.deep = repo_id, root, sub, deep


@dataclass
class _Wanted:
    """What pushed filters ask for; each holds for itself."""

    repos: list[set] = field(default_factory=list)
    paths: list[set] = field(default_factory=list)
    starts: list[str] = field(default_factory=list)
    ends: list[str] = field(default_factory=list)

    def take(self, asked: Filter) -> bool:
        """Whether the filter is kept here in full."""
        if isinstance(asked, (EqualTo, EqualNullSafe, In)):
            values = set(asked.value) if isinstance(asked, In) else {asked.value}
            column = {("repo_id",): self.repos, ("path",): self.paths}.get(asked.attribute)
            if column is not None:
                column.append(values)
            return column is not None
        if asked.attribute != ("path",):
            return isinstance(asked, IsNotNull) and asked.attribute == ("repo_id",)
        if isinstance(asked, StringStartsWith):
            self.starts.append(asked.value)
        elif isinstance(asked, StringEndsWith):
            self.ends.append(asked.value)
        return isinstance(asked, (StringStartsWith, StringEndsWith, IsNotNull))

    def repo(self, repo_id: str) -> bool:
        return all(repo_id in values for values in self.repos)

    def path(self, path: str) -> bool:
        return (
            all(path in values for values in self.paths)
            and all(map(path.startswith, self.starts)) and all(map(path.endswith, self.ends))
        )

    def folder(self, folder: str) -> bool:
        """Whether a path below can be wanted; a name that is shown escaped is always entered."""
        if _printable(folder)[1] is not None:
            return True
        below = folder + "/"
        return all(below.startswith(s) or s.startswith(below) for s in self.starts) and all(
            any(p is not None and p.startswith(below) for p in values) for values in self.paths
        )


class _TreeReader(DataSourceReader):
    def __init__(self, roots: dict[str, str], prune: bool, split: bool):
        self._roots, self._prune, self._split, self._wanted = roots, prune, split, _Wanted()

    def partitions(self) -> list[InputPartition]:
        units = []
        for repo_id, root in sorted(self._roots.items()):
            if not self._wanted.repo(repo_id):
                continue
            units.append(_Unit(repo_id, root, "", not self._split))
            if self._split:
                tops = _walk(root, "", self._prune, deep=False, enter=self._wanted.folder)
                units.extend(_Unit(repo_id, root, path, True) for path, folder, _ in tops if folder)
        return units

    def read(self, partition: _Unit) -> Iterator[tuple]:
        found = _walk(partition.root, partition.sub, self._prune, deep=partition.deep, enter=self._wanted.folder)
        for path, folder, error in found:
            if not folder and self._wanted.path(path) and (error is not None or not (self._prune and _skipped(path))):
                yield _file_row(partition.repo_id, partition.root, path, error)


class _FilteredTreeReader(_TreeReader):
    """Keeps filters on ``repo_id`` and ``path`` itself: other roots are not listed, other files not opened."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [asked for asked in filters if not self._wanted.take(asked)]


class RepositoryTrees(DataSource):
    """Options: ``roots`` (JSON map of repo id to directory), ``prune`` and ``split`` (true/false), and ``filters``:
    true takes pushed filters, for which Spark wants ``spark.sql.python.filterPushdown.enabled``."""

    @classmethod
    def name(cls) -> str:
        return "repository_trees"

    def schema(self) -> str:
        return FILES_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        roots = json.loads(self.options["roots"])
        prune = self.options.get("prune", "true") == "true"
        split = self.options.get("split", "true") == "true"
        filters = self.options.get("filters", "false") == "true"
        return (_FilteredTreeReader if filters else _TreeReader)(roots, prune, split)


def read_trees(spark: SparkSession, roots: dict[str, str], prune: bool = True, split: bool = True) -> DataFrame:
    """A few named roots, one task per top-level directory of each.

    Filters on ``repo_id`` and on ``path`` (equal, in, starts with, ends with, so by extension too) reach the source:
    it then lists and opens nothing else. Spark hands them over by a setting of the session, which is turned on here.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepositoryTrees)
    return (
        spark.read.format("repository_trees")
        .option("roots", json.dumps(roots))
        .option("prune", str(prune).lower())
        .option("split", str(split).lower())
        .option("filters", "true")
        .load()
    )


def list_trees(
    roots: DataFrame, prune: bool = True, tasks: int | None = None, entries_per_unit: int = _ENTRIES_PER_UNIT,
) -> DataFrame:
    """(repo_id, root, path, read_error) under ``roots(repo_id, root)``, for any number of repositories.

    Nothing is opened. A task that has listed ``entries_per_unit`` entries of its unit hands the
    folders left over to other tasks, round by round, so one very large repository spreads over many
    tasks however deep it is. Each round is written and none is listed twice.
    """

    ship_package(roots.sparkSession)

    def explore(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for unit in batch.itertuples(index=False):
                found = _walk(unit.root, unit.path, prune, entries_per_unit)
                while block := list(itertools.islice(found, _PATHS_PER_BATCH)):
                    frame = pd.DataFrame(block, columns=["path", "folder", "read_error"])
                    yield frame.assign(repo_id=unit.repo_id, root=unit.root)[["repo_id", "root", "path", "folder", "read_error"]]

    units = roots.select("repo_id", "root", F.lit("").alias("path"))
    listed = None
    while listed is None or units.limit(1).count():
        found = landed(_spread(units, tasks, "repo_id", "path").mapInPandas(explore, _FOUND_SCHEMA))
        files = found.where("NOT folder").drop("folder")
        listed = files if listed is None else listed.unionByName(files)
        units = found.where("folder").select("repo_id", "root", "path")
    return listed


def _blocks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """File rows in lists of few files and bytes: a file is held once more while it goes to Spark."""
    block, held = [], 0
    for row in rows:
        block.append(row)
        held += len(row[4] or b"")
        if len(block) >= _FILES_PER_BATCH or held >= _BYTES_PER_BATCH:
            yield block
            block, held = [], 0
    if block:
        yield block


def load_contents(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    """Read the files of ``paths(repo_id, root, path[, read_error])``, spread evenly whatever their folder."""

    ship_package(paths.sparkSession)
    if "read_error" not in paths.columns:
        paths = paths.withColumn("read_error", F.lit(None).cast("string"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["repo_id", "path", "size", "head", "content", "read_error"]
        for batch in batches:
            rows = (_file_row(p.repo_id, p.root, p.path, p.read_error) for p in batch.itertuples(index=False))
            for block in _blocks(rows):
                frame = pd.DataFrame(block, columns=columns)
                yield frame.assign(size=frame["size"].astype("Int64"))

    wanted = paths.select("repo_id", "root", "path", "read_error")
    return _spread(wanted, tasks, "repo_id", "path").mapInPandas(read, FILES_SCHEMA)


def scan_trees(
    roots: DataFrame, prune: bool = True, tasks: int | None = None, emitted_only: bool = False,
    entries_per_unit: int = _ENTRIES_PER_UNIT,
) -> DataFrame:
    """Files table of a DataFrame of roots: list, keep the paths worth reading, read.

    ``emitted_only`` opens only important and code files, the ones a bundle can hold. Rows with a
    read_error always stay. Land the result as a table before running several queries over it: each
    scan reads the files.
    """
    found = list_trees(roots, prune, tasks, entries_per_unit)
    name = file_name("path")
    worth = F.lit(True)
    if prune:
        worth = keep_dir("path") & keep_name(name) & keep_ext(extension(name))
    if emitted_only:
        worth = worth & (is_important(name) | is_code(extension(name)))
    return load_contents(found.where(F.col("read_error").isNotNull() | worth), tasks)


def _spread(df: DataFrame, tasks: int | None, *columns: str) -> DataFrame:
    """A fixed number of tasks: these rows are tiny, so AQE would merge them into one."""
    number = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(number, *columns)
