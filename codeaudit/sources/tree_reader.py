"""The data source ``source_tree``: directory trees as rows of files.

Planning lists directories breadth first over all roots, up to ``listings`` of
them, so a root that holds most files is cut into many subtrees: a listed
directory becomes its files (in slices, if there are many) and its
subdirectories; a directory that is left unlisted is one subtree, walked by
the task that gets it.  Ignored directories are dropped before descent, in
planning and in tasks alike.  Simple conditions on the columns are applied to
the listing, conditions on ``repo_id`` and ``path`` to roots and directories,
and a file is opened only if the requested schema has ``data`` and the file
passes all of them.

Roots are folders of a file system that every node sees: paths (mounted) or
URIs that Arrow opens.  A file that disappears while it is read is left out.
"""

from __future__ import annotations

import json
import os
import re
import stat
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
                                    InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith,
                                    StringStartsWith)
from pyspark.sql.types import StructType

from codeaudit import rules as R
from codeaudit.functions.text import glob_body

SCHEMA = ("repo_id string, path string, name string, ext string, size long, mtime timestamp, is_symlink boolean, data binary")
IGNORE_FILES = (".codeauditignore", ".gitignore")
_BATCH_BYTES, _BATCH_ROWS = 16 << 20, 5000


# Listing and reading, of local (or mounted) folders and of Arrow's file systems

@dataclass
class Entry:
    name: str
    is_dir: bool
    is_symlink: bool = False
    size: int = 0
    mtime: datetime | None = None


def _arrow_fs(uri: str):
    import pyarrow.fs as pafs
    return pafs.FileSystem.from_uri(uri)


def _local(path: str) -> str | None:
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


def list_dir(path: str) -> list[Entry]:
    """Entries by name; links are listed as files and never followed."""
    here, out = _local(path), []
    if here is None:
        import pyarrow.fs as pafs
        fs, folder = _arrow_fs(path)
        for x in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if x.type in (pafs.FileType.File, pafs.FileType.Directory):
                out.append(Entry(x.base_name, x.type == pafs.FileType.Directory, False, x.size or 0, x.mtime))
    else:
        try:
            with os.scandir(here) as entries:
                for e in entries:
                    try:
                        s = e.stat(follow_symlinks=False)
                    except OSError:
                        continue
                    kind = s.st_mode
                    if stat.S_ISDIR(kind):
                        out.append(Entry(e.name, True))
                    elif stat.S_ISREG(kind) or stat.S_ISLNK(kind):
                        out.append(Entry(e.name, False, stat.S_ISLNK(kind), s.st_size, datetime.fromtimestamp(s.st_mtime, timezone.utc)))
        except OSError:
            pass
    return sorted(out, key=lambda e: e.name)


def read_bytes(path: str) -> bytes | None:
    here = _local(path)
    try:
        if here is None:
            fs, name = _arrow_fs(path)
            with fs.open_input_stream(name) as f:
                return f.read()
        with open(here, "rb") as f:
            return f.read()
    except OSError:
        return None


# Ignore rules

def _regex(bodies: list[str]) -> re.Pattern | None:
    if not bodies:
        return None
    python = (re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), b) for b in bodies)
    return re.compile("(?s)(?:" + "|".join(python) + r")\Z")


class Ignores:
    """Shell patterns that drop a file or directory by its name, its relative
    path, as ``*/pattern`` or as ``pattern/*``."""

    def __init__(self, patterns: list[str]):
        self.name = _regex([glob_body(p) for p in patterns])
        self.path = _regex([glob_body(g) for p in patterns for g in (p, "*/" + p, p + "/*")])

    def __call__(self, path: str, name: str) -> bool:
        return self.name is not None and bool(self.name.match(name) or self.path.match(path))


def ignore_lines(text: str) -> list[str]:
    """The patterns of an ignore file: no comments, no negations."""
    lines = (x.strip(" ") for x in re.split("\r?\n", text))
    return [p for p in (x.rstrip("/") for x in lines if x and x[0] not in "#!") if p]


def _ignores_of(root: str, defaults: list[str], files: list[str]) -> Ignores:
    found = []
    for name in files:
        raw = read_bytes(f"{root.rstrip('/')}/{name}")
        if raw is not None and b"\x00" not in raw[:4096]:
            found += ignore_lines(raw.decode("utf-8", "replace"))
    return Ignores(list(dict.fromkeys([*defaults, *found])))


# Conditions

_TESTS: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x, EqualNullSafe: lambda v, x: v == x, In: lambda v, x: v in x,
    GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x, StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v, IsNotNull: lambda v, x: True}
_LISTED = ("repo_id", "path", "name", "ext", "size", "is_symlink")


@dataclass
class Condition:
    """``column test value`` on the listing, or its negation."""
    column: str
    kind: type
    value: object
    negated: bool = False

    @staticmethod
    def of(f: Filter) -> Condition | None:
        negated = isinstance(f, Not)
        inner = f.child if negated else f
        column = getattr(inner, "attribute", ("",))
        if type(inner) not in _TESTS or len(column) != 1 or column[0] not in _LISTED:
            return None
        value = getattr(inner, "value", None)
        if value is None and not isinstance(inner, IsNotNull) or isinstance(inner, In) and None in value:
            return None
        return Condition(column[0], type(inner), value, negated)

    def holds(self, value) -> bool:
        return bool(_TESTS[self.kind](value, self.value)) != self.negated

    def may_hold_below(self, folder: str) -> bool:
        """Whether a path below ``folder`` (ending in "/") can pass."""
        if self.column != "path" or self.negated:
            return True
        if self.kind in (EqualTo, EqualNullSafe):
            return self.value.startswith(folder)
        if self.kind is In:
            return any(x.startswith(folder) for x in self.value)
        if self.kind is StringStartsWith:
            return self.value.startswith(folder) or folder.startswith(self.value)
        return True


# Planning and reading

@dataclass
class Unit:
    """A subtree, or with ``slices`` the files of a directory alone whose names'
    CRC-32 falls to ``part``.  ``folder`` is relative and ends in "/"."""
    repo_id: str
    root: str
    folder: str = ""
    slices: int = 0
    part: int = 0


@dataclass
class Units(InputPartition):
    units: list[Unit]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.roots = [tuple(x) for x in json.loads(options["roots"])]
        self.defaults = json.loads(options.get("excludes") or json.dumps(R.DEFAULT_EXCLUDES))
        self.ignore_files = json.loads(options.get("ignoreFiles") or json.dumps(IGNORE_FILES))
        self.max_bytes = int(options.get("maxBytes") or R.MAX_FILE_BYTES)
        self.listings = int(options.get("listings") or 4000)
        self.tasks = int(options.get("tasks") or 512)
        self.slice_files = int(options.get("sliceFiles") or 500)
        self.names, self.conditions = names, []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            c = Condition.of(f)
            if c is None:
                yield f
            else:
                self.conditions.append(c)

    def _root_wanted(self, repo_id: str) -> bool:
        return all(c.holds(repo_id) for c in self.conditions if c.column == "repo_id")

    def _below(self, folder: str) -> bool:
        return all(c.may_hold_below(folder) for c in self.conditions)

    def _listed(self, root: str, folder: str, ignored: Ignores) -> tuple[list[Entry], list[str]]:
        """Files and subfolders that are not ignored and may hold wanted files."""
        files, folders = [], []
        for e in list_dir(f"{root.rstrip('/')}/{folder}"):
            path = folder + e.name
            if ignored(path, e.name):
                continue
            if e.is_dir:
                if self._below(path + "/"):
                    folders.append(path + "/")
            else:
                files.append(e)
        return files, folders

    def partitions(self) -> list[Units]:
        queue = deque(Unit(r, p) for r, p in self.roots if self._root_wanted(r))
        ignores: dict[str, Ignores] = {}
        units, left = [], self.listings
        while queue and left > 0:
            u = queue.popleft()
            left -= 1
            if u.root not in ignores:
                ignores[u.root] = _ignores_of(u.root, self.defaults, self.ignore_files)
            files, folders = self._listed(u.root, u.folder, ignores[u.root])
            queue.extend(Unit(u.repo_id, u.root, f) for f in folders)
            wanted = sum(self._row(u, e) is not None for e in files)
            if wanted:
                n = -(-wanted // self.slice_files)
                units += [Unit(u.repo_id, u.root, u.folder, n, k) for k in range(n)]
        units += queue
        # neighbouring units differ least in size: they are dealt apart
        n = max(1, min(self.tasks, len(units)))
        return [Units(units[k::n]) for k in range(n)]

    def _row(self, u: Unit, e: Entry) -> dict | None:
        m = re.match(r"(?s).+(\.[^.]+)\Z", e.name)
        row = {"repo_id": u.repo_id, "path": u.folder + e.name, "name": e.name, "ext": m[1].lower() if m else "", "size": e.size,
               "mtime": e.mtime, "is_symlink": e.is_symlink}
        return row if all(c.holds(row[c.column]) for c in self.conditions) else None

    def _rows(self, u: Unit, ignored: Ignores) -> Iterator[tuple[Unit, dict]]:
        stack = [u.folder]
        while stack:
            folder = stack.pop()
            files, folders = self._listed(u.root, folder, ignored)
            if not u.slices:
                stack += reversed(folders)
            at = Unit(u.repo_id, u.root, folder)
            for e in files:
                if u.slices > 1 and zlib.crc32(e.name.encode("utf-8", "surrogateescape")) % u.slices != u.part:
                    continue
                row = self._row(at, e)
                if row is not None:
                    yield at, row

    def read(self, partition: Units) -> Iterator[pa.RecordBatch]:
        kinds = {"size": pa.int64(), "mtime": pa.timestamp("us", "UTC"), "is_symlink": pa.bool_(), "data": pa.binary()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in self.names])
        content, ignores, rows, held = "data" in self.names, {}, [], 0
        for u in partition.units:
            if u.root not in ignores:
                ignores[u.root] = _ignores_of(u.root, self.defaults, self.ignore_files)
            for at, row in self._rows(u, ignores[u.root]):
                source = f"{u.root.rstrip('/')}/{row['path']}"
                row["path"], row["name"] = (row[c].encode("utf-8", "surrogateescape").decode("utf-8", "replace") for c in ("path", "name"))
                if content:
                    row["data"] = None
                    if not row["is_symlink"] and row["size"] <= self.max_bytes:
                        row["data"] = read_bytes(source)
                        if row["data"] is None:
                            continue
                        held += len(row["data"])
                rows.append(row)
                if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(dict(self.options), schema.names)


def read_tree(spark: SparkSession, roots: list[tuple[str, str]], *, content: bool = True, listings: int | None = None,
              tasks: int | None = None, excludes: list[str] | None = None) -> DataFrame:
    """Files of (repo_id, root) folders after the ignore rules, with their bytes
    in ``data`` only if ``content`` (null for links and files over the size
    limit).  Filters on the other columns but mtime reach the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("roots", json.dumps([list(x) for x in roots]))
    for key, value in (("listings", listings), ("tasks", tasks), ("excludes", None if excludes is None else json.dumps(excludes))):
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.schema(SCHEMA if content else SCHEMA.removesuffix(", data binary")).load()


def write_tree(raw: DataFrame, folder: str) -> None:
    """Rows (repo_id, path, mtime, data) as files below ``folder/repo_id``, by
    the tasks that hold them; a repeated task writes the same files again."""
    here = _local(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            for repo_id, path, mtime, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if here is None:
                    fs, base = _arrow_fs(folder)
                    target = f"{base}/{repo_id}/{path}"
                    fs.create_dir(os.path.dirname(target), recursive=True)
                    with fs.open_output_stream(target) as f:
                        f.write(data or b"")
                else:
                    target = f"{here}/{repo_id}/{path}"
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(target, "wb") as f:
                        f.write(data or b"")
                    if mtime is not None:
                        at = mtime.replace(tzinfo=mtime.tzinfo or timezone.utc).timestamp()
                        os.utime(target, (at, at))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    raw.select("repo_id", "path", "mtime", "data").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()
