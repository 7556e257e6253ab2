"""A data source of asset files: spark.read.format("assets") and df.write.format("assets").

    register(spark)
    spark.read.format("assets").load("file:///data").where("format = 'image:Png'")
    results.select("name", "content").write.format("assets").mode("append").save("file:///out")

The reader is given conditions on name and format. Files whose name is not
wanted are not opened; of the others the first bytes are read, and only files
of the wanted format are read whole. The writer puts files into a folder of its
attempt and moves them to their names when every task has ended. A task that
fails, and one that runs twice, leaves no file under its name; what a task puts
down after its attempt was given up lies in a folder that readers pass over.

Many files want folders, since whoever reads a folder lists it whole, and the
driver moves files that lie in none one by one:

    dealt(results.select("name", "content")).write.format("assets").mode("append").save("file:///out")

Then the driver sees folders only. It renames them, and hands them to tasks,
which list what lies in them.
"""

from __future__ import annotations

import contextlib
import heapq
import io
import itertools
import json
import posixpath
import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

#: First bytes of formats, in hexadecimal digits, with the place where they stand (fixed values).
HEADS = (
    ("image:Png", 0, "89504E470D0A1A0A"), ("image:Jpeg", 0, "FFD8FF"), ("image:WebP", 8, "57454250"), ("image:Gif", 0, "47494638"), ("image:Bmp", 0, "424D"), ("image:Tiff", 0, "49492A00"), ("image:Tiff", 0, "4D4D002A"),
    ("image:Ico", 0, "00000100"), ("mesh:Glb", 0, "676C5446"), ("mesh:Ply", 0, "706C790A"), ("mesh:Ply", 0, "706C790D0A"), ("mesh:Fbx", 0, "4B6179646172612046425820"), ("mesh:Fbx", 0, "3B2046425820"),
)
#: Bytes that are looked at to tell a format; bytes of files that make a partition, about, and what opening one counts.
HEAD, PARTITION, OPENING = 16, 128 << 20, 1 << 20
STAGED, LISTED, FOLDERS = "_attempt-", "_names", "_folders"
#: Files of a folder, about, where they are dealt; bytes and rows of them that a reader gives on at once.
FOLDER, AT_ONCE, ROWS = 4096, 1 << 20, 1024
#: Folders of a task that writes, about.
TOGETHER = 4
#: With fewer folders than this the driver looks into them, so that there are enough partitions, but not when it has seen so many names.
ENOUGH, SEEN = 64, 1 << 16
#: Partitions of folders, at most.
MOST = 8192


def format_of(head: bytes) -> str:
    return next((name for name, at, digits in HEADS if head[at : at + len(digits) // 2] == bytes.fromhex(digits)), "unknown")


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]
    folders: list[str] = field(default_factory=list)  # that the task lists itself


@dataclass
class Wanted:
    """Conditions on a column: values that it may have (None: any), and beginnings of which it must have all."""

    values: set[str] | None = None
    starts: list[str] = field(default_factory=list)

    def add(self, f: Filter) -> None:
        if isinstance(f, StringStartsWith):
            self.starts.append(f.value)
            return
        own = {f.value} if isinstance(f, EqualTo) else set(f.value)
        self.values = own if self.values is None else self.values & own

    def __contains__(self, value: str) -> bool:
        return (self.values is None or value in self.values) and all(value.startswith(s) for s in self.starts)


class AssetReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.name, self.format = Wanted(), Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes conditions on name and format; gives the others back."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("name", "format") and isinstance(f, EqualTo | In | StringStartsWith):
                getattr(self, column).add(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Wanted names, in groups of about PARTITION bytes; folders, if there are many, as they are."""
        where, root = pafs.FileSystem.from_uri(self.path)
        found, folders, seen = [], deque([root]), 0
        while folders and (not seen or len(folders) < ENOUGH and seen < SEEN):
            for info in _entries(where, folders.popleft()):
                seen += 1
                if info.type == pafs.FileType.Directory:
                    folders.append(info.path)
                elif info.base_name in self.name:
                    found.append((info.path, info.size))
        parts, size = [[]], 0
        for path, length in sorted(found):
            if parts[-1] and size + length + OPENING > PARTITION:
                parts.append([])
                size = 0
            parts[-1].append((path, length))
            size += length + OPENING
        left, step = sorted(folders), -(-len(folders) // MOST) or 1
        return [Files(p) for p in parts if p or not left] + [Files([], left[k : k + step]) for k in range(0, len(left), step)]

    def _below(self, where: pafs.FileSystem, folders: list[str]) -> Iterator[tuple[str, int]]:
        """Wanted names in folders and those below them, one folder after another."""
        left = deque(folders)
        while left:
            for info in _entries(where, left.popleft()):
                if info.type == pafs.FileType.Directory:
                    left.append(info.path)
                elif info.base_name in self.name:
                    yield info.path, info.size

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = pafs.FileSystem.from_uri(self.path)
        schema = pa.schema([("path", pa.string()), ("name", pa.string()), ("format", pa.string()), ("length", pa.int64()), ("content", pa.binary())])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

        held: list[tuple] = []
        size = 0
        for path, length in itertools.chain(partition.paths, self._below(where, partition.folders)):
            with where.open_input_file(path) as f:
                head = f.read(HEAD)
                kind = format_of(head)
                if kind not in self.format:
                    continue
                content = head + f.read()
            if held and (size + len(content) > AT_ONCE or len(held) >= ROWS):
                yield batch()
                held, size = [], 0
            held.append((path, posixpath.basename(path), kind, length, content))
            size += len(content)
        if held:
            yield batch()


def _entries(where: pafs.FileSystem, folder: str) -> Iterator[pafs.FileInfo]:
    """Files and folders that lie in a folder, but for what the writer has not committed."""
    return (i for i in where.get_file_info(pafs.FileSelector(folder)) if i.type in (pafs.FileType.File, pafs.FileType.Directory) and not i.base_name.startswith(STAGED))


@dataclass
class Written(WriterCommitMessage):
    folder: str  # of a task; its list LISTED has the names, ascending, and where each file lies; FOLDERS has what lies in folders, under its names


class AssetWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.attempt = path, overwrite, f"{STAGED}{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        """Files of one task, in a folder of its own with a list of them; a name with a folder in it, a null name and a null content are errors."""
        where, root = pafs.FileSystem.from_uri(self.path)
        folder, done, inside = f"{root}/{self.attempt}/{uuid.uuid4().hex}", [], {}
        where.create_dir(folder)
        for k, row in enumerate(rows):
            own = getattr(row, "folder", None) or ""
            if not row.name or "/" in row.name or "/" in own or own in (".", "..") or own.startswith(STAGED) or row.content is None:
                raise ValueError(f"no file can be written as {row.name!r}")
            if not own:
                place = f"{folder}/{k}"
                done.append((row.name, k))
            else:
                place = f"{folder}/{FOLDERS}/{own}/{row.name}"
                if own not in inside:
                    where.create_dir(posixpath.dirname(place))
                names = inside.setdefault(own, set())
                if row.name in names:
                    raise ValueError("two files of one name")
                names.add(row.name)
            with where.open_output_stream(place) as out:
                out.write(bytes(row.content))
        with where.open_output_stream(f"{folder}/{LISTED}") as out:
            for entry in sorted(done):
                out.write(json.dumps(entry).encode("ascii") + b"\n")
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        """All files take their names. Two rows of one name, and one folder, are an error, and nothing is written."""
        where, root = pafs.FileSystem.from_uri(self.path)
        folders = [w.folder for w in messages if w is not None]
        inside: dict[str, list[str]] = {}
        for info in itertools.chain.from_iterable(where.get_file_info(pafs.FileSelector(f"{f}/{FOLDERS}", allow_not_found=True)) for f in folders):
            inside.setdefault(info.base_name, []).append(info.path)

        def listed(folder: str) -> Iterator[tuple[str, str]]:
            with where.open_input_stream(f"{folder}/{LISTED}") as f, io.TextIOWrapper(f, "ascii") as lines:
                for name, k in map(json.loads, lines):
                    yield name, f"{folder}/{k}"

        def moves() -> Iterator[tuple[str, str]]:
            return heapq.merge(*map(listed, folders))

        def meet(parts: list[str]) -> bool:
            names = [i.base_name for p in parts for i in where.get_file_info(pafs.FileSelector(p))]
            return len(set(names)) < len(names)

        if any(a == b for (a, _), (b, _) in itertools.pairwise(moves())) or any(meet(parts) for parts in inside.values() if len(parts) > 1):
            self.abort(messages)
            raise ValueError("two files of one name")
        if self.overwrite:
            for info in _entries(where, root):
                (where.delete_dir if info.type == pafs.FileType.Directory else where.delete_file)(info.path)
        for name, place in moves():
            where.move(place, f"{root}/{name}")
        for name, parts in inside.items():
            for part in parts:
                _put(where, part, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        where, root = pafs.FileSystem.from_uri(self.path)
        with contextlib.suppress(FileNotFoundError):
            where.delete_dir(f"{root}/{self.attempt}")


def _put(where: pafs.FileSystem, part: str, folder: str) -> None:
    """A folder takes its name as a whole; files of one whose name is there already, or that can't be renamed, are moved."""
    if where.get_file_info(folder).type == pafs.FileType.NotFound:
        with contextlib.suppress(OSError):
            where.move(part, folder)
            return
    where.create_dir(folder)
    for info in where.get_file_info(pafs.FileSelector(part)):
        where.move(info.path, f"{folder}/{info.base_name}")


class AssetSource(DataSource):
    """path, name, format, length, content of files; written are name and content, and folder, if the rows have one: a folder of the path."""

    @classmethod
    def name(cls) -> str:
        return "assets"

    def schema(self) -> str:
        return "path string, name string, format string, length bigint, content binary"

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise ValueError("assets need a path")
        return path.rstrip("/") if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return AssetReader(self._path())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return AssetWriter(self._path(), overwrite)


def dealt(files: DataFrame) -> DataFrame:
    """files (name, content) with the folder of each, by its name: so many that one has about FOLDER files and PARTITION bytes. Those of a folder are in one task. Few files need no folder."""
    n, size = files.agg(F.count("*"), F.sum(F.octet_length("content"))).first()
    folders = max(-(-n // FOLDER), -(-(size or 0) // PARTITION))
    if folders < 2:
        return files
    return files.withColumn("folder", F.lpad(F.pmod(F.xxhash64("name"), F.lit(folders)).cast("string"), len(str(folders)), "0")).repartition(-(-folders // TOGETHER), "folder")


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, and lets conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AssetSource)
