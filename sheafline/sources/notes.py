"""Notes as a data source of Spark: a reader with partitions and a writer that commits as a whole.

    register(spark)
    spark.read.format("sheafline-notes").load(folder)                        # note_path, content
    notes.write.format("sheafline-notes").mode("append").save(folder)        # adds or replaces notes
    notes.write.format("sheafline-notes").mode("overwrite").save(folder)     # these notes and no others

Writing: each task writes its notes into a staging folder of the job and a list
of them; its message names the list. Commit writes one small file that names the lists of all tasks
(that moment counts), then moves the notes to their places, several at a time, and deletes the file. A job that
fails before leaves the old notes, and its staging folder is deleted (a task that outlives it
may leave files there, which nobody reads). If the driver dies while notes
are moved, the file is still there: readers take notes from where they lie, old ones that are
replaced are not seen, and the next job, or ``finish``, moves the rest.

Reading: names and sizes of files go through the driver, as in Spark's own file sources;
partitions are runs of notes of about ``partition_bytes``. A note is read whole.

Options: path (a URI or a local path), suffix (of a note's name), prefix (of its path below
the folder), partition_bytes. Notes with one path in one job must be one row. Short notes are a
few large partitions of Spark; ``sheafline.session.dealt`` spreads them over tasks before they are written.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sheafline.session import ship

SCHEMA = "note_path string, content string"
STAGING, COMMITS = ".staging", ".commits"
#: Threads of the driver that move notes when a job commits.
MOVERS = 2
#: What opening a note costs, as bytes of a partition.
OPENING = 1 << 15


def _root(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _bytes(filesystem: pafs.FileSystem, path: str) -> bytes:
    with filesystem.open_input_stream(path, compression=None) as file:
        return file.read()


def _put(filesystem: pafs.FileSystem, path: str, data: bytes) -> None:
    with filesystem.open_output_stream(path, compression=None) as file:
        file.write(data)


def _files(filesystem: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return [x for x in filesystem.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)) if x.type == pafs.FileType.File]


def _jobs(filesystem: pafs.FileSystem, root: str) -> list[tuple[str, bool, list[str]]]:
    """Of each job whose notes may not all be in their places: its file, whether it replaces all, and its tasks' lists."""
    out = []
    for info in sorted(_files(filesystem, f"{root}/{COMMITS}"), key=lambda x: x.base_name):
        if info.base_name.endswith(".json"):
            commit = json.loads(_bytes(filesystem, info.path))
            out.append((info.path, commit["overwrite"], commit["lists"]))
    return out


def _staged(filesystem: pafs.FileSystem, root: str, name: str) -> list[tuple[str, str]]:
    """The notes of a task's list and their staged files."""
    folder = name.rsplit("/", 1)[0]
    return [(note, f"{root}/{folder}/{k}") for k, note in enumerate(json.loads(_bytes(filesystem, f"{root}/{name}")))]


def _notes(filesystem: pafs.FileSystem, root: str, suffix: str, prefix: str) -> list[tuple[str, str | None, int]]:
    """Path below the folder, file (none: at this path), and size of each note as it is, with what is committed and not yet moved."""
    found: dict[str, tuple[str | None, int]] = {}
    for info in _files(filesystem, root):
        name = info.path[len(root) :].lstrip("/")
        if not name.startswith((f"{STAGING}/", f"{COMMITS}/")):
            found[name] = (None, info.size)
    for _, overwrite, lists in _jobs(filesystem, root):
        staged = dict(x for name in lists for x in _staged(filesystem, root, name))
        if overwrite:
            found = {n: x for n, x in found.items() if n in staged or not n.endswith(suffix)}
        note_of = {file: note for note, file in staged.items()}
        for info in filesystem.get_file_info(list(note_of)) if note_of else []:
            if info.type == pafs.FileType.File:
                found[note_of[info.path]] = (info.path, info.size)
    return sorted((n, f, size) for n, (f, size) in found.items() if n.endswith(suffix) and n.startswith(prefix))


def _move(filesystem: pafs.FileSystem, file: str, place: str) -> None:
    """Move a staged note to its place, whose folder is there; one that has been moved is left alone."""
    try:
        if isinstance(filesystem, pafs.LocalFileSystem):
            os.replace(file, place)
        else:
            filesystem.move(file, place)
    except OSError:  # some file systems don't move onto a file that is there
        if filesystem.get_file_info(file).type == pafs.FileType.File:
            if filesystem.get_file_info(place).type == pafs.FileType.File:
                filesystem.delete_file(place)
            filesystem.move(file, place)


def finish(path: str, suffix: str = ".translations.md") -> int:
    """Move what committed jobs have not moved yet to its place, a task's list after the other; how many jobs there were."""
    filesystem, root = _root(path)
    jobs = _jobs(filesystem, root)
    with ThreadPoolExecutor(MOVERS) as pool:
        for commit, overwrite, lists in jobs:
            old = {name for name, _, _ in _plain(filesystem, root, suffix)} if overwrite else set()
            made: set[str] = set()
            for name in lists:
                staged = [(note, file, f"{root}/{note}") for note, file in _staged(filesystem, root, name)]
                for folder in {place.rsplit("/", 1)[0] for _, _, place in staged} - made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                list(pool.map(lambda k: [_move(filesystem, file, place) for _, file, place in staged[k::MOVERS]], range(MOVERS)))
                old.difference_update(note for note, _, _ in staged)
            list(pool.map(lambda note: filesystem.delete_file(f"{root}/{note}"), old))
            filesystem.delete_file(commit)
    return len(jobs)


def _plain(filesystem: pafs.FileSystem, root: str, suffix: str) -> list[tuple[str, str, int]]:
    """The notes in their places."""
    found = ((x.path[len(root) :].lstrip("/"), x.path, x.size) for x in _files(filesystem, root))
    return [x for x in found if x[0].endswith(suffix) and not x[0].startswith((f"{STAGING}/", f"{COMMITS}/"))]


@dataclass
class Run(InputPartition):
    notes: list[tuple[str, str | None]]


@dataclass
class Written(WriterCommitMessage):
    list_file: str | None


class NotesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.prefix = options["path"], options.get("suffix", ".translations.md"), options.get("prefix", "")
        self.most = int(options.get("partition_bytes", 1 << 26))

    def partitions(self) -> list[Run]:
        filesystem, root = _root(self.path)
        runs: list[list[tuple[str, str | None]]] = []
        held = self.most
        for name, file, size in _notes(filesystem, root, self.suffix, self.prefix):
            if held >= self.most:
                runs.append([])
                held = 0
            runs[-1].append((name, file))
            held += size + OPENING
        return [Run(x) for x in runs] or [Run([])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        filesystem, root = _root(self.path)
        names: list[str] = []
        texts: list[str] = []
        held = 0
        for name, file in partition.notes:
            try:
                data = _bytes(filesystem, file or f"{root}/{name}")
            except FileNotFoundError:  # moved to its place since it was listed
                data = _bytes(filesystem, f"{root}/{name}")
            names.append(name)
            texts.append(data.decode("utf-8", "replace"))
            held += len(data)
            if held > 1 << 23:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["note_path", "content"])
                names, texts, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["note_path", "content"])


class NotesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.suffix = options.get("suffix", ".translations.md")

    def write(self, rows: Iterator) -> Written:
        filesystem, root = _root(self.path)
        folder = f"{STAGING}/{self.job}/{uuid.uuid4().hex}"
        names: list[str] = []
        for row in rows:
            if row["note_path"] is None:
                continue
            if any(x in ("", ".", "..") for x in row["note_path"].split("/")) or row["note_path"].startswith((STAGING, COMMITS)):
                raise ValueError(f"no path of a note: {row['note_path']!r}")
            if not names:
                filesystem.create_dir(f"{root}/{folder}", recursive=True)
            _put(filesystem, f"{root}/{folder}/{len(names)}", (row["content"] or "").encode())
            names.append(row["note_path"])
        if not names:
            return Written(None)
        _put(filesystem, f"{root}/{folder}/list", json.dumps(names).encode())
        return Written(f"{folder}/list")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        filesystem, root = _root(self.path)
        finish(self.path, self.suffix)  # of jobs before
        lists = [m.list_file for m in messages if isinstance(m, Written) and m.list_file]
        filesystem.create_dir(f"{root}/{COMMITS}", recursive=True)
        part = f"{root}/{COMMITS}/{self.job}.part"
        _put(filesystem, part, json.dumps({"overwrite": self.overwrite, "lists": lists}).encode())
        filesystem.move(part, f"{root}/{COMMITS}/{self.job}.json")  # from now on the job counts
        finish(self.path, self.suffix)
        self._clear(filesystem, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_root(self.path))

    def _clear(self, filesystem: pafs.FileSystem, root: str) -> None:
        folder = f"{root}/{STAGING}/{self.job}"
        if filesystem.get_file_info(folder).type == pafs.FileType.Directory:
            filesystem.delete_dir(folder)


class Notes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheafline-notes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> NotesReader:
        return NotesReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> NotesWriter:
        if {"note_path", "content"} - set(schema.names):
            raise ValueError("notes need the columns note_path and content")
        return NotesWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship(spark)
    spark.dataSource.register(Notes)
