"""Documents as a Spark data source: spark.read.format("argument_documents").load(folder), and the same to write.

Rows are (doc_id, json). A ``.json`` file is one document, its doc_id its path; a line of a ``.jsonl`` file is an object
of doc_id and document. Folders are of any scheme that pyarrow opens.
"""

from __future__ import annotations

import io
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

NAME = "argument_documents"
#: Bytes of a file of lines that one task reads.
STRETCH = 64 << 20


def _opened(uri: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path in it, what stands before a path to name it as the caller does)."""
    if "://" not in uri and not re.match("file:/", uri):
        return pafs.LocalFileSystem(), uri, ""
    if re.match("file:/(?!/)", uri):
        uri = "file://" + uri.removeprefix("file:")
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path, uri[: uri.index(path)] if path in uri else ""


@dataclass
class Stretch(InputPartition):
    """The lines of a file that start in [start, end), or the whole file."""

    uri: str
    start: int
    end: int
    lines: bool

    def __init__(self, uri: str, start: int, end: int, lines: bool):
        super().__init__(None)
        self.uri, self.start, self.end, self.lines = uri, start, end, lines


@dataclass
class Written(WriterCommitMessage):
    held: str
    name: str
    rows: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.stretch = options["path"], int(options.get("stretch", STRETCH))

    def partitions(self) -> list[InputPartition]:
        """A partition for each file; a file of lines has one for each stretch of its bytes."""
        fs, path, before = _opened(self.path)
        info = fs.get_file_info(path)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        out: list[InputPartition] = []
        for f in sorted(found, key=lambda f: f.path):
            if not f.is_file or re.search(r"/[._][^/]*(/|$)", f.path[len(path) :]):
                continue
            if f.path.endswith(".jsonl"):
                out += [Stretch(before + f.path, at, min(at + self.stretch, f.size), True) for at in range(0, f.size, self.stretch)]
            elif f.path.endswith(".json"):
                out.append(Stretch(before + f.path, 0, f.size, False))
        return out or [Stretch("", 0, 0, True)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.uri:
            return
        fs, path, _ = _opened(partition.uri)
        with io.BufferedReader(fs.open_input_file(path), 1 << 20) as f:
            if not partition.lines:
                yield partition.uri, f.read().decode("utf-8", "replace")
                return
            at = partition.start
            f.seek(max(at - 1, 0))
            if at:  # a line belongs to the stretch in which it starts
                at += len(f.readline()) - 1
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                if line.strip():
                    row = json.loads(line)
                    yield row["doc_id"], json.dumps(row["document"], ensure_ascii=False)
                at += len(line)


class Writer(DataSourceWriter):
    """Tasks write to a folder of their own; a commit moves what successful attempts wrote, so others leave nothing."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        fs, path, _ = _opened(self.path)
        held = f"{path}/_pending-{self.run}/{uuid.uuid4().hex}"
        fs.create_dir(held.rpartition("/")[0], recursive=True)
        n = 0
        with fs.open_output_stream(held) as f:
            for r in rows:
                f.write((json.dumps({"doc_id": r["doc_id"], "document": json.loads(r["json"])}, ensure_ascii=False) + "\n").encode())
                n += 1
        return Written(held, f"part-{TaskContext.get().partitionId():05d}-{self.run}.jsonl", n)

    def commit(self, messages: list) -> None:
        fs, path, _ = _opened(self.path)
        fs.create_dir(path, recursive=True)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.is_file]
        for m in messages:
            if m is not None and m.rows:
                fs.move(m.held, f"{path}/{m.name}")
        if self.overwrite:
            for f in old:
                fs.delete_file(f)
        self._clean(fs, path)

    def abort(self, messages: list) -> None:
        fs, path, _ = _opened(self.path)
        self._clean(fs, path)

    def _clean(self, fs: pafs.FileSystem, path: str) -> None:
        held = f"{path}/_pending-{self.run}"
        if fs.get_file_info(held).type != pafs.FileType.NotFound:
            fs.delete_dir(held)


class ArgumentDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "doc_id string, json string"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArgumentDocuments)
