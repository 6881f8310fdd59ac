"""ZIP archives as a source: a member is a partition, read as a stream of lines or of CSV records. (SRC-11)"""

from __future__ import annotations

import csv
import io
import json
import sys
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 10_000  # rows that a task holds at once
PLACE = "file string, member string, number long"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    local = path.startswith("file:/") and not path.startswith("file://")
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if local else path)


@contextmanager
def opened(path: str) -> Iterator[zipfile.ZipFile]:
    """An archive on any file system that pyarrow knows, of which only what is asked for is read."""
    where, name = place(path)
    with where.open_input_file(name) as raw, zipfile.ZipFile(raw) as z:
        yield z


@dataclass
class Member(InputPartition):
    file: str
    member: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.files, self.only, self.encoding = [p for p in options.get("paths", "").split("\n") if p], options.get("members", "*"), options.get("encoding", "latin-1")
        self.columns = list(json.loads(options.get("columns", "{}")).items())
        self.names = [f.name for f in schema.fields]

    def partitions(self) -> list[Member]:
        """A partition for each member, from the archives' directories alone."""
        out = []
        for path in self.files:
            with opened(path) as z:
                out += [Member(path, m.filename) for m in z.infolist() if not m.is_dir() and fnmatchcase(m.filename, self.only)]
        return out or [Member("", "")]

    def _records(self, lines: Iterable[str]) -> Iterator[tuple]:
        """The chosen columns of CSV records by the names in the member's first one; a column or a field that is not there is null."""
        csv.field_size_limit(sys.maxsize)
        rows = csv.reader(lines)
        places = {name.strip().removeprefix("﻿"): i for i, name in reversed(list(enumerate(next(rows, []))))}
        chosen = [places.get(old) for old, _ in self.columns]
        for r in rows:
            if r:
                yield tuple(r[i].strip() if i is not None and i < len(r) else None for i in chosen)

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        with opened(partition.file) as z, z.open(partition.member) as raw:
            if self.columns:
                rows = self._records(io.TextIOWrapper(raw, self.encoding, newline=""))
            else:
                rows = ((line.rstrip("\r\n"),) for line in io.TextIOWrapper(raw, self.encoding))
            at = 0
            while part := list(islice(rows, BATCH)):
                n = len(part)
                values = [[partition.file] * n, [partition.member] * n, range(at, at + n), *zip(*part, strict=True)]
                kinds = [pa.string(), pa.string(), pa.int64()] + [pa.string()] * (len(values) - 3)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=self.names)
                at += n


class Archive(DataSource):
    """format("archive"): options paths (one a line), members (a pattern), encoding, columns (JSON: name in the file to name in the table; none for lines).

    Executors open the paths themselves, so archives lie where all of them can read. A member is read from its start to
    its end by one task, which holds BATCH rows of it.
    """

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        columns = json.loads(self.options.get("columns", "{}"))
        return f"{PLACE}, " + (", ".join(f"`{c}` string" for c in columns.values()) or "line string")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, schema)


def _load(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    spark.dataSource.register(Archive)
    listed = spark.read.format("binaryFile").load(path).select("path")  # names alone: contents are not read
    return spark.read.format("archive").options(paths="\n".join(sorted(r[0] for r in listed.collect())), **options).load()


def zipped_text(spark: SparkSession, path: str | list[str], encoding: str = "latin-1", members: str = "*") -> DataFrame:
    """(file, member, number, line) of the text members of ZIP archives; number is the line's place from 0. (SRC-11)

    Empty members have no rows. A file that is not an archive is an error.
    """
    return _load(spark, path, encoding=encoding, members=members)


def zipped_csv(spark: SparkSession, path: str | list[str], columns: dict[str, str], encoding: str = "latin-1", members: str = "*") -> DataFrame:
    """(file, member, number, ...) of CSV members: the columns of a header under new names, trimmed, quotes read. (SRC-11)

    Members may have their columns in different orders or lack some: what is not there is null, as are the ends of short
    records. Empty lines are no records. The first of two columns of one name counts.
    """
    if not columns or set(columns.values()) & {"file", "member", "number"}:
        raise ValueError("columns must be named, and file, member and number are taken")
    return _load(spark, path, encoding=encoding, members=members, columns=json.dumps(columns))
