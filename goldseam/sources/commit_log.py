"""A log of numbered records per target: what is published is what its newest record says.

A record is one JSON file whose name is its number. It is written completely under a hidden name and
then given its name in one exclusive step, so a number belongs to one writer, a record is never half
written, and a writer that dies leaves at most a hidden draft that nobody reads.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

_DIGITS = 20
#: Stores that rename in one step and refuse to replace; a plain local file is linked instead.
EXCLUSIVE_RENAME = ("hdfs", "viewfs", "abfs", "abfss", "ofs", "o3fs")


class NumberTaken(RuntimeError):
    """Another writer committed this number first."""


class NoExclusiveCommit(RuntimeError):
    """The store of the log cannot create a file exclusively."""


@dataclass(frozen=True)
class Record:
    """One commit: its number and its fields."""

    number: int
    fields: Mapping[str, object]

    def __getitem__(self, name: str) -> object:
        return self.fields.get(name)


class CommitLog:
    """Logs of all targets below one folder. Targets are names that are safe as folder names."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark._jvm

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _system(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path, system = self._path(*parts), self._system()
        if not system.exists(path):
            return []
        names = (status.getPath().getName() for status in system.listStatus(path))
        return sorted(n for n in names if not n.startswith("."))

    def targets(self) -> list[str]:
        """All targets that have a record."""
        return [name.removeprefix("target=") for name in self._names()]

    def record(self, target: str, number: int) -> Record:
        stream = self._system().open(self._path(f"target={target}", f"{number:0{_DIGITS}}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Record(number, json.loads(text))

    def head(self, target: str) -> Record | None:
        """The newest record of a target."""
        names = self._names(f"target={target}")
        return self.record(target, int(names[-1].removesuffix(".json"))) if names else None

    def commit(self, target: str, number: int, fields: Mapping[str, object]) -> Record:
        """Creates record ``number``, or raises NumberTaken if there is one; never replaces anything."""
        system, folder = self._system(), f"target={target}"
        system.mkdirs(self._path(folder))
        name = f"{number:0{_DIGITS}}.json"
        draft, final = self._path(folder, f".{name}.{uuid.uuid4().hex}"), self._path(folder, name)
        text = json.dumps({**fields, "commit_number": number}, sort_keys=True)
        stream = system.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self._take_name(system, draft, final)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                raise NumberTaken(f"{target}: commit {number} was made by another writer.") from error
            raise
        finally:
            system.delete(draft, False)
        return Record(number, json.loads(text))

    def _take_name(self, system, draft, final) -> None:
        scheme = system.getUri().getScheme()
        if scheme == "file":
            paths = self._jvm.java.nio.file.Paths
            none = self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)
            places = [paths.get(p.toUri().getPath(), none) for p in (final, draft)]
            self._jvm.java.nio.file.Files.createLink(*places)
        elif scheme in EXCLUSIVE_RENAME:
            rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
            options = self.spark.sparkContext._gateway.new_array(rename, 0)
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                system.getUri(), self.spark._jsc.hadoopConfiguration()
            )
            context.rename(draft, final, options)
        else:
            raise NoExclusiveCommit(f"A store of kind {scheme} has no exclusive rename.")

    def records(self, schema: str, target: str | None = None) -> DataFrame:
        """All records, or those of one target, as rows of ``schema``; not one of them on the driver."""
        if not (self._names() if target is None else self._names(f"target={target}")):
            return self.spark.createDataFrame([], schema)
        where = self.folder if target is None else f"{self.folder}/target={target}"
        names = [part.split()[0] for part in schema.split(", ")]
        read = self.spark.read.schema(schema).option("basePath", self.folder).json(where)
        return read.select(*[F.col(n) for n in names])
