"""Zip packages as a Spark data source that reads ranges: large packages are dealt to several tasks, and only wanted entries are read.

    spark.dataSource.register(PackageSource)
    spark.read.format("packages").option("parts", "word/*.xml").load(folder)

``binaryFile`` holds a package as one value, which ends at 2 GB; here a task opens the file, reads its directory from the end, and then
the entries that it is dealt.
"""

from __future__ import annotations

import fnmatch
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from leafmill.sources.files import BAD_ENTRY, read_entry

SCHEMA = "path string, part_no int, part string, size long, bytes binary, error string"
#: Packed bytes that one task reads, about; rows that it hands on at a time, and their bytes.
TASK_BYTES, BATCH_ROWS, BATCH_BYTES = 64 << 20, 256, 32 << 20
_ARROW = pa.schema([("path", pa.string()), ("part_no", pa.int32()), ("part", pa.string()), ("size", pa.int64()), ("bytes", pa.binary()), ("error", pa.string())])


@dataclass
class Deal(InputPartition):
    """Whole packages, or (``begin`` to ``end``) some entries of one."""

    paths: list[str]
    begin: int = 0
    end: int | None = None


def _open(path: str) -> tuple[zipfile.ZipFile, object]:
    """A package of any file system that Arrow knows by its address (file, s3, gs, hdfs), read by ranges."""
    system, inner = fs.FileSystem.from_uri(path)
    file = system.open_input_file(inner)
    return zipfile.ZipFile(file), file


class PackageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parts = options["path"], options.get("parts", "*")
        self.names_only = str(options.get("namesonly", options.get("names_only", "false"))).lower() == "true"
        self.task_bytes = int(options.get("taskbytes", TASK_BYTES))
        self.wanted: list[tuple[str, tuple[str, ...]]] = []

    def takes(self, name: str) -> bool:
        fits = all(name in values if how == "in" else name.startswith(values[0]) for how, values in self.wanted)
        return fits and fnmatch.fnmatchcase(name, self.parts)

    def partitions(self) -> list[Deal]:
        """Small packages are put together up to ``task_bytes``. The entries of a larger one, of which only the directory is read here, are split by their packed sizes."""
        system, inner = fs.FileSystem.from_uri(self.path)
        one = system.get_file_info(inner)
        found = [one] if one.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
        address = lambda info: f"{system.type_name if system.type_name != 'local' else 'file'}://{info.path}"
        deals, held, size = [], [], 0
        for info in sorted((x for x in found if x.is_file), key=lambda x: x.path):
            if info.size > self.task_bytes:
                deals += self.split(address(info))
                continue
            if held and size + info.size > self.task_bytes:
                deals.append(Deal(held))
                held, size = [], 0
            held, size = [*held, address(info)], size + info.size
        return [*deals, Deal(held)] if held else deals or [Deal([])]

    def split(self, path: str) -> list[Deal]:
        try:
            z, file = _open(path)
        except BAD_ENTRY:
            return []
        out, begin, size = [], 0, 0
        with file:
            entries = z.infolist()
        for k, entry in enumerate(entries):
            own = entry.compress_size if self.takes(entry.filename) and not self.names_only else 0
            if size and size + own > self.task_bytes:
                out.append(Deal([path], begin, k))
                begin, size = k, 0
            size += own
        return [*out, Deal([path], begin, len(entries))]

    def read(self, deal: Deal) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for path in deal.paths:
            try:
                z, file = _open(path)
            except BAD_ENTRY:  # no package
                continue
            with file:
                for k, entry in enumerate(z.infolist()[deal.begin : deal.end], deal.begin):
                    if self.takes(entry.filename):
                        rows.append((path, k, entry.filename, entry.file_size, *read_entry(z, entry, self.names_only)))
                        held += len(rows[-1][4] or b"")
                        if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t.type) for j, t in enumerate(_ARROW)], schema=_ARROW)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t.type) for j, t in enumerate(_ARROW)], schema=_ARROW)


class FilteredReader(PackageReader):
    """One that takes filters; Spark allows it only in sessions with ``spark.sql.python.filterPushdown.enabled``."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes conditions on entry names, so that other entries are never read; the rest is Spark's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("part",):
                self.wanted.append(("in", (f.value,)))
            elif isinstance(f, In) and f.attribute == ("part",):
                self.wanted.append(("in", tuple(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute == ("part",):
                self.wanted.append(("starts", (f.value,)))
            else:
                yield f


class PackageSource(DataSource):
    """Options: ``path`` (a package or a folder), ``parts`` (a pattern of entry names), ``namesOnly``, ``taskBytes``, ``filters`` (whether Spark pushes them)."""

    @classmethod
    def name(cls) -> str:
        return "packages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        given = str(self.options.get("filters", "false")).lower() == "true"
        return (FilteredReader if given else PackageReader)(dict(self.options))


def read_packages(spark: SparkSession, path: str, parts: str = "*", names_only: bool = False, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``path, part_no, part, size, bytes, error`` of the entries, by name, of the zip packages at ``path``; files that are none have no rows.

    With ``spark.sql.python.filterPushdown.enabled`` conditions on ``part`` also keep entries from being read.
    """
    spark.dataSource.register(PackageSource)
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("packages").options(parts=parts, namesOnly=names_only, taskBytes=task_bytes, filters=filters).load(path)
