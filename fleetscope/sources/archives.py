"""Cycles in ZIP archives as a Spark data source, one input partition per member.

An archive holds CSV members ``<code>/<prefix><number>.csv``, one per cycle of an
operation code.  Only the central directories are read to plan a scan; the
members to read are chosen by code and by their place in the numeric order of a
code's cycles, and a task opens its member alone and streams it.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.csv as pa_csv
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NAME = "cycle_archives"
#: Columns that the source adds to those of the members: the cycle's code and number, which end of the run it is from, the row's place.
OWN = ("code", "cycle", "side", "row")


@dataclass
class Member(InputPartition):
    archive: str
    name: str
    code: str
    cycle: int
    side: str


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    temporary: str | None


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


def _archives(path: str) -> Iterator[tuple[fs.FileSystem, str]]:
    system, place = _located(path)
    if place.endswith(".zip"):
        yield system, place
        return
    for info in sorted(system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True)), key=lambda i: i.path):
        if info.is_file and info.path.endswith(".zip") and not info.base_name.startswith(("_", ".")):
            yield system, info.path


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.member = re.compile(rf"(?:.*/)?([^/]+)/{re.escape(options.get('prefix', 'cycle_'))}(\d+)\.csv")
        self.first, self.last = (int(options[k]) if k in options else None for k in ("first", "last"))
        self.codes: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of ``code`` choose members; Spark applies all others."""
        for f in filters:
            found = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if found is None or f.attribute != ("code",):
                yield f
            else:
                self.codes = found if self.codes is None else self.codes & found

    def partitions(self) -> Sequence[Member]:
        cycles: dict[str, list[tuple[int, str, str]]] = {}
        for system, archive in _archives(self.path):
            with system.open_input_file(archive) as file, zipfile.ZipFile(file) as opened:
                for name in opened.namelist():
                    found = self.member.fullmatch(name)
                    if found and (self.codes is None or found[1] in self.codes):
                        cycles.setdefault(found[1], []).append((int(found[2]), archive, name))
        chosen = []
        for code, members in sorted(cycles.items()):
            members.sort()
            ends = [("all", members)] if self.first is None and self.last is None else [
                ("first", members[: self.first or 0]), ("last", members[len(members) - min(self.last or 0, len(members)) :]),
            ]
            chosen += [Member(archive, name, code, cycle, side) for side, found in ends for cycle, archive, name in found]
        return chosen

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a scan without members
            return
        wanted = to_arrow_schema(self.schema)
        inside = [f for f in wanted if f.name not in OWN]
        convert = pa_csv.ConvertOptions(column_types={f.name: f.type for f in inside}, include_columns=[f.name for f in inside], strings_can_be_null=True)
        system, _ = _located(self.path)
        at = 0
        with system.open_input_file(partition.archive) as file, zipfile.ZipFile(file) as opened, opened.open(partition.name) as member:
            if not inside:  # only the member's rows count
                convert = pa_csv.ConvertOptions()
            for batch in pa_csv.open_csv(member, parse_options=pa_csv.ParseOptions(newlines_in_values=True), convert_options=convert):
                n = batch.num_rows
                own = {
                    "code": pa.array([partition.code] * n, pa.string()), "cycle": pa.array([partition.cycle] * n, pa.int64()),
                    "side": pa.array([partition.side] * n, pa.string()), "row": pa.array(range(at, at + n), pa.int64()),
                }
                at += n
                yield pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else batch.column(f.name) for f in wanted], schema=wanted)


class _Writer(DataSourceArrowWriter):
    """Every task writes one archive; its name is final only once the job commits."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.prefix = schema, options["path"], options.get("prefix", "cycle_")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, place = _located(self.path)
        temporary, stream, opened, current, member, done = None, None, None, None, None, set()
        try:
            for batch in iterator:
                keys = list(zip(batch.column("code").to_pylist(), batch.column("cycle").to_pylist(), strict=True))
                values = batch.drop_columns([c for c in OWN if c in batch.schema.names])
                start = 0
                while start < len(keys):
                    stop = start + 1
                    while stop < len(keys) and keys[stop] == keys[start]:
                        stop += 1
                    if opened is None:
                        system.create_dir(place)
                        temporary = f"{place}/_{uuid.uuid4().hex}.zip"
                        stream = system.open_output_stream(temporary)
                        opened = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                    fresh = keys[start] != current
                    if fresh:
                        if member is not None:
                            member.close()
                        if keys[start] in done:
                            raise ValueError(f"cycle {keys[start]} comes in several pieces; sort each partition by code and cycle")
                        current = keys[start]
                        done.add(current)
                        member = opened.open(f"{current[0]}/{self.prefix}{current[1]}.csv", "w", force_zip64=True)
                    text = io.BytesIO()
                    pa_csv.write_csv(values.slice(start, stop - start), text, pa_csv.WriteOptions(include_header=fresh))
                    member.write(text.getvalue())
                    start = stop
        finally:
            if member is not None:
                member.close()
            if opened is not None:
                opened.close()
                stream.close()
        return Written(None if temporary is None else temporary.replace("/_", "/part-"), temporary)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _located(self.path)
        for done in messages:
            if done is not None and done.temporary:
                system.move(done.temporary, done.path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _located(self.path)
        for done in messages:
            if done is not None and done.temporary:
                system.delete_file(done.temporary)


class CycleArchives(DataSource):
    """``spark.read.format("cycle_archives")`` with a schema of the members' columns and of any in ``OWN``.

    Options: ``first`` and ``last``, the members of each end of a code's run (a
    member of both ends comes twice; without either, all members once), and
    ``prefix``, the member names' part before the number.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        raise ValueError("give the schema of the members' columns")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("archives are only appended to")
        return _Writer(schema, dict(self.options))


def read_archives(spark: SparkSession, path: str, schema: str, first: int | None = None, last: int | None = None, prefix: str = "cycle_") -> DataFrame:
    """The cycles of all archives below ``path``; filters on ``code`` choose members."""
    spark.dataSource.register(CycleArchives)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(NAME).schema(schema).option("prefix", prefix)
    for key, value in (("first", first), ("last", last)):
        if value is not None:
            reader = reader.option(key, str(value))
    return reader.load(path)


def write_archives(df: DataFrame, path: str, order: Sequence[str], prefix: str = "cycle_") -> None:
    """Append ``df`` (``code``, ``cycle`` and the members' columns) to archives below ``path``.

    A cycle's rows meet in one task and are streamed to its member in
    ``order``; null codes and cycles are an error, as no member could name them.
    """
    df.sparkSession.dataSource.register(CycleArchives)
    named = F.when(F.col("code").isNull() | F.col("cycle").isNull(), F.raise_error(F.lit("a cycle without code or number"))).otherwise(F.col("code"))
    rows = df.withColumn("code", named.cast("string")).repartition("code", "cycle").sortWithinPartitions("code", "cycle", *order)
    rows.write.format(NAME).option("prefix", prefix).mode("append").save(path)
