"""The archive data source: order of cycles, ends of runs, pruning, and what a writer leaves."""

import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from pyspark.sql.types import StructType

from fleetscope.sources.archives import _Reader, read_archives, write_archives

SCHEMA = "code string, cycle long, side string, row long, note string, value double"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("archives")
    cycles = {"A": [1, 2, 3, 7, 10, 11, 100], "B": [5], "C": list(range(20, 0, -1))}
    rows = [(code, n, i, f"{code}{n}, \"{i}\"\nx" if i % 2 else None, n + i / 10) for code, ns in cycles.items() for n in ns for i in range(n % 4 + 1)]
    df = spark.createDataFrame(rows, "code string, cycle long, place long, note string, value double").repartition(5)
    write_archives(df, f"file://{folder}", ["place"])
    (folder / "_unfinished.zip").write_bytes(b"not an archive")
    with zipfile.ZipFile(folder / "extra.zip", "w") as extra:
        extra.writestr("deep/B/cycle_6.csv", "place,note,value\n0,,6.5\n")
        extra.writestr("B/readme.txt", "no cycle")
    return f"file://{folder}"


def test_all_cycles_come_back(spark, path):
    got = read_archives(spark, path, SCHEMA).collect()
    assert len(got) == len(set((r.code, r.cycle, r.row) for r in got)) and {r.side for r in got} == {"all"}
    assert {(r.code, r.cycle) for r in got if r.code != "C"} == {("A", n) for n in (1, 2, 3, 7, 10, 11, 100)} | {("B", 5), ("B", 6)}
    for r in got:
        if (r.code, r.cycle) != ("B", 6):
            assert r.value == r.cycle + r.row / 10 and r.note == (f"{r.code}{r.cycle}, \"{r.row}\"\nx" if r.row % 2 else None)


def test_ends_of_runs_by_number(spark, path):
    found = read_archives(spark, path, "code string, cycle long, side string", first=3, last=2).distinct().collect()
    ends = {}
    for r in found:
        ends.setdefault((r.code, r.side), []).append(r.cycle)
    assert {k: sorted(v) for k, v in ends.items()} == {
        ("A", "first"): [1, 2, 3], ("A", "last"): [11, 100], ("B", "first"): [5, 6], ("B", "last"): [5, 6], ("C", "first"): [1, 2, 3], ("C", "last"): [19, 20],
    }


def test_filters_on_the_code_choose_members(spark, path):
    reader = _Reader(StructType([]), {"path": path})
    assert list(reader.pushFilters([EqualTo(("code",), "A"), In(("code",), ("A", "B")), GreaterThan(("value",), 1.0)])) == [GreaterThan(("value",), 1.0)]
    assert {m.code for m in reader.partitions()} == {"A"} and len(reader.partitions()) == 7
    got = read_archives(spark, path, SCHEMA).where("code = 'B' and value > 5.5")
    assert [(r.cycle, r.value) for r in got.collect()] == [(6, 6.5)]
    assert read_archives(spark, path, SCHEMA).where("code in ('A', 'none')").select("cycle").distinct().count() == 7


def test_one_partition_per_member(spark, path):
    assert read_archives(spark, path, SCHEMA, first=1, last=0).rdd.getNumPartitions() == 3
    assert read_archives(spark, path, "code string, cycle long").where("code = 'C'").groupBy("cycle").agg(F.count(F.lit(1)).alias("n")).where("n <> cycle % 4 + 1").count() == 0


def test_nothing_written_and_unnamed_cycles(spark, tmp_path):
    empty = spark.createDataFrame([], "code string, cycle long, place long, value double")
    write_archives(empty, f"file://{tmp_path}/none", ["place"])
    assert read_archives(spark, f"file://{tmp_path}/none", "code string, cycle long, value double").count() == 0
    with pytest.raises(Exception, match="without code or number"):
        write_archives(spark.createDataFrame([(None, 1, 0, 1.0)], empty.schema), f"file://{tmp_path}/bad", ["place"])
