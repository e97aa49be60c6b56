"""Limits from footers, and files that are put together from parts."""

import pytest
from pyspark.sql import functions as F

from tritempo.plans import fixtures as fx
from tritempo.plans.layouts import shared_path
from tritempo.sinks import merged
from tritempo.sinks.text import csv_rows, write_csv_file
from tritempo.operators.sort import sort_output
from tritempo.sources import footers, stored


@pytest.fixture(scope="module")
def points(spark, sf):
    path = shared_path(spark, "points")
    fx.curve_points(spark, sf).repartitionByRange(6, "quote_index").write.parquet(path)
    return path


def test_limits_come_from_footers(spark, points, physical_plan):
    plan = footers.footer_limits(spark, points, ["quote_index", "SettlementPrice"], run=False)
    text = physical_plan(plan)
    assert "PushedAggregation: [MIN(quote_index), MAX(quote_index), MIN(SettlementPrice), MAX(SettlementPrice), COUNT(*)]" in text
    assert "ReadSchema: struct<min(quote_index):int" in text  # no column of the rows
    found = footers.footer_limits(spark, points, ["quote_index", "SettlementPrice"]).first()
    assert tuple(found) == tuple(spark.read.parquet(points).agg(
        F.min("quote_index"), F.max("quote_index"), F.min("SettlementPrice"), F.max("SettlementPrice"), F.count("*")).first())
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown", "false") == "false"


def test_what_footers_do_not_give_is_refused(spark, points):
    with pytest.raises(ValueError, match="ReferenceTime"):
        footers.footer_limits(spark, points, ["ReferenceTime"])
    with pytest.raises(ValueError, match="Identifier"):
        footers.footer_limits(spark, points, ["quote_index"], by=["Identifier"])


def test_limits_by_stored_partition(spark, sf):
    path = shared_path(spark, "archive")
    stored.write_archive(fx.archive_hours(spark, sf), path, period="year")
    found = footers.footer_limits(spark, path, ["quote_index"], by=["archive_table", "quote_period"])
    rows = spark.read.parquet(path)
    expected = rows.groupBy("archive_table", "quote_period").agg(F.min("quote_index"), F.max("quote_index"), F.count("*"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    tables = footers.footer_limits(spark, path, ["quote_index"], by=["archive_table"], partitioned_by=["archive_table", "quote_period"])
    expected = rows.groupBy("archive_table").agg(F.min("quote_index"), F.max("quote_index"), F.count("*"))
    assert sorted(map(tuple, tables.collect())) == sorted(map(tuple, expected.collect()))
    with pytest.raises(ValueError, match="not partitioned"):
        footers.footer_limits(spark, path, ["quote_index"], by=["archive_table"])


def test_the_newest_rows_are_read_from_their_day_only(spark, points, physical_plan):
    rows = spark.read.parquet(points)
    top = rows.agg(F.max("ReferenceTime")).first()[0]
    found = footers.latest_global_rows(spark, points)
    assert {tuple(row) for row in found.collect()} == {tuple(row) for row in rows.filter(F.col("ReferenceTime") == F.lit(top)).collect()}
    assert "PushedFilters: [IsNotNull(quote_index), IsNotNull(ReferenceTime), EqualTo(quote_index," in physical_plan(found)
    assert footers.newest_reference_time(spark, points).first()[0] == top


def test_an_empty_table_has_no_newest_day(spark, points):
    path = shared_path(spark, "nothing")
    spark.read.parquet(points).limit(0).write.parquet(path)
    assert footers.newest_day(spark, path) is None and footers.latest_global_rows(spark, path).count() == 0
    assert footers.newest_reference_time(spark, path).collect()[0][0] is None


def lines_of(path):
    return path.read_text().split("\n")


@pytest.fixture
def parts_stay_small(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_file_has_the_global_order_and_one_header(spark, sf, tmp_path, parts_stay_small):
    rows = fx.curve_points(spark, sf).repartition(7)
    columns = ["Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice"]
    parts = write_csv_file(rows, str(tmp_path / "one.csv"), columns, zone=fx.ZONE, offset=True)
    text = lines_of(tmp_path / "one.csv")
    assert parts > 1 and text[0] == ",".join(columns) and text[-1] == "" and len(text) == rows.count() + 2
    ordered = [",".join(row) for row in csv_rows(sort_output(rows), columns, zone=fx.ZONE, offset=True).collect()]
    assert text[1:-1] == ordered
    assert [path.name for path in tmp_path.iterdir() if not path.name.startswith(".")] == ["one.csv"]
    with pytest.raises(FileExistsError):
        write_csv_file(rows, str(tmp_path / "one.csv"), columns)


def test_a_file_without_rows_has_its_header(spark, sf, tmp_path):
    write_csv_file(fx.curve_points(spark, sf).limit(0), str(tmp_path / "none.csv"), ["Identifier", "ReferenceTime"])
    assert lines_of(tmp_path / "none.csv") == ["Identifier,ReferenceTime", ""]


def test_lines_in_order(spark, tmp_path, parts_stay_small):
    lines = spark.range(1000).selectExpr("id", "concat('line ', id) as value").repartition(5)
    assert merged.write_lines_in_order(lines, str(tmp_path / "lines"), [F.desc("id")], header="top") > 1
    assert lines_of(tmp_path / "lines") == ["top", *(f"line {n}" for n in range(999, -1, -1)), ""]


@pytest.mark.parametrize("header", ["top", None])
def test_file_systems_that_concatenate_are_left_to_do_so(spark, header):
    """Calls only: the local file system can't."""

    class Stream:
        def write(self, content):
            calls.append(("write", bytes(content)))

        def close(self):
            calls.append(("close",))

    class System:
        def create(self, path):
            return Stream()

        def rename(self, source, to):
            calls.append(("rename", source, to))

        def concat(self, draft, parts):
            calls.append(("concat", draft, [part.toString() for part in parts]))

    calls = []
    parts = [spark._jvm.org.apache.hadoop.fs.Path(f"/p/part-{n}") for n in range(3)]
    merged._concatenate(spark, System(), "draft", parts, header)
    if header:
        assert calls == [("write", b"top\n"), ("close",), ("concat", "draft", ["/p/part-0", "/p/part-1", "/p/part-2"])]
    else:
        assert calls == [("rename", parts[0], "draft"), ("concat", "draft", ["/p/part-1", "/p/part-2"])]


def test_a_failed_copy_leaves_nothing_in_sight(spark, tmp_path, monkeypatch):
    folder = tmp_path / "parts"
    spark.range(10).selectExpr("cast(id as string) as value").write.text(str(folder))
    monkeypatch.setattr(merged, "_copy", lambda *arguments: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        merged.merge_files(spark, str(folder), str(tmp_path / "whole"))
    assert not (tmp_path / "whole").exists() and folder.exists()
