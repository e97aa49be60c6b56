import json
import random
from datetime import datetime as dt, timedelta

import pytest
from conftest import partition_sizes
from pyspark.sql import Window
from pyspark.sql import functions as F

from tritempo.operators.hybrid import hybrid_union, latest_global, union_requests, watermarks
from tritempo.operators.aggregate import aggregate_delivery, check_aggregation
from tritempo.functions.mapped import MappedColumn
from tritempo.plans import fixtures as fx
from tritempo.sinks.text import csv_rows, generic_target_zone, includes_offset, json_rows, union_categories, write_csv
from tritempo.operators import joins, positions
from tritempo.streaming.batches import column_batches, ndjson_lines, row_positions, write_ndjson

DAY = dt(2024, 1, 1)


def test_hybrid_union_splits_at_the_watermark(spark):
    schema = "Identifier long, ReferenceTime timestamp_ntz, Value double"
    archive = spark.createDataFrame([(1, DAY, 1.0), (1, DAY + timedelta(days=1), 2.0), (2, DAY, 3.0)], schema)
    recent = spark.createDataFrame([(1, DAY, 10.0), (1, DAY + timedelta(days=1), 20.0)], schema)
    # series 2 has no recent rows and stays with the archive; series 1 switches at its newest recent time
    found = sorted((row.Identifier, row.Value) for row in hybrid_union(archive, recent).collect())
    assert found == [(1, 1.0), (1, 20.0), (2, 3.0)]
    marks = spark.createDataFrame([(1, DAY)], "Identifier long, Watermark timestamp_ntz")
    assert sorted(row.Value for row in hybrid_union(archive, recent, marks).collect()) == [3.0, 10.0, 20.0]
    assert watermarks(recent).first().Watermark == DAY + timedelta(days=1)
    assert [row.Value for row in latest_global(recent).collect()] == [20.0]


def test_hybrid_union_partitions_its_inputs(spark, sf):
    rows = fx.curve_points(spark, sf).select("Identifier", "ReferenceTime", "DeliveryStart", "SettlementPrice")
    marks = rows.groupBy("Identifier").agg(F.expr("percentile_approx(cast(ReferenceTime as date), 0.5)")
                                           .cast("timestamp_ntz").alias("Watermark"))
    merged = hybrid_union(rows, rows, marks)
    assert merged.exceptAll(rows).isEmpty() and rows.exceptAll(merged).isEmpty()


def test_filters_on_a_hybrid_union_reach_both_scans(spark, sf, tmp_path):
    columns = ("Identifier", "ReferenceTime", "SettlementPrice")
    for name in ("archive", "recent"):
        fx.curve_points(spark, sf).select(*columns).write.parquet(str(tmp_path / name))
    archive, recent = (spark.read.parquet(str(tmp_path / name)) for name in ("archive", "recent"))
    merged = hybrid_union(archive, recent).filter(F.col("ReferenceTime") >= F.expr("TIMESTAMP_NTZ '1999-01-01'"))
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = merged._jdf.queryExecution().explainString(formatted)
    assert text.count("GreaterThanOrEqual(ReferenceTime,1999-01-01T00:00)") == 2


def test_unions_fill_missing_columns(spark):
    left, right = spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(2, 3.0)], "x int, z double")
    assert [tuple(row) for row in union_requests(left, right).orderBy("x").collect()] == [(1, "a", None), (2, None, 3.0)]
    both = union_categories(left, right.withColumn("Y", F.lit(None).cast("string")))
    assert both.columns == ["x", "y", "z"]
    assert [tuple(row) for row in both.orderBy("x").collect()] == [("1", "a", "N/A"), ("2", "null", "3")]


def test_aggregation_guards():
    mapping = [MappedColumn("ReferenceTime", "t", is_key=True), MappedColumn("Value", "v")]
    check_aggregation([("AVG", "Value", "A"), ("count", "*", "N")], "Bucket", mapping)
    for values in ([], [("MEDIAN", "Value", "A")], [("SUM", "*", "A")], [("SUM", "Value", "a b")],
                   [("SUM", "Value", "A"), ("MIN", "Value", "a")], [("SUM", "Value", "bucket")],
                   [("SUM", "ReferenceTime", "A")], [("SUM", "Missing", "A")]):
        with pytest.raises(ValueError):
            check_aggregation(values, "Bucket", mapping)


def test_bucket_counts_sum_to_the_rows(spark, sf):
    rows = fx.curve_points(spark, sf)
    for period in ("PT15M", "PT7H", "P2D", "P3W", "P4M", "P2Y"):
        counts = aggregate_delivery(rows, period, [("COUNT", "*", "n")])
        assert counts.agg(F.sum("n")).first()[0] == rows.count()


def test_offset_rules():
    assert includes_offset("json") and includes_offset("ndjson", False)
    assert not includes_offset("csv") and includes_offset("csv_stream", True)
    with pytest.raises(ValueError):
        includes_offset("xml")
    assert generic_target_zone() == "UTC" and generic_target_zone("CET") == "CET"
    assert generic_target_zone(offset=True) is None and generic_target_zone(aggregated=True) is None


@pytest.fixture
def outputs(spark):
    data = [(1, dt(2024, 4, 25, 22), 1.5, 'a "quoted", text'), (1, dt(2024, 1, 1, 0, 0, 0, 123456), None, ""),
            (2, dt(2024, 2, 1), 1e-7, None)]
    return spark.createDataFrame(data, "Identifier long, ReferenceTime timestamp_ntz, Value double, Note string")


def text_of(path, suffix):
    return [file.read_text() for file in sorted(path.glob(f"part-*{suffix}"))]


def test_csv_files(outputs, tmp_path):
    path = tmp_path / "csv"
    write_csv(outputs.coalesce(1), str(path), ["Identifier", "ReferenceTime", "Value", "Note", "CreatedOn"],
              zone="Europe/Zurich", offset=True)
    header = "Identifier,ReferenceTime,Value,Note,CreatedOn"
    lines = []
    for text in text_of(path, ".csv"):
        first, *rest = text.splitlines()
        assert first == header
        lines += rest
    assert lines == [
        "1,2024-01-01T01:00:00.123+01:00,null,,N/A",
        "2,2024-02-01T01:00:00.000+01:00,0.0000001,null,N/A",
        '1,2024-04-26T00:00:00.000+02:00,1.5,"a ""quoted"", text",N/A',
    ]
    assert csv_rows(outputs).filter("Identifier = '2'").first().ReferenceTime == "2024-02-01T00:00:00.000"


def test_csv_of_nothing_still_has_a_header(outputs, tmp_path):
    path = tmp_path / "empty"
    write_csv(outputs.filter("Identifier > 10"), str(path))
    assert [text.splitlines() for text in text_of(path, ".csv")] == [["Identifier,ReferenceTime,Value,Note"]]


def test_json_rows(outputs):
    rows = [json.loads(row.value) for row in json_rows(outputs, zone="Europe/Zurich").collect()]
    assert rows[0] == {"Identifier": 1, "Note": ['a "quoted", text'], "ReferenceTime": ["2024-04-26T00:00:00.000+02:00"],
                       "Value": [1.5]}
    assert rows[1]["Value"] == [None] and rows[2]["Note"] == [None]
    assert list(rows[0]) == sorted(rows[0])
    lists = outputs.withColumn("Parts", F.array(F.lit(1), F.lit(2)))
    assert json.loads(json_rows(lists).first().value)["Parts"] == [1, 2]


@pytest.fixture
def series(spark):
    """Series 1 holds most rows, most of them on one day; some times are missing."""
    generator = random.Random(5)
    data, used = [], set()
    for n in range(4000):
        series = 1 if n % 4 else generator.randrange(2, 6)
        day = 0 if n % 3 else generator.randrange(60)
        reference = DAY + timedelta(days=day, minutes=generator.choice((0, 0, 1, 700)), microseconds=generator.randrange(3))
        delivery = DAY + timedelta(hours=generator.randrange(24 * 400))
        key = (series, reference, delivery)
        if key not in used:
            used.add(key)
            data.append((*key, float(n) if n % 7 else None))
    data += [(1, None, DAY, 1.0), (1, None, None, 2.0), (3, DAY, None, 3.0)]
    return spark.createDataFrame(data, "Identifier long, ReferenceTime timestamp_ntz, DeliveryStart timestamp_ntz, Value double")


def expected_order(rows):
    def part(value):
        return (0, DAY) if value is None else (1, value)

    return sorted(rows, key=lambda row: (part(row.ReferenceTime), part(row.DeliveryStart)))


@pytest.mark.parametrize("threshold", ["10485760", "-1"])
@pytest.mark.parametrize("limit", [0, 10**6])
def test_positions_equal_sorting(spark, series, threshold, limit, monkeypatch):
    monkeypatch.setattr(joins.fits, "__defaults__", (limit, 10**9))
    monkeypatch.setattr(joins.sized, "__defaults__", (limit,))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        placed = row_positions(series, "Identifier", ["ReferenceTime", "DeliveryStart"]).collect()
        assert len(placed) == series.count()
        for number in {row.Identifier for row in placed}:
            rows = sorted((row for row in placed if row.Identifier == number), key=lambda row: row._position)
            assert [row._position for row in rows] == list(range(len(rows)))
            assert [row[1:3] for row in rows] == [row[1:3] for row in expected_order(rows)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_positions_without_a_checkpoint_folder_are_the_same(spark, series, monkeypatch):
    rows = {tuple(row) for row in row_positions(series, "Identifier", ["ReferenceTime"]).collect()}
    monkeypatch.setattr(positions, "has_checkpoint_dir", lambda session: False)
    assert {tuple(row) for row in row_positions(series, "Identifier", ["ReferenceTime"]).collect()} == rows


def test_no_task_holds_a_series_or_a_tie(spark):
    """A series has most rows and half of these tie: sorted partitions are even, and ties have the same order in every run."""
    rows = spark.range(40_000).selectExpr("if(id % 3 > 0, 1, id % 50) as Identifier", "if(id % 2 = 0, 5, id) as o", "id as n").repartition(5)
    sizes = partition_sizes(spark, positions._sorted(rows, ["Identifier"], [F.col("o"), positions.any_order(rows)]))
    assert max(sizes) < 2 * rows.count() / 8
    first, second = ({tuple(row) for row in row_positions(each, "Identifier", ["o"]).collect()} for each in (rows, rows.repartition(9)))
    assert first == second and len({row[0::3] for row in first}) == rows.count()


def test_positions_shuffle_the_rows_once(spark, series, physical_plan):
    plan = physical_plan(row_positions(series, "Identifier", ["ReferenceTime", "DeliveryStart"]))
    assert "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0] and "row_number" not in plan


def test_column_batches(spark, series):
    size = 64
    batches = column_batches(series, size=size, zone="Europe/Zurich")
    counts = {row.Identifier: row.n for row in series.groupBy("Identifier").agg(F.count("*").alias("n")).collect()}
    found = {}
    for row in batches.collect():
        assert row.rows == len(row.ReferenceTime) == len(row.DeliveryStart) == len(row.Value) <= size
        found.setdefault(row.Identifier, {})[row.batch] = row
    for number, parts in found.items():
        full, last = divmod(counts[number], size)
        assert [parts[b].rows for b in sorted(parts)] == [size] * full + ([last] if last else [])
        values = [value for b in sorted(parts) for value in parts[b].Value]
        rows = expected_order([row for row in series.collect() if row.Identifier == number])
        assert values == [row.Value for row in rows]


def test_ndjson_files(spark, series, tmp_path):
    path = tmp_path / "nd"
    write_ndjson(series, str(path), size=500)
    objects = [json.loads(line) for text in text_of(path, ".txt") for line in text.splitlines()]
    assert sum(len(item["Value"]) for item in objects) == series.count()
    assert all(list(item) == ["DeliveryStart", "Identifier", "ReferenceTime", "Value"] for item in objects)
    ids = [item["Identifier"] for item in objects]
    assert ids == sorted(ids)
    assert any(None in item["Value"] for item in objects)
    assert ndjson_lines(column_batches(series, size=0)).count() >= 5


@pytest.mark.parametrize("kind", ["int", "smallint", "decimal(10,2)", "bigint", "string", "date", "timestamp_ntz", "double", "boolean"])
def test_positions_of_every_order_type_with_nulls(spark, kind):
    """Nulls, the lowest values and ties: long series are numbered like short ones."""
    values = {
        "string": "concat('v', id % 5)", "date": "date_add(DATE '2024-01-01', cast(id % 50 as int))",
        "timestamp_ntz": "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id * 7 % 90 as int))",
        "boolean": "id % 2 = 0",
    }.get(kind, f"cast((id % 11) - 5 as {kind})")
    lowest = {"bigint": "-9223372036854775808", "int": "-2147483648", "smallint": "-32768"}.get(kind)
    rows = spark.range(120).selectExpr(
        "if(id % 40 = 0, null, id % 2) as Identifier",
        f"case when id % 13 = 0 then null {f'when id % 17 = 0 then {lowest}' if lowest else ''} else {values} end as o", "id as tie",
    )
    for order in (["o", "tie"], ["tie", "o"]):
        plain = F.row_number().over(Window.partitionBy("Identifier").orderBy(*order)) - 1
        expected = {tuple(row) for row in rows.withColumn("_position", plain).collect()}
        assert {tuple(row) for row in row_positions(rows, "Identifier", order).collect()} == expected


def test_batches_may_not_be_endless(spark, series):
    with pytest.raises(ValueError):
        column_batches(series, size=10**9)


def test_categories_are_ordered_by_instant(spark, tmp_path):
    from tritempo.functions.mapped import MappedColumn
    from tritempo.sinks.text import mapped_header, write_csv_categories

    # 00:30 and 01:30 UTC are both 02:30 in Zurich on 27 October; with offsets the texts sort the other way round
    times = [dt(2024, 10, 27, hour, minute) for hour in (0, 1) for minute in (0, 30)]
    curve = spark.createDataFrame([(1, t, t) for t in times[::-1]], "Identifier long, ReferenceTime timestamp_ntz, DeliveryStart timestamp_ntz")
    series = spark.createDataFrame([(2, t, 1.5) for t in times], "Identifier long, ReferenceTime timestamp_ntz, Value double")
    header = mapped_header(
        [MappedColumn("Identifier", is_key=True, key_ordering=0), MappedColumn("ReferenceTime", is_key=True, key_ordering=1),
         MappedColumn("DeliveryStart", is_key=True, key_ordering=2), MappedColumn("Secret", is_projectable=False)],
        [MappedColumn("identifier", is_key=True, key_ordering=0), MappedColumn("Value", value_ordering=1)],
    )
    assert header == ["Identifier", "ReferenceTime", "DeliveryStart", "Value"]
    path = str(tmp_path / "out")
    write_csv_categories([curve, series], path, header, zone="Europe/Zurich", offset=True)
    lines = []
    for part in sorted((tmp_path / "out").glob("part-*")):
        head, *body = part.read_text().splitlines()
        assert head == ",".join(header)
        lines += [line.split(",") for line in body]
    read = [dt.fromisoformat(line[1]) for line in lines]
    assert len(lines) == 8 and read == sorted(read)
    assert {line[3] for line in lines} == {"N/A", "1.5"}


def test_times_with_a_session_zone_and_short_floats(spark):
    from tritempo.sinks.text import csv_rows, to_target_zone

    rows = spark.sql("SELECT timestamp_seconds(0) AS t, cast(0.1 AS float) AS f, cast(null AS float) AS n")
    assert tuple(csv_rows(rows, zone="Asia/Tokyo", offset=True).first()) == ("1970-01-01T09:00:00.000+09:00", "0.1", "null")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Zurich")
        assert csv_rows(rows, zone="Asia/Tokyo", offset=True).first().t == "1970-01-01T09:00:00.000+09:00"
        assert to_target_zone(rows, "Asia/Tokyo").first().t == dt(1970, 1, 1, 9)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
