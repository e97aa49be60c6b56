import pytest

from tritempo.functions.mapped import MappedColumn, check_requested, output_order
from tritempo.operators import catalog as cat
from tritempo.operators import project as pr
from tritempo.operators.ids import check_ids, with_ids
from tritempo.operators.sort import order_names, order_names_latest
from tritempo.sources.layouts import CATALOG

ROW = dict(category="curve", source=None, resolution=None, archive_id=None, versioned_id=None, switchover=None,
           split_query=None, timezone=None, column_ordinal=1, logical="Value", physical="v", data_type="number",
           is_key=False, is_projectable=True, order_priority=None, key_ordering=None, value_ordering=None)


def catalog(spark, *rows):
    return cat.catalog_rows(spark.createDataFrame([tuple({**ROW, **row}.get(f.name) for f in CATALOG.fields)
                                                   for row in rows], CATALOG))


def versioned(spark, *ids, timezone=None):
    rows = [tuple({**ROW, "series_id": i, "timezone": timezone}.get(f.name) for f in CATALOG.fields) for i in ids]
    return cat.versioned_rows(spark.createDataFrame(rows, CATALOG))


def by_id(df):
    return {row.series_id: row for row in df.collect()}


def test_nested_mapping(spark):
    rows = catalog(
        spark, {"series_id": 1, "column_ordinal": 2, "logical": "B", "split_query": False},
        {"series_id": 1, "column_ordinal": 1, "logical": "A", "archive_id": "power:1"}, {"series_id": 2},
    )
    nested = by_id(cat.mapping_nest(rows))
    assert [column.logical for column in nested[1].columns] == ["A", "B"]
    assert nested[1].archive_id == "power:1" and nested[1].split_query is True and nested[2].source == "recent"
    mapping = cat.mapping_of(rows, 1)
    assert [column.logical for column in mapping] == ["A", "B"] and mapping[0].physical == "v"
    with pytest.raises(ValueError):
        cat.mapping_of(rows, 99)


def test_regular_and_migration_stages(spark):
    recent = catalog(
        spark,
        {"series_id": 1, "switchover": "MDS:2024-01-01", "versioned_id": 101, "timezone": "CET"},
        {"series_id": 2, "switchover": "mds", "timezone": "Asia/Tokyo"},
        {"series_id": 3, "switchover": "CMDP:2024-01-01", "versioned_id": 103},
        {"series_id": 4, "versioned_id": 104},
        {"series_id": 5, "archive_id": "power:5"},
    )
    stored = versioned(spark, 101, 2, 103, 4, 5, 104)
    regular = by_id(cat.resolve_regular(recent, stored))
    assert set(regular) == {101, 2, 3, 4, 5}
    assert regular[101].switchover == "MDS:2024-01-01" and regular[101].timezone == "CET"
    assert regular[2].timezone == "Asia/Tokyo" and regular[4].switchover is None
    assert (regular[3].source, regular[3].versioned_id) == ("recent", None)
    assert regular[4].source == "versioned" and regular[5].source == "archive"
    migration = by_id(cat.resolve_migration(recent, stored))
    assert set(migration) == {103, 4, 5, 1, 2}
    assert migration[103].switchover == "CMDP:2024-01-01" and migration[5].source == "versioned"
    assert (migration[1].source, migration[1].versioned_id) == ("recent", None)
    ids = spark.createDataFrame([(5,)], "id long")
    for stage, source in (("Design-1", "versioned"), ("pre-VALIDATION", "versioned"), ("Migration", "versioned"),
                          ("production", "archive")):
        found = cat.resolve_by_stage(recent, stored, stage, ids=ids).collect()
        assert [(row.series_id, row.source) for row in found] == [(5, source)]


def test_enrichment_takes_the_first_original_and_keeps_own_zone(spark):
    originals = catalog(spark, {"series_id": 7, "versioned_id": 50, "switchover": "MDS:b", "timezone": "CET"},
                        {"series_id": 6, "versioned_id": 50, "switchover": "MDS:a", "timezone": "Asia/Tokyo"})
    assert by_id(cat.mapping_enrich(versioned(spark, 50), originals))[50].switchover == "MDS:a"
    own = by_id(cat.mapping_enrich(versioned(spark, 50, 51, timezone="UTC"), originals))
    assert own[50].timezone == "UTC" and own[51].switchover is None


def test_versioned_flags(spark):
    raw = spark.createDataFrame([(1, "curves", 1, "ReferenceTime", "t", 1, None), (1, "curves", 2, "Value", "n", None, 1)],
                                "series_id long, category string, column_ordinal int, logical string, data_type string,"
                                "key_ordering int, value_ordering int")
    key, value = cat.versioned_rows(raw).orderBy("column_ordinal").collect()
    assert (key.is_key, key.is_projectable, key.split_query, key.versioned_id) == (True, False, True, 1)
    assert (value.is_key, value.is_projectable, value.physical, value.source) == (False, True, "Value", "versioned")


MAPPING = [
    MappedColumn("Volume", "vol", "number", value_ordering=2),
    MappedColumn("Identifier", "fid", "long", is_key=True, is_projectable=False),
    MappedColumn("Price", "settlement price", "number", value_ordering=1),
    MappedColumn("ReferenceTime", "t", "datetimeoffset", is_key=True, is_projectable=False, key_ordering=1),
    MappedColumn("Again", "VOL", "number"),
    MappedColumn("Hidden", "h", "number", is_projectable=False),
    MappedColumn("Urgent", "u", "number", order_priority=3),
]


def test_select_lists(spark):
    assert [c.logical for c in output_order(MAPPING)] == [
        "ReferenceTime", "Urgent", "Price", "Volume", "Again", "Hidden", "Identifier"]
    data = spark.createDataFrame([(1.0, 7, 2.0, "x", 9.0, 4.0)], "vol double, fid long, `settlement price` double, t string, h double, u double")
    assert pr.project_mapped(data, MAPPING).columns == ["ReferenceTime", "Urgent", "Price", "Volume", "Identifier"]
    assert pr.project_mapped(data, MAPPING, ["PRICE"]).columns == ["ReferenceTime", "Price", "Identifier"]
    assert pr.project_mapped(data, MAPPING, ["vol"]).columns == ["ReferenceTime", "Volume", "Identifier"]
    assert pr.requested_names(MAPPING) == ["Volume", "Price", "ReferenceTime", "Again", "Hidden", "Urgent"]
    assert pr.requested_names(MAPPING, ["createdon"], keep_identifier=True) == [
        "Volume", "Identifier", "Price", "ReferenceTime", "Again", "Hidden", "Urgent", "CreatedOn"]
    assert pr.requested_names(MAPPING, ["price", "CreatedOn", "Price"]) == ["ReferenceTime", "Hidden", "Price", "CreatedOn"]
    assert order_names(MAPPING) == ["ReferenceTime", "Urgent"]
    assert order_names_latest(MAPPING) == ["Urgent"]
    assert order_names([MappedColumn("DeliveryStart", "d"), MappedColumn("ReferenceTime", "r")]) == [
        "ReferenceTime", "DeliveryStart"]
    assert order_names_latest([MappedColumn("X", "x", key_ordering=1)]) == ["ReferenceTime"]


def test_projection_guards():
    for names in (["Missing"], ["bad-name"], ["CreatedOn"]):
        with pytest.raises(ValueError):
            check_requested(MAPPING, names, versioned=False)
    assert check_requested(MAPPING, ["CreatedOn", "Price"], versioned=True)


def test_positional_values_of_latest_timeseries(spark):
    data = spark.createDataFrame([(1, "r", '{"Value": "2.5", "B": 1, "A": 2}', "c")],
                                 "MdoId long, ReferenceTime string, payload string, CreatedOn string")
    keys = [MappedColumn("Identifier", "MdoId", is_key=True, key_ordering=1),
            MappedColumn("ReferenceTime", is_key=True, key_ordering=2)]
    values = [MappedColumn("B", data_type="int", value_ordering=1), MappedColumn("A", data_type="int", value_ordering=2)]
    assert pr.project_latest_timeseries(data, keys + values, "payload").first().asDict() == {
        "ReferenceTime": "r", "Property0": 1, "Property1": 2}
    assert pr.project_latest_timeseries(data, keys + values, "payload", ["A"], keep_identifier=True).first().asDict() == {
        "Identifier": 1, "ReferenceTime": "r", "Property0": 2}
    assert pr.project_latest_timeseries(data, keys + values, "payload", ["CreatedOn"]).columns == [
        "ReferenceTime", "Property0", "Property1", "CreatedOn"]
    assert pr.project_latest_timeseries(data, keys, "payload").first().Property0 == "2.5"
    assert pr.project_latest_timeseries(data, values, "payload").columns[0] == "ReferenceTime"


def test_archive_contract(spark):
    data = spark.createDataFrame([(1, 2, 3)], "Identifier int, Value int, Extra int")
    assert pr.archive_contract_columns(data, ["Extra", "value"]).columns == ["Extra", "Value", "Identifier"]


def test_ids(spark, physical_plan):
    for ids in ([], [0], [-1], [1, 1]):
        with pytest.raises(ValueError):
            check_ids(ids)
    data = spark.range(5000).withColumnRenamed("id", "Identifier")
    assert with_ids(data, [3, 4, 9999]).count() == 2
    many = with_ids(data, list(range(1, 2001)))
    assert many.count() == 2000 and "LeftSemi" in physical_plan(many)
    assert with_ids(data, spark.createDataFrame([(3,), (3,), (4,)], "x long")).count() == 2
