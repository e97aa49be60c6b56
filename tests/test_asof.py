"""Versions as of many times, and the stored table of newest versions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tritempo.operators.asof import as_of_join, latest_reference_times_as_of, versions_as_of
from tritempo.operators.versions import latest_before, latest_reference_time, latest_version, version_as_of
from tritempo.plans.layouts import shared_path
from tritempo.sources.latest import PART, LatestTable

DAY = datetime(2024, 1, 1)
SCHEMA = "MdoId bigint, ReferenceTime timestamp_ntz, CreatedOn timestamp_ntz, Deleted boolean, n int, value double"


@pytest.fixture(scope="module")
def data():
    """Series 1 has two thirds of the versions, many of one instant; some are deleted, some columns null."""
    chosen = random.Random(3)
    rows = []
    for n in range(1500):
        key = 1 if n % 3 else chosen.choice([2, 3, 4, None])
        reference = DAY + timedelta(days=chosen.randrange(6)) if n % 40 else None
        created = DAY + timedelta(hours=chosen.randrange(0, 400, 5), microseconds=chosen.choice([0, 0, 1])) if n % 50 else None
        rows.append((key, reference, created, chosen.random() < 0.2, n, None if n % 7 == 0 else float(n)))
    return rows


@pytest.fixture(scope="module")
def versions(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def requests(spark, data):
    times = [DAY + timedelta(hours=hours, microseconds=part) for hours in range(-20, 440, 23) for part in (0, 1)] + [None, datetime(1900, 1, 1)]
    times += [row[2] for row in data[:40] if row[2]]
    rows = [(key, at, f"{key}-{place}") for key in (1, 2, 3, 9, None) for place, at in enumerate(times)] + [(1, times[5], "again")] * 2
    return spark.createDataFrame(rows, "MdoId bigint, AsOf timestamp_ntz, request string")


@pytest.mark.parametrize("span", [86_400, 3_600, 10**9])
def test_as_of_join_equals_the_plain_rule(data, versions, requests, span):
    found = as_of_join(requests, versions.drop("ReferenceTime"), ["MdoId"], tiebreak=["n"], how="left", span=span)
    assert found.columns == ["MdoId", "AsOf", "request", "CreatedOn", "Deleted", "n", "value"]
    expected = []
    for key, at, name in map(tuple, requests.collect()):
        known = [(row[2], row[4]) for row in data if row[0] == key and at is not None and row[2] is not None and row[2] <= at]
        expected.append((name, max(known)[1] if known else None))
    assert sorted(((row.request, row.n) for row in found.collect()), key=str) == sorted(expected, key=str)
    inner = as_of_join(requests, versions.drop("ReferenceTime"), ["MdoId"], tiebreak=["n"], span=span)
    assert sorted((row.request, row.n) for row in inner.collect()) == sorted(each for each in expected if each[1] is not None)


def test_many_requests_equal_one_by_one(versions, requests, spark):
    asked = requests.filter("MdoId is not null and AsOf is not null").dropDuplicates(["MdoId", "AsOf"])
    known = versions.filter("ReferenceTime is not null and CreatedOn is not null")
    before = DAY + timedelta(days=4)
    many = {
        "as_of": versions_as_of(known, asked, tiebreak=["n"]),
        "latest": latest_reference_times_as_of(known, asked, tiebreak=["n"]),
        "before": latest_reference_times_as_of(known, asked, before=("<", before), tiebreak=["n"]),
    }
    many = {name: {(row.MdoId, row.AsOf, row.n) for row in found.collect()} for name, found in many.items()}
    rows = asked.collect()
    for at in sorted({row.AsOf for row in rows})[::9]:
        ids = [row.MdoId for row in rows if row.AsOf == at]
        own = known.filter(F.col("MdoId").isin(ids))
        one = {
            "as_of": version_as_of(own, at, tiebreak=("n",)), "latest": latest_reference_time(own, as_of=at, tiebreak=("n",)),
            "before": latest_before(own, "<", before, as_of=at, tiebreak=("n",)),
        }
        for name, found in one.items():
            assert {(row.MdoId, at, row.n) for row in found.collect()} == {each for each in many[name] if each[1] == at}, (name, at)


def test_versions_are_not_paired_with_requests(versions, requests, physical_plan):
    text = physical_plan(as_of_join(requests, versions, ["MdoId", "ReferenceTime"][:1]))
    assert text.count("Join") == 1 and "_carried" in text  # with a row per key and span only
    with pytest.raises(ValueError, match="value"):
        as_of_join(requests.withColumn("value", F.lit(1)), versions, ["MdoId"])


def test_requests_of_a_series_are_not_repeated_for_its_keys(versions, requests, physical_plan):
    wide = latest_reference_times_as_of(versions, requests, ["MdoId", "ReferenceTime", "value"])
    for found, joins in ((versions_as_of(versions, requests, tiebreak=["n"]), 1), (wide, 2)):
        text = physical_plan(found)
        assert text.count("Join") == joins
        above = text[:text.index("Join")]  # what meets isn't sorted, summed up or sent on
        assert not [word for word in ("Exchange", "Sort ", "Aggregate", "Window") if word in above]


@pytest.mark.parametrize("span", [86_400, 3_600, 10**9])
@pytest.mark.parametrize("keys", [["MdoId", "ReferenceTime"], ["MdoId", "ReferenceTime", "part"]])
def test_newest_versions_of_all_keys_equal_the_plain_rule(data, versions, requests, span, keys):
    """Keys with versions in many spans, in none, and with null parts; repeated requests and ones of no time."""
    rows = [(*row, row[4] % 3 or None) for row in data]
    place = {"MdoId": 0, "ReferenceTime": 1, "part": 6}
    versions = versions.withColumn("part", F.expr("nullif(n % 3, 0)"))
    expected, at_largest = [], []
    for key, at, name in map(tuple, requests.collect()):
        newest, largest = {}, {}
        known = [row for row in rows if key is not None and row[0] == key and at is not None and row[2] is not None and row[2] <= at]
        for row in sorted(known, key=lambda row: (row[2], row[4])):
            newest[tuple(row[place[field]] for field in keys)] = row
        top = max([row[1] for row in known if row[1]], default=None)
        expected += [(name, row[4]) for row in newest.values() if not row[3]]
        at_largest += [(name, row[4]) for row in newest.values() if not row[3] and top and row[1] == top]
    found = versions_as_of(versions, requests, keys, tiebreak=["n"], span=span)
    rest = [name for name in versions.columns if name not in keys]
    assert found.columns == ["MdoId", "AsOf", "request", *keys[1:], *rest]
    assert sorted((row.request, row.n) for row in found.collect()) == sorted(expected)
    latest = latest_reference_times_as_of(versions, requests, keys, tiebreak=["n"], span=span)
    assert sorted((row.request, row.n) for row in latest.filter("MdoId is not null").collect()) == sorted(at_largest)
    hidden = versions_as_of(versions, requests, keys, tiebreak=["n"], span=span, include_deleted=True).filter("Deleted")
    assert hidden.count() + len(expected) == versions_as_of(versions, requests, keys, tiebreak=["n"], include_deleted=True).count() > len(expected)
    with pytest.raises(ValueError, match="value"):
        versions_as_of(versions, requests.withColumn("value", F.lit(1)), keys)


def test_empty_sides_of_all_keys(versions, requests):
    assert versions_as_of(versions, requests.filter("MdoId = 77")).count() == versions_as_of(versions.filter("n < 0"), requests).count() == 0


def test_empty_sides(versions, requests):
    assert as_of_join(requests.filter("MdoId = 77"), versions, ["MdoId"]).count() == 0
    assert as_of_join(requests, versions.filter("n < 0"), ["MdoId"]).count() == 0
    assert as_of_join(requests, versions.filter("n < 0"), ["MdoId"], how="left").count() == requests.count()


def table(spark, name, parts=8):
    return LatestTable(spark, shared_path(spark, name), tiebreak=("n",)).create(SCHEMA, parts=parts)


def test_batches_equal_a_full_recompute(spark, versions):
    full = {tuple(row) for row in latest_version(versions, tiebreak=("n",)).collect()}
    for seed in range(3):
        own = table(spark, f"latest-{seed}")
        parts = [versions.filter(F.pmod(F.xxhash64("n", F.lit(seed)), F.lit(4)) == part) for part in range(4)]
        for batch in (*parts, parts[1]):  # the last comes twice
            own.merge(batch.select(F.lit("x").alias("more"), *reversed(versions.columns)))
        assert {tuple(row) for row in own.versions().collect()} == full
        assert {tuple(row) for row in own.rows().collect()} == {row for row in full if not row[3]}


def test_only_touched_parts_are_read_and_written(spark, versions):
    own = table(spark, "latest-touched", parts=16)
    many = spark.range(400).selectExpr("id as MdoId", "TIMESTAMP_NTZ '2024-01-01 00:00:00' as ReferenceTime", "TIMESTAMP_NTZ '2024-01-02 00:00:00' as CreatedOn",
                                       "false as Deleted", "cast(id as int) as n", "1D as value")
    assert own.merge(many) == list(range(16))
    before = own.manifest()[1]["generations"]
    reader = own.versions()
    late = many.filter("MdoId < 2").withColumn("CreatedOn", F.expr("TIMESTAMP_NTZ '2024-01-01 12:00:00'")).withColumn("value", F.lit(9.0))
    gone = many.filter("MdoId = 1").withColumn("CreatedOn", F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00'")).withColumn("Deleted", F.lit(True))
    touched = own.merge(late.union(gone))
    after = own.manifest()[1]["generations"]
    assert 1 <= len(touched) <= 2 and {int(part) for part in after if after[part] != before[part]} == set(touched)
    assert own.rows().count() == 399 and own.versions().count() == 400 and own.versions().filter("value = 9").count() == 0
    assert reader.filter("Deleted").count() == 0 and reader.count() == 400  # a reader keeps what it began with
    assert own.merge(many.filter("MdoId < 0")) == [] and own.manifest()[0] == 2
    assert own.vacuum() == len(touched) and own.versions().count() == 400


def test_of_two_merges_from_one_manifest_the_later_fails(spark, versions, monkeypatch):
    own = table(spark, "latest-race")
    own.merge(versions)
    stale = own.manifest()
    own.merge(versions.limit(5))
    count = own.versions().count()
    monkeypatch.setattr(own, "manifest", lambda: stale)
    with pytest.raises(RuntimeError, match="repeat"):
        own.merge(versions.withColumn("ReferenceTime", F.col("CreatedOn")))
    monkeypatch.undo()
    assert own.versions().count() == count and PART not in own.versions().columns
