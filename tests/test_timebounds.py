from datetime import datetime as dt

import pytest

from tritempo.functions import timebounds as tb

Z = "Europe/Zurich"


def test_points_are_read_in_the_zone():
    assert tb.point("2024-04-26T00:00:00", Z) == dt(2024, 4, 25, 22)
    assert tb.point("2024-04-26T00:00:00", "CET") == dt(2024, 4, 25, 22)
    assert tb.point("2024-04-26T00:00:00") == dt(2024, 4, 26)
    assert tb.point("2024-04-26T00:00:00.250", "UTC") == dt(2024, 4, 26, 0, 0, 0, 250000)
    assert tb.point("2024-04-26T00:00:00+05:00", Z) == dt(2024, 4, 25, 19)
    assert tb.point("2024-04-26T00:00:00Z", Z) == dt(2024, 4, 26)
    assert tb.point("2023-01-01T00:00:00", Z) == dt(2022, 12, 31, 23)


@pytest.mark.parametrize("text", [
    "2024-03-31T02:30:00", "2024-02-30T00:00:00", "2024-01-01", "2024-01-01T00:00", "2024-01-01T00:00:00.5",
    "2024-01-01 00:00:00", "",
])
def test_impossible_points_are_rejected(text):
    with pytest.raises(ValueError):
        tb.point(text, Z)


def test_unknown_zone_is_rejected():
    with pytest.raises(ValueError):
        tb.point("2024-01-01T00:00:00", "Mars/Olympus")


def test_period_arithmetic():
    assert tb.point("2024-04-26T00:00:00", Z, plus="+P1D") == dt(2024, 4, 26, 22)
    assert tb.shift(dt(2024, 1, 31), "P1M") == dt(2024, 3, 2)
    assert tb.shift(dt(2023, 1, 31), "P1M") == dt(2023, 3, 3)
    assert tb.shift(dt(2024, 2, 29), "P1Y") == dt(2025, 3, 1)
    assert tb.shift(dt(2024, 3, 31), "-P1M") == dt(2024, 3, 2)
    assert tb.shift(dt(2024, 1, 1), "P1Y2M1W3DT4H5M6S") == dt(2025, 3, 11, 4, 5, 6)
    assert tb.shift(dt(2024, 1, 1), "-P1W") == dt(2023, 12, 25)
    for text in ("P", "1D", "P1.5D", "P1D2H", "P-1D"):
        if text == "P":
            assert tb.Period.parse(text) == tb.Period()
            continue
        with pytest.raises(ValueError):
            tb.Period.parse(text)


def test_local_calendar_keeps_the_wall_clock_over_dst():
    start = tb.point("2024-03-01T00:00:00", Z)
    assert tb.interval_of("month", "2024-03-01T00:00:00", Z).end == dt(2024, 3, 29, 23)
    assert tb.shift(start, "P1M", calendar="local", zone=Z) == dt(2024, 3, 31, 22)
    assert tb.interval_of("day", "2024-03-31T00:00:00", Z, calendar="local").end == dt(2024, 3, 31, 22)
    with pytest.raises(ValueError):
        tb.shift(start, "P1M", calendar="lunar")


def test_intervals():
    explicit = tb.interval("2023-05-21T00:00:00", "2023-05-21T23:59:59", Z)
    assert explicit == tb.Interval(dt(2023, 5, 20, 22), dt(2023, 5, 21, 21, 59, 59))
    assert tb.interval_of("day", "2024-04-26T00:00:00", Z) == tb.Interval(dt(2024, 4, 25, 22), dt(2024, 4, 26, 22))
    lengths = {unit: tb.interval_of(unit, "2024-01-10T00:00:00").end for unit in tb.INTERVAL_LENGTHS}
    assert lengths == {
        "day": dt(2024, 1, 11), "week": dt(2024, 1, 17), "month": dt(2024, 2, 10), "quarter": dt(2024, 4, 10),
        "year": dt(2025, 1, 10),
    }
    assert tb.gas_interval_of("month", "2024-01-10T00:00:00") == tb.interval_of("month", "2024-01-10T00:00:00")
    moved = tb.interval_of("day", "2024-01-31T00:00:00").shifted("P1M")
    assert moved == tb.Interval(dt(2024, 3, 2), dt(2024, 3, 1))
    with pytest.raises(ValueError):
        tb.interval_of("decade", "2024-01-10T00:00:00")


def test_gas_seasons():
    assert tb.gas_season("summer", "2024-12-01T00:00:00", Z) == tb.Interval(dt(2024, 4, 1, 4), dt(2024, 10, 1, 4))
    assert tb.gas_season("winter", "2024-11-01T00:00:00", Z) == tb.Interval(dt(2024, 10, 1, 4), dt(2025, 4, 1, 4))
    assert tb.gas_season("winter", "2024-09-30T00:00:00", Z) == tb.Interval(dt(2023, 10, 1, 4), dt(2024, 4, 1, 4))
    # the season follows the local year of the point
    assert tb.gas_season("summer", dt(2023, 12, 31, 23, 30), Z).start == dt(2024, 4, 1, 4)
    with pytest.raises(ValueError):
        tb.gas_season("spring", "2024-09-30T00:00:00", Z)


def test_now_is_injectable():
    assert tb.now(at=dt(2024, 1, 1), plus="-PT1H") == dt(2023, 12, 31, 23)
    assert abs((tb.now() - tb.now(plus="P1D")).total_seconds() + 86400) < 60
