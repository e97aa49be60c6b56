import pytest

from tritempo.operators.guards import check_category, check_request


def test_feature_combinations():
    check_request("curves", shape=True, archived=True)
    check_request("curves", aggregation=True, versioned=True)
    check_request("surfaces", rank_over=True)
    for category, features in (
        ("surfaces", {"shape"}), ("curves", {"shape", "versioned"}), ("timeseries", {"aggregation"}),
        ("curves", {"rank_over", "aggregation"}), ("timeseries", {"rank_over"}), ("curves", {"rank_over", "versioned"}),
        ("curves", {"rank_over", "archived"}),
    ):
        with pytest.raises(ValueError):
            check_request(category, **dict.fromkeys(features, True))


def test_categories(spark):
    series = spark.createDataFrame([(1, "Curve"), (2, "CURVES"), (3, None)], "series_id long, category string")
    check_category(series, "curves")
    with pytest.raises(ValueError, match="1, 2"):
        check_category(series, "surfaces")
