import math
import random

import pytest

from helpers import rows_of
from tritempo.llm import hardnegatives

SCHEMA = "vec_id long, embedding array<double>, label int, score long, node long, anchor string, id string"


def rows_with(spark, vectors):
    return spark.createDataFrame([(key, value, label, 1, 2, "a", "i") for key, value, label in vectors], SCHEMA)


def plain(vectors):
    """The contract by loops."""
    kept = [
        (place, key, (label + 1) % 10 if key % 7 == 0 else label, [math.floor(256 * x) for x in value])
        for place, (key, value, label) in enumerate(vectors)
        if key is not None and label is not None and value is not None and all(x is not None and math.isfinite(x) for x in value)
    ]
    found = []
    for place, key, label, x in kept:
        if key % 100:
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(x, y, strict=True)), other, own == label) for at, other, own, y in kept if at != place and len(y) == len(x)
        )
        for low, positive, _ in [each for each in scored if each[2]][:5]:
            fits = [each for each in scored if not each[2] and 80 * -low <= 100 * -each[0] <= 100 * -low]
            found += [(key, positive, rank + 1, other, -low, -score) for rank, (score, other, _) in enumerate(fits[:5])]
    return found


@pytest.fixture(scope="module")
def vectors():
    chosen = random.Random(6)
    middle = [[chosen.gauss(0, 1) for _ in range(4)] for _ in range(3)]
    near = lambda: [x + chosen.gauss(0, 0.1) for x in chosen.choice(middle)]
    rows = [(key, near(), chosen.randrange(10)) for key in range(0, 700, 2)]
    rows += [(key, middle[0], key % 3) for key in range(1000, 1300)]  # many equal rows of several labels
    rows += [(100, near(), 3), (100, near(), 3), (200, [0.0] * 4, 1), (300, [-x for x in middle[0]], 0), (-100, near(), 2)]
    return rows + [
        (2000, None, 1), (2001, [1.0] * 4, None), (2100, [1.0, None, 1.0, 1.0], 1), (2101, [float("nan")] * 4, 1), (2102, [float("inf")] * 4, 1),
        (None, near(), 1), (2200, [], 1), (2201, [], 1), (2202, [], 2), (2300, [1.0, 2.0], 4), (2301, [1.0, 2.0], 4), (2302, [1.0, 1.9], 5),
    ]


@pytest.mark.parametrize("rows,abreast,left,right", [(65_536, 4096, 512, 2048), (50, 5, 3, 40)])
def test_equals_the_plain_rule(spark, vectors, monkeypatch, rows, abreast, left, right):
    for name, value in (("ROWS", rows), ("ABREAST", abreast), ("LEFT", left), ("RIGHT", right)):
        monkeypatch.setattr(hardnegatives, name, value)
    found = hardnegatives.hard_negatives(rows_with(spark, vectors).repartition(6))
    expected = plain(vectors)
    assert len(expected) > 100 and sorted(rows_of(found)) == sorted(expected)


def test_keys_sort_as_the_order_asks():
    pairs = [(5, 1, 9, 1, 4, 0), (5, 1, 9, 0, 7, 0), (5, 1, -3, 0, 1, 0), (-5, 9, 0, 1, -2, 3), (-5, 9, 0, 1, 2, 0), (5, 1, 9, 1, -4, 0)]
    assert sorted(pairs, key=lambda pair: hardnegatives.packed(*pair)) == sorted(pairs, key=lambda pair: (*pair[:2], -pair[2], *pair[3:]))


def test_the_stream_takes_any_rows_that_hold_the_wanted_ones():
    keys = [(0, 0, score, negative, id, 0) for id, (score, negative) in enumerate([(90, 1), (100, 0), (100, 1), (80, 1), (79, 1), (50, 0), (40, 1), (39, 1)])]
    found = list(hardnegatives.mined((key, None) for key in sorted(hardnegatives.packed(*each) for each in keys)))
    assert found == [(0, 1, 1, 2, 100, 100), (0, 1, 2, 0, 100, 90), (0, 1, 3, 3, 100, 80), (0, 5, 1, 6, 50, 40)]


def test_empty_and_huge(spark):
    assert hardnegatives.hard_negatives(rows_with(spark, []).filter("vec_id = 1")).count() == 0
    rows = [(100, [1e300, 1.0], 1), (101, [1e300, 1.0], 1), (102, [1e299, 1.0], 2), (200, None, 1)]
    assert [row[:4] for row in rows_of(hardnegatives.hard_negatives(rows_with(spark, rows)))] == [(100, 101, 1, 102)]
