import numpy as np
from helpers import held_out, rows_of

from tritempo.llm import quality


def test_isotonic_pools_violators():
    places, values = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.array([1.0, 1, 3, 1]))
    assert values.tolist() == [0.0, 0.25, 1.0] and places.tolist() == [1.0, 2.75, 4.0]


def test_features_approximate_a_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 3))
    kernel = quality.Kernel(np.zeros(3), np.ones(3))
    waves = kernel(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) * quality.WIDTH**2 / 2)
    assert np.abs(waves @ waves.T - exact).max() < 0.25


def test_sums_by_partition_equal_those_of_all_rows(spark):
    rng = np.random.default_rng(2)
    x, y = rng.standard_normal((50, 3)), rng.integers(0, 2, 50).astype(float)
    kernel = quality.Kernel(np.zeros(3), np.ones(3))
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(5)
    matrix, vector = quality.normal_equations(rows, kernel)
    features = kernel(x)
    assert np.allclose(matrix, features.T @ features) and np.allclose(vector, features.T @ y)


def test_held_out_accuracy(spark, sf):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    found = {row.doc_id: row for row in quality.quality_scores(documents, labels).collect()}
    assert len(found) == documents.count()
    marks = {row.doc_id: row.quality for row in labels.collect() if held_out(row.doc_id, 5, 0)}
    assert all(found[key].held_out and 0 <= found[key].score <= 1 for key in marks)
    good, bad = ([found[key].score for key, mark in marks.items() if mark == kind] for kind in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.95
    assert all(row.predicted == (row.score >= 0.3) for row in found.values())


def test_scores_equal_a_plain_fit(spark, sf, documents):
    """Brute force: one matrix of all documents, one solution, one calibration."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = {row.doc_id: row.score for row in quality.quality_scores(documents, labels).collect()}
    rows = documents.select("doc_id", "text").collect()
    texts = [(row.text or "").encode() for row in rows]
    x = np.array(quality.statistics(np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8), 0, len(texts)))
    marks = {row.doc_id: row.quality for row in labels.collect() if row.quality is not None and not held_out(row.doc_id, 5, 0)}
    kernel = quality.Kernel(x.mean(0), x.std(0))
    features = kernel(x)
    own = np.array([row.doc_id in marks for row in rows])
    y = np.array([float(marks[row.doc_id]) for row in rows if row.doc_id in marks])
    ridge = quality.RIDGE * own.sum() * np.diag([*[1 / quality.FEATURES] * quality.FEATURES, 1e-9])
    raw = features @ np.linalg.solve(features[own].T @ features[own] + ridge, features[own].T @ y)
    bins = np.floor((raw[own] + 0.5) * (quality.BINS / 2))
    points = sorted((raw[own][bins == each].mean(), y[bins == each].mean(), (bins == each).sum()) for each in np.unique(bins))
    expected = np.clip(np.interp(raw, *quality.isotonic(*np.array(points, float).T)), 0, 1)
    assert np.abs(expected - [found[row.doc_id] for row in rows]).max() < 1e-3


def test_equal_texts_get_equal_scores_wherever_they_stand(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    twice = documents.union(documents.select((documents.doc_id + 10**6).alias("doc_id"), *documents.columns[1:])).repartition(7)
    scores = {}
    for row in twice.join(quality.quality_scores(twice, labels), "doc_id").collect():
        scores.setdefault(row.text, set()).add((row.score, row.predicted))
    assert all(len(each) == 1 for each in scores.values())


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, None, 0), (5, 0, 0), (6, 1, 0), (7, 0, 0), (None, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int"
    )
    found = rows_of(quality.quality_scores(odd, labels))
    assert len(found) == odd.count() and all(0 <= score <= 1 for _, _, score, _ in found)
    assert len({row[2:] for row in found if row[0] in (2, 3)}) == 1  # a null text counts as empty
    assert quality.quality_scores(nothing, labels).count() == 0
    without = rows_of(quality.quality_scores(odd, labels.filter("doc_id = -1")))
    assert {row[2:] for row in without} == {(0.5, 1)}
