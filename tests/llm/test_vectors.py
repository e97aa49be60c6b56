import numpy as np
from helpers import rows_of
from pyspark.sql import functions as F

from tritempo.llm import vectors
from tritempo.llm.common import Scratch


def by_brute_force(rows):
    usable = {}
    for at, row in enumerate(rows):
        own = row[1]
        if own is not None and len(own) and all(x is not None and np.isfinite(x) for x in own) and any(own):
            x = np.array(own, np.float64)
            usable[at] = x / np.linalg.norm(x)
    links = {at: [b for b in usable if b != at and len(usable[b]) == len(usable[at]) and usable[at] @ usable[b] >= 0.9] if at in usable else [] for at in range(len(rows))}
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[at], *(label[b] for b in links[at])]) for at in range(len(rows))]
    groups = {}
    for at, row in enumerate(rows):
        if row[0] is not None:
            groups[label[at]] = min(row[0], groups.get(label[at], row[0]))
    return sorted(((row[0], len(links[at]), groups.get(label[at]), row[0] == groups.get(label[at])) for at, row in enumerate(rows)), key=str)


SCHEMA = "vec_id long, embedding array<float>, node long, key string, digest string, sim double"


def test_cliques_pairs_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = []
    for size in (60, 25, *[2] * 15, *[1] * 120):
        centre = rng.standard_normal(24)
        for _ in range(size):
            rows.append((centre + rng.standard_normal(24) * 0.12 * np.linalg.norm(centre) / 24**0.5 * 1.5).astype(np.float32).tolist())
    rows += rows[:7]
    rng.shuffle(rows)
    full = [(key, row, 1, "x", "y", 0.5) for key, row in enumerate(rows)]
    found = sorted(rows_of(vectors.near_vectors(spark.createDataFrame(full, SCHEMA))), key=str)
    assert found == by_brute_force(full)
    assert max(row[1] for row in found) > vectors.LIST


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
        (8, [1.0, 0.0, 0.0]), (9, [2.0, 0.1]), (None, None), (10, [-0.0, 3.0]), (11, [1e-30, 0.0]), (12, [-1.0, 0.0]),
    ]
    full = [(*row, 1, None, "y", None) for row in rows]
    frame = spark.createDataFrame(full, SCHEMA)
    found = {row.vec_id: row for row in vectors.near_vectors(frame.filter("vec_id is not null")).collect()}
    expected = by_brute_force([row for row in full if row[0] is not None])
    assert sorted(rows_of(vectors.near_vectors(frame.filter("vec_id is not null"))), key=str) == expected
    assert found[9].component_id == 1 and found[4].n_links == 0 and found[12].component_id == 12
    last = [row for row in rows_of(vectors.near_vectors(frame)) if row[0] is None]
    assert last == [(None, 0, None, True)]
    assert vectors.near_vectors(frame.filter("vec_id = -1")).count() == 0


def test_tables_follow_the_bits():
    same = 1 - np.arccos(0.9) / np.pi
    for count in (10, 10_256, 51_282, 3_000_000, 10**9):
        bits = vectors.bits_of(count)
        assert 1 - (1 - same**bits) ** vectors.tables_of(bits) >= vectors.MET


def nodes_of(spark, rows):
    read = vectors.read_vectors(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>"), key="vec_id", vector="embedding")
    return read.withColumnRenamed("key", "node").withColumn("copies", F.lit(1)).cache()


NO_GROUPS = "node long, component long"


def test_isolated_pairs_at_the_threshold_meet_in_the_tables(spark):
    rng, rows = np.random.default_rng(8), []
    for _ in range(1500):
        one, two = rng.standard_normal((2, 32))
        one /= np.linalg.norm(one)
        two -= two @ one * one
        rows += [one.tolist(), (0.91 * one + (1 - 0.91**2) ** 0.5 * two / np.linalg.norm(two)).tolist()]
    alone = spark.createDataFrame([], NO_GROUPS)
    tables = vectors.tables_of(vectors.bits_of(51_282))
    found = vectors.between_groups(Scratch(spark, "test"), nodes_of(spark, rows), alone, 51_282, 11, tables, "turn")
    assert found.filter("a % 2 = 0 and b = a + 1").count() >= 0.995 * 1500 and found.filter("a >= b").count() == 0


def test_of_two_groups_one_link_is_found_and_large_buckets_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(vectors, "WIDE", 5)
    rng = np.random.default_rng(9)
    centre, off = rng.standard_normal((2, 16))
    off -= off @ centre / (centre @ centre) * centre
    far = centre * 0.8 + off / np.linalg.norm(off) * np.linalg.norm(centre) * 0.6  # cosine 0.8
    rows = [(centre + rng.standard_normal(16) * 0.01).tolist() for _ in range(40)] + [(far + rng.standard_normal(16) * 0.01).tolist() for _ in range(40)]
    between = (centre + far) / 2
    rows += [(between + rng.standard_normal(16) * 0.001).tolist() for _ in range(3)]
    grouped = spark.createDataFrame([(node, 0 if node < 40 else 40) for node in range(80)], NO_GROUPS)
    found = rows_of(vectors.between_groups(Scratch(spark, "test"), nodes_of(spark, rows), grouped, 83, 11, 12, "turn"))
    reached = {(min(a, 79) // 40 * 40 if a < 80 else a, b // 40 * 40 if b < 80 else b) for a, b in found}
    assert {(0, 80), (40, 80), (0, 81), (40, 82), (80, 81)} <= reached and (0, 40) not in reached


def test_links_of_groups_of_any_size_are_counted(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = [(x + rng.standard_normal(8) * 0.3).tolist() for x in np.repeat(rng.standard_normal((4, 8)), (3, 9, 40, 30), 0)]
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    copies = rng.integers(1, 4, len(rows))
    grouped = spark.createDataFrame([(node, int(place)) for node, place in enumerate(np.repeat([0, 3, 12, 52], (3, 9, 40, 30)))], NO_GROUPS)
    links = unit @ unit.T >= 0.9
    links &= np.equal.outer(np.repeat(range(4), (3, 9, 40, 30)), np.repeat(range(4), (3, 9, 40, 30)))
    np.fill_diagonal(links, False)
    counted = nodes_of(spark, rows).drop("copies").join(spark.createDataFrame([(n, int(c)) for n, c in enumerate(copies)], "node long, copies long"), "node")
    for small, tile, product in ((64, 1000, 512), (2, 7, 3), (10, 1, 512)):
        for name, value in (("SMALL", small), ("TILE", tile), ("PRODUCT", product)):
            monkeypatch.setattr(vectors, name, value)
        found = {row.node: row.others for row in vectors.link_counts(counted, grouped).collect()}
        assert [found[node] for node in range(len(rows))] == (links @ copies).tolist()


def test_the_audit_sees_lost_pairs_beside_a_large_group(spark):
    rng = np.random.default_rng(10)
    centre = rng.standard_normal(32)
    rows = [(centre + rng.standard_normal(32) * 0.05).tolist() for _ in range(100)]
    for _ in range(30):
        one = rng.standard_normal(32)
        rows += [one.tolist(), (one + rng.standard_normal(32) * 0.05).tolist()]
    nodes = nodes_of(spark, rows)
    group = spark.createDataFrame([(node, 0) for node in range(100)], NO_GROUPS)
    assert vectors.audit(nodes, group) == (0, 1, 60)
    pairs = spark.createDataFrame([(node, node // 2 * 2) for node in range(100, 160)], NO_GROUPS)
    assert vectors.audit(nodes, group.union(pairs)) == (1, 1, 60)


def test_all_vectors_are_compared_if_the_search_misses_the_target(spark, monkeypatch):
    rng, rows = np.random.default_rng(11), []
    for _ in range(20):
        one = rng.standard_normal(8)
        rows += [one.tolist(), (one + rng.standard_normal(8) * 0.05).tolist()]
    full = [(key, row, 1, "x", "y", 0.5) for key, row in enumerate(rows)]
    monkeypatch.setattr(vectors, "EXTENSIONS", 0)
    monkeypatch.setattr(vectors, "BLOCK", 15)
    nothing = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(vectors, "exact_edges", lambda nodes, lists: nothing)
    monkeypatch.setattr(vectors, "between_groups", lambda *arguments: nothing)
    assert sorted(rows_of(vectors.near_vectors(spark.createDataFrame(full, SCHEMA))), key=str) == by_brute_force(full)
