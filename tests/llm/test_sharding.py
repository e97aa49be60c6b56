import zlib

from helpers import rows_of

from tritempo.llm import sharding


def check(rows, found, shards, slack):
    assert len(found) == len(rows)
    expected = sorted((row.doc_id, len((row.text or "").encode()) + 16, zlib.crc32((row.text or "").encode())) for row in rows if row.doc_id is not None)
    assert sorted(row[:3] for row in found if row[0] is not None) == expected
    held = {}
    for _, size, _, shard, slot in found:
        held.setdefault(shard, []).append((slot, size))
    assert set(held) <= set(range(shards))
    for own in held.values():
        assert sorted(slot for slot, _ in own) == list(range(len(own)))
    sizes = [sum(size for _, size in held.get(shard, [])) for shard in range(shards)]
    assert max(sizes) - min(sizes) <= slack


def test_sizes_are_even_and_copies_stay_together(spark):
    rows = [(key, f"text {key} " * (1 + key % 17)) for key in range(600)] + [(1000 + key, f"copied {key % 40} " * 9) for key in range(160)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = rows_of(sharding.balanced_shards(frame, shards=8))
    check(frame.collect(), found, 8, 400)
    homes = {}
    for key, _, _, shard, _ in found:
        if key >= 1000:
            homes.setdefault(key % 40, set()).add(shard)
    assert sum(len(shards) == 1 for shards in homes.values()) >= 36


def test_a_group_larger_than_a_shard_is_spread(spark):
    rows = [(key, "the same text everywhere") for key in range(400)] + [(500 + key, f"other {key}") for key in range(500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = rows_of(sharding.balanced_shards(frame, shards=8))
    check(frame.collect(), found, 8, 120)
    assert len({row[3] for row in found if row[0] < 500}) <= 6


def cut_links(rows, found):
    """Links between neighbours in groups of equal texts whose ends are in different shards, by brute force, and all of them."""
    shard = {row[0]: row[3] for row in found}
    groups = {}
    for row in rows:
        groups.setdefault(row.text, []).append(shard[row.doc_id])
    pairs = [(a, b) for group in groups.values() for at, a in enumerate(group) for b in group[at + 1 :]]
    return sum(a != b for a, b in pairs), len(pairs)


def test_few_links_are_cut(spark):
    rows = [(key, f"text {key} " * (1 + key % 17)) for key in range(600)] + [(1000 + key, f"copied {key % 60} " * 9) for key in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = rows_of(sharding.balanced_shards(frame, shards=8))
    cut, every = cut_links(frame.collect(), found)
    assert every == sum(n * (n - 1) // 2 for n in [7] * 40 + [6] * 20) and cut <= 0.15 * every


def test_odd_rows(odd, nothing, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 1)  # many buckets
    rows = odd.filter("doc_id is null or doc_id <> 5")
    check(rows.collect(), rows_of(sharding.balanced_shards(rows, shards=3)), 3, 10**9)
    assert sharding.shard_digests(nothing).count() == 0
    names = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sharding.shard_digests(odd).columns == names
