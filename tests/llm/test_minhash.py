import random
import re
from itertools import combinations

from helpers import lower, rows_of

import corpus_pipeline
from tritempo.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_brute_force(rows):
    sets = []
    for row in rows:
        words = WORD.findall(lower(row.text or ""))
        sets.append(frozenset(tuple(words[at : at + 3]) for at in range(max(1, len(words) - 2))) if words else frozenset())
    component = list(range(len(rows)))

    def root(at):
        while component[at] != at:
            at = component[at]
        return at

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and None not in (rows[a].doc_id, rows[b].doc_id):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                component[root(b)] = root(a)
    smallest = {}
    for at, row in enumerate(rows):
        if row.doc_id is not None:
            smallest[root(at)] = min(row.doc_id, smallest.get(root(at), row.doc_id))
    result = []
    for at, row in enumerate(rows):
        own = None if row.doc_id is None else smallest[root(at)]
        result.append((row.doc_id, len(sets[at]), own, row.doc_id == own))
    return sorted(result, key=str)


def test_given_documents(documents):
    assert sorted(rows_of(minhash.near_duplicates(documents)), key=str) == by_brute_force(documents.collect())


def test_odd_rows(odd, nothing):
    assert sorted(rows_of(minhash.near_duplicates(odd)), key=str) == by_brute_force(odd.collect())
    assert minhash.near_duplicates(nothing).count() == 0
    kept = minhash.first_of_groups(odd)
    assert kept.columns == odd.columns
    assert sorted(row.doc_id for row in kept.collect() if row.doc_id) == [1, 1, 2, 3, 4, 5, 6, 8]


def test_near_copies_that_link_in_chains_and_in_tiles(spark, monkeypatch):
    """Near copies of a few texts around the threshold, in tiles of a few members."""
    monkeypatch.setattr(minhash, "TILE", 7)
    chosen, rows = random.Random(5), []
    for group in range(4):
        words = [f"w{group}x{place}" for place in range(100)]
        for copy in range(25):
            own = list(words)
            for place in chosen.sample(range(100), chosen.randrange(5)):
                own[place] = f"c{copy}p{place}"
            rows.append((len(rows), " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(rows_of(minhash.near_duplicates(frame)), key=str)
    assert found == by_brute_force(frame.collect())
    assert 4 < len({row[2] for row in found}) < 100


def test_estimates_count_bits(spark):
    rows = spark.createDataFrame([([-1] * 8, [0] * 8), ([-1] * 8, [-1] * 8), ([0] * 8, [1] + [0] * 7)], "a array<long>, b array<long>")
    none, all_, one = (row[0] for row in rows.select(minhash.estimate("a", "b")).collect())
    assert none < 0 and all_ == 1 and abs(one - (1 - 1 / 128 / (1 - 2**-4))) < 1e-12


def test_rules_follow_the_threshold():
    rule = minhash.Rule()
    assert (rule.size, rule.percent, rule.rows, rule.bands, rule.least_estimate) == (3, 85, 5, 25, 0.70)
    for percent in range(11, 101):
        rule = minhash.Rule(5, percent)
        assert rule.rows * rule.bands <= minhash.PERMUTATIONS and rule.least_estimate <= percent / 100
        assert rule.rows == 1 or (1 - (percent / 100) ** rule.rows) ** rule.bands < minhash.MISSED


def test_the_pipeline_takes_five_words_and_eighty_percent(spark, sf):
    base = [f"w{at}" for at in range(300)]
    more = [*base, *(f"x{at}" for at in range(62))]  # 296 of 358 shingles of five words are shared
    other = [f"v{at}" for at in range(300)]
    changed = [f"c{at}" if at % 37 == 18 else word for at, word in enumerate(other)]  # 8 words: 256 of 336
    rows = [(1, " ".join(base)), (2, " ".join(more)), (3, " ".join(other)), (4, " ".join(changed))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(row.doc_id for row in corpus_pipeline.minhash_dedup(spark, frame, sf).collect()) == [1, 3, 4]
    assert sorted(row.doc_id for row in minhash.first_of_groups(frame).collect()) == [1, 2, 3]
