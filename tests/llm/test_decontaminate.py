import hashlib
import re

from helpers import lower, rows_of
from tritempo.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def by_brute_force(documents, items):
    windows = {}
    for row in items:
        words = WORD.findall(lower(row.text or ""))
        if row.item_id is not None and words:
            for at in range(max(1, len(words) - 12)):
                windows.setdefault(tuple(words[at : at + 13]), set()).add(str(row.item_id))
    result = []
    for row in documents:
        words, hit, named = WORD.findall(lower(row.text or "")), set(), set()
        for size in {len(window) for window in windows}:
            for at in range(len(words) - size + 1):
                if found := windows.get(tuple(words[at : at + size])):
                    hit |= set(range(at, at + size))
                    named |= found
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        result.append((row.doc_id, len(words), len(hit), len(named), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(result, key=str)


def test_given_tables(documents, benchmark):
    expected = by_brute_force(documents.collect(), benchmark.collect())
    assert any(row[-1] for row in expected)
    assert sorted(rows_of(dc.contamination_digests(documents, benchmark)), key=str) == expected
    # many small blocks of phrases give the same
    assert sorted(rows_of(dc.contamination_digests(documents, benchmark, block=400)), key=str) == expected


def test_odd_rows(spark, odd, nothing, benchmark):
    items = spark.createDataFrame(
        [(1, "The CAT sat on the mat"), (1, "looked at the dog"), (2, "cat sat"), (3, None), (4, ""), (None, "the mat"), (5, "!!!"), (6, " ".join(["long words"] * 7))],
        "item_id long, text string",
    )
    expected = by_brute_force(odd.collect(), items.collect())
    assert sorted(rows_of(dc.contamination_digests(odd, items)), key=str) == expected
    assert dc.contamination_digests(nothing, items).count() == 0
    clean = rows_of(dc.contamination_digests(odd, items.filter("item_id = -1")))
    assert len(clean) == odd.count() and not any(row[2] for row in clean)
    kept = dc.without_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == sum(not row[-1] for row in expected)


def test_lists_of_items_do_not_reach_the_driver(spark, monkeypatch):
    """A third of the items are copies: what is collected has a row for each window, and no item."""
    documents = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p"), (2, "q"), (3, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(f"copy{n}", "A b c d e f g h i j k l m n") for n in range(300)] + [("one", "q")], "item_id string, text string")
    collected, collect = [], type(documents).collect
    monkeypatch.setattr(type(documents), "collect", lambda self: collected.append((self.columns, collect(self))) or collected[-1][1])
    found = {row.doc_id: row for row in dc.contamination(documents, items).collect()}
    assert len(found[1]["items"]) == 300 and found[2]["items"] == ["one"] and found[3]["items"] == []
    assert all(len(rows) <= 20 for _, rows in collected) and not any("items" in columns and "doc_id" not in columns for columns, _ in collected)


def test_phrases_do_not_cross_documents(spark):
    documents = spark.createDataFrame([(1, "one two"), (2, "three four"), (3, "zero one two three four")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "one two three four")], "item_id string, text string")
    found = {row.doc_id: row.n_hit for row in dc.contamination_digests(documents, items).collect()}
    assert found == {1: 0, 2: 0, 3: 4}


def test_proximity(spark):
    documents = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "gamma beta alpha"), (3, "alpha beta"), (4, None)], "doc_id long, text string")
    index = dc.build_index(documents)
    found = rows_of(dc.proximity_matches(index, {"abc": ["Alpha", "beta", "gamma"]}, 4))
    assert found == [(2, "abc", [0])]
    found = rows_of(dc.proximity_matches(index, {"abc": ["alpha", "beta", "gamma"], "none": ["omega"]}, 5))
    assert sorted(found) == [(1, "abc", [0]), (2, "abc", [0])]
