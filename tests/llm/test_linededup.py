import random

from helpers import CAT
from tritempo.llm import linededup as ld


def test_patience_aligns_unique_lines_in_order():
    assert ld.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]
    assert ld.patience([1, 2, 3], [3, 2, 1]) in ([(0, 2)], [(1, 1)], [(2, 0)])
    assert ld.patience([], [1]) == [] and ld.patience([5, 5, 5], [5, 5]) == [(0, 0), (1, 1)]
    chosen = random.Random(1)
    for _ in range(300):
        left, right = ([chosen.randrange(9) for _ in range(chosen.randrange(12))] for _ in range(2))
        found = ld.patience(left, right)
        assert all(left[a] == right[b] for a, b in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def test_blocks_need_words():
    assert ld.shared_blocks([1, 2, 3, 8], [7, 1, 2, 6, 3], [1, 2, 3, 1, 4], 5) == [1, 2]
    assert ld.shared_blocks([1, 2, 3, 8], [7, 1, 2, 6, 3], [1, 2, 3, 1, 5], 5) == [1, 2, 4]


def by_brute_force(rows, rare, least):
    """The same rules on pairs of all documents: keys differ and texts are unique here."""
    rows = sorted(rows)
    lines = {key: text.split("\n") for key, text in rows}
    holders = {}
    for key, own in lines.items():
        for line in set(own):
            if len(line.split()) >= least:
                holders.setdefault(line, []).append(key)
    result = {}
    for key, own in lines.items():
        partners = set()
        for line in set(own):
            keys = holders.get(line, [])
            partners |= set(keys if len(keys) <= rare else keys[:1])
        gone = set()
        for other in partners:
            if other < key:
                gone |= set(ld.shared_blocks(lines[other], own, [len(line.split()) for line in own], least))
        result[key] = "\n".join(line for at, line in enumerate(own) if at not in gone)
    return result


def test_against_brute_force(spark):
    chosen = random.Random(2)
    pool = [" ".join(f"w{chosen.randrange(50)}" for _ in range(chosen.randrange(1, 9))) for _ in range(60)]
    rows = [(key, "\n".join([f"only {key} here and nowhere else", *chosen.sample(pool, 8)])) for key in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {row.doc_id: row.text for row in ld.line_dedup(frame).collect()}
    assert found == by_brute_force(rows, ld.RARE, ld.MIN_WORDS)
    assert any(found[key] != text for key, text in rows)


def by_plain_rule(rows, rare, least):
    """With short lines, from the definition: which windows name pairs, and which runs of lines go."""
    lines = {key: text.split("\n") for key, text in sorted(rows)}
    words = {key: [len(line.split()) for line in own] for key, own in lines.items()}
    holders = {}
    for key, own in lines.items():
        named = set()
        for one in range(len(own)):
            ends = [end for end in range(one + 1, len(own) + 1) if sum(words[key][one:end]) >= least]
            starts = [start for start in range(one + 1) if sum(words[key][start : one + 1]) >= least]
            named |= {(one, end) for end in ends[:1]} | {(start, one + 1) for start in starts[-1:]}
        for a, b in named:
            if b - a == 1 or max(words[key][a:b]) < least:
                holders.setdefault(tuple(own[a:b]), set()).add(key)
    result = {}
    for key, own in lines.items():
        partners = set()
        for keys in holders.values():
            if key in keys:
                partners |= {other for other in (keys if len(keys) <= rare else {min(keys)}) if other < key}
        gone = set()
        for other in partners:
            runs = {tuple(lines[other][a:b]) for a in range(len(lines[other])) for b in range(a + 1, len(lines[other]) + 1)}
            for a in range(len(own)):
                for b in range(a + 1, len(own) + 1):
                    if sum(words[key][a:b]) >= least and tuple(own[a:b]) in runs:
                        gone |= set(range(a, b))
        result[key] = "\n".join(line for at, line in enumerate(own) if at not in gone)
    return result


def test_short_lines_against_the_plain_rule(spark):
    chosen = random.Random(12)
    pool = [" ".join(f"w{chosen.randrange(9)}" for _ in range(chosen.choice((1, 1, 2, 2, 3, 4, 6)))) for _ in range(25)]
    verse = [chosen.sample(pool, 5) for _ in range(4)]
    rows = [(key, "\n".join([f"only {key}", *chosen.choices(pool, k=4), *chosen.choice(verse), *chosen.choices(pool, k=3)])) for key in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {row.doc_id: row.text for row in ld.line_dedup(frame, short_lines=True).collect()}
    expected = by_plain_rule(rows, ld.RARE, ld.MIN_WORDS)
    assert found == expected and found != {row.doc_id: row.text for row in ld.line_dedup(frame).collect()}


def test_odd_rows(odd, nothing):
    found = ld.line_dedup(odd)
    assert [name for name in found.columns if name not in ("n_lines", "n_removed")] == [name for name in odd.columns if name != "n_lines"]
    texts = sorted(((row.doc_id, row.text, row.n_removed) for row in found.collect()), key=str)
    assert [row for row in texts if row[0] == 1 and row[1] == CAT] == [(1, CAT, 0)] * 2
    assert (7, "", 1) in texts  # a later copy of a whole text
    assert len(texts) == odd.count() and sum(text is None for _, text, _ in texts) == 2
    assert ld.line_dedup(nothing).count() == 0


def test_no_line_is_lost_from_the_corpus(documents):
    before = {line for row in documents.collect() for line in row.text.split("\n")}
    found = ld.line_dedup(documents).collect()
    assert {line for row in found for line in row.text.split("\n")} | {""} == before | {""}
    assert sum(row.n_removed for row in found) > 0


def test_blocks_that_repeat_or_cross_are_found():
    assert ld.shared_blocks([1, 2, 3, 4], [3, 4, 8, 1, 2], [5] * 5, 5) == [0, 1, 3, 4]
    assert ld.shared_blocks([1, 2, 9], [7, 1, 2, 6, 1, 2], [1, 3, 2, 1, 3, 2], 5) == [1, 2, 4, 5]
    assert ld.shared_blocks([1, 8, 1, 9], [7, 1, 6, 1], [1, 5, 1, 5], 5) == [1, 3]
    assert ld.shared_blocks([1, 2, 3], [3, 0, 1, 2], [2, 0, 2, 2], 5) == []
    assert ld.shared_blocks([5, 6, 7, 1], [1, 5, 6, 7, 8], [9, 3, 3, 1, 1], 5) == [0, 1, 2, 3]  # the end of a run, too
    chosen = random.Random(6)
    for _ in range(300):
        left, right = ([chosen.randrange(1, 7) for _ in range(chosen.randrange(12))] for _ in range(2))
        sizes = [item % 4 for item in right]
        plain = set()
        for a in range(len(right)):
            for b in range(a + 1, len(right) + 1):
                if sum(sizes[a:b]) >= 5 and any(left[at : at + b - a] == right[a:b] for at in range(len(left))):
                    plain |= set(range(a, b))
        assert ld.shared_blocks(left, right, sizes, 5) == sorted(plain)


def test_no_long_shared_line_stays(spark, documents):
    chosen = random.Random(7)
    pool = [" ".join(f"w{chosen.randrange(90)}" for _ in range(chosen.randrange(5, 9))) for _ in range(30)]
    rows = [(key, "\n".join([f"only {key} here", *chosen.choices(pool, k=12)])) for key in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (frame, documents.select("doc_id", "text")):
        first = {}
        for row in docs.collect():
            for line in row.text.split("\n"):
                first[line] = min(row.doc_id, first.get(line, row.doc_id))
        for row in ld.line_dedup(docs).collect():
            assert all(first[line] == row.doc_id for line in row.text.split("\n") if len(line.split()) >= ld.MIN_WORDS)


def test_passages_in_short_lines_are_found(spark):
    verse = "\n".join(f"so short is {at}" for at in range(20))
    rows = [(1, f"the one beginning of it all\n{verse}\nend"), (2, f"alone\n{verse}\nand another end of it"), (3, "so short is 3\nis not\nso short is 4")]
    # the end of a run goes, too, where more hold its beginning
    rows += [(key, f"begin {key}\nout of many\nare these here\ntail {key // 2}") for key in range(10, 18)]
    found = {row.doc_id: row.text for row in ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), short_lines=True).collect()}
    assert found[1] == rows[0][1] and found[2] == "alone\nand another end of it" and found[3] == rows[2][1]
    assert found[10] == "begin 10\nout of many\nare these here\ntail 5"
    assert [found[key] for key in range(11, 18)] == ["begin 11"] + [f"begin {key}" + (f"\ntail {key // 2}" if key % 2 == 0 else "") for key in range(12, 18)]
