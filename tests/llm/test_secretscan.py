import re

from helpers import document, rows_of
from pyspark.ml.functions import array_to_vector

from tritempo.llm import secretscan as scan


def test_dictionary_coverage_and_transitions():
    known = scan.Dictionary(["table", "chair", "able"], {">0,1": 50})
    assert known.covered("tablechair") == 1.0 and known.covered("xxable") == 4 / 6 and known.covered("") == 0.0
    assert known.log[0, 1] > known.log[0, 2]


def test_candidates_are_runs_within_a_text(spark):
    rows = [(1, 'a token = "0123456789abcdef0123" here', "p"), (2, "abcdefgh", "p"), (3, "ijklmnopqrstuvwx", None), (4, None, "p"), (5, "é0123456789ABCDEFé", "")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = scan.candidates(documents, scan.Dictionary([], {})).select("key", "start", "value", "before", "after").collect()
    assert sorted(map(tuple, found)) == [
        (1, 11, "0123456789abcdef0123", 'a token = "', '" here'), (3, 0, "ijklmnopqrstuvwx", "", ""), (5, 2, "0123456789ABCDEF", "é", "é"),
    ]


def test_secrets_are_told_from_long_words(spark):
    words = ["internationalization", "characteristically", "straightforwardness", "incomprehensibility"]
    rows = [(key, f"{words[key % 4]}{'ing' * (key % 3)} and so on", "en", "docs") for key in range(60)]
    secrets = [f"{key * 7919 + 104729:x}{key * 15485863 + 32452843:x}9f8e7d6c5b" for key in range(40)]
    rows += [(100 + key, f'set token = "{value}" now', "en", "docs") for key, value in enumerate(secrets)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = scan.secret_findings(frame).collect()
    assert {row.value for row in found if row.is_secret} == {value for value in secrets if len(value) >= scan.LEAST}
    assert all(not row.is_secret for row in found if row.doc_id < 100)
    own = scan.planted_findings(frame, scan.Dictionary([], {}))
    assert scan.secret_findings(frame, own.filter("label = 0")).filter("is_secret").count() == 0


def test_the_forest_tells_planted_findings_it_has_not_seen(spark, sf, documents):
    dictionary = scan.Dictionary([row.word for row in scan.corpus_counts(documents).filter("n > 20 and word not like '>%'").collect()], {})
    learned, other = (scan.planted_findings(documents, dictionary, seed=seed) for seed in (1, 2))
    forest = scan.train_forest(learned.cache())
    shown = forest.transform(other.withColumn("features", array_to_vector("x"))).select("label", "prediction").collect()
    assert len(shown) > 1000
    right = sum(row.label == row.prediction == 1 for row in shown)
    precision, recall = right / sum(row.prediction for row in shown), right / sum(row.label for row in shown)
    assert precision > 0.9 and recall > 0.9


def test_planting_follows_from_the_text(spark, documents):
    first, again = (scan.planted_findings(each, scan.Dictionary([], {})).collect() for each in (documents, documents.repartition(5)))
    assert set(map(str, first)) == set(map(str, again)) and {row.label for row in first} == {0.0, 1.0}


def test_findings_equal_a_plain_scan(spark, documents):
    """Brute force: the runs and assigned values of every text, by regular expressions over characters."""
    run = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
    names = "|".join(scan.NAMES)
    assigned = re.compile(rf"""(?:(?:{names})["'`]?[ \t]+|[=:]>?[ \t]*)(?=("[^"\n]{{8,}}"|'[^'\n]{{8,}}'|`[^`\n]{{8,}}`|[^\s"'`]{{8,}}))""", re.I)
    expected = set()
    for row in documents.collect():
        spans = {match.span() for match in run.finditer(row.text or "")}
        for match in assigned.finditer(row.text or ""):
            quoted = match[1][0] in "\"'`"
            spans.add((match.start(1) + quoted, match.end(1) - quoted))
        expected |= {(row.doc_id, len(row.text[:a].encode()), row.text[a:b]) for a, b in spans if row.text[a:b].isascii()}
    found = {(row.doc_id, row.start, row.value) for row in scan.secret_findings(documents).collect()}
    assert {each for each in found if each[2].isascii()} == expected


def test_odd_rows(spark, odd, nothing):
    one = spark.createDataFrame([document(9, "x" * 100_000 + ' key: "A1b2C3d4E5f6G7h8J9k0"')], odd.schema)
    found = rows_of(scan.secret_findings(odd.union(one)))
    assert [row[:3] for row in found if row[0] == 9] == [(9, 0, 100_000), (9, 100_007, 20)]
    assert scan.secret_findings(nothing).count() == 0


def test_short_values_and_those_with_punctuation_are_candidates(spark):
    rows = [
        (1, 'password = "Tr0ub4dor&3"', "p"), (2, "pwd=hunter2!x next", "p"), (3, "Bearer a1$b2%c3", "p"), (4, "a plain Tr0ub4dor&3 here", "p"),
        (5, "secret: 'pâss wörd9'", "p"), (6, "key=abcdefg", "p"),
    ]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {(row.doc_id, row.value) for row in scan.secret_findings(documents).collect()}
    assert found == {(1, "Tr0ub4dor&3"), (2, "hunter2!x"), (3, "a1$b2%c3"), (5, "pâss wörd9")}
    # the forest tells them from an assigned word
    many = [(key, f'set password = "Tr{key * 7919 % 997}b4d&x{key}"', "p") for key in range(60)]
    many += [(100 + key, "note: characteristically so", "p") for key in range(60)]
    result = scan.secret_findings(spark.createDataFrame(many, "doc_id long, text string, source string")).collect()
    assert {row.doc_id for row in result if row.is_secret} == set(range(60))
