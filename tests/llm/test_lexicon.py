import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import COLUMNS, document, rows_of
from tritempo.llm import lexicon

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return lexicon.Vocabulary.read(PATH)


def coder(vocabulary, words):
    ids = lexicon.Merger(vocabulary).merge(words)
    return lexicon.Coder(vocabulary, lexicon.Transducer(lexicon.compiled(zip(words, map(tuple, ids), strict=True))))


def texts():
    chosen = random.Random(5)
    kinds = ["aé ", "'stremvld ", "012 \n", " \t\r\n\x1c\x85\xa0x", "日本🙂 '", "!?'$ a", "՘࢏\U0003d000a "]
    yield from ("", " ", "  a", "a" * 700, "ab" * 3000, " " * 500 + "x", "x<|endoftext|>y", "<|endoftext|>", "<|endoftext|", " <|endoftext|>\n\n<|endoftext|>")
    for _ in range(400):
        yield "".join("<|endoftext|>" if chosen.random() < 0.03 else chosen.choice(chosen.choice(kinds)) for _ in range(chosen.randrange(40)))


@pytest.mark.parametrize("words", [[], [b"a", b" a", b"ab", b" str", "é".encode(), b"stream", b"endoftext", b"<|", b"tremendously"]])
def test_ids_and_texts_equal_the_library(vocabulary, reference, words):
    every, own = list(texts()), coder(vocabulary, words)
    ids, cuts = own.encode(every)
    decoded = own.decode(ids, cuts)
    for place, text in enumerate(every):
        expected = reference.encode(text, add_special_tokens=False).ids
        assert ids[cuts[place] : cuts[place + 1]].tolist() == expected, text
        assert decoded[place] == reference.decode(expected, skip_special_tokens=False)


def test_ids_that_are_no_text_decode_as_the_library_does(vocabulary, reference):
    chosen, own = random.Random(1), coder(vocabulary, [])
    runs = [chosen.choices(range(50_300), k=chosen.randrange(9)) for _ in range(200)]
    cuts = np.cumsum([0, *map(len, runs)])
    found = own.decode(np.array([each for run in runs for each in run]), cuts)
    assert found == [reference.decode(run, skip_special_tokens=False) for run in runs]


def test_transducer_is_minimal_and_maps_every_word(tmp_path):
    chosen = random.Random(2)
    words = sorted({bytes(chosen.choices(b"ab", k=chosen.randrange(1, 7))) for _ in range(60)})
    ids = {word: tuple(chosen.choices(range(3), k=chosen.randrange(1, 4))) for word in words}
    (tmp_path / "file").write_bytes(lexicon.compiled(ids.items()))
    found = lexicon.Transducer.open(str(tmp_path / "file"))
    every = [bytes(chosen.choices(b"abc", k=chosen.randrange(8))) for _ in range(300)] + words
    ends = np.cumsum([len(word) for word in every])
    held, counts, out = found.walk(np.frombuffer(b"".join(every), np.uint8), ends - [len(word) for word in every], ends)
    assert held.tolist() == [word in ids for word in every]
    cuts = np.cumsum([0, *counts])
    assert [tuple(out[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)] == [ids.get(word, ()) for word in every]

    def common(prefix):
        below = [ids[word] for word in words if word.startswith(prefix)]
        size = 0
        while all(len(each) > size for each in below) and len({each[: size + 1] for each in below}) == 1:
            size += 1
        return size

    prefixes = {word[:size] for word in words for size in range(len(word) + 1)}
    rests = {frozenset((word[len(p) :], ids[word][common(p) :]) for word in words if word.startswith(p)) for p in prefixes}
    assert len(found) == len(rests)


def test_frequent_words_are_counted_over_all_rows(spark):
    docs = spark.createDataFrame([(each, "one two two" + " three" * (each % 3)) for each in range(40)] + [(50, None)], "doc_id long, text string")
    counts = {bytes(row.word): row.n for row in lexicon.word_counts(docs.repartition(5)).collect()}
    assert counts == {b"one": 40, b" two": 80, b" three": 39}
    assert sorted(lexicon.frequent_words(docs)) == [b" three", b" two", b"one"]
    assert lexicon.frequent_words(docs, 1) == [b" two"] and lexicon.frequent_words(docs, 0) == []


@pytest.mark.parametrize("words", [0, 1000])
def test_odd_rows(spark, odd, nothing, reference, words):
    more = spark.createDataFrame([document(20, "a <|endoftext|> b"), document(21, "x" * 200_000), document(22, "\U0003d000 ࢏")], COLUMNS)
    docs = odd.union(more)
    own = lexicon.lexicon_of(docs, words=words)
    found = lexicon.lexicon_decode(lexicon.lexicon_encode(docs, own), own)
    expected = [(row.doc_id, reference.encode(row.text or "", add_special_tokens=False).ids, row.text or "") for row in docs.collect()]
    assert sorted(rows_of(found), key=str) == sorted(expected, key=str)
    assert lexicon.lexicon_decode(spark.createDataFrame([(1, None), (2, [15339, -5, 10**6])], "doc_id long, ids array<int>"), own).count() == 2
    assert lexicon.lexicon_digests(nothing).count() == 0


def test_digests(documents, reference):
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = set()
    for row in documents.collect():
        ids = reference.encode(row.text or "", add_special_tokens=False).ids
        expected.add((row.doc_id, len(ids), sha(",".join(map(str, ids))), sha(row.text or "")))
    assert set(rows_of(lexicon.lexicon_digests(documents))) == expected
