import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from helpers import rows_of
from tritempo.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def texts():
    chosen = random.Random(3)
    kinds = ["aé ", "'stremvld ", "012 \n", " \t\r\n\x1c\x85\xa0x", "日本🙂 '", "!?'$ a"]
    yield from ("", " ", "  a", "a  b", "it's we'll I'd 's ''s !'s \n's", "a" * 700, "ab" * 3000, " " * 500 + "x", "\n" * 90, "don't\n'll", "x'", "'re'v")
    for _ in range(300):
        yield "".join(chosen.choice(chosen.choice(kinds)) for _ in range(chosen.randrange(40)))


def test_ids_equal_the_reference_tokenizer(encoder, reference):
    every = list(texts())
    found = encoder.encode(every)
    for text, ids in zip(every, found, strict=True):
        numbers = np.frombuffer(ids, "<u4")
        assert numbers.tolist() == reference.encode_ordinary(text), text
        assert encoder.decode(numbers) == text.encode()


def test_other_patterns_are_split_one_by_one(encoder):
    own = bpe.Encoder(encoder.ranks, r"\S+|\s+")
    reference = tiktoken.Encoding("b", pat_str=r"\S+|\s+", mergeable_ranks=encoder.ranks, special_tokens={})
    for text in ("some words  here", "", "日本 x"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_segment_tree_gives_the_leftmost_minimum():
    values = [5, 3, 9, 3, 7]
    tree = bpe.SegmentTree([value * 8 + place for place, value in enumerate(values)])
    assert divmod(tree.nodes[1], 8) == (3, 1)
    tree.set(1, bpe.NONE)
    assert divmod(tree.nodes[1], 8) == (3, 3)


def test_odd_rows(odd, nothing, reference):
    found = rows_of(bpe.bpe_digests(odd))
    expected = []
    for row in odd.collect():
        text = row.text or ""
        ids = np.array(reference.encode_ordinary(text), "<u4").tobytes()
        expected.append((row.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert bpe.bpe_digests(nothing).count() == 0
