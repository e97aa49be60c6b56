import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import held_out, lower, rows_of

from tritempo.llm import lmscore
from tritempo.llm.trie import Bits, EliasFano, Trie, build, probability_of, quantised

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("count, top", [(1, 1), (5, 100), (1000, 10**6), (3000, 3200), (2, 1 << 40)])
def test_elias_fano_finds_successors(count, top):
    rng = np.random.default_rng(count)
    values = np.unique(rng.integers(0, top, count))
    header, low, high, before = EliasFano.encode(values)
    sequence = EliasFano(int(header[0]), int(header[1]), low, Bits(high, before))
    assert (sequence.get(np.arange(len(values))) == values).all()
    asked = np.concatenate([rng.integers(0, top + 9, 500), values])
    at, equal = sequence.successor(asked)
    assert (at == np.searchsorted(values, asked)).all() and (equal == np.isin(asked, values)).all()


def test_trie_from_a_file_and_from_memory(tmp_path):
    rng = np.random.default_rng(1)
    grams, counts = np.unique(rng.integers(1, 30, (4000, 3)), axis=0, return_counts=True)
    grams[:, 2] -= 1
    grams, at = np.unique(grams, axis=0, return_index=True)
    counts = counts[at]
    buffer = build(*grams.T, counts, {}, {}, (30.0, 2.0))
    buffer.tofile(tmp_path / "trie")
    pairs, words = Counter(), Counter()
    for (u, v, _), n in zip(grams.tolist(), counts.tolist(), strict=True):
        pairs[u, v] += n
        words[u] += n
    asked = rng.integers(1, 32, (3000, 3))
    triples = {tuple(gram): n for gram, n in zip(grams.tolist(), counts.tolist(), strict=True)}
    for trie in (Trie.mapped(buffer), Trie.open(str(tmp_path / "trie"))):
        two, three = trie.look(*asked.T)
        for (u, v, w), a, b in zip(asked.tolist(), two, three, strict=True):
            expected = pairs[u, v] / (words[u] + 30) if pairs[u, v] else 0
            deeper = triples.get((u, v, w), 0) / (pairs[u, v] + 2)
            for code, value in ((a, expected), (b, deeper)):
                assert (code == 0) == (value == 0) and (not value or abs(math.log10(probability_of(code)) - math.log10(value)) < 0.018)


def test_codes():
    assert probability_of(quantised(np.array([1.0]))) == 1.0 and quantised(np.array([1e-20])) == 1


def by_brute_force(rows):
    tokens = [WORD.findall(lower(row.text or "")) + [None] for row in rows]
    ones, twos, threes = Counter(), Counter(), Counter()
    for row, own in zip(rows, tokens, strict=True):
        if row.doc_id is None or not held_out(row.doc_id, 10, 0):
            ones.update(own)
            twos.update(zip(own, own[1:], strict=False))
            threes.update(zip(own, own[1:], own[2:], strict=False))
    total, size = sum(ones.values()), len(ones)
    two_strength, three_strength = lmscore.STRENGTH
    for row, own in zip(rows, tokens, strict=True):
        base = score = 0.0
        for at, token in enumerate(own):
            p = (ones[token] + 0.1) / (total + 0.1 * (size + 1))
            base += math.log10(p)
            if at:
                p = (twos[own[at - 1], token] + two_strength * p) / (ones[own[at - 1]] + two_strength)
            if at > 1:
                p = (threes[own[at - 2], own[at - 1], token] + three_strength * p) / (twos[own[at - 2], own[at - 1]] + three_strength)
            score += math.log10(p)
        yield row.doc_id, len(own), sum(ones[token] > 0 for token in own), total, base, score


def agree(found, expected):
    found, expected = sorted(found, key=str), sorted(expected, key=str)
    assert len(found) == len(expected)
    for (key, n, known, total, base, score), wanted in zip(found, expected, strict=True):
        assert (key, n, known, total) == wanted[:4]
        assert math.isclose(base, wanted[4], rel_tol=1e-9, abs_tol=1e-9) and abs(score - wanted[5]) <= 0.02 * n


def columns(frame):
    return rows_of(frame.select("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"))


def test_given_documents(documents):
    found = lmscore.lm_scores(documents)
    agree(columns(found), by_brute_force(documents.collect()))
    assert all(row.held_out == held_out(row.doc_id, 10, 0) for row in found.select("doc_id", "held_out").collect())


def test_odd_rows_and_words_that_are_dealt_out(odd, nothing):
    agree(columns(lmscore.lm_scores(odd)), by_brute_force(odd.collect()))
    assert lmscore.lm_scores(nothing).count() == 0
