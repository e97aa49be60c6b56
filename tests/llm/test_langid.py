import re

import numpy as np

from helpers import held_out, rows_of
from tritempo.llm import langid


def test_backpropagation_matches_differences():
    rng = np.random.default_rng(0)
    table, inner, bias = rng.standard_normal((6, 257)), rng.standard_normal((6, 2)), rng.standard_normal((2, 1))
    symbols, wanted = rng.integers(0, 257, (5, 3)), rng.standard_normal((5, 2, 3))

    def loss():
        states, _ = langid.Direction(table, inner, bias).run(symbols)
        return float((states * wanted).sum())

    _, kept = langid.Direction(table, inner, bias).run(symbols, True)
    gradients = langid.Direction(table, inner, bias).back(symbols, kept, wanted)
    for weight, gradient in zip((table, inner, bias), gradients, strict=True):
        for place in (0, weight.size // 2, int(np.abs(gradient).argmax())):
            flat = weight.reshape(-1)
            saved, step = flat[place], 1e-3
            flat[place] = saved + step
            above = loss()
            flat[place] = saved - step
            below = loss()
            flat[place] = saved
            assert abs((above - below) / (2 * step) - gradient.reshape(-1)[place]) < 2e-2


def test_held_out_accuracy(documents):
    found = {row.doc_id: row for row in langid.language_id(documents).collect()}
    rows = [row for row in documents.collect() if held_out(row.doc_id, 4, 2)]
    assert all(found[row.doc_id].held_out for row in rows) and len(found) == documents.count()
    right = sum(found[row.doc_id].lang_pred == row.lang for row in rows)
    assert right >= 0.9 * len(rows)
    assert all(0 <= row.score <= 1 for row in found.values())


def test_predictions_equal_those_of_each_text_alone(documents):
    """Brute force: every text by itself, every byte of it, over the network's own probabilities."""
    model = langid.learned_model(documents)
    found = {row.doc_id: (row.lang_pred, row.score) for row in langid.language_id(documents).collect()}
    letters = re.compile(r"[^\W\d_]")
    for row in documents.orderBy("doc_id").limit(60).collect():
        raw = np.frombuffer((row.text or "").encode(), np.uint8)
        symbols, _ = langid.segments(np.array([0, len(raw)]), raw, 0, 1)
        weight = langid.LETTERS[symbols]
        mean = (model.probabilities(symbols) * weight[:, None, :]).sum((0, 2)) / max(1, weight.sum())
        if not letters.search(row.text or ""):
            assert found[row.doc_id] == ("und", 0.0)
        else:
            assert found[row.doc_id][0] == model.languages[mean.argmax()] and abs(found[row.doc_id][1] - mean.max()) < 1e-4


def test_odd_rows(odd, nothing):
    found = rows_of(langid.language_id(odd))
    assert len(found) == odd.count()
    kinds = {row.text: None for row in odd.collect()}
    by_key = {(key, held): (lang, score) for key, held, lang, score in found if key in (2, 3, 4, 6, 8)}
    assert len(kinds) and all(by_key[key, held_out(key, 4, 2)] == ("und", 0.0) for key in (2, 3, 4, 8))
    assert by_key[6, held_out(6, 4, 2)][0] != "und"
    assert langid.language_id(nothing).count() == 0
    replaced = langid.with_language(odd, langid.Model([], []))
    assert {row.lang_pred for row in replaced.collect()} == {"und"} and "key" in replaced.columns


def test_long_texts_are_read_whole():
    model = langid.train([("aaaa aaaa", "a"), ("bbbb bbbb", "b")], rounds=60)
    raw = ("a" * 1000 + "b" * 9000).encode() * 60
    sums, counts = langid.pooled(model, np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), 0, 1)
    assert counts[0] == len(raw) and sums[0].argmax() == 1 and 0.8 < sums[0, 1] / counts[0] < 0.95
