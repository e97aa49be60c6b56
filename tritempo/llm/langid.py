"""Language of texts by a bidirectional gated recurrent network over bytes.

The network reads segments of ``STEPS`` bytes in both directions and labels every position with a language. A document's
probabilities are the mean of those at its letters (ASCII letters and bytes of other characters); all of its bytes are
read. It is trained in numpy by backpropagation through time on the driver, from a bounded sample of labelled rows: at most
``PER_LANGUAGE`` documents of each language, ``SAMPLE`` in all, and ``SEGMENTS`` segments of each. Scoring runs where the
rows lie; the broadcast model has about ten thousand numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tritempo.llm.common import column_bytes, slices

HIDDEN, STEPS = 8, 64
PER_LANGUAGE, SAMPLE, SEGMENTS = 300, 20_000, 6
BATCH, ROUNDS, RATE = 256, 320, 0.02
#: text bytes that are read side by side; the arrays of a step then fit the processor's caches
READ_BYTES = 250_000
PAD = 256

LETTERS = np.zeros(257, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Direction:
    """One direction of the network: gates z, r and candidate n, each with its rows in ``table`` and ``inner``."""

    def __init__(self, table: np.ndarray, inner: np.ndarray, bias: np.ndarray) -> None:
        self.table, self.inner, self.bias = table, inner, bias

    def run(self, symbols: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States after every step, (steps, hidden, columns), and what backpropagation needs."""
        hidden = self.inner.shape[1]
        state = np.zeros((hidden, symbols.shape[1]), np.float32)
        states = np.empty((len(symbols), *state.shape), np.float32)
        kept = []
        for step, column in enumerate(symbols):
            given, own = self.table[:, column], self.inner @ state
            gates = _sigmoid(given[: 2 * hidden] + own[: 2 * hidden])
            update, reset = gates[:hidden], gates[hidden:]
            linear = own[2 * hidden :] + self.bias
            candidate = np.tanh(given[2 * hidden :] + reset * linear)
            if keep:
                kept.append((state, update, reset, linear, candidate))
            state = candidate + update * (state - candidate)
            states[step] = state
        return states, kept

    def back(self, symbols: np.ndarray, kept: list, above: np.ndarray) -> list[np.ndarray]:
        """Gradients of table, inner and bias from those of the states."""
        d_inner, d_bias = np.zeros_like(self.inner), np.zeros_like(self.bias)
        d_given = np.empty((len(symbols), *self.table.shape[:1], symbols.shape[1]), np.float32)
        carried = np.zeros_like(above[0])
        for step in range(len(symbols) - 1, -1, -1):
            state, update, reset, linear, candidate = kept[step]
            slope = above[step] + carried
            to_candidate = slope * (1 - update) * (1 - candidate**2)
            to_update = slope * (state - candidate) * update * (1 - update)
            to_reset = to_candidate * linear * reset * (1 - reset)
            to_linear = to_candidate * reset
            own = np.concatenate([to_update, to_reset, to_linear])
            d_inner += own @ state.T
            d_bias += to_linear.sum(1, keepdims=True)
            carried = slope * update + self.inner.T @ own
            d_given[step] = np.concatenate([to_update, to_reset, to_candidate])
        flat = symbols.ravel()
        d_table = np.stack([np.bincount(flat, d_given[:, row].ravel(), self.table.shape[1]) for row in range(len(self.table))])
        return [d_table.astype(np.float32), d_inner, d_bias]


@dataclass
class Model:
    languages: list[str]
    #: forward table, inner, bias; the same backward; output weights, output bias
    weights: list[np.ndarray]

    def probabilities(self, symbols: np.ndarray) -> np.ndarray:
        """(steps, languages, columns) for segments in columns."""
        ahead, _ = Direction(*self.weights[:3]).run(symbols)
        behind, _ = Direction(*self.weights[3:6]).run(symbols[::-1])
        out, bias = self.weights[6:]
        half = out.shape[1] // 2
        scores = out[:, :half] @ ahead + out[:, half:] @ behind[::-1] + bias
        scores = np.exp(scores - scores.max(1, keepdims=True))
        return scores / scores.sum(1, keepdims=True)


def segments(offsets: np.ndarray, data: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut into segments, one per column, filled up with PAD; and how many columns each text has."""
    lengths = np.diff(offsets[start : stop + 1])
    columns = -(-lengths // STEPS)
    filled = np.full(int(columns.sum()) * STEPS, PAD, np.int16)
    at = np.cumsum(columns) - columns
    for first, row, length in zip((at * STEPS).tolist(), range(start, stop), lengths.tolist(), strict=True):
        filled[first : first + length] = data[offsets[row] : offsets[row + 1]]
    return np.ascontiguousarray(filled.reshape(-1, STEPS).T), columns


def train(samples: list[tuple[str, str]], *, rounds: int = ROUNDS, seed: int = 7) -> Model:
    """Fits the network to (text, language) samples; languages have equal weight. Without text there is nothing to know."""
    samples = [(text, language) for text, language in samples if text]
    if not samples:
        return Model([], [])
    languages = sorted({language for _, language in samples})
    raw = [text.encode() for text, _ in samples]
    offsets = np.cumsum([0, *map(len, raw)])
    symbols, columns = segments(offsets, np.frombuffer(b"".join(raw), np.uint8), 0, len(raw))
    label = np.repeat([languages.index(language) for _, language in samples], columns)
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
    zeros = lambda *shape: np.zeros(shape, np.float32)
    one_way = lambda: [draw(3 * HIDDEN, 257), draw(3 * HIDDEN, HIDDEN), zeros(HIDDEN, 1)]
    model = Model(languages, [*one_way(), *one_way(), draw(len(languages), 2 * HIDDEN), zeros(len(languages), 1)])
    share = 1 / np.bincount(label, minlength=len(languages))[label]
    share /= share.sum()
    first, second = [zeros(*w.shape) for w in model.weights], [zeros(*w.shape) for w in model.weights]
    for turn in range(1, rounds + 1 if len(languages) > 1 else 1):
        chosen = rng.choice(len(label), BATCH, p=share)
        batch, target = symbols[:, chosen], label[chosen]
        ahead, behind = Direction(*model.weights[:3]), Direction(*model.weights[3:6])
        states, kept = ahead.run(batch, True)
        back_states, back_kept = behind.run(batch[::-1], True)
        both = np.concatenate([states, back_states[::-1]], 1)
        out, bias = model.weights[6:]
        scores = out @ both + bias
        scores = np.exp(scores - scores.max(1, keepdims=True))
        slope = scores / scores.sum(1, keepdims=True)
        slope[:, target, np.arange(len(target))] -= 1
        counted = LETTERS[batch]
        slope *= counted[:, None] / max(1, counted.sum())
        d_out = np.einsum("tcb,thb->ch", slope, both)
        d_both = out.T @ slope
        gradients = [
            *ahead.back(batch, kept, d_both[:, :HIDDEN]),
            *behind.back(batch[::-1], back_kept, d_both[::-1, HIDDEN:]),
            d_out, slope.sum((0, 2))[:, None],
        ]
        norm = max(1.0, float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in gradients))))
        rate = RATE * min(1.0, 2 * (1 - turn / (rounds + 1))) * np.sqrt(1 - 0.999**turn) / (1 - 0.9**turn)
        for weight, gradient, mean, square in zip(model.weights, gradients, first, second, strict=True):
            gradient = gradient / norm
            mean += 0.1 * (gradient - mean)
            square += 0.001 * (gradient**2 - square)
            weight -= (rate * mean / (np.sqrt(square) + 1e-8)).astype(np.float32)
    return model


def held_out_of(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the key as text leaves ``part`` modulo ``parts``; false for a null key."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def labelled_sample(docs: DataFrame, learn: Column, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """Segments of a bounded, repeatable sample of labelled rows, as (text, language): the rows of each language that come first by a hash."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), learn.alias("learn"))
    rows = rows.filter("learn and key is not null and text is not null and lang is not null").withColumn("at", F.xxhash64("key", "lang"))
    languages = rows.select("lang").distinct().count()
    each = max(1, min(PER_LANGUAGE, SAMPLE // max(1, languages)))
    first = Window.partitionBy("lang").orderBy("at", "key")
    chosen = rows.select("lang", "key", "at").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= each)
    chosen = chosen.select("lang", "key").distinct()  # at most SAMPLE rows, or one for each language
    # character positions; a segment of STEPS characters has at least STEPS bytes
    begin = lambda i: (1 + F.pmod(F.xxhash64("key", i), F.greatest(F.length("text") - STEPS + 1, F.lit(1)))).cast("int")
    pieces = F.transform(F.sequence(F.lit(1), F.lit(SEGMENTS)), lambda i: F.substring("text", begin(i), F.lit(STEPS)))
    found = rows.join(F.broadcast(chosen), ["lang", "key"]).select("lang", "at", "key", F.explode(F.array_distinct(pieces)).alias("piece"))
    return [(row.piece, row.lang) for row in sorted(found.select("lang", "at", "piece").distinct().collect(), key=lambda row: (row.lang, row.at, row.piece))]


def with_language(docs: DataFrame, model: Model, *, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the columns ``lang_pred`` and ``score``, or as ``names`` calls them: ``und`` and 0 if the text is null or has no letter.

    Columns of the input that are named like the new ones are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights))
    rows = docs.drop(*names)
    at = rows.columns.index(text)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, weights = shared.value
        network = Model(languages, weights)
        for batch in batches:
            offsets, data = column_bytes(batch.column(at))
            for start, stop in slices(offsets, READ_BYTES):
                sums, counts = pooled(network, offsets, data, start, stop)
                best = sums.argmax(1) if languages else np.zeros(stop - start, int)
                found, scores = [], []
                for row in range(stop - start):
                    if languages and counts[row] and has_letter(data[offsets[start + row] : offsets[start + row + 1]]):
                        found.append(languages[best[row]])
                        scores.append(min(1.0, float(sums[row, best[row]] / counts[row])))
                    else:
                        found.append("und")
                        scores.append(0.0)
                part = batch.slice(start, stop - start)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, *names]
                )

    return rows.mapInArrow(label, T.StructType([*rows.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def pooled(network: Model, offsets: np.ndarray, data: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the probabilities at the letters of each row, and the number of those letters; long texts are read in parts."""
    symbols, columns = segments(offsets, data, start, stop)
    sums = np.zeros((symbols.shape[1], len(network.languages)))
    counts = LETTERS[symbols].sum(0)
    most = READ_BYTES // STEPS
    for at in range(0, symbols.shape[1] if network.languages else 0, most):
        part = symbols[:, at : at + most]
        sums[at : at + most] = np.einsum("tcb,tb->bc", network.probabilities(part), LETTERS[part].astype(np.float32))
    row = np.repeat(np.arange(stop - start), columns)
    total = np.stack([np.bincount(row, sums[:, each], stop - start) for each in range(sums.shape[1])], 1) if sums.shape[1] else np.zeros((stop - start, 0))
    return total, np.bincount(row, counts, stop - start)


def has_letter(raw: np.ndarray) -> bool:
    low = raw | 0x20
    return bool(((low >= 0x61) & (low <= 0x7A)).any()) or (bool((raw >= 0x80).any()) and _LETTER.search(raw.tobytes().decode()) is not None)


def learned_model(docs: DataFrame, *, parts: int = 4, part: int = 2, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """The network that learns from the labelled rows that aren't held out."""
    return train(labelled_sample(docs, ~held_out_of(F.col(key), parts, part), key=key, text=text, lang=lang))


def language_id(docs: DataFrame, *, parts: int = 4, part: int = 2, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row, by a model that learns from the labelled rows that aren't held out.

    Without labelled rows everything is ``und``. Rows with a null key are predicted but not learned from; repeated rows get
    the same prediction. Only the text is an input of a prediction.
    """
    model = learned_model(docs, parts=parts, part=part, key=key, text=text, lang=lang)
    found = with_language(docs.select(key, text), model, text=text)
    return found.select(key, held_out_of(F.col(key), parts, part).alias("held_out"), "lang_pred", "score")
