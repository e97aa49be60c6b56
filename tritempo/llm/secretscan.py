"""Secrets in documents: candidates by shape, false positives removed by a random forest.

A candidate is a run of at least ``LEAST`` letters, digits and ``+/_-=``, the characters of keys and encoded values. After
an assignment or a credential's name, a value of ``SHORT`` characters and more is one, too, whatever its characters, up to the
closing quote or white space; a run inside such a value stays a candidate of its own. Its
features are its length, its kinds of characters and the changes between them, how likely its character transitions are in
the corpus, how much of it dictionary words cover, words of its path, and the words beside it. The transitions and the
dictionary (the ``DICTIONARY`` most frequent words of up to eight letters) are counted over all documents.

The forest is Spark's own, trained from labelled findings: candidates with their features and a label. Where nobody has
labelled any, ``planted_findings`` plants them: random keys and passwords, and look-alikes that are none (joined words, placeholders,
numbers, dates, digests of files), each behind various words, into passages of the documents themselves. A label says
what was planted, so it is not read off the features, and a part of the planted findings that the forest hasn't seen tells how good it is. Findings
are few, so all steps after the scan work on small rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tritempo.llm.common import NOT_ALNUM, Scratch, column_bytes, joined_bytes, lowered, slices, words

LEAST, BESIDE = 16, 48
#: a word that occurs less often is no word of the dictionary: it may be part of a secret
COMMON = 3
DICTIONARY, SHORTEST, LONGEST = 20_000, 3, 8
TREES, DEPTH = 20, 8
#: labelled findings of one label that the forest learns from, about, chosen by hash
LABELLED = 50_000
#: planted findings, about, and the most in one document; characters of the passage on either side
PLANTED, PLANTED_IN_ONE, PASSAGE = 4000, 40, 60
#: features that hash the words of the path and the two words before a candidate
BUCKETS = 16
#: names of credentials
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "key", "credential", "credentials", "auth", "bearer")
#: bytes of a value that is assigned or follows a credential's name
SHORT = 8
_ASSIGNED = re.compile(
    rb"""(?:(?i:%s)["'`]?[ \t]+|[=:]>?[ \t]*)(?=("[^"\n]{%d,}"|'[^'\n]{%d,}'|`[^`\n]{%d,}`|[^\s"'`]{%d,}))"""
    % ("|".join(NAMES).encode(), SHORT, SHORT, SHORT, SHORT)
)

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_-="]] = True
#: kinds of characters for transitions: a-z, A-Z (as a-z), digits, anything else
_KIND = np.full(256, 27, np.int64)
_KIND[0x61:0x7B] = np.arange(26)
_KIND[0x41:0x5B] = np.arange(26)
_KIND[0x30:0x3A] = 26
KINDS = 28


def corpus_counts(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(word, n): how often words of 3 to 8 letters and digits occur, and transitions, named ``>i,j`` by kinds of characters."""
    rows = docs.select(F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(KINDS * KINDS, np.int64)
        for batch in batches:
            offsets, data = column_bytes(batch.column(0))
            for start, stop in slices(offsets):
                joined, begins = joined_bytes(offsets, data, start, stop)
                kinds = _KIND[joined]
                pairs += np.bincount(kinds[:-1] * KINDS + kinds[1:], minlength=KINDS * KINDS)
                low = lowered(joined)
                heads, tails, hashes, _ = words(low, begins, NOT_ALNUM)
                fits = (tails - heads >= SHORTEST) & (tails - heads <= LONGEST)
                heads, tails = heads[fits], tails[fits]
                _, sample, often = np.unique(hashes[fits], return_index=True, return_counts=True)
                raw = low.tobytes()
                found = [raw[a:b].decode("utf-8", "replace") for a, b in zip(heads[sample].tolist(), tails[sample].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(often)], ["word", "n"])
        some = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([f">{i // KINDS},{i % KINDS}" for i in some.tolist()], pa.string()), pa.array(pairs[some])], ["word", "n"])

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Dictionary:
    """What features need to know of the corpus: frequent words and the log probabilities of transitions."""

    def __init__(self, words_: list[str], transitions: dict[str, int]) -> None:
        self.words = frozenset(words_)
        counts = np.ones((KINDS, KINDS))
        for name, n in transitions.items():
            left, right = name[1:].split(",")
            counts[int(left), int(right)] += n
        self.log = np.log(counts / counts.sum(1, keepdims=True))

    def covered(self, value: str) -> float:
        """The largest share of the value that words of the dictionary cover without overlap."""
        low = value.lower()
        best = [0] * (len(low) + 1)
        for end in range(1, len(low) + 1):
            best[end] = best[end - 1]
            for size in range(SHORTEST, min(LONGEST, end) + 1):
                if low[end - size : end] in self.words:
                    best[end] = max(best[end], best[end - size] + size)
        return best[-1] / max(1, len(low))


def features(value: str, before: str, after: str, path: str, dictionary: Dictionary) -> list[float]:
    """The numbers that the forest sees of one candidate; all of its characters count."""
    raw = np.frombuffer(value.encode(), np.uint8)
    kinds = _KIND[raw]
    upper, digit = (raw >= 0x41) & (raw <= 0x5A), kinds == 26
    other = kinds == 27
    broad = np.where(digit, 2, np.where(other, 3, upper.astype(np.int64)))
    share = np.bincount(raw, minlength=128)
    share = share[share > 0] / len(raw)
    lead = [word for word in _split(before)][-2:]
    names = [word in NAMES for word in lead]
    hashed = [0.0] * (2 * BUCKETS)
    for word in lead:
        hashed[_bucket(word)] = 1.0
    for word in _split(path):
        hashed[BUCKETS + _bucket(word)] = 1.0
    return [
        float(len(raw)), float(digit.mean()), float(upper.mean()), float(other.mean()), float((broad[1:] != broad[:-1]).mean()),
        float(dictionary.log[kinds[:-1], kinds[1:]].mean()), dictionary.covered(value), float(-(share * np.log2(share)).sum()), float(len(share)),
        float(np.isin(raw | 0x20, np.frombuffer(b"0123456789abcdef", np.uint8)).mean()), float(any(names)),
        float(before.rstrip(" \"'`").endswith(("=", ":"))), float(before.endswith(('"', "'", "`"))), float(after.startswith(('"', "'", "`"))),
        float(after[:1] in (".", ",", " ", "\n", "")), *hashed,
    ]


def _split(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _bucket(word: str) -> int:
    number = 0
    for byte in word.encode():
        number = (number * 31 + byte) % 1_000_003
    return number % BUCKETS


def _with_assigned(raw: bytes, cuts: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges and those of assigned values in each text, without repetition."""
    found = set(zip(heads.tolist(), tails.tolist(), strict=True))
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        for match in _ASSIGNED.finditer(raw[first:last]):
            head, tail = match.span(1)
            quoted = match[1][:1] in (b'"', b"'", b"`")
            found.add((first + head + quoted, first + tail - quoted))
    ranges = np.array(sorted(found), np.int64).reshape(-1, 2)
    return ranges[:, 0], ranges[:, 1]


def candidates(docs: DataFrame, dictionary: Dictionary, *, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(key, start, value, before, after, path, x): every candidate with its first byte, what stands beside it and its features."""
    known = docs.sparkSession.sparkContext.broadcast(dictionary)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = column_bytes(batch.column("text"))
            for start, stop in slices(offsets):
                part = data[offsets[start] : offsets[stop]]
                raw = part.tobytes()
                edge = np.diff(_INSIDE[part].astype(np.int8), prepend=0, append=0)
                heads, tails = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                cuts = offsets[start : stop + 1] - offsets[start]
                # a run over the end of a text is a run in either
                inner = np.setdiff1d(cuts[1:-1], heads)
                inner = inner[_INSIDE[part[np.minimum(inner, max(len(part) - 1, 0))]]] if len(part) else inner
                crossed = inner[(inner > 0) & (inner < len(part))]
                crossed = crossed[_INSIDE[part[crossed - 1]]]
                heads, tails = np.sort(np.concatenate([heads, crossed])), np.sort(np.concatenate([tails, crossed]))
                fits = tails - heads >= LEAST
                heads, tails = _with_assigned(raw, cuts, heads[fits], tails[fits])
                row = np.searchsorted(cuts, heads, "right") - 1
                found = {name: [] for name in ("value", "before", "after", "path", "x")}
                for head, tail, at in zip(heads.tolist(), tails.tolist(), row.tolist(), strict=True):
                    value = raw[head:tail].decode()
                    before = raw[max(int(cuts[at]), head - BESIDE) : head].decode("utf-8", "ignore")
                    after = raw[tail : min(int(cuts[at + 1]), tail + BESIDE)].decode("utf-8", "ignore")
                    where = batch.column("path")[start + at].as_py()
                    for name, one in zip(found, (value, before, after, where, features(value, before, after, where, known.value)), strict=True):
                        found[name].append(one)
                keys = batch.column("key").take(pa.array(row + start))
                yield pa.RecordBatch.from_arrays([
                    keys, pa.array(heads - cuts[row]), *[pa.array(found[name], pa.string()) for name in ("value", "before", "after", "path")],
                    pa.array(found["x"], pa.list_(pa.float64())),
                ], ["key", "start", "value", "before", "after", "path", "x"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(scan, f"key {kind}, start long, value string, before string, after string, path string, x array<double>")


_ALPHABETS = {
    "hex": "0123456789abcdef", "base": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "wide": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", "typed": "ABCDEFGHJKLMNPRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789!@#$%&*?",
}
#: words before look-alikes of random characters, and before any others
_FILES = ("commit", "checksum", "digest", "sha256", "md5", "etag", "revision", "hash")
_OTHERS = ("name", "value", "id", "ref", "title", "note", "version", "date", "path", "label")
_PLACEHOLDERS = ("password", "changeme", "your_token_here", "placeholder", "undefined", "description", "xxxxxxxxxxxxxxxx", "not_available", "see documentation")


def _random(rng: np.random.Generator, kind: str, low: int, high: int) -> str:
    letters = _ALPHABETS[kind]
    return "".join(letters[at] for at in rng.integers(0, len(letters), rng.integers(low, high + 1)))


def _lead(rng: np.random.Generator, names: tuple[str, ...]) -> tuple[str, str]:
    """What stands before a value and after it."""
    name = names[rng.integers(len(names))]
    name = (name, name.upper(), f"api_{name}", f"my {name}")[rng.integers(4)]
    quote = ("", "", '"', "'")[rng.integers(4)]
    return f"{name}{(' = ', '=', ': ', ' ', ' := ')[rng.integers(5)]}{quote}", quote


def planted_value(rng: np.random.Generator, own: list[str]) -> tuple[float, str, str, str]:
    """(label, before, value, after): a secret or a look-alike; ``own`` are words of the passage."""
    word = lambda: own[rng.integers(len(own))] if own else "word"
    if rng.random() < 0.5:
        kind = ("hex", "base", "wide", "typed", "made")[rng.integers(5)]
        if kind == "made":  # a password that a person makes up
            value = word()[: rng.integers(2, 7)].capitalize() + _random(rng, "typed", 2, 6) + str(rng.integers(10_000))
            value += _random(rng, "typed", max(0, SHORT - len(value)), max(2, SHORT - len(value)))
        else:
            value = _random(rng, kind, *((SHORT, 16) if kind == "typed" else (16, 48)))
        lead, quote = _lead(rng, NAMES if kind in ("typed", "made") or rng.random() < 0.85 else _OTHERS)
        return 1.0, lead, value, quote
    kind = rng.integers(6)
    if kind == 0:
        lead, quote = _lead(rng, _FILES)
        return 0.0, lead, _random(rng, "hex", 16, 64), quote
    if kind == 1:
        value = ("", "_", "-", "/")[rng.integers(4)].join(word() for _ in range(rng.integers(2, 6)))
    elif kind == 2:
        value = "".join(word().capitalize() for _ in range(rng.integers(2, 5)))
    elif kind == 3:
        value = str(rng.integers(10**7, 10**18))
    elif kind == 4:
        value = f"{rng.integers(1990, 2040)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(24):02d}:{rng.integers(60):02d}:00"
    else:
        value = _PLACEHOLDERS[rng.integers(len(_PLACEHOLDERS))]
    if rng.random() < 0.4:
        return 0.0, "", value, ""
    lead, quote = _lead(rng, NAMES if rng.random() < 0.5 else _OTHERS)
    return 0.0, lead, value, quote


def planted_findings(docs: DataFrame, dictionary: Dictionary, *, key: str = "doc_id", text: str = "text", path: str = "source", seed: int = 1) -> DataFrame:
    """Candidates with a label, planted into passages of about ``PLANTED`` places of the documents, chosen by hash.

    Documents without text have no passages. What is planted follows from text, path and seed alone.
    """
    rows = docs.filter(F.octet_length(text) > 0).select(F.col(text).alias("text"), F.col(path).cast("string").alias("path"))
    count = max(1, rows.count())
    each = max(1, min(PLANTED_IN_ONE, PLANTED // count))
    rows = rows.filter(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, PLANTED / count)))

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {name: [] for name in ("name", "text", "path", "at", "label")}
            for whole, where in zip(batch.column("text").to_pylist(), batch.column("path").to_pylist(), strict=True):
                number = zlib.crc32(f"{where}\n{whole}".encode())
                rng = np.random.default_rng([seed, number])
                for place in range(each):
                    at = whole.find(" ", int(rng.integers(len(whole)))) + 1 or len(whole)
                    left, right = whole[max(0, at - PASSAGE) : at], whole[at : at + PASSAGE]
                    label, lead, value, after = planted_value(rng, [word for word in f"{left} {right}".split() if word.isalpha()])
                    lead = f"{left.rstrip()} {lead}"
                    for name, one in zip(found, (f"{number}-{place}", f"{lead}{value}{after} {right}", where, len(lead.encode()), label), strict=True):
                        found[name].append(one)
            yield pa.RecordBatch.from_arrays([
                *(pa.array(found[name], pa.string()) for name in ("name", "text", "path")), pa.array(found["at"], pa.int64()), pa.array(found["label"], pa.float64()),
            ], ["name", "text", "path", "at", "label"])

    scratch = Scratch(docs.sparkSession, "planted")
    planted = scratch.put(rows.mapInArrow(plant, "name string, text string, path string, at long, label double").dropDuplicates(["name"]), "texts")
    found = candidates(planted, dictionary, key="name", text="text", path="path")
    own = planted.select(F.col("name").alias("key"), F.col("at").alias("start"), "label")
    return found.join(own, ["key", "start"])


def train_forest(labelled: DataFrame):
    """Spark's random forest on (x, label); a number if there is but one label, None if there is none.

    Of a label with more findings than ``LABELLED`` a hash keeps about so many.
    """
    counts = {row.label: row["count"] for row in labelled.filter("label in (0, 1)").groupBy("label").count().collect()}
    if len(counts) < 2:
        return next((float(label) for label in counts), None)
    share = F.when(F.col("label") == 1, LABELLED / counts[1.0]).otherwise(LABELLED / counts[0.0])
    chosen = labelled.filter("label in (0, 1)").filter(F.pmod(F.xxhash64("value", "before", "after"), F.lit(1_000_000)) < share * 1_000_000)
    rows = chosen.select(array_to_vector("x").alias("features"), "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=3, minInstancesPerNode=2, featureSubsetStrategy="sqrt")
    return forest.fit(rows)


def secret_findings(docs: DataFrame, labelled: DataFrame | None = None, *, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(key, start, length, value, score, is_secret): every candidate; ``start`` and ``length`` count bytes of the text.

    ``labelled``: findings with features and a label, as ``planted_findings`` returns them; by default its own. Null and empty
    texts have no candidates; a null path is an empty one. Rows with a null or repeated key are scanned like others. Without
    labelled findings every score is 0.5 and nothing is taken for a secret; with one label only, that is the score.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    counted = scratch.put(corpus_counts(docs, text=text), "counts")
    transitions = {row.word: row.n for row in counted.filter(F.col("word").startswith(">")).collect()}  # at most KINDS * KINDS
    frequent = counted.filter(~F.col("word").startswith(">") & (F.col("n") >= COMMON)).orderBy(F.desc("n"), "word").limit(DICTIONARY).select("word").collect()
    scratch.drop("counts")
    dictionary = Dictionary([row.word for row in frequent], transitions)
    found = scratch.put(candidates(docs, dictionary, key=key, text=text, path=path), "findings")
    if labelled is None:
        labelled = scratch.put(planted_findings(docs, dictionary, key=key, text=text, path=path), "labelled")
    forest = train_forest(labelled)
    if forest is None or isinstance(forest, float):
        scored = found.withColumn("score", F.lit(0.5 if forest is None else forest))
    else:
        scored = forest.transform(found.withColumn("features", array_to_vector("x"))).withColumn("score", vector_to_array("probability")[1])
    return scored.select(
        F.col("key").alias(key), "start", F.octet_length("value").cast("long").alias("length"), "value", "score", (F.col("score") > 0.5).alias("is_secret")
    )
