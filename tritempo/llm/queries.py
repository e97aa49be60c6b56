"""The registered queries of this package and their SQL: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tritempo.llm.bpe import bpe_digests
from tritempo.llm.decontaminate import contamination_digests
from tritempo.llm.hardnegatives import hard_negatives
from tritempo.llm.langid import language_id
from tritempo.llm.lexicon import lexicon_digests
from tritempo.llm.linededup import line_dedup
from tritempo.llm.lmscore import lm_scores
from tritempo.llm.minhash import near_duplicates
from tritempo.llm.orchard import cluster_digests
from tritempo.llm.quality import quality_scores
from tritempo.llm.secretscan import secret_findings
from tritempo.llm.sharding import shard_digests
from tritempo.llm.vectors import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: smallest id that links (a, b), both ways, reach from each id
_REACH = """reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
    smallest AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"""

ORACLES["op3_nn_descent"] = f"""
    WITH RECURSIVE vectors AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (
        SELECT one.vec_id AS a, two.vec_id AS b FROM vectors AS one
        JOIN vectors AS two ON one.vec_id <> two.vec_id AND len(one.v) = len(two.v)
        WHERE list_cosine_similarity(one.v, two.v) >= 0.9),
    {_REACH},
    counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
           vec_id <= coalesce(low, vec_id) AS kept
    FROM embeddings LEFT JOIN smallest ON smallest.a = vec_id LEFT JOIN counted ON counted.a = vec_id"""

_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op5_decontamination"] = f"""
    WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
    windows AS (
        SELECT DISTINCT item, array_to_string(w[i : i + 12], ' ') AS win, len(w[i : i + 12]) AS n
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
    docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    found AS (
        SELECT doc_id, i, d.n, item
        FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                    FROM docs CROSS JOIN (SELECT DISTINCT n FROM windows))) AS d
        JOIN windows ON windows.win = d.win AND windows.n = d.n),
    hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
    named AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
    FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)"""

ORACLES["op10_minhash"] = rf"""
    WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS shingle
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    met AS (
        SELECT one.doc_id AS a, two.doc_id AS b, count(*) AS shared
        FROM sets AS one JOIN sets AS two ON one.shingle = two.shingle AND one.doc_id <> two.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM met JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b
        WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
    {_REACH}
    SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id,
           doc_id <= coalesce(low, doc_id) AS kept
    FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN smallest ON smallest.a = doc_id"""


def _orchard_sql(rounds: int) -> str:
    """Each round as three tables: squared distances to all centroids, the nearest one, floors of the means."""
    steps = []
    for turn in range(rounds + 1):
        steps.append(f"""
    own{turn} AS (
        SELECT vec_id, cells, arg_min(number, (distance, number)) AS number, min(distance) AS distance
        FROM (SELECT vec_id, v.cells, number, CAST(list_sum(list_transform(list_zip(v.cells, c.cells), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
              FROM vectors AS v CROSS JOIN centroids{turn} AS c)
        GROUP BY vec_id, cells),""")
        if turn < rounds:
            steps.append(f"""
    moved{turn} AS (
        SELECT number, list(CAST((total - ((total % n) + n) % n) // n AS BIGINT) ORDER BY place) AS cells
        FROM (SELECT number, place, sum(cell) AS total, count(*) AS n
              FROM (SELECT number, unnest(cells) AS cell, unnest(range(1, 65)) AS place FROM own{turn}) GROUP BY number, place)
        GROUP BY number),
    centroids{turn + 1} AS (
        SELECT number, coalesce(m.cells, c.cells) AS cells FROM centroids{turn} AS c LEFT JOIN moved{turn} AS m USING (number)),""")
    return f"""
    WITH vectors AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS cells
        FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    centroids0 AS (
        SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS number, cells
        FROM vectors QUALIFY number < 16),{"".join(steps)}
    sums AS (SELECT number, sum(distance) AS total FROM own{rounds} GROUP BY number)
    SELECT vec_id, CAST(number AS INTEGER) AS cluster, distance, CAST(total AS BIGINT) AS cluster_inertia,
           CAST((SELECT sum(total) FROM sums) AS BIGINT) AS inertia, sha256(array_to_string(c.cells, ',')) AS centroid_sha256
    FROM own{rounds} JOIN sums USING (number) JOIN centroids{rounds} AS c USING (number)"""


ORACLES["op12_orchard"] = _orchard_sql(3)

ORACLES["op13_hard_negatives"] = """
    WITH vectors AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS cells
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.cells, b.cells) AS BIGINT) AS score
        FROM vectors AS a JOIN vectors AS b ON a.vec_id <> b.vec_id AND len(a.cells) = len(b.cells) WHERE a.vec_id % 100 = 0),
    positives AS (
        SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
           other AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    QUALIFY rank <= 5"""


@query
def op1_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return line_dedup(table(spark, directory, "documents"), short_lines=True).select("doc_id", "n_lines", "n_removed", "text")


@query
def op2_quality(spark: SparkSession, directory: str) -> DataFrame:
    return quality_scores(table(spark, directory, "documents"), table(spark, directory, "labels"))


@query
def op3_nn_descent(spark: SparkSession, directory: str) -> DataFrame:
    return near_vectors(table(spark, directory, "embeddings"))


@query
def op4_secrets(spark: SparkSession, directory: str) -> DataFrame:
    return secret_findings(table(spark, directory, "documents"))


@query
def op5_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    return contamination_digests(table(spark, directory, "documents"), table(spark, directory, "benchmark"))


@query
def op6_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return bpe_digests(table(spark, directory, "documents"))


@query
def op7_sharding(spark: SparkSession, directory: str) -> DataFrame:
    return shard_digests(table(spark, directory, "documents"))


@query
def op8_lm_score(spark: SparkSession, directory: str) -> DataFrame:
    return lm_scores(table(spark, directory, "documents"))


@query
def op9_language_id(spark: SparkSession, directory: str) -> DataFrame:
    return language_id(table(spark, directory, "documents"))


@query
def op10_minhash(spark: SparkSession, directory: str) -> DataFrame:
    return near_duplicates(table(spark, directory, "documents"))


@query
def op11_lexicon_bpe(spark: SparkSession, directory: str) -> DataFrame:
    return lexicon_digests(table(spark, directory, "documents"))


@query
def op12_orchard(spark: SparkSession, directory: str) -> DataFrame:
    return cluster_digests(table(spark, directory, "embeddings"))


@query
def op13_hard_negatives(spark: SparkSession, directory: str) -> DataFrame:
    return hard_negatives(table(spark, directory, "embeddings"))
