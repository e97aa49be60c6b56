"""A corpus for training: five stages over ``documents``, each an operator of ``tritempo.llm``.

Every stage takes what its predecessor kept, written as Parquet. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tritempo.llm.bpe import bpe_decode, bpe_encode
from tritempo.llm.common import Scratch, fresh
from tritempo.llm.decontaminate import without_contaminated
from tritempo.llm.langid import learned_model, with_language
from tritempo.llm.linededup import line_dedup
from tritempo.llm.minhash import first_of_groups

#: a text whose best language has a lower probability is of none of the learned languages
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or text, and those that no learned language fits.

    Where no row has a language to learn from, only texts without letters could be told apart; then nothing is rejected.
    """
    model = learned_model(docs)
    if not model.languages:
        return docs
    language, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = with_language(docs, model, names=(language, score)).filter((F.col(language) != "und") & (F.col(score) >= LEAST_SCORE))
    return found.select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the new text, and its length where lines were removed; a document that lost all its words goes."""
    n_lines, n_removed = fresh("n_lines", docs.columns), fresh("n_removed", docs.columns)
    found = line_dedup(docs, short_lines=True, counts=(n_lines, n_removed))
    changed = F.col(n_removed) > 0
    length = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.filter(~changed | F.col("text").rlike(r"\S")).withColumn("n_chars", length).select(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: 80 % of the five-word shingles in common."""
    return first_of_groups(docs, size=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the encoded corpus and the digests of its round trip."""
    decoded = bpe_decode(bpe_encode(docs))
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("minhash_dedup", minhash_dedup),
    ("decontaminate", decontaminate),
    ("bpe", encode),
]

#: the stages hold a trained network, patience diff and byte-pair merges, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
