import public_tokenizers
import tiktoken
from helpers import rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from tritempo.llm.bpe import read_ranks
from tritempo.llm.common import Scratch
from tritempo.llm.decontaminate import contamination
from tritempo.llm.linededup import line_dedup
from tritempo.llm.minhash import near_duplicates


def test_stages_take_effect_on_what_is_left(spark, sf, documents, benchmark):
    scratch, docs = Scratch(spark, "stages"), documents
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.put(stage(spark, docs, sf), name)
        kept[name] = docs
        if name != "bpe":
            assert docs.schema.names == documents.schema.names
        if name == "line_dedup":
            texts = {row.doc_id: row.text for row in line_dedup(before).collect()}
            assert all(row.text == texts[row.doc_id] and row.n_chars == len(row.text) for row in docs.collect())
            assert {row.doc_id for row in docs.collect()} == {key for key, text in texts.items() if text.strip()}
        if name == "minhash_dedup":
            assert {row.doc_id for row in docs.collect()} == {row.doc_id for row in near_duplicates(before).collect() if row.kept}
        if name == "decontaminate":
            clean = {row.doc_id for row in contamination(before, benchmark).collect() if not row.contaminated}
            assert {row.doc_id for row in docs.collect()} == clean and docs.count() < before.count()
    # documents of the given languages are kept by the first stage
    assert kept["language_id"].count() >= 0.99 * documents.count()
    tokenizer = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={}
    )
    texts = {row.doc_id: row.text for row in kept["decontaminate"].collect()}
    assert {row.doc_id: row.n_tokens for row in docs.collect()} == {key: len(tokenizer.encode_ordinary(text)) for key, text in texts.items()}


def test_run_gives_the_last_stage(spark, sf):
    found = corpus_pipeline.run(spark, sf)
    assert found.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and found.count() > 0


def test_columns_of_the_input_keep_their_values(spark, sf, documents):
    extra = ("score", "lang_pred", "n_lines", "n_removed", "_key", "_digest", "_copy", "_deleted", "_late", "_row", "kept", "node", "digest", "SCORE_2")
    value = F.concat(F.col("doc_id").cast("string"), F.lit("x"))
    docs = documents.withColumns({name: value for name in extra})
    scratch = Scratch(spark, "extra")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf), name)
        assert docs.columns == [*documents.columns, *extra] and docs.count() > 0
        assert docs.filter(" or ".join(f"{each} is distinct from concat(doc_id, 'x')" for each in extra)).count() == 0
        before = docs.select("doc_id", "lang", "source").exceptAll(documents.select("doc_id", "lang", "source"))
        assert before.count() == 0


def test_odd_rows(spark, sf, odd, nothing):
    for docs in (odd, nothing):
        scratch = Scratch(spark, "odd")
        for name, stage in corpus_pipeline.STAGES:
            docs = scratch.put(stage(spark, docs, sf), name)
    assert rows_of(docs) == []
