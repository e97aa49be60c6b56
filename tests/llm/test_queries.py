import pytest

import __spark_entry__ as spark_entry
from tools.check_oracles import compare, connect
from tritempo.llm import queries


def test_every_operator_has_a_query():
    numbers = {int(name[2:].split("_")[0]) for name in queries.QUERIES}
    assert numbers == set(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
    assert set(queries.QUERIES) | {"pipeline"} <= set(spark_entry.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, sf, name):
    assert compare(spark, connect(sf), name, sf) == ""


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_begin_as_promised(spark, sf, name):
    promised = {
        2: "doc_id held_out score predicted", 3: "vec_id n_links component_id kept", 5: "doc_id n_words n_hit n_items items_sha256 contaminated",
        6: "doc_id n_tokens ids_sha256 decoded_sha256", 7: "doc_id size text_crc32 law shard slot grown_shard",
        8: "doc_id held_out n_tokens n_known train_tokens base_score score", 9: "doc_id held_out lang_pred score", 10: "doc_id n_shingles component_id kept", 11: "doc_id n_tokens ids_sha256 decoded_sha256",
        12: "vec_id cluster distance cluster_inertia inertia centroid_sha256",
        13: "anchor_id positive_id rank negative_id positive_score negative_score",
    }.get(int(name[2:].split("_")[0]))
    if name in ("op2_quality", "op6_bpe", "op7_sharding", "op9_language_id", "op11_lexicon_bpe", "op12_orchard", "op13_hard_negatives"):
        assert queries.QUERIES[name](spark, sf).columns == promised.split()
