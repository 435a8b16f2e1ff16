"""Jaccard join: rows with a null doc_id that are near copies link with nothing."""

from tessera.llm.jaccard_join import link_components
from tests.llm.helpers import documents


def test_null_doc_id_with_near_copy(spark):
    w = [f"w{i}" for i in range(60)]
    df = documents(spark, [" ".join(w), " ".join(w[:59]), " ".join([*w, "x"]), "a b c d e f"], [7, None, 3, None])
    assert sorted(map(tuple, link_components(df).collect()), key=repr) == sorted([(7, 56, 3), (None, 55, None), (3, 57, 3), (None, 2, None)], key=repr)
