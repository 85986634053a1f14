"""The driver contract, and a sample of registered queries against their SQL (all of them:
``python tests/check_queries.py``)."""

import pytest

from check_queries import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["ix1_postings", "rk3_bm25", "rk4_tfidf", "bo7_result", "ph1_phrase_search", "dn1_knn", "fu1_rrf", "in12_chunk_ids",
          "in14_page_ranges", "cc6_assign_citations", "ac5_access_decisions", "st1_admissions"]


def test_entry_and_keys(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    problem, _ = compare(spark, connect(SF), SF, entry.queries()[name], entry.oracle_sql()[name])
    assert problem is None, problem
