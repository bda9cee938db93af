"""Registered queries against their SQL on the smallest tables."""

import os

import pytest
from conftest import DATA

import __spark_entry__ as entry
from tarnfold.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
#: The driver compares all; here one of each kind, to keep the tests short.
SOME = (
    "knn_exact_topk", "knn_per_label_cap", "knn_eval_metrics", "int8_topk", "mmr_topk", "bm25_topk", "grep_topk", "random_topk", "fuse_weighted", "retriever_comparison", "search_filtered", "search_oracle_language",
    "filter_comparison", "rerank_enriched_topk", "context_cost", "chunk_ids", "chunk_all", "parse_symbols", "context_expand", "strategy_comparison", "label_grades", "sync_actions", "citation_check", "extractive_answer",
)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, same_as_sql, name):
    same_as_sql(registry.queries()[name], registry.oracle_sql()[name])
