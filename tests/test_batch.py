"""Files of queries: no row for a query and a document but the best ones, results as the SQL has them."""

import random
from itertools import combinations

import numpy as np
import pytest
from compare import assert_same

from lodestar.operators import batch, search
from lodestar.operators import index as ix
from lodestar.plans import retrieval

WORDS = "red blue green fox dog cat sun moon sky sea tree leaf rain".split()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """4,000 documents with about half of the words each, 286 queries of three words: a million pairs."""
    rnd, at = random.Random(5), f"file://{tmp_path_factory.mktemp('sf')}"
    docs = [(7 * i - 900, " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(6, 14)))) for i in range(4000)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{at}/documents.parquet")
    asked = [(f"q{i}", " ".join(w)) for i, w in enumerate(combinations(WORDS, 3))]
    asked += [("twice", "red fox fox"), ("none", "zzz"), ("null", None), (None, "red"), ("q0", " ".join(WORDS[:3]))]
    spark.createDataFrame(asked, "qid string, query_text string").write.parquet(f"{at}/queries.parquet")
    return at


def shuffled(spark, run):
    """Rows that the stages of `run` write to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    gateway = spark.sparkContext._gateway

    def total():
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {s.stageId(): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = total()
    run()
    return sum(n for k, n in total().items() if k not in before)


@pytest.mark.parametrize("name", ["bm25_query_file_topk", "tfidf_and_topk", "maxscore_query_file_topk", "tfidf_query_file_topk", "dup_terms_topk", "run_file", "bm25_and_compressed_topk", "bm25_and_topk", "unknown_terms_and"])
def test_no_row_for_each_query_and_document(spark, sf, name):
    retrieval.stored_index(spark, sf, compressed="compressed" in name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large for it
    try:
        assert shuffled(spark, lambda: retrieval.QUERIES[name](spark, sf).collect()) < 200_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert_same(spark, retrieval.QUERIES[name], retrieval.ORACLES[name], sf.removeprefix("file://"))


@pytest.mark.parametrize("limits", [{"TASK_POSTINGS": 1000}, {"TASK_QUERIES": 50, "FEW_TERMS": 0}, {"DEEPEST": 0, "BATCH": 7}])
def test_limits_do_not_change_results(spark, sf, limits, monkeypatch):
    index = retrieval.stored_index(spark, sf)
    asked = spark.read.parquet(f"{sf}/queries.parquet")
    want = sorted(map(tuple, batch.search_file(asked, index, 6).collect()))
    for name, value in limits.items():
        monkeypatch.setattr(batch, name, value)
    assert sorted(map(tuple, batch.search_file(asked, index, 6).collect())) == want


@pytest.mark.parametrize("conjunctive", [False, True])
def test_as_joined(spark, sf, conjunctive):
    index = retrieval.stored_index(spark, sf)
    asked = spark.read.parquet(f"{sf}/queries.parquet")
    want = sorted(map(tuple, search.search_batch(asked, index, 3, "tfidf", conjunctive).collect()))
    assert sorted(map(tuple, batch.search_file(asked, index, 3, "tfidf", conjunctive).collect())) == want


@pytest.mark.parametrize("k", [1, 10, 5000])
@pytest.mark.parametrize("model", ["bm25", "tfidf"])
def test_pruned_as_exhaustive(spark, sf, k, model):
    index = retrieval.stored_index(spark, sf)
    terms = search.query_terms(spark.read.parquet(f"{sf}/queries.parquet").limit(30))
    want = sorted(map(tuple, batch.top_k(terms, index, k, model).collect()))
    assert sorted(map(tuple, batch.top_k(terms, index, k, model, "pruned").collect())) == want


def test_no_documents_no_queries_no_known_term(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    queries = spark.createDataFrame([("1", "x y"), ("2", "a")], "qid string, query_text string")
    assert batch.search_file(queries, ix.build(docs.limit(0))).collect() == []
    assert batch.search_file(queries.limit(0), ix.build(docs)).collect() == []
    assert batch.search_file(queries.where("qid = '1'"), ix.build(docs)).collect() == []
    assert [tuple(r)[:3] for r in batch.search_file(queries, ix.build(docs)).collect()] == [("2", 1, 1)]
    with pytest.raises(ValueError):
        batch.search_file(queries, ix.build(docs), 0)


def test_equal_scores_go_to_the_smaller_document():
    shard = batch.Shard(np.array([1, 1, 1, 2, 2]), np.array([9, 4, 7, 7, 4]), np.array([0.5, 0.5, 0.5, 0.25, 0.25]), 2)
    found = {n: (shard.ids[d].tolist(), s.tolist()) for n, d, s in shard.any_of([(0, ((1, 1),)), (1, ((1, 1), (2, 2)))])}
    assert found == {0: ([4, 7], [0.5, 0.5]), 1: ([4, 7], [1.0, 1.0])}
