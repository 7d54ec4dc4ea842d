"""Top k with upper bounds, in two passes: lists that cannot lift a document into the result are only read for
documents that another list brings in. The result is that of exhaustive scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators import index as ix
from lodestar.operators import search
from lodestar.storage import cut

#: Room for rounded scores.
MARGIN = 1e-5
#: Thresholds are broadcast up to this number of queries.
FEW_QUERIES = 1 << 17


def bounded_terms(terms: DataFrame, index: ix.Index, model: str) -> DataFrame:
    """qid, term, qtf, bound, cum_bound: bounds of repeated terms multiplied, summed in ascending order."""
    bound = F.col("bm25_ub" if model == "bm25" else "tfidf_ub")
    known = terms.join(index.lexicon.select("term", bound.alias("ub")), "term").withColumn("bound", F.col("ub") * F.col("qtf"))
    run = Window.partitionBy("qid").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    return known.select("qid", "term", "qtf", "bound", F.sum("bound").over(run).alias("cum_bound"))


def _strongest(bounded: DataFrame, strongest: int) -> DataFrame:
    """The terms with a mark on the `strongest` of each query."""
    order = Window.partitionBy("qid").orderBy(F.col("bound").desc(), F.col("term"))
    return bounded.withColumn("is_strong", F.row_number().over(order) <= strongest)


def _sums(terms: DataFrame, index: ix.Index, model: str) -> DataFrame:
    return search.contributions(terms.select("qid", "term", "qtf"), index, model).groupBy("qid", "doc_id").agg(F.sum("part").alias("part"))


def _looked_up(docs: DataFrame, terms: DataFrame, index: ix.Index, model: str) -> DataFrame:
    """qid, doc_id, part of each of the terms (qid, term, qtf) in each of the documents (qid, doc_id) that holds it."""
    wanted = docs.select("qid", "doc_id").join(search.weighted(terms.select("qid", "term", "qtf"), index).select("qid", "term", "weight"), "qid")
    return index.postings.join(wanted, ["term", "doc_id"]).select("qid", "doc_id", search.part(index, model))


def _theta(sums: DataFrame, weak: DataFrame, index: ix.Index, k: int, model: str) -> DataFrame:
    """qid, theta: the least whole score of the k documents that are best by `sums` alone, where there are as many: k
    documents score no less. `weak` are the terms whose lists have no part in the sums."""
    best = search.top_k(sums.select("qid", "doc_id", F.col("part").alias("score")), k).select("qid", "doc_id", F.col("score").alias("part"))
    whole = best.unionByName(_looked_up(best, weak, index, model)).groupBy("qid", "doc_id").agg(F.round(F.sum("part"), search.DIGITS).alias("score"))
    return whole.where("score > 0").groupBy("qid").agg(F.min("score").alias("theta"), F.count("*").alias("n")).where(F.col("n") == k).select("qid", "theta")


def _marked(bounded: DataFrame, theta: DataFrame) -> DataFrame:
    essential = F.col("cum_bound") >= F.coalesce("theta", F.lit(0.0)) - MARGIN
    return bounded.join(theta, "qid", "left").withColumn("is_essential", essential)


def essential_terms(terms: DataFrame, index: ix.Index, k: int = 10, model: str = "bm25", strongest: int = 8) -> DataFrame:
    """qid, term, qtf, cum_bound, is_essential: a list is not essential if it and all weaker ones together stay below a
    score that k documents reach: those best by the `strongest` terms of the query; 0 if these terms reach fewer."""
    bounded = cut(_strongest(bounded_terms(terms, index, model), strongest), "bounded")
    theta = _theta(_sums(bounded.where("is_strong"), index, model), bounded.where("not is_strong"), index, k, model)
    return _marked(bounded, theta).select("qid", "term", "qtf", "cum_bound", "is_essential")


def pruned_top_k(terms: DataFrame, index: ix.Index, k: int = 10, model: str = "bm25", strongest: int = 8) -> DataFrame:
    """As exhaustive disjunctive top k, with less of the lists read.

    The sums over the strongest lists are kept; the whole scores of the k documents best by them give the threshold. The
    other essential lists are added to the sums. A document is followed up only if its sum so far and the bounds of the
    lists left together reach the threshold; of those lists just the postings of such documents are looked up.
    """
    bounded = cut(_strongest(bounded_terms(terms, index, model), strongest), "bounded")
    first = cut(_sums(bounded.where("is_strong"), index, model), "strong")
    marked = cut(_marked(bounded, _theta(first, bounded.where("not is_strong"), index, k, model)), "marked")
    more = _sums(marked.where("is_essential and not is_strong"), index, model)
    left = marked.where("not is_essential and not is_strong")
    limits = marked.groupBy("qid").agg(F.max("theta").alias("theta")).join(left.groupBy("qid").agg(F.max("cum_bound").alias("rest")), "qid", "left")
    main = first.unionByName(more).groupBy("qid", "doc_id").agg(F.sum("part").alias("part"))
    alive = main.join(F.broadcast(limits) if limits.count() <= FEW_QUERIES else limits, "qid")
    alive = alive.where(F.col("part") + F.coalesce("rest", F.lit(0.0)) >= F.coalesce("theta", F.lit(0.0)) - MARGIN)
    alive = cut(alive.select("qid", "doc_id", "part"), "alive")
    total = alive.unionByName(_looked_up(alive, left, index, model)).groupBy("qid", "doc_id").agg(F.round(F.sum("part"), search.DIGITS).alias("score"))
    return search.top_k(total.where("score > 0"), k)
