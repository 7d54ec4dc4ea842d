"""Ranked retrieval for batches of queries, disjunctive or conjunctive, and for single queries.

A batch is one job: query terms join the postings, contributions are summed per query and document, and a ranked limit
per query keeps the best. A posting's contribution does not depend on the query but for the number of times the term is
asked, so it is computed on the side of the postings. While the query terms are few they are broadcast and no posting
moves; a batch too large for that shuffles postings by term, those of a common term to several tasks.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import scoring, text
from lodestar.operators import index as ix
from lodestar.storage import cut

DIGITS = 6


def query_terms(queries: DataFrame, index: ix.Index | None = None, qid: str = "qid", body: str = "query_text") -> DataFrame:
    """qid, term, qtf: how often each term occurs in each query; queries with the same id and text count once."""
    one = queries.select(F.col(qid).alias("qid"), F.col(body).alias("text")).where(F.col("qid").isNotNull()).distinct()
    terms = text.exploded(one, "qid", "text").drop("pos")
    if index is not None and index.parsed:
        terms = ix.parse_terms(terms, index.stop)
    return terms.groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def known_terms(terms: DataFrame, lexicon: DataFrame) -> DataFrame:
    """qid, term, qtf, df: terms that are in the lexicon; others are dropped silently."""
    return terms.join(lexicon.select("term", "df"), "term").select("qid", "term", "qtf", "df")


def weighted(terms: DataFrame, index: ix.Index) -> DataFrame:
    """qid, term, df, weight of the known terms."""
    weight = F.col("qtf") * scoring.idf(index.n_docs(), F.col("df"))
    return known_terms(terms, index.lexicon).select("qid", "term", "df", weight.alias("weight"))


def part(index: ix.Index, model: str) -> Column:
    """TF-IDF needs no document lengths and does not read them."""
    if scoring.check_model(model) == "bm25":
        return scoring.bm25(F.col("tf"), F.col("doc_len"), index.avgdl(), F.col("weight")).alias("part")
    return scoring.tfidf(F.col("tf"), F.col("weight")).alias("part")


def contributions(terms: DataFrame, index: ix.Index, model: str) -> DataFrame:
    """qid, doc_id, term, part: what each term of a query adds to the score of each document that holds it."""
    return ix.with_postings(index, weighted(terms, index)).select("qid", "doc_id", "term", part(index, model))


def conjunctive_contributions(terms: DataFrame, index: ix.Index, model: str) -> DataFrame:
    """qid, doc_id, need, part of the documents that hold the rarest known term of the query; need is the number of
    known terms. Only those documents can hold them all, so the lists of the others are not gone through query by query; of
    a compressed index only the blocks in which such a document may be are decoded."""
    by = Window.partitionBy("qid")
    asked = weighted(terms, index).withColumns({"need": F.count("*").over(by), "_r": F.row_number().over(by.orderBy("df", "term"))})
    rare = asked.where("_r = 1").select("qid", "term")
    brought = ix.with_postings(index, rare).select("qid", "doc_id")
    wanted = brought.join(asked.select("qid", "term", "weight", "need"), "qid")
    if index.blocks is not None:
        wanted = cut(wanted, "wanted")
    return ix.postings_at(index, wanted).join(wanted, ["term", "doc_id"]).select("qid", "doc_id", "need", part(index, model))


def score(terms: DataFrame, index: ix.Index, model: str = "bm25", conjunctive: bool = False) -> DataFrame:
    """qid, doc_id, score above 0, rounded; conjunctive: only documents with every known term of the query."""
    total = F.round(F.sum("part"), DIGITS).alias("score")
    if not conjunctive:
        return contributions(terms, index, model).groupBy("qid", "doc_id").agg(total).where("score > 0")
    have = conjunctive_contributions(terms, index, model).groupBy("qid", "doc_id", "need").agg(total, F.count("*").alias("have"))
    return have.where((F.col("have") == F.col("need")) & (F.col("score") > 0)).select("qid", "doc_id", "score")


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, rank from 1, score: by falling score, ties to the smaller document id."""
    if k < 1:
        raise ValueError("k must be at least 1")
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id"))
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).select("qid", "doc_id", "rank", "score")


def search_batch(queries: DataFrame, index: ix.Index, k: int = 10, model: str = "bm25", conjunctive: bool = False, qid: str = "qid", body: str = "query_text") -> DataFrame:
    """The k best documents of every query. Queries without known terms, or null, have no rows."""
    return top_k(score(query_terms(queries, index, qid, body), index, model, conjunctive), k)


def search(spark: SparkSession, index: ix.Index, query: str, k: int = 10, model: str = "bm25") -> DataFrame:
    """doc_id, rank, score for one query; a leading plus asks for all terms. The terms become a literal filter, so a
    stored index is read only where they lie."""
    conjunctive = query.strip().startswith("+")
    if k < 1:
        raise ValueError("k must be at least 1")
    words = spark.range(1).select(text.tokens(F.lit(query)).alias("w"))
    if index.parsed:
        words = ix.parse_terms(words.select(F.explode("w").alias("term")), index.stop).agg(F.collect_list("term").alias("w"))
    asked = Counter(words.first()[0])
    terms = spark.createDataFrame([("q", t, n) for t, n in sorted(asked.items())], "qid string, term string, qtf bigint")
    near = replace(index, postings=index.postings.where(F.col("term").isin(list(asked))), lexicon=index.lexicon.where(F.col("term").isin(list(asked))))
    best = score(terms, near, model, conjunctive).orderBy(F.col("score").desc(), "doc_id").limit(k)
    return best.select("doc_id", F.row_number().over(Window.orderBy(F.col("score").desc(), F.col("doc_id"))).cast("bigint").alias("rank"), "score")


def first_document(terms: DataFrame, index: ix.Index) -> DataFrame:
    """qid, doc_id: the least document that any term of the query occurs in."""
    asked = index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    least = asked.groupBy("term").agg(F.min("doc_id").alias("doc_id"))
    return terms.join(least, "term").groupBy("qid").agg(F.min("doc_id").alias("doc_id"))
