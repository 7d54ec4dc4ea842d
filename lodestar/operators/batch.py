"""Ranked retrieval for whole files of queries.

A file of queries meets a posting as often as its term is asked, so joining the two makes rows in proportion to documents
times queries. Here the postings of the asked terms are dealt by document to tasks and every task gets all queries; it
scores its documents over arrays and returns its k best of each query, of which the k best are kept. No row is made for a
query and a document but for these. Queries with the same terms are scored once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import scoring
from lodestar.operators import index as ix
from lodestar.operators import search
from lodestar.storage import cut

#: Postings that a task holds; there are more tasks if there are more of them, one for each core at least.
TASK_POSTINGS = 1 << 21
#: Different queries that a task answers; with more of them the postings go to several tasks.
TASK_QUERIES = 1 << 18
#: Asked terms are broadcast up to this number.
FEW_TERMS = 1 << 17
#: Queries whose results are handed over at once.
BATCH = 4096
#: Terms that are summed for several queries at most.
DEEPEST = 32
_SLACK = 10.0**-search.DIGITS
_BEST = pa.schema([("bag", pa.int64()), ("doc_id", pa.int64()), ("score", pa.float64())])


class Shard:
    """The postings of some documents: docs[t] are the places in `ids` (ascending) of the documents that hold term t,
    parts[t] what it adds to their scores if asked once."""

    def __init__(self, tid: np.ndarray, doc_id: np.ndarray, part: np.ndarray, k: int):
        self.k = k
        self.ids, place = np.unique(doc_id, return_inverse=True)
        order = np.lexsort((place, tid))
        tid, place, part = tid[order], place[order].astype(np.int64), part[order]
        starts = np.flatnonzero(np.r_[True, tid[1:] != tid[:-1]]) if len(tid) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(tid)]
        self.docs = {int(tid[a]): place[a:b] for a, b in zip(starts, ends, strict=True)}
        self.parts = {int(tid[a]): part[a:b] for a, b in zip(starts, ends, strict=True)}
        self.none = (np.zeros(0, np.int64), np.zeros(0))
        self._sum = np.zeros(len(self.ids))
        self._dense: dict[int, np.ndarray] = {}

    def best(self, docs: np.ndarray, scores: np.ndarray, copies: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Of documents with scores, each there up to `copies` times, the k best: by rounded score, ties to the smaller."""
        most = self.k * copies
        if len(scores) > most:
            kept = scores >= np.partition(scores, len(scores) - most)[len(scores) - most] - _SLACK
            docs, scores = docs[kept], scores[kept]
        rounded = np.floor(scores * 10**search.DIGITS + 0.5) / 10**search.DIGITS
        if copies > 1:
            docs, first = np.unique(docs, return_index=True)
            rounded = rounded[first]
        order = np.lexsort((docs, -rounded))[: self.k]
        order = order[rounded[order] > 0]
        return docs[order], rounded[order]

    def any_of(self, bags: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """number, documents, scores of the best documents with any term of each bag (number, ((term, times), ...)).

        The bags are gone through as a tree, commonest terms first. Where enough bags begin alike, what these terms add is
        summed once for all documents. A bag's other lists then lift the documents they hold; a document that none of them
        holds can only be among the k best if it is among the k best of the sum.
        """
        held = {x for _, bag in bags for x in bag if x[0] in self.docs}
        asked = sorted(held, key=lambda x: (-len(self.docs[x[0]]), x))
        rank = {x: i for i, x in enumerate(asked)}
        own = sorted((tuple(sorted(rank[x] for x in bag if x in rank)), n) for n, bag in bags)
        yield from self._branch([x for x in own if x[0]], asked, 0, np.zeros(len(self.ids)))

    def _branch(self, own: list[tuple], asked: list[tuple[int, int]], depth: int, base: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        top = self.best(np.flatnonzero(base), base[np.flatnonzero(base)]) if depth else self.none
        a = 0
        while a < len(own):
            if len(own[a][0]) == depth:
                yield own[a][1], *top
                a += 1
                continue
            here, b = own[a][0][depth], a + 1
            while b < len(own) and len(own[b][0]) > depth and own[b][0][depth] == here:
                b += 1
            t, q = asked[here]
            docs, parts = self.docs[t], self.parts[t]
            if (b - a) * len(docs) >= 2 * len(base) and depth < DEEPEST:
                more = base.copy()
                more[docs] += q * parts
                yield from self._branch(own[a:b], asked, depth + 1, more)
            else:
                for bag, n in own[a:b]:
                    yield n, *self._lifted([asked[i] for i in bag[depth:]], base, top)
            a = b

    def _lifted(self, rest: list[tuple[int, int]], base: np.ndarray, top: tuple) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.docs[t] for t, _ in rest]
        docs = np.concatenate([top[0], *lists])
        for t, q in rest:
            self._sum[self.docs[t]] += q * self.parts[t]
        scores = base[docs] + self._sum[docs]
        for d in lists:
            self._sum[d] = 0.0
        if len(top[0]) == self.k:
            kept = scores >= top[1][-1] - _SLACK
            docs, scores = docs[kept], scores[kept]
        return self.best(docs, scores, len(lists) + 1)

    def all_of(self, bags: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As any_of, of the documents with all terms of a bag: those of its shortest list, looked up in the others."""
        for n, bag in bags:
            if not all(t in self.docs for t, _ in bag):
                continue
            (t, q), *others = sorted(bag, key=lambda x: (len(self.docs[x[0]]), x))
            docs, scores = self.docs[t], q * self.parts[t]
            for t, q in others:
                if not len(docs):
                    break
                part, held = self._part(t, docs)
                docs, scores = docs[held], scores[held] + q * part[held]
            yield n, *self.best(docs, scores)

    def pruned(self, bags: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """As any_of, by upper bounds: the lists are added up from the highest bound on, until those left together stay
        below a score that k documents have reached; these are only looked up for documents that can still reach it."""
        most = {t: float(p.max()) for t, p in self.parts.items()}
        for n, bag in bags:
            lists = sorted(((q * most[t], t, q) for t, q in bag if t in self.docs), reverse=True)
            rest = np.r_[np.cumsum([u for u, _, _ in lists][::-1])[::-1], 0.0]
            reached, seen = 0.0, []
            for j, (_, t, q) in enumerate(lists):
                if rest[j] < reached - _SLACK:
                    break
                own = self.docs[t]
                self._sum[own] += q * self.parts[t]
                seen.append(own)
                if len(own) >= self.k:
                    reached = max(reached, float(np.partition(self._sum[own], len(own) - self.k)[len(own) - self.k]))
            if not seen:
                continue
            docs = np.concatenate(seen)
            scores = self._sum[docs]
            self._sum[docs] = 0.0
            alive = scores + rest[len(seen)] >= reached - _SLACK
            docs, first = np.unique(docs[alive], return_index=True)
            scores = scores[alive][first]
            for j in range(len(seen), len(lists)):
                part, held = self._part(lists[j][1], docs)
                scores = scores + np.where(held, lists[j][2] * part, 0.0)
                alive = scores + rest[j + 1] >= reached - _SLACK
                docs, scores = docs[alive], scores[alive]
            yield n, *self.best(docs, scores)

    def _part(self, t: int, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What term t adds to each of the documents, and which of them hold it; a list of many documents is laid out."""
        own = self.docs[t]
        if len(own) * 4 > len(self.ids):
            if t not in self._dense:
                self._dense[t] = np.full(len(self.ids), -1.0)
                self._dense[t][own] = self.parts[t]
            part = self._dense[t][docs]
            return part, part >= 0
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return self.parts[t][at], own[at] == docs


def _bags(terms: DataFrame) -> DataFrame:
    """qid, bag: the terms (tid, qtf) of each query as one value."""
    return terms.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("tid", "qtf"))).alias("bag"))


def _factor(index: ix.Index, model: str) -> Column:
    if scoring.check_model(model) == "bm25":
        return scoring.bm25(F.col("tf"), F.col("doc_len"), index.avgdl(), F.col("idf"))
    return scoring.tfidf(F.col("tf"), F.col("idf"))


def _asked_postings(index: ix.Index, asked: DataFrame, few: bool) -> DataFrame:
    """The postings of the asked terms, joined to them; of a compressed index only the blocks of these terms are decoded."""
    if not few:
        return ix.with_postings(index, asked)
    postings = index.postings
    if index.blocks is not None:
        postings = ix.unblocked(index.blocks.join(F.broadcast(asked.select("term")), "term", "left_semi"))
    return postings.join(F.broadcast(asked), "term")


def _tuples(number: np.ndarray, tid: np.ndarray, qtf: np.ndarray) -> list[tuple]:
    """(number, ((term, times), ...)) from a row for each term of a bag; equal pairs are one object."""
    pairs, code = np.unique(np.stack([tid, qtf], axis=1), axis=0, return_inverse=True)
    items = [(int(t), int(q)) for t, q in pairs]
    order = np.argsort(number, kind="stable")
    number, code = number[order], code.reshape(-1)[order].tolist()
    starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]).tolist()
    return [(int(number[a]), tuple(items[c] for c in code[a:b])) for a, b in zip(starts, [*starts[1:], len(code)], strict=True)]


def _scorer(k: int, how: str):
    """Of rows (bag, tid, n, factor): terms of bags, n times asked, and, where bag is null, postings of document n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        asks: list[tuple] = []
        for b in batches:
            null = b.column("bag").is_null()
            for to, rows, names in ((held, b.filter(null), ("tid", "n", "factor")), (asks, b.filter(pc.invert(null)), ("bag", "tid", "n"))):
                if rows.num_rows:
                    to.append(tuple(rows.column(x).to_numpy(zero_copy_only=False) for x in names))
        if not asks or not held:
            return
        bags = _tuples(*(np.concatenate(x) for x in zip(*asks, strict=True)))
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        held.clear()
        asks.clear()
        shard = Shard(*columns, k)
        del columns
        found: list[tuple] = []

        def batch() -> pa.RecordBatch:
            numbers = np.repeat(np.array([n for n, _, _ in found], np.int64), [len(d) for _, d, _ in found])
            docs = shard.ids[np.concatenate([d for _, d, _ in found])]
            return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(docs), pa.array(np.concatenate([s for _, _, s in found]))], schema=_BEST)

        for x in getattr(shard, how)(bags):
            found.append(x)
            if len(found) == BATCH:
                yield batch()
                found.clear()
        if found:
            yield batch()

    return run


def top_k(terms: DataFrame, index: ix.Index, k: int = 10, model: str = "bm25", how: str = "any_of") -> DataFrame:
    """qid, doc_id, rank, score of the k best documents for the terms (qid, term, qtf) of every query, as search.top_k of
    search.score has them. `how` is the method of Shard that finds them."""
    if k < 1:
        raise ValueError("k must be at least 1")
    scoring.check_model(model)
    spark = index.postings.sparkSession
    known = search.known_terms(terms, index.lexicon)
    idf = scoring.idf(index.n_docs(), F.col("df"))
    asked = cut(known.select("term", "df").distinct().select(F.monotonically_increasing_id().alias("tid"), "term", "df", idf.alias("idf")), "asked")
    count, total = asked.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    few = count <= FEW_TERMS
    named = asked.select("term", "tid")
    named = _bags(terms.join(F.broadcast(named) if few else named, "term"))
    bags = cut(named.select("bag").distinct().select(F.monotonically_increasing_id().alias("number"), "bag"), "bags")
    shards = max(spark.sparkContext.defaultParallelism, -(-total // TASK_POSTINGS))
    parts = max(1, -(-bags.count() // TASK_QUERIES))
    postings = _asked_postings(index, asked.select("term", "tid", "idf"), few)
    shard, part = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("number"), F.lit(parts)).cast("int")
    rows = postings.select(shard.alias("_task"), F.lit(None).cast("bigint").alias("bag"), "tid", F.col("doc_id").alias("n"), _factor(index, model).alias("factor"))
    if parts > 1:
        rows = rows.withColumn("_task", F.explode(F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda x: x * shards + F.col("_task"))))
    every = F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda x: part * shards + x)).alias("_task")
    asks = bags.select("number", "bag", every).select("_task", F.col("number").alias("bag"), F.explode("bag").alias("x"))
    asks = asks.select("_task", "bag", "x.tid", F.col("x.qtf").alias("n"), F.lit(0.0).alias("factor"))
    dealt = rows.unionByName(asks).repartitionById(shards * parts, F.col("_task")).drop("_task")
    best = dealt.mapInArrow(_scorer(k, how), "bag bigint, doc_id bigint, score double")
    ranked = search.top_k(best.withColumnRenamed("bag", "qid"), k).withColumnRenamed("qid", "number")
    return named.join(bags, "bag").select("qid", "number").join(ranked, "number").select("qid", "doc_id", "rank", "score")


def search_file(queries: DataFrame, index: ix.Index, k: int = 10, model: str = "bm25", conjunctive: bool = False) -> DataFrame:
    """As search.search_batch, for many queries (qid, query_text)."""
    return top_k(search.query_terms(queries, index), index, k, model, "all_of" if conjunctive else "any_of")
