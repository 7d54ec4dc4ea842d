"""How distinctive a term is of a record: local weight times rarity in the collection.

The local weight of records with known token order comes from a graph of words: terms are nodes, terms that occur
within a window of each other are joined, and a term counts by the number of its different neighbours. Repeating a
term next to the same words adds nothing, being used in many surroundings does. Records that come as postings, with
frequencies but without order, have no such graph; their local weight is 1 + log10(tf).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.storage import cut, spread

#: A term is common if more rows hold it than one task should get.
HOT_ROWS = 1 << 18
#: The list of common terms is broadcast up to this length (some 10 MB).
HOT_TERMS = 1 << 17
#: Tokens that one call of the edge builder holds at a time.
BLOCK_TOKENS = 1 << 18


def latest_postings(postings: DataFrame, doc: str, term: str, tf: str, at: str) -> DataFrame:
    """doc, term, tf of the valid rows; of several for a (doc, term) the one written last counts.

    Null doc or term and null or non-positive tf are left out. A null time is older than any other; of rows written
    at the same time the larger tf counts.
    """
    rows = postings.where(F.col(doc).isNotNull() & F.col(term).isNotNull() & (F.col(tf) > 0))
    last = F.max(F.struct(F.coalesce(F.unix_micros(F.col(at)), F.lit(-(2**62))).alias("at"), F.col(tf).cast("int").alias("tf"))).alias("last")
    return rows.groupBy(F.col(doc).alias("doc"), F.col(term).alias("term")).agg(last).select("doc", "term", "last.tf")


def _degrees_many(rec: np.ndarray, ids: np.ndarray, n: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes rec * n + id in order, their distinct neighbours and occurrences, of records laid end to end."""
    edges = []
    for d in range(1, window + 1):
        near = (rec[:-d] == rec[d:]) & (ids[:-d] != ids[d:])
        a, b, r = ids[:-d][near], ids[d:][near], rec[:-d][near] * n
        edges += [(r + a) * n + b, (r + b) * n + a]
    nodes, tf = np.unique(rec * n + ids, return_counts=True)
    owner, count = np.unique(np.unique(np.concatenate(edges)) // n, return_counts=True)
    degree = np.zeros(len(nodes), np.int64)
    degree[np.searchsorted(nodes, owner)] = count
    return nodes, degree, tf


def _degrees(tokens: list, window: int):
    """(term, distinct neighbours, occurrences) of one record; a term is no neighbour of itself."""
    codes: dict[str, int] = {}
    ids = np.fromiter((codes.setdefault(t, len(codes)) for t in tokens if t is not None), dtype=np.int64)
    n, terms = len(codes), list(codes)
    degree = np.zeros(n, np.int64)
    for start in range(0, len(ids), BLOCK_TOKENS):  # edges of a very long record are built in blocks and merged
        part = ids[start : start + BLOCK_TOKENS + window]
        pairs = [part[:-d] * n + part[d:] for d in range(1, min(window, len(part) - 1) + 1)]
        block = np.unique(np.concatenate([*pairs, *[(p % n) * n + p // n for p in pairs]])) if pairs else np.zeros(0, np.int64)
        edges = block if start == 0 else np.union1d(edges, block)
    if len(ids):
        edges = edges[edges // n != edges % n]
        degree = np.bincount(edges // n, minlength=n)
    return terms, degree, np.bincount(ids, minlength=n)


def graph_of_words(records: DataFrame, doc: str, tokens: str, window: int = 4) -> DataFrame:
    """doc, term, degree, tf: the distinct neighbours of each term within `window` tokens, for each record.

    Records with null id, null or empty token lists have no rows, nor have null tokens, which also leave no gap. A
    record of one term has degree 0 for it. Records that share an id are taken one by one.
    """
    if window < 1:
        raise ValueError("window must be positive")
    kind = dict(records.dtypes)[doc]
    rows = records.where(F.col(doc).isNotNull() & (F.size(tokens) > 0)).select(F.col(doc).alias("doc"), F.col(tokens).alias("tokens"))

    names = ["doc", "term", "degree", "tf"]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, lists = batch.column(0), batch.column(1)
            lengths = pc.list_value_length(lists).to_numpy()
            codes = lists.flatten().dictionary_encode()
            ids, rec, n = codes.indices.fill_null(-1).to_numpy().astype(np.int64), np.repeat(np.arange(len(lengths)), lengths), len(codes.dictionary)
            ends, first = np.cumsum(lengths), 0
            while first < len(lengths):  # as many records as make a block, a longer one by itself
                begin = int(ends[first] - lengths[first])
                last = max(first + 1, int(np.searchsorted(ends, begin + BLOCK_TOKENS, "right")))
                part = slice(begin, int(ends[last - 1]))
                kept = ids[part] >= 0
                if lengths[first] > BLOCK_TOKENS:
                    terms, degree, tf = _degrees(lists[first].as_py(), window)
                    at, terms = np.full(len(terms), first), pa.array(terms, pa.string())
                elif kept.any():
                    nodes, degree, tf = _degrees_many(rec[part][kept] - first, ids[part][kept], n, window)
                    at, terms = nodes // n + first, codes.dictionary.take(pa.array(nodes % n)).cast(pa.string())
                else:
                    at, terms, degree, tf = np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(at)), terms, pa.array(degree), pa.array(tf)], names=names)
                first = last

    return spread(rows).mapInArrow(edges, f"doc {kind}, term string, degree bigint, tf bigint")


def weighted(local: DataFrame, amount: str, min_df: int = 2) -> DataFrame:
    """doc, term, weight = `amount` * log10(N / df), rounded to 6 places, for terms of `min_df` documents or more and
    weights above 0.

    `local` has one row for every (doc, term) and should be a stored table: it is read three times. Rows of terms that
    more than HOT_ROWS rows hold get their df by a broadcast of that list and never leave the place where they lie; only
    rows of the others are shuffled, HOT_ROWS of one term at most. If the list is longer than HOT_TERMS, all rows are
    joined by a shuffle, and adaptive skew handling divides the partitions of common terms.
    """
    freq = cut(local.groupBy("term").agg(F.count("*").alias("df")), "df")
    if dict(local.dtypes)["doc"] not in ("bigint", "int"):
        total = local.select("doc").distinct().agg(F.count("*").alias("n"))
    else:  # one bit a document, 64 to a word, so that the rows of a document combine before the shuffle
        bit = F.expr("shiftleft(1L, cast(cast(doc as bigint) & 63L as int))")
        cells = local.groupBy(F.shiftright(F.col("doc").cast("bigint"), 6).alias("cell")).agg(F.bit_or(bit).alias("bits"))
        total = cells.agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n"))
    common = freq.where(F.col("df") > HOT_ROWS)
    n_common = common.count()
    if n_common == 0 or n_common > HOT_TERMS:
        both = local.join(freq.where(F.col("df") >= min_df), "term")
    else:
        kept = ["doc", "term", amount, "df"]
        hot = local.join(F.broadcast(common.where(F.col("df") >= min_df)), "term").select(*kept)
        rare = local.join(F.broadcast(common.select("term")), "term", "left_anti")
        both = hot.unionByName(rare.join(freq.where((F.col("df") >= min_df) & (F.col("df") <= HOT_ROWS)), "term").select(*kept))
    weight = F.round(F.col(amount) * F.log10(total.scalar().cast("double") / F.col("df")), 6)
    return both.select("doc", "term", weight.alias("weight")).where(F.col("weight") > 0)


def most_distinctive(weights: DataFrame) -> DataFrame:
    """doc, term, weight: the term of the highest weight for each doc, ties to the smaller term in byte order."""
    order = Window.partitionBy("doc").orderBy(F.col("weight").desc(), F.col("term"))
    return weights.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def distinctive_postings(postings: DataFrame, doc: str, term: str, tf: str, at: str) -> DataFrame:
    """The most distinctive term of every document of a postings table."""
    local = cut(latest_postings(postings, doc, term, tf, at), "postings")
    return most_distinctive(weighted(local.withColumn("amount", 1 + F.log10("tf")), "amount"))


def distinctive_records(records: DataFrame, doc: str, tokens: str, window: int = 4) -> DataFrame:
    """The most distinctive term of every record with token order, by graph of words. Records sharing an id are
    one: of each term the largest degree counts."""
    local = graph_of_words(records, doc, tokens, window).groupBy("doc", "term").agg(F.max("degree").alias("degree"))
    return most_distinctive(weighted(cut(local, "degrees"), "degree"))
