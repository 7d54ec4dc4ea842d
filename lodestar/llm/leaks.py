"""Held-out passages inside a corpus, found with suffix arrays over shards of the corpus.

Both sides become sequences of words (runs of letters or digits, case folded). The corpus is read once: shard by shard its
words are numbered, the suffixes sorted, and the array stored with the words in the shared folder. The test items lie
there in blocks. A task takes its shards one by one and opens block after block, and binary-searches every suffix of every
item in the sorted list; equal ranges are the verbatim occurrences, which are then lengthened as far as they go. So neither
a task nor the driver holds more than a shard and a block, however large corpus and test set are.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.storage import cut, fresh, spread

WORD = re.compile(r"[^\W_]+")
#: Words of a shard, a bound on memory. A document is never divided.
SHARD_WORDS = 1 << 20
#: Bytes of item text in a block, about.
BLOCK_BYTES = 32 << 20

MATCHES = "doc_id {0}, item_id {1}, n_words int, doc_word int, item_word int, start_pos int, end_pos int"


def words(text: str) -> list[str]:
    return WORD.findall(text.lower()) if text.isascii() else [w.casefold() for w in WORD.findall(text)]


class Items:
    """The words of the test items, end to end, with a None after each item."""

    def __init__(self, items: Sequence[tuple], least: int):
        self.least = least
        self.words, self.owner, place = [], [], []
        for item_id, text in items:
            w = words(text)
            if len(w) >= least:
                self.words += [*w, None]
                self.owner += [item_id] * (len(w) + 1)
                place += range(len(w) + 1)
        self.place = np.array(place, np.int32)

    def numbered(self, vocabulary: dict[str, int]) -> np.ndarray:
        """The numbers that a shard gives the words, 0 for none."""
        known = {w: vocabulary.get(w, 0) for w in set(self.words)}
        return np.fromiter((known[w] for w in self.words), np.int64, len(self.words))


def long_runs(ids: np.ndarray, least: int) -> np.ndarray:
    """Positions from which at least `least` numbers in a row are not 0."""
    if not len(ids):
        return np.zeros(0, np.int64)
    return np.flatnonzero(_ahead(ids) >= least)


def _ahead(ids: np.ndarray) -> np.ndarray:
    """How many numbers stand from each position on before the next 0."""
    zeros = np.flatnonzero(np.r_[ids, 0] == 0)
    at = np.arange(len(ids))
    return zeros[np.searchsorted(zeros, at)] - at


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """The positions of `ids` in the order of the first `depth` numbers, or more, of their suffixes, by prefix doubling; 0
    ends a suffix."""
    rank = np.unique(ids, return_inverse=True)[1].astype(np.int64)
    ahead, k = _ahead(ids) if len(ids) else ids, 1
    while k < depth and len(rank) and rank.max() + 1 < len(rank):
        after = np.r_[rank[k:], np.zeros(min(k, len(rank)), np.int64)] + 1
        after[ahead < k] = 0
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        k *= 2
    return np.argsort(rank, kind="stable")


@dataclass
class Shard:
    """Documents, and their words as numbers above 0 with a 0 after each document, in suffix order too."""

    docs: bytes
    starts: np.ndarray
    vocabulary: list[str]
    ids: np.ndarray
    order: np.ndarray

    @classmethod
    def of(cls, docs: pa.RecordBatch, least: int) -> Shard:
        """docs: doc_id, text."""
        number: dict[str, int] = {}
        ids, starts = [], []
        for t in docs.column(1).to_pylist():
            starts.append(len(ids))
            ids += [number.setdefault(w, len(number) + 1) for w in words(t)]
            ids.append(0)
        held = np.array(ids, np.int32)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs.schema) as out:
            out.write_batch(docs)
        order = suffix_array(held, least)
        order = order[np.isin(order, long_runs(held, least), assume_unique=True)]
        return cls(sink.getvalue().to_pybytes(), np.array(starts, np.int64), list(number), held, order.astype(np.int32))

    def batch(self) -> pa.RecordBatch:
        return pa.ipc.open_stream(self.docs).read_next_batch()


def _bounds(ids: np.ndarray, order: np.ndarray, wanted: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the suffixes whose first n numbers are those of `wanted` from `at` on begin and end in `order`: a binary
    search for all of them at once."""
    out = []
    for past in (False, True):
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(order))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            p, j = order[mid].astype(np.int64), at[open_]
            right, tied = np.zeros(len(open_), bool), np.ones(len(open_), bool)
            for i in range(n):
                a, b = ids[p + i], wanted[j + i]
                right |= tied & (a < b)
                tied &= a == b
            right |= tied & past
            low[open_], high[open_] = np.where(right, mid + 1, low[open_]), np.where(right, high[open_], mid)
        out.append(low)
    return out[0], out[1]


def search_shard(shard: Shard, items: Items) -> list[tuple[int, int, int]]:
    """(place in the shard, place in the items' words, length) of every longest verbatim match of `least` words or more."""
    n, ids = items.least, shard.ids
    wanted = items.numbered({w: k + 1 for k, w in enumerate(shard.vocabulary)})
    starts = long_runs(wanted, n)
    if not len(starts) or not len(shard.order):
        return []
    low, high = _bounds(ids, shard.order, wanted, starts, n)
    count = high - low
    j = np.repeat(starts, count)
    p = shard.order[np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())].astype(np.int64)
    before_p, before_j = np.where(p > 0, ids[p - 1], 0), np.where(j > 0, wanted[j - 1], 0)
    first = (before_p != before_j) | (before_p == 0)  # else the match begins a word earlier
    p, j = p[first], j[first]
    size = np.full(len(p), n)
    ends, pad_s, pad_i = np.arange(len(p)), np.r_[ids, 0], np.r_[wanted, 0]
    while len(ends):
        a, b = pad_s[p[ends] + size[ends]], pad_i[j[ends] + size[ends]]
        ends = ends[(a == b) & (a != 0)]
        size[ends] += 1
    return list(zip(p.tolist(), j.tolist(), size.tolist(), strict=True))


def build_shards(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """shard: the stored arrays of a corpus, for searches of at least `least` words. Null texts are left out."""
    rows = spread(docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(text).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def shard() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Shard.of(whole, least))], pa.binary())], names=["shard"])

        for batch in batches:
            first = 0
            for k, t in enumerate(batch.column(1).to_pylist()):
                size += t.count(" ") + len(t) // 16 + 1  # words, about
                if size >= SHARD_WORDS:
                    held.append(batch.slice(first, k + 1 - first))
                    yield shard()
                    held, size, first = [], 0, k + 1
            if first < batch.num_rows:
                held.append(batch.slice(first))
        if held:
            yield shard()

    return cut(rows.mapInArrow(run, "shard binary"), "shards")


def store_items(items: DataFrame, item: str = "item_id", text: str = "text") -> list[str]:
    """The files of the items, of some BLOCK_BYTES each: a partition of the items by hash."""
    rows = items.where(F.col(text).isNotNull()).select(F.col(item).alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    path = fresh(items.sparkSession, "items")
    rows.repartition(-(-2 * total // BLOCK_BYTES) or 1, F.xxhash64("t")).write.parquet(path)
    return sorted(items.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())


@lru_cache(maxsize=1)
def _block(path: str, least: int) -> Items:
    fs, name = pafs.FileSystem.from_uri(path)
    t = pq.read_table(fs.open_input_file(name))
    return Items(list(zip(t.column("i").to_pylist(), t.column("t").to_pylist(), strict=True)), least)


def find_matches(docs: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", least: int = 12) -> DataFrame:
    """doc_id, item_id, n_words, doc_word, item_word, start_pos, end_pos: the longest verbatim matches of at least
    `least` words between documents and test items; positions in code points of the document, words counted from 0.

    Null texts and items of fewer words match nothing. A passage that several items share is reported for each.
    Repeated rows are matched one by one; a null id is reported as such. Empty tables give an empty result. The file
    system of spark.checkpoint.dir must be one that Arrow opens by the same name.
    """
    if least < 1:
        raise ValueError("least must be positive")
    schema = MATCHES.format(dict(docs.dtypes)[doc], dict(items.dtypes)[item])
    item_type = pa.int64() if dict(items.dtypes)[item] == "bigint" else pa.string()
    blocks = store_items(items, item, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                shard = pickle.loads(data)
                for path in blocks:
                    yield _found(shard, _block(path, least), item_type)

    shards = build_shards(docs, doc, text, least)
    return shards.mapInArrow(run, schema)


def _found(shard: Shard, items: Items, item_type: pa.DataType) -> pa.RecordBatch:
    docs = shard.batch()
    out = []
    for p, j, n in search_shard(shard, items):
        d = int(np.searchsorted(shard.starts, p, "right")) - 1
        out.append((d, items.owner[j], n, p - int(shard.starts[d]), int(items.place[j])))
    spans = {d: [m.span() for m in WORD.finditer(docs.column(1)[d].as_py())] for d in {x[0] for x in out}}
    cols = [[x[k] for x in out] for k in (1, 2, 3, 4)]
    cols += [[spans[x[0]][x[3]][0] for x in out], [spans[x[0]][x[3] + x[2] - 1][1] for x in out]]
    ids = docs.column(0).take(pa.array([x[0] for x in out], pa.int64()))
    kinds = [item_type, *[pa.int32()] * 5]
    names = ["doc_id", "item_id", "n_words", "doc_word", "item_word", "start_pos", "end_pos"]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=names)


def leaked_items(matches: DataFrame) -> DataFrame:
    """doc_id, item_id, once for each pair."""
    return matches.select("doc_id", "item_id").distinct()


def without_leaks(docs: DataFrame, matches: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The documents that hold no test passage, those with a null id included."""
    bad = matches.select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(bad, docs[doc] == bad["_leaked"], "left_anti")
