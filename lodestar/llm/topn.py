"""The N best items of every group by a multiway merge of stored sorted runs.

A run is what one partition holds, sorted by bucket of the group, group, score and item, cut after N items of each group
and stored as a file in the shared folder. The task of a bucket opens the runs side by side, each by a cursor that reads a
row group only when it comes to it, and merges them with a loser tree: after N items of a group every cursor seeks
to the next group, past row groups whose statistics show that they end before it. So a task holds one row group of
each run, whatever a group's size, and what a group has beyond its N items in the runs is skipped unread.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.storage import fresh

#: Bytes of a row group of a run, before compression: what a cursor holds.
ROW_GROUP_BYTES = 1 << 20


class Run:
    """A cursor over rows sorted by key, that come in pages; `load(n)` gives the keys of page n, `last(n)` the greatest
    of them or None if that is not known without loading."""

    def __init__(self, pages: int, load: Callable[[int], list], last: Callable[[int], object | None]):
        self.pages, self.load, self.last = pages, load, last
        self.page, self.at, self.keys = -1, 0, []
        self._turn()

    def _turn(self) -> None:
        while self.at >= len(self.keys) and self.page + 1 < self.pages:
            self.page += 1
            self.keys, self.at = self.load(self.page), 0

    def head(self):
        return self.keys[self.at] if self.at < len(self.keys) else None

    def step(self) -> None:
        self.at += 1
        if self.at >= len(self.keys):
            self._turn()

    def seek(self, key) -> None:
        """To the first row whose key is not less."""
        self.at = bisect_left(self.keys, key, self.at)
        while self.at >= len(self.keys) and self.page + 1 < self.pages:
            end = self.last(self.page + 1)
            if end is not None and end < key:
                self.page += 1
                continue
            self.page += 1
            self.keys = self.load(self.page)
            self.at = bisect_left(self.keys, key)


class LoserTree:
    """Tournament over runs: `pop` gives the least head, replaying one path of the tree.

    Internal nodes hold the loser of their match, the root's winner stands apart. Exhausted runs lose to all others;
    equal keys go to the run that was named first.
    """

    def __init__(self, runs: Sequence[Run]):
        self.runs, self.k = runs, max(1, len(runs))
        self.build()

    def build(self) -> None:
        """Play all matches, as at the start or when runs have been moved by a seek."""
        self.tree = [-1] * self.k
        if self.runs:
            self.winner = self._build(1)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.runs[a].head(), self.runs[b].head()
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.tree[node] = lose
        return win

    def peek(self):
        return self.runs[self.winner].head() if self.runs else None

    def pop(self):
        """The least remaining key, or None at the end."""
        if (key := self.peek()) is None:
            return None
        r = self.winner
        self.runs[r].step()
        node = (r + self.k) // 2
        while node >= 1:
            if self._beats(self.tree[node], r):
                self.tree[node], r = r, self.tree[node]
            node //= 2
        self.winner = r
        return key


def latest_scores(hits: DataFrame, group: str, item: str, score: str, at: str, tie: str) -> DataFrame:
    """group, item, score of the valid rows; the row with the latest `at`, then the largest `tie`, counts.

    Null group, item or score and NaN scores are left out. A null time or tie is smaller than any other; of rows equal
    in both the higher score counts. Minus zero counts as zero.
    """
    ok = F.col(group).isNotNull() & F.col(item).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)
    rows = hits.where(ok).select(F.col(group).alias("g"), F.col(item).alias("i"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"), F.col(at).alias("t"), F.col(tie).alias("b"))
    return rows.groupBy("g", "i").agg(F.max(F.struct("t", "b", "s")).alias("m")).select("g", "i", F.col("m.s").alias("s"))


def _head_of_groups(n: int):
    """Cuts sorted rows (bucket, g, neg, i) after `n` of each g."""

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0  # the group that the batch before ended in
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            codes = batch.column(1).dictionary_encode()
            ids = codes.indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            rank = np.arange(m) - np.repeat(starts, np.diff(np.r_[starts, m]))
            if codes.dictionary[int(ids[0])].as_py() == last:
                end = starts[1] if len(starts) > 1 else m
                rank[:end] += seen
            last, seen = codes.dictionary[int(ids[-1])].as_py(), int(rank[-1]) + 1
            yield batch.filter(pa.array(rank < n))

    return head


def store_runs(items: DataFrame, n: int, buckets: int) -> list[str]:
    """The files of the runs of `items` (g, i, s), sorted by (bucket, g, neg, i), neg being the negative score."""
    bucket = F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int").alias("bucket")
    rows = items.select(bucket, "g", (-F.col("s")).alias("neg"), "i").sortWithinPartitions("bucket", "g", "neg", "i")
    path = fresh(items.sparkSession, "runs")
    rows.mapInArrow(_head_of_groups(n), rows.schema).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return sorted(items.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())


def open_run(path: str, bucket: int) -> Run:
    """The rows of one bucket in a stored run, as keys (g, neg, i)."""
    fs, name = pafs.FileSystem.from_uri(path)
    file = pq.ParquetFile(fs.open_input_file(name))
    meta = file.metadata

    def ends(group: int, column: int) -> tuple | None:
        s = meta.row_group(group).column(column).statistics
        return (s.min, s.max) if s is not None and s.has_min_max else None

    own = [k for k in range(meta.num_row_groups) if (e := ends(k, 0)) is None or e[0] <= bucket <= e[1]]

    def load(page: int) -> list:
        t = file.read_row_group(own[page])
        t = t.filter(pc.equal(t.column(0), bucket))
        return list(zip(*[c.to_pylist() for c in t.columns[1:]], strict=True))

    def last(page: int):
        b, g = ends(own[page], 0), ends(own[page], 1)
        return (g[1],) if g is not None and b is not None and b[0] == b[1] else None

    return Run(len(own), load, last)


class _After:
    """Greater than every key of its group, less than those of later groups."""

    def __init__(self, group):
        self.group = group

    def __gt__(self, key) -> bool:
        return key[0] <= self.group

    def __lt__(self, key) -> bool:
        return key[0] > self.group


def best_of(runs: Sequence[Run], n: int) -> Iterator[tuple]:
    """g, i, s, rank of the `n` best of each group, group by group."""
    tree = LoserTree(runs)
    while (key := tree.peek()) is not None:
        group, rank = key[0], 0
        while rank < n and key is not None and key[0] == group:
            rank += 1
            tree.pop()
            yield group, key[2], -key[1], rank
            key = tree.peek()
        if key is not None and key[0] == group:
            after = _After(group)
            for run in runs:
                if (head := run.head()) is not None and head[0] == group:
                    run.seek(after)
            tree.build()


def merge_runs(items: DataFrame, n: int, buckets: int | None = None) -> DataFrame:
    """g, i, s, rank of the `n` best of each group of `items` (g, i, s).

    The file system of spark.checkpoint.dir must be one that Arrow opens by the same name (a shared mount, HDFS, S3 or
    GCS). As many runs are open in a task as `items` has partitions.
    """
    kinds, spark = dict(items.dtypes), items.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = store_runs(items, n, buckets)
    schema = f"g {kinds['g']}, i {kinds['i']}, s double, rank int"
    arrow = items.limit(0).select("g", "i").toArrow().schema
    fields = [("g", arrow.field(0).type), ("i", arrow.field(1).type), ("s", pa.float64()), ("rank", pa.int32())]

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in (b for batch in batches for b in batch.column(0).to_pylist()):
            out: list[tuple] = []
            for row in best_of([open_run(f, bucket) for f in files], n):
                out.append(row)
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], schema=pa.schema(fields))

    return spark.range(0, buckets, 1, buckets).mapInArrow(merged, schema)


def top_n(hits: DataFrame, group: str, item: str, score: str, at: str, tie: str, n: int = 10) -> DataFrame:
    """group, item, score, rank: the `n` best items of every group by score, ties to the smaller item.

    A group with fewer items has all of them; an empty table gives an empty result.
    """
    if n < 1:
        raise ValueError("n must be positive")
    best = merge_runs(latest_scores(hits, group, item, score, at, tie), n)
    return best.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
