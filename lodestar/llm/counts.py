"""Occurrences and record counts of every term, kept up to date by signed deltas.

The store holds the records as last seen and the counts, which lie in hash parts. A batch brings new rows of some
records: only records whose content it changes count. Each gives -1 for what it held and +1 for what it holds, the signs are
summed per term before and after the shuffle, and the sums are merged into the parts that hold those terms; other parts are
neither read nor written. A part that is rewritten goes into a new folder, and the last step names the folders that make
up the new version, so a failed batch leaves the old one whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar import storage

STATE = "term string, occurrences bigint, records bigint"
#: Terms of a part, about; the number of parts is set when the store is first filled.
PART_TERMS = 1 << 18
LEAST_PARTS = 8
#: The keys of a batch are broadcast to the records up to this number.
FEW_KEYS = 1 << 19


def latest(rows: DataFrame, key: str, tokens: str, at: str | None = None) -> DataFrame:
    """key, best (at, n, tokens): one row for every non-null key.

    Rows that share a key are copies or versions of one record. The latest by `at` counts among those with tokens, a
    null time being the oldest; without `at`, or at equal times, the longer list counts, then the greater one. A record
    none of whose rows has tokens is kept with a null list. The best of several is the greatest, so batches of rows can
    be reduced one by one.
    """
    have = F.when(F.size(tokens) > 0, F.col(tokens))
    time = F.when(have.isNotNull(), F.col(at).cast("timestamp")) if at else F.lit(None).cast("timestamp")
    best = F.max(F.struct(time.alias("at"), F.coalesce(F.size(have), F.lit(-1)).alias("n"), have.alias("tokens"))).alias("best")
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(best)


def current_records(rows: DataFrame, key: str, tokens: str, at: str | None = None) -> DataFrame:
    """key, tokens of `latest`."""
    return latest(rows, key, tokens, at).select("key", F.col("best.tokens").alias("tokens"))


def signed_deltas(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """term, occurrences, records as signed changes; the row with a null term carries the number of records alone.

    `before` and `after` are (key, tokens), one row per key, of the records touched only: an added record stands in
    `after`, a deleted one in `before`, a changed one in both. Null tokens within a list do not count.
    """
    signed = [d.select("key", "tokens", F.lit(s).alias("sign")) for d, s in ((before, -1), (after, 1)) if d is not None]
    if not signed:
        raise ValueError("no change given")
    all_ = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
    said = all_.select("sign", F.explode("tokens").alias("term"), F.lit(0).alias("record"))
    held = all_.select("sign", F.explode(F.array_distinct("tokens")).alias("term"), F.lit(1).alias("record"))
    counted = said.unionByName(held).where(F.col("term").isNotNull()).groupBy("term")  # merges on the map side
    change = counted.agg(F.sum(F.col("sign") * (1 - F.col("record"))).cast("bigint").alias("occurrences"), F.sum(F.col("sign") * F.col("record")).cast("bigint").alias("records"))
    touched = all_.agg(F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("occurrences"), F.coalesce(F.sum("sign"), F.lit(0)).cast("bigint").alias("records"))
    return change.where("occurrences <> 0 or records <> 0").unionByName(touched)


def merge(*parts: DataFrame) -> DataFrame:
    """The sum of states and deltas. Terms that no record holds any more disappear; the null term counts all records."""
    all_ = reduce(DataFrame.unionByName, parts)
    total = all_.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return total.where((F.col("records") != 0) | F.col("term").isNull())


@dataclass
class Store:
    """Persistent records and counts below `path`. Not for several writers at a time."""

    spark: SparkSession
    path: str

    def _version(self) -> tuple[int, dict[int, int], int]:
        """Number of the version, the version in which each part was last written, number of parts."""
        found = [int(p.rpartition("-")[2]) for p, _, _ in storage.children(self.spark, self.path) if "/manifest-" in p and storage.exists(self.spark, f"{p}/_SUCCESS")]
        if not found:
            return 0, {}, 0
        rows = self.spark.read.schema("part int, version int, parts int").parquet(f"{self.path}/manifest-{max(found)}").collect()
        return max(found), {r.part: r.version for r in rows if r.part is not None}, rows[0].parts

    def _read(self, at: dict[int, int]) -> DataFrame:
        files = [f"{self.path}/counts-{v}/part={p}" for p, v in sorted(at.items())]
        return self.spark.read.schema(STATE).parquet(*files) if files else self.spark.createDataFrame([], STATE)

    def counts(self) -> DataFrame:
        """term, occurrences, records of the current version; the null term counts all records."""
        return self._read(self._version()[1])

    def apply(self, rows: DataFrame, key: str, tokens: str, at: str | None = None, deleted: DataFrame | None = None) -> list[int]:
        """Take in new rows of records, and delete the records whose keys stand in `deleted` (key); the parts rewritten.

        A row of a known record replaces it if it is later, as `latest` has it. Deleting comes after the rows.
        """
        n, parts_at, parts = self._version()
        new = n + 1
        batch = latest(rows, key, tokens, at)
        batch = batch.withColumn("gone", F.lit(None).cast("boolean"))
        if deleted is not None:
            batch = batch.unionByName(deleted.where("key is not null").select(F.col("key"), F.lit(None).cast(batch.schema["best"].dataType).alias("best"), F.lit(True).alias("gone")))
            batch = batch.groupBy("key").agg(F.max("best").alias("best"), F.bool_or("gone").alias("gone"))
        none = F.lit(None).cast(batch.schema["best"].dataType)
        if n:
            batch = storage.cut(batch, "batch")
            keys = batch.select("key")
            held = self.spark.read.parquet(*[p for p, _, _ in storage.children(self.spark, f"{self.path}/records")]).where(F.col("version") <= n)
            held = held.join(F.broadcast(keys) if keys.count() <= FEW_KEYS else keys, "key", "left_semi")
            known = held.groupBy("key").agg(F.max(F.struct("version", "best", "gone")).alias("x")).where(~F.coalesce("x.gone", F.lit(False)))
            both = batch.join(known.select("key", F.col("x.best").alias("was"), F.lit(True).alias("known")), "key", "left")
        else:
            both = batch.select("*", none.alias("was"), F.lit(None).cast("boolean").alias("known"))
        gone = F.coalesce("gone", F.lit(False))
        both = both.withColumn("best", F.greatest("best", "was"))
        changed = both.where(F.when(gone, F.col("known")).otherwise(F.col("known").isNull() | ~F.col("best").eqNullSafe(F.col("was"))))
        at_ = f"{self.path}/records/{new:08d}"
        changed.select("key", "best", "was", "known", "gone", F.lit(new).alias("version")).write.mode("overwrite").parquet(at_)
        changed = self.spark.read.parquet(at_)
        before = changed.where("known").select("key", F.col("was.tokens").alias("tokens"))
        after = changed.where(~gone).select("key", F.col("best.tokens").alias("tokens"))
        delta = storage.cut(signed_deltas(before if n else None, after), "delta")
        if not n:
            parts = max(LEAST_PARTS, -(-delta.count() // PART_TERMS))
        part = F.coalesce(F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"), F.lit(0))
        touched = sorted(r[0] for r in delta.select(F.when(F.col("term").isNull(), F.lit(0)).otherwise(part).alias("p")).distinct().collect())
        state = merge(self._read({p: v for p, v in parts_at.items() if p in touched}), delta)
        state = state.withColumn("part", F.when(F.col("term").isNull(), F.lit(0)).otherwise(part))
        state.repartition(len(touched), "part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/counts-{new}")
        there = {int(p.rpartition("=")[2]) for p, _, _ in storage.children(self.spark, f"{self.path}/counts-{new}")}
        now = {p: v for p, v in parts_at.items() if p not in touched} | {p: new for p in touched if p in there}
        self.spark.createDataFrame([(p, v, parts) for p, v in now.items()], "part int, version int, parts int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest-{new}")
        return touched


def term_counts(state: DataFrame) -> DataFrame:
    return state.where(F.col("term").isNotNull())


def marked(state: DataFrame, min_records: int = 3, max_percent: int = 40) -> DataFrame:
    """term, occurrences, records, mark: `rare` in fewer than `min_records` records, `common` in more than
    `max_percent` % of all records, else null. A term that is both is `rare`."""
    n = state.where(F.col("term").isNull()).agg(F.max("records").alias("n")).scalar()
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") * 100 > n * max_percent, "common")
    return term_counts(state).withColumn("mark", mark)
