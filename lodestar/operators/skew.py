"""Per-key results when a few keys hold most of the rows.

Nothing here sends the values of one key to one task. Rows are first counted in the cells of a histogram, which merge
on the map side; cells are merged into coarser ones, level by level, each of which divides into CELLS of the level below.
A rank is then found from the top: at each level the running counts within one coarse cell say in which of its cells
the rank lies, until that is a cell of one value. So a group that meets in one task has at most CELLS rows, for hot keys
and others alike, at any size; no level and no state is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.storage import cut

#: Cells that a cell of the level above divides into: a power of two.
CELLS_BITS = 8
CELLS = 1 << CELLS_BITS
#: Values of one word of a bitmap, as bits.
WORD_BITS = 6


def _levels(finest: DataFrame, keys: Sequence[str]) -> list[DataFrame]:
    """The histogram `finest` (keys, _cell, _n) and its coarser levels, up to the one where no key has more than CELLS
    cells. Only the least and the greatest cell of all are taken to the driver."""
    low, high = finest.agg(F.min("_cell"), F.max("_cell")).first()
    levels = [finest]
    while low is not None and high - low >= CELLS:
        low, high = low >> CELLS_BITS, high >> CELLS_BITS
        up = levels[-1].groupBy(*keys, F.shiftright("_cell", CELLS_BITS).alias("_cell")).agg(F.sum("_n").alias("_n"))
        levels.append(cut(up, "level") if high - low >= CELLS else up)
    return levels


def _resolve(levels: list[DataFrame], wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`wanted` (keys, _rank, other columns) with _cell, the cell of the finest level that holds the value of that rank
    (from 1), and _rank within that cell; ranks beyond a key's last value and keys without values are dropped.

    Each level goes to where its coarse cells are (by keys and coarse cell), is summed up there and met by the ranks.
    """
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    own = [c for c in wanted.columns if c not in keys and c != "_rank"]
    state = wanted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *own, "_rank", F.lit(0).cast("bigint").alias("_in"))
    for depth, level in enumerate(reversed(levels)):
        parent = F.lit(0).cast("bigint") if depth == 0 else F.shiftright("_cell", CELLS_BITS)
        cells = level.select(*keys, "_cell", "_n", parent.alias("_parent"))
        run = Window.partitionBy(*keys, "_parent").orderBy("_cell")
        cells = cells.withColumn("_upto", F.sum("_n").over(run))
        hit = cells.join(state, reduce(lambda a, b: a & b, on) & (F.col("_parent") == F.col("_in")))
        hit = hit.where((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        state = hit.select(*[f"_k{i}" for i in range(len(keys))], *own, (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"), F.col("_cell").alias("_in"))
    return state.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], *own, "_rank", F.col("_in").alias("_cell"))


def _words(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, _cell, _bits, _n: which of 64 neighbouring values occur, and how many of them; 0 of the null cell.

    Rows of a hot key combine on the map side, and its cells are spread over all partitions."""
    bit = F.expr(f"shiftleft(1L, cast(cast(`{value}` as bigint) & 63L as int))").alias("_bit")
    words = df.select(*keys, F.shiftright(F.col(value).cast("bigint"), WORD_BITS).alias("_cell"), bit)
    words = words.groupBy(*keys, "_cell").agg(F.bit_or("_bit").alias("_bits"))
    return words.select(*keys, "_cell", "_bits", F.coalesce(F.bit_count("_bits"), F.lit(0)).cast("bigint").alias("_n"))


def _bit_of_rank(bits: Column, rank: Column) -> Column:
    """The place of the set bit of that rank, by halves: the count below decides which half it is in."""
    at, rest = F.lit(0), rank
    for half in (32, 16, 8, 4, 2, 1):
        mask = F.lit((1 << half) - 1).cast("bigint")
        below = F.bit_count(F.call_function("shiftrightunsigned", bits, at).bitwiseAND(mask)).cast("bigint")
        above = rest > below
        at, rest = F.when(above, at + half).otherwise(at), F.when(above, rest - below).otherwise(rest)
    return at


def distinct_per_key(df: DataFrame, keys: Sequence[str], value: str, out: str = "n_distinct") -> DataFrame:
    """keys, number of different non-null integers in `value`: the counts of a histogram of distinct values, merged.

    A null key is a key of its own; null values do not count, and a key that has no other has 0. Repeated rows change
    nothing; an empty table gives an empty result.
    """
    top = _levels(cut(_words(df, keys, value), "words"), keys)[-1]
    return top.groupBy(*keys).agg(F.sum("_n").alias(out))


def wrong_counts(entries: DataFrame, rows: DataFrame, keys: Sequence[str], count: str, value: str) -> DataFrame:
    """The different keys of `entries` whose `count` is null or not the distinct count of `value` in `rows`.

    A count n is right if there is a distinct value of rank n, and none of rank n + 1. Both ranks are looked for in the
    histogram of distinct values; whether a rank is there resolves on the coarsest level, so the finer ones, of which
    its counts are the sums, are not gone through again. An entry without rows should say 0. Repeated entries give one
    row, and one wrong entry among several of a key is enough. Null keys match null keys.
    """
    claims = entries.select(*keys, F.col(count).cast("bigint").alias("_claim")).distinct()
    top = _levels(cut(_words(rows, keys, value), "words"), keys)[-1:]
    ranks = claims.select(*keys, "_claim", F.explode(F.array(F.col("_claim"), F.col("_claim") + 1)).alias("_rank"))
    found = _resolve(top, ranks.withColumn("_past", F.col("_rank") > F.col("_claim")).where("_rank > 0"), keys)
    both = claims.withColumn("_past", F.lit(None).cast("boolean")).unionByName(found.select(*keys, "_claim", "_past"))
    held = both.groupBy(*keys, "_claim").agg(F.coalesce(F.bool_or(~F.col("_past")), F.lit(False)).alias("_last"), F.coalesce(F.bool_or("_past"), F.lit(False)).alias("_more"))
    right = (F.col("_last") | (F.col("_claim") == 0)) & ~F.col("_more")
    return held.where(~F.coalesce(right, F.lit(False))).select(*keys).distinct()


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """keys, percent, value: the exact `percent` quantile of every key, the value of rank max(1, ceil(n p / 100)).

    All keys go the same way, through a histogram with one cell to a value and its coarser levels: 8 levels at most for
    64-bit values. Null values do not count and keys without other values have no row; null keys are keys; equal values
    are ranked as often as they occur. An empty table gives an empty result.
    """
    if not percents or any(not 0 < p <= 100 for p in percents):
        raise ValueError("percents must lie in 1..100")
    values = df.select(*keys, F.col(value).cast("bigint").alias("_cell")).where(F.col("_cell").isNotNull())
    levels = _levels(cut(values.groupBy(*keys, "_cell").agg(F.count("*").alias("_n")), "values"), keys)
    total = levels[-1].groupBy(*keys).agg(F.sum("_n").alias("_total"))
    wanted = total.select(*keys, "_total", F.explode(F.array(*[F.lit(int(p)) for p in percents])).alias("percent"))
    wanted = wanted.select(*keys, "percent", F.expr("greatest(1L, (_total * percent + 99) div 100)").alias("_rank"))
    return _resolve(levels, wanted, keys).select(*keys, "percent", F.col("_cell").alias("value"))


def distinct_quantiles(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[int]) -> DataFrame:
    """As `exact_quantiles`, of the different values of each key, each ranked once: by bitmaps of 64 values."""
    if not percents or any(not 0 < p <= 100 for p in percents):
        raise ValueError("percents must lie in 1..100")
    words = cut(_words(df, keys, value), "words")
    levels = _levels(words, keys)
    total = levels[-1].groupBy(*keys).agg(F.sum("_n").alias("_total"))
    wanted = total.select(*keys, "_total", F.explode(F.array(*[F.lit(int(p)) for p in percents])).alias("percent"))
    wanted = wanted.select(*keys, "percent", F.expr("greatest(1L, (_total * percent + 99) div 100)").alias("_rank"))
    found = _resolve(levels, wanted, keys)
    bits = words.select(*[F.col(k).alias(f"_w{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_word"), "_bits")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_w{i}")) for i, k in enumerate(keys)])
    hit = found.join(bits, on & (F.col("_cell") == F.col("_word")))
    return hit.select(*keys, "percent", (F.shiftleft("_cell", WORD_BITS) + _bit_of_rank(F.col("_bits"), F.col("_rank"))).alias("value"))
