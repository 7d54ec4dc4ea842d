"""Skew-safe aggregation and record parsing: edge cases and brute force on small tables."""

import math
import random

import pytest
from compare import heaviest
from pyspark.sql import functions as F

from lodestar.operators import index as ix
from lodestar.operators import records, skew


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def skewed():
    rnd = random.Random(1)
    data = [("hot", rnd.choice([rnd.randint(-(10**6), 10**6), 7, None])) for _ in range(3000)]
    data += [(rnd.choice(["a", "b", "c", None]), rnd.choice([rnd.randint(0, 9), None])) for _ in range(200)]
    return data + [("none", None), ("edge", 2**63 - 1), ("edge", -(2**63)), ("one", 5)]


def test_distinct_counts_match_brute_force(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, v bigint")
    want = {k: len({v for kk, v in skewed if kk == k and v is not None}) for k, _ in skewed}
    assert {r.k: r.n_distinct for r in skew.distinct_per_key(df, ["k"], "v").collect()} == want
    assert rows(skew.distinct_per_key(df.union(df), ["k"], "v")) == rows(skew.distinct_per_key(df, ["k"], "v"))


@pytest.mark.parametrize("bits", [1, 3, 8])
@pytest.mark.parametrize("distinct", [False, True])
def test_quantiles_match_brute_force(spark, skewed, bits, distinct, monkeypatch):
    """However many levels the histogram has."""
    monkeypatch.setattr(skew, "CELLS_BITS", bits)
    monkeypatch.setattr(skew, "CELLS", 1 << bits)
    data = [(k, v) for k, v in skewed if bits == 8 or v is None or abs(v) < 10**6]
    df = spark.createDataFrame(data, "k string, v bigint")
    want = []
    for k in {k for k, _ in data}:
        v = sorted(x for kk, x in data if kk == k and x is not None)
        v = sorted(set(v)) if distinct else v
        want += [(k, p, v[max(1, math.ceil(len(v) * p / 100)) - 1]) for p in (1, 50, 90, 100) if v]
    found = (skew.distinct_quantiles if distinct else skew.exact_quantiles)(df, ["k"], "v", [1, 50, 90, 100])
    assert rows(found) == sorted(want, key=repr)


def test_quantiles_of_an_empty_table_and_bad_percents(spark):
    empty = spark.createDataFrame([], "k string, v bigint")
    assert skew.exact_quantiles(empty, ["k"], "v", [50]).collect() == []
    assert skew.distinct_per_key(empty, ["k"], "v").collect() == []
    with pytest.raises(ValueError):
        skew.exact_quantiles(empty, ["k"], "v", [0])


def test_wrong_counts(spark):
    entries = spark.createDataFrame([(1, "a", 2), (1, "a", 2), (1, "b", 1), (1, "c", None), (2, "a", 0), (2, "b", 3), (None, "n", 1)], "p int, t string, df int")
    data = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (1, "a", 6), (1, "b", None), (1, "c", 1), (2, "b", 1), (None, "n", 9)], "p int, t string, d bigint")
    found = skew.wrong_counts(entries.withColumn("d", F.lit("clash")), data, ["p", "t"], "df", "d")
    assert rows(found) == [(1, "b"), (1, "c"), (2, "b")]
    assert rows(skew.wrong_counts(entries, data.limit(0), ["p", "t"], "df", "d")) == [(1, "a"), (1, "b"), (1, "c"), (2, "b"), (None, "n")]
    assert skew.wrong_counts(entries.limit(0), data, ["p", "t"], "df", "d").collect() == []
    negative = spark.createDataFrame([(1, "a", -1), (2, "b", -1)], "p int, t string, df int")
    assert rows(skew.wrong_counts(negative, data, ["p", "t"], "df", "d")) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize(
    ("line", "reason", "field"),
    [
        ("12\tfoo", None, None),
        ('"12"\tfoo', None, None),
        ('12\t"a\tb ""c"" d"', None, None),
        ('12\ta "quoted" word', None, None),
        ("000000000012\tx", None, None),
        ("2147483647\tx", None, None),
        ('7\t""""', None, None),
        ("2147483648\tx", "value", "pid"),
        ("99999999999\tx", "value", "pid"),
        ("-1\tx", "value", "pid"),
        ("1 \tx", "value", "pid"),
        ("١٢\tx", "value", "pid"),
        ("﻿1\tx", "value", "pid"),
        ("\tx", "value", "pid"),
        ("1\t", "value", "text"),
        ("1\t 　\x85", "value", "text"),
        ('1\t"  "', "value", "text"),
        ('1\t" \t "', "value", "text"),
        ('1\t""', "value", "text"),
        (None, "empty", "pid"),
        ("", "empty", "pid"),
        (" \t  ", "empty", "pid"),
        ('1\t"open', "quoting", "text"),
        ('1\t"closed" after', "quoting", "text"),
        ('1\t"odd"" end', "quoting", "text"),
        ('"1\tx', "quoting", "pid"),
        ('1\tx\t"open', "quoting", None),
        ("1", "columns", "text"),
        ("1\tx\ty", "columns", None),
        ("1\tx\t", "columns", None),
        ("1|x", "columns", "pid"),
    ],
)
def test_record_reasons(spark, line, reason, field):
    df = spark.createDataFrame([(line,)], "line string")
    got = records.parse_records(df, "line", records.COLLECTION).first()
    assert (got.reason, got.broken_field) == (reason, field)
    assert (got.pid is None) == (reason is not None)


def test_record_values_long_lines_and_clashing_columns(spark):
    long_ = "x" * 200_000 + '""' * 50_000
    data = [(1, '5\t"' + long_ + '"', "old"), (1, '6\t"a ""b"" c"', "old"), (2, '7\t"' + long_ + '" tail', "old")]
    df = spark.createDataFrame(data, "line_no int, line string, text string")
    got = records.parse_records(df, "line", records.COLLECTION)
    assert got.columns == ["line_no", "line", "pid", "text", "reason", "broken_field"]
    found = {r.pid: r for r in got.collect()}
    assert found["5"].text == "x" * 200_000 + '"' * 50_000
    assert found["6"].text == 'a "b" c'
    assert found[None].reason == "quoting"
    assert records.parse_records(df.limit(0), "line", records.COLLECTION).collect() == []


def test_integer_patterns():
    import re

    for limit in (0, 7, 10, 99, 2048, 2147483647):
        pattern = re.compile(records.integer_at_most(limit))
        for n in {0, 1, 9, 10, limit - 1, limit, limit + 1, limit * 10, 2 * limit} - {-1}:
            assert bool(pattern.fullmatch(str(n))) == (n <= limit), (limit, n)


@pytest.fixture(scope="module")
def hot(spark):
    """200,000 postings, 90 % of one term."""
    term = F.when(F.col("id") % 10 != 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") % 90000).cast("string")))
    return spark.range(200_000).select(term.alias("term"), F.xxhash64("id").bitwiseAND(F.lit(0xFFFFFF)).alias("doc_id"), F.lit(1).alias("tf")).dropDuplicates(["term", "doc_id"])


@pytest.mark.parametrize("operator", ["quantiles", "counts", "blocks", "seek"])
def test_no_task_gets_the_rows_of_a_hot_key(spark, hot, operator, monkeypatch):
    monkeypatch.setattr(ix, "RANGE_BITS", 14)
    targets = hot.where("doc_id % 97 = 0").select("term", F.col("doc_id").alias("target"))
    run = {
        "quantiles": lambda: skew.exact_quantiles(hot, ["term"], "doc_id", [50, 99]).collect(),
        "counts": lambda: skew.wrong_counts(hot.select("term", F.lit(1).alias("df")).distinct(), hot, ["term"], "df", "doc_id").collect(),
        "blocks": lambda: ix.blocks(hot).select("term", "block_no", "n").collect(),
        "seek": lambda: ix.next_at_least(hot, targets).collect(),
    }[operator]
    # the stages of a seek are unions: half of their tasks read the few targets, so the mean is half of a share
    assert 0 < heaviest(spark, run) <= (2 if operator != "seek" else 2.5)
