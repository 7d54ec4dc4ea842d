"""Distinctive terms, term counts and top items: edge cases and brute force."""

import math
import random
from collections import Counter
from datetime import datetime

import pytest
from compare import heaviest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.llm import counts, topn, weights

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
POSTINGS = "docid bigint, term string, tf int, written_at timestamp"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_latest_postings(spark):
    data = [(1, "a", 1, T1), (1, "a", 5, T2), (1, "a", 9, None), (1, "b", 2, T1), (1, "b", 3, T1), (None, "a", 1, T1), (1, None, 1, T1), (2, "c", 0, T1), (2, "d", None, T2), (2, "d", 4, T1), (2, "e", -1, T1)]
    got = weights.latest_postings(spark.createDataFrame(data, POSTINGS), "docid", "term", "tf", "written_at")
    assert rows(got) == [(1, "a", 5), (1, "b", 3), (2, "d", 4)]


@pytest.mark.parametrize(("hot_rows", "hot_terms"), [(10, 100), (10, 1), (1 << 18, 100)])
def test_distinctive_postings_match_brute_force(spark, hot_rows, hot_terms, monkeypatch):
    monkeypatch.setattr(weights, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(weights, "HOT_TERMS", hot_terms)
    rnd = random.Random(5)
    tf = {(d, t): rnd.randint(1, 4) for d in range(-3, 40) for t in rnd.sample("the the2 of fox dog cat red sun zoo ox".split(), 4)}
    tf |= {(d, "the"): 1 for d in range(-3, 40)} | {(99, "alone"): 3}
    data = [(d, t, n, T2) for (d, t), n in tf.items()] + [(d, t, n + 7, T1) for (d, t), n in list(tf.items())[::3]]
    df = spark.createDataFrame(data, POSTINGS).withColumn("weight", F.lit("clash"))
    n, freq = len({d for d, _ in tf}), Counter(t for _, t in tf)
    want = {}
    for (d, t), x in tf.items():
        w = round((1 + math.log10(x)) * math.log10(n / freq[t]), 6)
        if freq[t] >= 2 and w > 0 and (d not in want or (-w, t) < want[d]):
            want[d] = (-w, t)
    got = weights.distinctive_postings(df, "docid", "term", "tf", "written_at").collect()
    assert {r.doc: r.term for r in got} == {d: t for d, (_, t) in want.items()}
    assert len(got) == len(want)


def test_no_task_gets_the_rows_of_a_hot_term(spark, monkeypatch):
    monkeypatch.setattr(weights, "HOT_ROWS", 5000)
    term = F.when(F.col("id") % 10 != 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), (F.col("id") % 3000).cast("string")))
    data = spark.range(100_000).select(F.col("id").alias("docid"), term.alias("term"), F.lit(1).alias("tf"), F.lit(None).cast("timestamp").alias("at"))
    assert 0 < heaviest(spark, lambda: weights.distinctive_postings(data, "docid", "term", "tf", "at").collect()) <= 2


def test_distinctive_postings_of_an_empty_table(spark):
    assert weights.distinctive_postings(spark.createDataFrame([], POSTINGS), "docid", "term", "tf", "written_at").collect() == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=30), st.integers(1, 5), st.integers(1, 7))
def test_degrees_match_brute_force(tokens, window, block):
    old, weights.BLOCK_TOKENS = weights.BLOCK_TOKENS, block
    try:
        terms, degree, tf = weights._degrees(tokens, window)
    finally:
        weights.BLOCK_TOKENS = old
    near = _near(tokens, window)
    assert dict(zip(terms, degree.tolist(), strict=True)) == {t: len(n) for t, n in near.items()}
    assert dict(zip(terms, tf.tolist(), strict=True)) == Counter(tokens)


def _near(tokens, window):
    return {t: {tokens[j] for i, x in enumerate(tokens) if x == t for j in range(max(0, i - window), min(len(tokens), i + window + 1))} - {t} for t in tokens}


@pytest.mark.parametrize("block", [1, 7, 1 << 18])
def test_graph_of_words_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(weights, "BLOCK_TOKENS", block)
    rnd = random.Random(block)
    data = [(str(i), [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 20))]) for i in range(60)]
    got = {(r.doc, r.term): (r.degree, r.tf) for r in weights.graph_of_words(spark.createDataFrame(data, "pid string, tokens array<string>"), "pid", "tokens", 3).collect()}
    want = {(i, t): (len(n), tokens.count(t)) for i, tokens in data for t, n in _near(tokens, 3).items()}
    assert got == want


def test_graph_of_words_edges(spark):
    df = spark.createDataFrame([("1", ["a", "b", None, "a", "c"]), ("2", []), ("3", None), (None, ["x"]), ("4", ["solo"]), ("5", ["w"] * 5000 + ["v"])], "pid string, tokens array<string>")
    got = {(r.doc, r.term): (r.degree, r.tf) for r in weights.graph_of_words(df, "pid", "tokens", 1).collect()}
    assert got == {("1", "a"): (2, 2), ("1", "b"): (1, 1), ("1", "c"): (1, 1), ("4", "solo"): (0, 1), ("5", "w"): (1, 5000), ("5", "v"): (1, 1)}
    with pytest.raises(ValueError):
        weights.graph_of_words(df, "pid", "tokens", 0)


RECORDS = "pid string, tokens array<string>, parsed_at timestamp"


def test_current_records(spark):
    data = [("1", ["a"], T1), ("1", ["b"], T2), ("1", None, None), ("2", [], T1), ("2", None, T2), (None, ["z"], T1), ("3", ["x"], None), ("3", [], T2)]
    got = counts.current_records(spark.createDataFrame(data, RECORDS), "pid", "tokens", "parsed_at")
    assert rows(got) == [("1", ["b"]), ("2", None), ("3", ["x"])]


def _state(data):
    occ, rec = Counter(), Counter()
    for tokens in data.values():
        occ.update(t for t in tokens or [] if t is not None)
        rec.update({t for t in tokens or [] if t is not None})
    return sorted((t, occ[t], rec[t]) for t in occ)


def _counts(store):
    return rows(counts.term_counts(store.counts())), store.counts().where("term is null").first().records


def test_batches_reach_the_same_state_as_a_full_count(spark, tmp_path):
    """Added, changed and deleted records, repeated rows, rows older than what is there."""
    rnd = random.Random(7)
    store, data, time = counts.Store(spark, f"file://{tmp_path}/s"), {}, 0
    for step in range(4):
        batch, gone = [], []
        for k in [str(i) for i in range(30)] if step == 0 else [*rnd.sample(sorted(data), 6), f"new{step}"]:
            time += 1
            tokens = [rnd.choice(["a", "b", "c", f"d{step}", None]) for _ in range(rnd.randint(1, 5))]
            batch += [(k, tokens, datetime(2024, 1, 1 + step, 0, 0, time))] * 2 + [(k, None, None), (k, ["old"], datetime(2020, 1, 1))]
            data[k] = tokens
        if step:
            gone = rnd.sample(sorted(data), 2)
        deleted = spark.createDataFrame([(k,) for k in [*gone, "never"]], "key string")
        store.apply(spark.createDataFrame([*batch, (None, ["z"], T1), (f"empty{step}", [], T1)], RECORDS), "pid", "tokens", "parsed_at", deleted if step else None)
        for k in gone:
            del data[k]
        data[f"empty{step}"] = None
        assert _counts(store) == (_state(data), len(data))
    assert store.apply(spark.createDataFrame([], RECORDS), "pid", "tokens", "parsed_at") == [0]
    assert _counts(store) == (_state(data), len(data))
    store.apply(spark.createDataFrame([], RECORDS), "pid", "tokens", "parsed_at", spark.createDataFrame([(k,) for k in data], "key string"))
    assert _counts(store) == ([], 0)
    with pytest.raises(ValueError):
        counts.signed_deltas(None, None)


def test_a_batch_rewrites_only_the_parts_of_its_terms(spark, tmp_path):
    store = counts.Store(spark, f"file://{tmp_path}/s")
    first = [(str(i), [f"t{j}" for j in range(i, i + 30)], T1) for i in range(40)]
    store.apply(spark.createDataFrame(first, RECORDS), "pid", "tokens", "parsed_at")
    before = store._version()[1]
    touched = store.apply(spark.createDataFrame([("x", ["t3", "t4"], T2)], RECORDS), "pid", "tokens", "parsed_at")
    after = store._version()[1]
    assert len(before) == counts.LEAST_PARTS and len(touched) <= 3
    assert {p for p in after if after[p] != before[p]} == set(touched)
    # a batch that was broken off before its manifest is not seen
    state = _counts(store)
    spark.range(1).write.parquet(f"file://{tmp_path}/s/counts-3/part=0")
    assert _counts(store) == state


def test_marks(spark, tmp_path):
    data = [(str(i), ["the"] + (["mid"] if i < 4 else []) + (["few"] if i < 2 else []), T1) for i in range(10)] + [("x", None, T1)]
    store = counts.Store(spark, f"file://{tmp_path}/s")
    assert store.counts().collect() == []
    store.apply(spark.createDataFrame(data, RECORDS), "pid", "tokens", "parsed_at")
    assert {r.term: r.mark for r in counts.marked(store.counts()).collect()} == {"the": "common", "mid": None, "few": "rare"}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9))), max_size=9))
def test_loser_tree_merges(runs):
    runs = [sorted(r) for r in runs]
    tree, out = topn.LoserTree([_run(r, 3) for r in runs]), []
    while (x := tree.pop()) is not None:
        out.append(x)
    assert out == sorted(x for r in runs for x in r)


def _run(keys, page, loaded=None, known=True):
    pages = [keys[k : k + page] for k in range(0, len(keys), page)]

    def load(n):
        if loaded is not None:
            loaded.append(n)
        return pages[n]

    return topn.Run(len(pages), load, lambda n: (pages[n][-1][0],) if known else None)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9), st.integers(0, 9)), max_size=30), max_size=5), st.integers(1, 4), st.booleans())
def test_merge_of_paged_runs_matches_brute_force(runs, n, known):
    want = []
    for g in range(6):
        own = sorted(x for r in runs for x in r if x[0] == g)[:n]
        want += [(g, i, -neg, k + 1) for k, (_, neg, i) in enumerate(own)]
    assert list(topn.best_of([_run(sorted(r), 4, known=known) for r in runs], n)) == want


def test_a_seek_passes_pages_unread():
    loaded = []
    run = _run([(0, k, k) for k in range(1000)] + [(1, 0, 0)], 10, loaded)
    assert list(topn.best_of([run, _run([(0, -1, 7)], 10)], 3)) == [(0, 7, 1, 1), (0, 0, 0, 2), (0, 1, -1, 3), (1, 0, 0, 1)]
    assert loaded == [0, 99, 100] or loaded == [0, 100]


HITS = "hit_id bigint, qid string, pid bigint, score double, scored_at timestamp"


def test_top_n_matches_brute_force(spark):
    rnd = random.Random(9)
    data = [(i, rnd.choice(["hot"] * 20 + ["a", "b", "c", None]), rnd.choice([rnd.randint(0, 400), None]), rnd.choice([1.0, 2.5, 0.0, -0.0, -3.0, float("inf"), float("nan"), None, rnd.random()]), rnd.choice([T1, T2, None])) for i in range(6000)]
    best = {}
    for h, q, p, s, t in data:
        if q is None or p is None or s is None or math.isnan(s):
            continue
        key = (t or datetime(1, 1, 1), h, s)
        if (q, p) not in best or key > best[q, p]:
            best[q, p] = key
    want = []
    for q in {q for q, _ in best}:
        ranked = sorted((-k[2], p) for (g, p), k in best.items() if g == q)[:7]
        want += [(q, p, -s + 0.0, i + 1) for i, (s, p) in enumerate(ranked)]
    df = spark.createDataFrame(data, HITS).repartition(6).withColumn("rank", F.lit("clash"))
    got = topn.top_n(df, "qid", "pid", "score", "scored_at", "hit_id", 7)
    assert rows(got) == sorted(want, key=repr)
    assert rows(topn.top_n(df.union(df), "qid", "pid", "score", "scored_at", "hit_id", 7)) == rows(got)


def test_top_n_edges(spark):
    empty = spark.createDataFrame([], HITS)
    assert topn.top_n(empty, "qid", "pid", "score", "scored_at", "hit_id").collect() == []
    with pytest.raises(ValueError):
        topn.top_n(empty, "qid", "pid", "score", "scored_at", "hit_id", 0)
    long_ = spark.createDataFrame([(1, "q" * 100_000, 1, 1.0, T1)], HITS)
    assert len(topn.top_n(long_, "qid", "pid", "score", "scored_at", "hit_id").first().qid) == 100_000


def test_top_n_groups_across_batches(spark):
    """Runs and groups that go over the border of an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        data = [(i, "ab"[i % 2], i, float(i % 17), T1) for i in range(200)]
        got = topn.top_n(spark.createDataFrame(data, HITS).repartition(5), "qid", "pid", "score", "scored_at", "hit_id", 4)
        want = [(q, p, -s, n + 1) for q in "ab" for n, (s, p) in enumerate(sorted((-x[3], x[2]) for x in data if x[1] == q)[:4])]
        assert rows(got) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
