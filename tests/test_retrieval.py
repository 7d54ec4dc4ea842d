"""Tokenising, codecs, index and search: tables of cases, golden bytes, brute force and properties."""

import math
import random
import tarfile
import time
from collections import Counter

import pytest
from compare import SF, heaviest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.functions import codec, scoring, stem, text
from lodestar.operators import index as ix
from lodestar.operators import prune, search
from lodestar.plans import retrieval
from lodestar.sources import collection, runfile


@pytest.mark.parametrize(
    ("given_text", "terms"),
    [
        ("a <b>x</b> c", ["a", "x", "c"]),
        ("a < b > c", ["a", "c"]),
        ("don't stop", ["don", "t", "stop"]),
        ("&amp;", ["amp"]),
        ("café ok", ["ok"]),
        ("a" * 40 + "b" * 23, ["aabb"]),
        ("ab" * 31 + "c", ["ab" * 31 + "c"]),
        ("ab" * 32, []),
        ("a" * 70, []),
        ("cooool www 10000 aab aaa", ["cool", "ww", "10000", "aab", "aa"]),
        ("x \t y", ["x", "", "y"]),
        ("\ttab", ["tab"]),
        ("in\tside", ["in\tside"]),
        ("one\ntwo\r\nthree", ["one", "two", "three"]),
        ("K x", ["k", "x"]),
        ("Kx", ["kx"]),
        ("İ x", ["x"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, given_text, terms):
    df = spark.createDataFrame([(given_text,)], "t string")
    assert df.select(text.tokens(F.col("t")).alias("x")).first().x == terms


@pytest.mark.parametrize(("sql", "n"), [("repeat('abcdefgh', 655360)", 0), ("repeat('<', 5242880)", 0), ("repeat('<>', 2621440)", 0), ("concat('>', repeat('<', 2621440))", 0), ("repeat('<a', 2621440)", 2621440), ("repeat('\t', 5242880)", 0), ("repeat('a\u0001', 2621440)", 0), ("repeat('ab ', 1000000)", 1000000)])
def test_time_of_long_texts_is_linear(spark, sql, n):
    began = time.time()
    assert spark.range(1).select(F.size(text.tokens(F.expr(sql))).alias("n")).first().n == n
    assert time.time() - began < 60


def test_stopwords_keep_duplicates_of_others(spark):
    terms = spark.createDataFrame([(1, "the"), (1, "cat"), (1, "cat"), (1, "of")], "doc_id int, term string")
    left = text.without_stopwords(terms, collection.read_stopwords(spark))
    assert sorted(r.term for r in left.collect()) == ["cat", "cat"]


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("triplicate", "triplic"), ("electrical", "electr"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("2nd", "2nd")],
)
def test_stem(word, want):
    assert stem.stem(word) == want


def signed(data):
    return [b - 256 if b > 127 else b for b in data]


def test_codec_goldens():
    assert signed(codec.unary([3, 10, 1, 2])) == [-17, -3, 96]
    assert codec.unary_decode(bytes([239, 253, 96]), 4).tolist() == [3, 10, 1, 2]
    assert codec.unary_decode(bytes([255, 255, 15, 224]), 5).tolist() == [16, 0, 0, 0, 7]
    assert codec.unary_get(bytes([239, 253, 96]), 4, 1) == 10
    assert codec.unary_get(bytes([239, 253, 96]), 4, 3) == 2
    assert [codec.low_width(u, n) for u, n in ((32, 7), (32, 8), (127, 8), (5, 1), (1200, 1200))] == [3, 2, 4, 3, 0]
    assert codec.elias_fano_size(12, 4) == 2
    a = [16, 18, 24, 25, 26, 30, 32]
    assert signed(codec.elias_fano(a)) == [8, 21, -128, 55, -96]
    assert signed(codec.elias_fano([1024, 1025, 10000, 10001])) == [64, 4, 1, 113, 7, 17, -52]
    c = [*range(1, 11), 512]
    assert signed(codec.elias_fano(c)) == [4, 32, -60, 20, 97, -56, 36, -96, 0, -1, -64, 32]
    assert [codec.elias_fano_get(codec.elias_fano(a), 7, 32, i) for i in (0, 2, 8)] == [16, 24, 2147483647]
    assert codec.elias_fano_get(codec.elias_fano(c), 11, 512, 10) == 512


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.tuples(st.just("u"), st.integers(0, 40)), st.tuples(st.integers(1, 33), st.integers(0, 2**33 - 1))), max_size=30), st.integers(0, 20))
def test_bits_at_an_offset(values, first):
    data, at = bytearray(b"\xff" * 400), first
    values = [(k, v if k == "u" else v % (1 << k)) for k, v in values]
    for k, v in values:
        at = codec.write_unary(data, at, v) if k == "u" else codec.write_bits(data, at, k, v)
    assert all(b == 255 for b in data[: first // 8]) and all(b == 255 for b in data[-(-at // 8) :])
    at = first
    for k, v in values:
        if k == "u":
            got, at = codec.read_unary(bytes(data), at)
        else:
            got, at = codec.read_bits(bytes(data), at, k), at + k
        assert got == v


@pytest.mark.parametrize("n", [25, 100, 1000])
def test_unary_size(n):
    assert codec.unary_size(range(1, n + 1)) == math.ceil((n * (n + 1) // 2 + n) / 8)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 10**6), min_size=1, max_size=200), st.lists(st.integers(0, 50), min_size=1, max_size=200))
def test_codec_round_trip(ids, freqs):
    x = sorted(ids)
    data = codec.elias_fano(x)
    assert codec.elias_fano_decode(data, len(x), x[-1]).tolist() == x
    assert len(data) <= codec.elias_fano_size(x[-1], len(x))
    assert codec.unary_decode(codec.unary(freqs), len(freqs)).tolist() == freqs


@pytest.mark.parametrize("n", [10, 100, 1000, 10000])
def test_posting_blocks(spark, n):
    post = spark.range(1, n + 1).select(F.lit("t").alias("term"), F.col("id").alias("doc_id"), F.col("id").alias("tf"))
    cut = ix.blocks(post).orderBy("block_no").collect()
    size = math.isqrt(n) if 4 * n > 2048 else n
    assert [r.n for r in cut] == [size] * (n // size) + ([n % size] if n % size else [])
    assert [i for r in cut for i in r.doc_ids] == list(range(1, n + 1))
    back = ix.decompress(ix.compress(ix.blocks(post, 128, True)))
    assert sorted(i for r in back.collect() for i in r.doc_ids) == list(range(1, n + 1))


def brute(docs, query, model, conjunctive=False):
    toks = {d: Counter(t.lower().split()) for d, t in docs}
    n, total = len(docs), sum(sum(c.values()) for c in toks.values())
    df = Counter(t for c in toks.values() for t in c)
    known = [t for t in query.lower().split() if t in df]
    out = {}
    for d, c in toks.items():
        if conjunctive and not all(t in c for t in known):
            continue
        s = 0.0
        for t in known:
            if c[t]:
                idf = math.log10(n / df[t])
                s += (c[t] / (1.5 * (0.3 + 0.7 * sum(c.values()) / (total / n)) + c[t]) if model == "bm25" else 1 + math.log10(c[t])) * idf
        if round(s, 6) > 0:
            out[d] = round(s, 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice("red blue green fox dog cat sun moon".split()) for _ in range(rnd.randint(0, 12)))) for i in range(60)]
    docs += [(60, docs[0][1]), (61, None), (62, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    return [(d, t or "") for d, t in docs], ix.build(df)


@pytest.mark.parametrize("model", scoring.MODELS)
@pytest.mark.parametrize("conjunctive", [False, True])
def test_search_matches_brute_force(spark, corpus, model, conjunctive):
    docs, index = corpus
    asked = [("1", "red fox"), ("2", "red red moon unknown"), ("3", "unknown"), ("4", " "), ("5", None), ("6", "cat dog sun blue")]
    got = search.search_batch(spark.createDataFrame(asked, "qid string, query_text string"), index, 7, model, conjunctive).collect()
    for qid, q in asked:
        have = sorted([(r.rank, r.doc_id, r.score) for r in got if r.qid == qid])
        want = brute(docs, q or "", model, conjunctive)[:7] if (q or "").split() and (q != "unknown") else []
        assert [(d, pytest.approx(s, abs=2e-6)) for d, s in want] == [(d, s) for _, d, s in have]
        assert [r for r, _, _ in have] == list(range(1, len(have) + 1))


def test_conjunctive_is_within_disjunctive_and_strict(spark):
    # a document with one of two terms must not come back however high it scores
    docs = spark.createDataFrame([(1, "a b"), (2, "b b b b"), (3, "c"), (4, "c")], "doc_id bigint, text string")
    index = ix.build(docs)
    assert [r.doc_id for r in search.search(spark, index, "+a b", 1).collect()] == [1]
    assert [r.doc_id for r in search.search(spark, index, "+a zzz", 5).collect()] == [1]
    assert search.search(spark, index, "+a c", 5).collect() == []
    assert search.search(spark, index, "   ", 5).collect() == []
    assert [r.doc_id for r in search.search(spark, index, "a b", 9).collect()] == [1, 2]
    with pytest.raises(ValueError):
        search.search(spark, index, "a", 0)
    with pytest.raises(ValueError):
        search.search(spark, index, "a", 1, "BM26")


def test_term_in_every_document_scores_nothing(spark):
    index = ix.build(spark.createDataFrame([(1, "x y"), (2, "x")], "doc_id bigint, text string"))
    assert search.search(spark, index, "x", 5).collect() == []
    assert [r.doc_id for r in search.search(spark, index, "x y", 5).collect()] == [1]


@pytest.mark.parametrize("strongest", [1, 2, 8])
def test_pruned_equals_exhaustive(spark, corpus, strongest):
    _, index = corpus
    asked = spark.createDataFrame([("1", "red fox moon moon"), ("2", "cat sun green dog blue"), ("3", "fox")], "qid string, query_text string")
    terms = search.query_terms(asked)
    full = sorted(map(tuple, search.top_k(search.score(terms, index), 5).collect()))
    assert sorted(map(tuple, prune.pruned_top_k(terms, index, 5, strongest=strongest).collect())) == full


def test_partial_merge_equals_single_pass(spark, corpus):
    docs, index = corpus
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    merged = ix.merge_partials([ix.postings_of(df.where(F.col("doc_id") % 3 == r)) for r in range(3)])
    assert sorted((r.term, r.df) for r in merged.collect()) == sorted((r.term, r.df) for r in index.lexicon.collect())


def test_index_is_saved_and_replaced(spark, corpus, tmp_path):
    docs, index = corpus
    for _ in range(2):
        ix.save(index, f"file://{tmp_path}/ix")
    back = ix.load(spark, f"file://{tmp_path}/ix")
    assert back.stats.first().n_docs == len(docs)
    assert back.parsed is False
    want = [tuple(r) for r in search.search(spark, index, "red fox").collect()]
    assert [tuple(r) for r in search.search(spark, back, "red fox").collect()] == want


def test_compressed_index_is_saved_and_searched(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "BLOCK_BYTES", 64)
    docs = [(i - 40, " ".join("abcdefgh"[j % 8] * 2 for j in range(i % 11)) + " common" * (1 + i % 3)) for i in range(700)]
    plain = ix.build(spark.createDataFrame(docs, "doc_id bigint, text string"))
    ix.save(plain, f"file://{tmp_path}/ix", compressed=True)
    back = ix.load(spark, f"file://{tmp_path}/ix")
    assert back.blocks.where("term = 'common'").count() > 20
    targets = spark.createDataFrame([(t, x) for t in ("common", "aa", "zz") for x in (-100, -40, 0, 7, 300, 659, 660)], "term string, target bigint")
    want = sorted(map(tuple, ix.next_at_least(plain.postings, targets).collect()), key=repr)
    assert sorted(map(tuple, ix.next_at_least_in_blocks(back.blocks, targets).select("term", "target", "doc_id").collect()), key=repr) == want
    near = ix.postings_at(back, spark.createDataFrame([("common", 100)], "term string, doc_id bigint"))
    assert 0 < near.count() < 60 and near.where("doc_id = 100").count() == 1
    assert sorted(map(tuple, back.postings.collect())) == sorted(map(tuple, plain.postings.collect()))
    asked = spark.createDataFrame([("1", "aa bb common"), ("2", "common")], "qid string, query_text string")
    for conjunctive in (False, True):
        want = sorted(map(tuple, search.search_batch(asked, plain, 9, conjunctive=conjunctive).collect()))
        assert sorted(map(tuple, search.search_batch(asked, back, 9, conjunctive=conjunctive).collect())) == want


def test_common_terms_are_dealt_to_several_tasks(spark, tmp_path, monkeypatch):
    words = F.concat(F.lit("common "), F.lit("w"), (F.col("id") % 5000).cast("string"), F.lit(" x"), (F.col("id") % 7000).cast("string"))
    index = ix.build(spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "w1").otherwise(words).alias("text")))
    ix.save(index, f"file://{tmp_path}/plain")
    monkeypatch.setattr(ix, "HOT_ROWS", 1000)
    ix.save(index, f"file://{tmp_path}/dealt")
    plain, dealt = (ix.load(spark, f"file://{tmp_path}/{n}") for n in ("plain", "dealt"))
    assert plain.hot is None and [(r.term, r.slots) for r in dealt.hot.collect()] == [("common", 40)]
    asked = spark.createDataFrame([(str(k), f"common w{k} x{k}") for k in range(60)], "qid string, query_text string")
    for conjunctive in (False, True):
        want = sorted(map(tuple, search.search_batch(asked, plain, 5, conjunctive=conjunctive).collect()))
        assert sorted(map(tuple, search.search_batch(asked, dealt, 5, conjunctive=conjunctive).collect())) == want
    assert heaviest(spark, lambda: search.contributions(search.query_terms(asked), dealt, "bm25").count()) <= 2


def test_a_broken_off_save_leaves_the_index(spark, corpus, tmp_path):
    _, index = corpus
    path = f"file://{tmp_path}/ix"
    ix.save(index, path)
    index.postings.limit(1).write.parquet(f"{path}/v2/postings")
    assert ix.load(spark, path).postings.count() == index.postings.count()
    with pytest.raises(ix.IndexMissing):
        ix.load(spark, f"file://{tmp_path}/none")


@pytest.mark.parametrize("bits", [5, 16])
def test_a_common_term_is_split(spark, bits, monkeypatch):
    """Blocks and seeks are the same however narrow the ranges that a task sees."""
    monkeypatch.setattr(ix, "RANGE_BITS", bits)
    post = spark.range(0, 9000, 3).select(F.lit("t").alias("term"), F.col("id").alias("doc_id"), F.lit(1).alias("tf"))
    found = ix.blocks(post).orderBy("block_no").collect()
    assert [len(r.doc_ids) for r in found] == [54] * 55 + [30] and [i for r in found for i in r.doc_ids] == list(range(0, 9000, 3))
    few = post.where("doc_id % 1000 = 0").union(spark.createDataFrame([("t", 50_000, 1), ("u", -7, 1)], post.schema))
    ids = [0, 3000, 6000, 50_000]
    asked = [("t", x) for x in (-100, 0, 1, 2999, 3000, 3001, 6001, 49_999, 50_000, 50_001, 10**9)] + [("u", -8), ("u", -7), ("u", -6), ("v", 0)]
    got = {(r.term, r.target): r.doc_id for r in ix.next_at_least(few, spark.createDataFrame(asked, "term string, target bigint")).collect()}
    assert got == {(t, x): next((i for i in {"t": ids, "u": [-7], "v": []}[t] if i >= x), None) for t, x in asked}


def test_intermediate_tables_are_deleted(spark):
    from lodestar import storage

    there = lambda: {p for p, _, _ in storage.children(spark, storage.shared_dir(spark))}
    before = there()
    with storage.scratch(spark):
        ix.build(spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")).lexicon.collect()
        assert there() > before
    assert there() == before


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    from types import SimpleNamespace

    from lodestar import storage

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: ""), sparkContext=SimpleNamespace(master="spark://h:7077"))
    with pytest.raises(storage.NoSharedFolder):
        storage.shared_dir(session)


def test_parsed_index_stems_queries_too(spark):
    docs = spark.createDataFrame([(1, "running the foxes"), (2, "a runner"), (3, "moon")], "doc_id bigint, text string")
    index = ix.build(docs, parsed=True, stop=collection.read_stopwords(spark))
    assert {r.term for r in index.lexicon.collect()} == {"run", "fox", "runner", "moon"}
    assert [r.doc_id for r in search.search(spark, index, "the fox runs").collect()] == [1]


def test_next_at_least(spark, corpus):
    _, index = corpus
    targets = spark.createDataFrame([("red", 0), ("red", 60), ("red", 10**9), ("zebra", 0)], "term string, target bigint")
    got = {(r.term, r.target): r.doc_id for r in ix.next_at_least(index.postings, targets).collect()}
    ids = sorted(r.doc_id for r in index.postings.where("term = 'red'").collect())
    assert got["red", 0] == ids[0]
    assert got["red", 60] == next((i for i in ids if i >= 60), None)
    assert got["red", 10**9] is None and got["zebra", 0] is None


def test_sources(spark, tmp_path):
    lines = ["12\tfoo", "abc12\tbar", "foo", "", " \t ", "1\t2\tx"]
    (tmp_path / "collection.tsv").write_text("\n".join(lines) + "\n")
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "collection.tsv", "other.tsv")
        tar.add(tmp_path / "collection.tsv", "collection.tsv")
    path = collection.unpack(spark, str(tmp_path / "c.tar.gz"), str(tmp_path / "out"))
    records, rejected = collection.parse_lines(collection.read_lines(spark, path))
    assert sorted(map(tuple, records.select("pid", "text").collect())) == [("1", "2\tx"), ("12", "bar"), ("12", "foo")]
    assert [r.line for r in rejected.collect()] == ["foo"]
    with pytest.raises(FileNotFoundError):
        collection.unpack(spark, str(tmp_path / "c.tar.gz"), str(tmp_path / "out"), "missing.tsv")
    (tmp_path / "q.tsv").write_text("1\tred fox\nbad\n2\ta\tb\n")
    assert [tuple(r) for r in collection.read_queries(spark, str(tmp_path / "q.tsv")).collect()] == [("1", "red fox")]
    (tmp_path / "stop.txt").write_text("red\n\nfox\n")
    assert [r.word for r in collection.read_stopwords(spark, str(tmp_path / "stop.txt")).collect()] == ["red", "fox"]


def test_dense_docids(spark):
    df = spark.range(500).select((F.col("id") * 7).alias("line_no"), F.lit("x").alias("text"))
    got = sorted(collection.with_docids(df, "line_no").collect(), key=lambda r: r.line_no)
    assert [r.docid for r in got] == list(range(1, 501))


def test_run_file(spark, tmp_path):
    res = spark.createDataFrame([("q1", 7, 1, 2.5), ("q1", 3, 2, 1.0)], "qid string, doc_id bigint, rank bigint, score double")
    runfile.write_run(res, f"file://{tmp_path}/run", "tag")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/run").collect()) == ["q1 Q0 3 2 1.000000 tag", "q1 Q0 7 1 2.500000 tag"]


def test_streamed_index_equals_one_build(spark, tmp_path):
    from lodestar.streaming import upkeep

    docs = [(i, f"fox {i % 3} red{i % 5} " * (i % 4)) for i in range(24)]
    for part in range(3):
        spark.createDataFrame(docs[part::3], "doc_id bigint, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("doc_id bigint, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second start finds nothing new
        upkeep.feed(stream, f"{tmp_path}/ix", f"{tmp_path}/cp").awaitTermination()
    fed, whole = upkeep.open_index(spark, f"{tmp_path}/ix"), ix.build(spark.createDataFrame(docs, "doc_id bigint, text string"))
    # a stream that begins anew, with another checkpoint, adds to what is there
    spark.createDataFrame([(100, "fox new")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/more")
    more = spark.readStream.schema("doc_id bigint, text string").parquet(f"{tmp_path}/more")
    for table in ("postings", "lexicon", "stats"):
        assert sorted(map(tuple, getattr(fed, table).collect())) == sorted(map(tuple, getattr(whole, table).collect()))
    upkeep.feed(more, f"{tmp_path}/ix", f"{tmp_path}/cp2").awaitTermination()
    assert upkeep.open_index(spark, f"{tmp_path}/ix").doc_index.count() == 25


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import io

    from lodestar.__main__ import main

    (tmp_path / "c.tsv").write_text("1\tred fox\n2\tred moon\n3\tsun\nbad line\n")
    (tmp_path / "q.tsv").write_text("7\tred fox\n")
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    main(["index", str(tmp_path / "c.tsv"), f"{tmp_path}/ix"])
    assert "indexed 3 documents, rejected 1 lines" in capsys.readouterr().out
    assert main(["search", f"{tmp_path}/ix", str(tmp_path / "q.tsv"), f"{tmp_path}/run", "-k", "1"]) == 0
    assert "1 queries" in capsys.readouterr().out
    assert [r.value.split()[2] for r in spark.read.text(f"{tmp_path}/run").collect()] == ["1"]
    monkeypatch.setattr("sys.stdin", io.StringIO("\n+red fox\nq\n"))
    main(["ask", f"{tmp_path}/ix"])
    assert capsys.readouterr().out.startswith("1\t")
    with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "c.tsv", "collection.tsv")
    assert main(["--log", f"{tmp_path}/log", "index", f"{tmp_path}/c.tar.gz", f"{tmp_path}/ix2", "--parse", "--compress"]) == 0
    assert "-- INFO -- indexed 3 documents" in (tmp_path / "log").read_text()
    assert main(["search", f"{tmp_path}/none", str(tmp_path / "q.tsv"), f"{tmp_path}/run2"]) == 253
    assert main(["index", f"{tmp_path}/none.tar.gz", f"{tmp_path}/ix3"]) == 254
    with pytest.raises(SystemExit) as wrong:
        main(["search", f"{tmp_path}/ix", "q", "r", "-k", "0"])
    assert wrong.value.code == 255


def test_every_lexicon_term_gets_its_top_k(spark):
    scored = retrieval.stored_index(spark, SF).lexicon.where("idf > 0 and round(bm25_ub, 6) > 0").select("term")
    got = retrieval.QUERIES["every_term_topk"](spark, SF).select(F.col("qid").alias("term")).distinct()
    assert got.count() > 20
    assert scored.exceptAll(got).count() == 0 and got.exceptAll(scored).count() == 0
