"""Queries of the retrieval operators: tokenising, index tables, codecs, ranked search."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import codec, scoring, stem, text
from lodestar.operators import index as ix
from lodestar.operators import batch, prune, search
from lodestar.sources import collection, runfile
from lodestar.storage import children, scratch, shared_dir, table

K = 10
SMALL_BLOCK_BYTES = 128
_TOP = "top + top div 10 + 2"
_STORED: dict[tuple, str] = {}


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def _bench(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query_text"))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "queries")


def stored_index(spark: SparkSession, sf: str, parsed: bool = False, compressed: bool = False) -> ix.Index:
    """The index of a dataset's documents in the shared folder, built on first use in an application, and again when
    the table's files have changed."""
    files = tuple(children(spark, f"{sf}/documents.parquet"))
    key = (spark.sparkContext.applicationId, sf, files, parsed, compressed)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        stop = collection.read_stopwords(spark) if parsed else None
        with scratch(spark):
            built = stored_index(spark, sf, parsed) if compressed else ix.build(_docs(spark, sf), parsed=parsed, stop=stop)
            ix.save(built, path, compressed)
        _STORED[key] = path
    return ix.load(spark, _STORED[key])


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return text.exploded(_docs(spark, sf), "doc_id", "text")


def parse_records(spark: SparkSession, sf: str) -> DataFrame:
    records, _ = collection.parse_lines(table(spark, sf, "collection_lines").select("line_no", "line"))
    return records.select("line_no", "pid", F.col("text").alias("body"))


def rejected_records(spark: SparkSession, sf: str) -> DataFrame:
    _, rejected = collection.parse_lines(table(spark, sf, "collection_lines").select("line_no", "line"))
    return rejected.agg(F.count("*").alias("n_rejected"))


def dense_docids(spark: SparkSession, sf: str) -> DataFrame:
    records, _ = collection.parse_lines(table(spark, sf, "collection_lines").select("line_no", "line"))
    return collection.with_docids(records, "line_no").select("line_no", "docid")


def tokenize_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _tokens(spark, sf).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "term")


def tokenize_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "collection_lines")
    return lines.select("line_no", F.size(text.tokens(F.col("line"))).cast("bigint").alias("n_tokens"))


def stopword_filter(spark: SparkSession, sf: str) -> DataFrame:
    terms = _tokens(spark, sf)
    before = terms.groupBy("doc_id").agg(F.count("*").alias("n_before"))
    after = text.without_stopwords(terms, collection.read_stopwords(spark)).groupBy("doc_id").agg(F.count("*").alias("n_after"))
    return before.join(after, "doc_id", "left").select("doc_id", "n_before", F.coalesce("n_after", F.lit(0)).alias("n_after"))


def stem_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    words = _tokens(spark, sf).select("term").distinct()
    return words.select("term", stem.stemmed(F.col("term")).alias("stem"))


def doc_index(spark: SparkSession, sf: str) -> DataFrame:
    return ix.document_lengths(_docs(spark, sf))


def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ix.statistics(ix.document_lengths(_docs(spark, sf)), ix.postings_of(_docs(spark, sf))).withColumn("avgdl", F.round("avgdl", 6))


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return ix.postings_of(_docs(spark, sf)).select("term", "doc_id", "tf")


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    return ix.build(_docs(spark, sf)).lexicon.select("term", "df", "max_doc_id", F.round("idf", 6).alias("idf"))


def term_upper_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return ix.build(_docs(spark, sf)).lexicon.select("term", F.round("bm25_ub", 6).alias("bm25_ub"), F.round("tfidf_ub", 6).alias("tfidf_ub"))


def spimi_merge(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf)
    return ix.merge_partials([ix.postings_of(docs.where(F.pmod("doc_id", F.lit(4)) == r)) for r in range(4)])


def _blocks(spark: SparkSession, sf: str, limit: int, compressed: bool) -> DataFrame:
    found = ix.blocks(stored_index(spark, sf).postings, limit, compressed)
    return found.select("term", "block_no", "max_doc_id", "n")


def posting_blocks_raw(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf, ix.BLOCK_BYTES, False)


def posting_blocks_ef(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf, ix.BLOCK_BYTES, True)


def posting_blocks_ef_small(spark: SparkSession, sf: str) -> DataFrame:
    return _blocks(spark, sf, SMALL_BLOCK_BYTES, True)


def codec_sizes(spark: SparkSession, sf: str) -> DataFrame:
    per = stored_index(spark, sf).postings.groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("s"), F.max("doc_id").alias("u"))
    return per.select("term", codec.elias_fano_size_column(F.col("u"), F.col("n")).alias("ef_bytes"), codec.unary_size_column(F.col("s"), F.col("n")).alias("unary_bytes"))


def codec_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    # ids from 1 on, as the format has them
    shifted = stored_index(spark, sf).postings.withColumn("doc_id", F.col("doc_id") + 1)
    found = ix.blocks(shifted, SMALL_BLOCK_BYTES, True)
    coded = found.withColumns({"e": codec.encode_ids(F.col("doc_ids")), "u": codec.encode_freqs(F.col("tfs"))})
    back = coded.withColumns({"i": codec.decode_ids(F.col("e"), F.col("n"), F.col("max_doc_id")), "f": codec.decode_freqs(F.col("u"), F.col("n"))})
    return back.groupBy("term").agg(F.every((F.col("i") == F.col("doc_ids")) & (F.col("f") == F.col("tfs"))).alias("ok"))


def lexicon_lookup(spark: SparkSession, sf: str) -> DataFrame:
    index = stored_index(spark, sf)
    return search.known_terms(search.query_terms(_bench(spark, sf)), index.lexicon)


def _targets(spark: SparkSession, sf: str, index: ix.Index) -> DataFrame:
    """A place in the ids, or a little beyond them, for every term of the query file."""
    target = F.expr(f"cast((ascii(term) * 7919 + length(term) * 104729 + length(qid) * 37) % ({_TOP}) as bigint)")
    top = index.doc_index.agg(F.max("doc_id").alias("top"))
    return search.query_terms(_queries(spark, sf)).select("*", top.scalar().alias("top")).select("term", target.alias("target")).distinct()


def next_geq(spark: SparkSession, sf: str) -> DataFrame:
    index = stored_index(spark, sf)
    return ix.next_at_least(index.postings, _targets(spark, sf, index))


def next_geq_blocks(spark: SparkSession, sf: str) -> DataFrame:
    index = stored_index(spark, sf, compressed=True)
    return ix.next_at_least_in_blocks(index.blocks, _targets(spark, sf, index))


def min_docid(spark: SparkSession, sf: str) -> DataFrame:
    return search.first_document(search.query_terms(_queries(spark, sf)), stored_index(spark, sf))


def _topk(queries: Callable, model: str, conjunctive: bool = False, parsed: bool = False, compressed: bool = False) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return search.search_batch(queries(spark, sf), stored_index(spark, sf, parsed, compressed), K, model, conjunctive)

    return run


def _file_topk(queries: Callable, model: str, conjunctive: bool = False, compressed: bool = False) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return batch.search_file(queries(spark, sf), stored_index(spark, sf, compressed=compressed), K, model, conjunctive)

    return run


def single_term_topk(spark: SparkSession, sf: str) -> DataFrame:
    index = stored_index(spark, sf)
    common = index.lexicon.orderBy(F.col("df").desc(), "term").limit(20).select("term", F.col("term").alias("qid"), F.lit(1).alias("qtf"))
    return search.top_k(search.score(common, index, "bm25"), K)


def every_term_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The best documents of every lexicon term as a query of its own."""
    index = stored_index(spark, sf)
    each = index.lexicon.select("term", F.col("term").alias("qid"), F.lit(1).alias("qtf"))
    return search.top_k(search.score(each, index, "bm25"), K)


def plus_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries that ask for all terms, among them one that no document holds."""
    asked = _queries(spark, sf).select("qid", F.concat(F.lit(" +"), "query_text", F.lit(" zzunknown")).alias("query_text"))
    return asked.where(text.is_conjunctive(F.col("query_text")))


def _doubled(spark: SparkSession, sf: str) -> DataFrame:
    """Queries that name each of their terms twice."""
    return _queries(spark, sf).select("qid", F.concat("query_text", F.lit(" "), "query_text").alias("query_text"))


def unknown_terms_and(spark: SparkSession, sf: str) -> DataFrame:
    return batch.search_file(plus_queries(spark, sf), stored_index(spark, sf), K, "tfidf", True)


def essential_terms(spark: SparkSession, sf: str) -> DataFrame:
    index = stored_index(spark, sf)
    found = prune.essential_terms(search.query_terms(_bench(spark, sf)), index)
    return found.select("qid", "term", F.round("cum_bound", 4).alias("cum_ub"), "is_essential")


def maxscore_topk(spark: SparkSession, sf: str) -> DataFrame:
    index = stored_index(spark, sf)
    return prune.pruned_top_k(search.query_terms(_bench(spark, sf)), index, K)


def maxscore_query_file_topk(spark: SparkSession, sf: str) -> DataFrame:
    return batch.top_k(search.query_terms(_queries(spark, sf)), stored_index(spark, sf), K, how="pruned")


def run_file(spark: SparkSession, sf: str) -> DataFrame:
    return runfile.run_lines(_file_topk(_queries, "bm25")(spark, sf), "bm25")


def single_query(spark: SparkSession, sf: str) -> DataFrame:
    """One query over the stored index: term filters reach its files."""
    return search.search(spark, stored_index(spark, sf), "how long does the sturdy bridge last", K)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parse_records": parse_records,
    "rejected_records": rejected_records,
    "dense_docids": dense_docids,
    "tokenize_documents": tokenize_documents,
    "tokenize_lines": tokenize_lines,
    "stopword_filter": stopword_filter,
    "stem_vocabulary": stem_vocabulary,
    "doc_index": doc_index,
    "collection_stats": collection_stats,
    "postings": postings,
    "lexicon": lexicon,
    "term_upper_bounds": term_upper_bounds,
    "spimi_merge": spimi_merge,
    "posting_blocks_raw": posting_blocks_raw,
    "posting_blocks_ef": posting_blocks_ef,
    "posting_blocks_ef_small": posting_blocks_ef_small,
    "codec_sizes": codec_sizes,
    "codec_roundtrip": codec_roundtrip,
    "lexicon_lookup": lexicon_lookup,
    "next_geq": next_geq,
    "next_geq_blocks": next_geq_blocks,
    "min_docid": min_docid,
    "bm25_or_topk": _topk(_bench, "bm25"),
    "tfidf_or_topk": _topk(_bench, "tfidf"),
    "bm25_and_topk": _file_topk(_queries, "bm25", True),
    "tfidf_and_topk": _file_topk(_queries, "tfidf", True),
    "bm25_query_file_topk": _file_topk(_queries, "bm25"),
    "bm25_parsed_topk": _topk(_bench, "bm25", parsed=True),
    "single_term_topk": single_term_topk,
    "every_term_topk": every_term_topk,
    "dup_terms_topk": _file_topk(_doubled, "bm25"),
    "unknown_terms_and": unknown_terms_and,
    "essential_terms": essential_terms,
    "maxscore_topk": maxscore_topk,
    "maxscore_query_file_topk": maxscore_query_file_topk,
    "tfidf_query_file_topk": _file_topk(_queries, "tfidf"),
    "bm25_compressed_topk": _topk(_bench, "bm25", compressed=True),
    "bm25_and_compressed_topk": _file_topk(_queries, "bm25", True, compressed=True),
    "run_file": run_file,
    "single_query": single_query,
}

# ---- SQL, written from the definitions -------------------------------------------------------------------------------

_RUNS = "|".join(f"{c}{c}{c}" for c in "abcdefghijklmnopqrstuvwxyz")


def _collapse(w: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        w = f"regexp_replace({w}, '{c}{{3,}}', '{c}{c}', 'g')"
    return w


def _tok(name: str, key: str, body: str, source: str) -> str:
    """CTE with key, pos, term of every token."""
    norm = f"lower(regexp_replace(regexp_replace(regexp_replace(coalesce({body}, ''), '[\\r\\n]', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[[:punct:]]', ' ', 'g'))"
    keep = "lambda w: w <> '' AND strlen(w) < 64 AND NOT regexp_matches(w, '[^\\x00-\\x7F]')"
    return f"""
    {name}_l AS (SELECT {key}, list_filter(string_split({norm}, ' '), {keep}) AS ws FROM {source}),
    {name}_w AS (SELECT {key}, generate_subscripts(ws, 1) - 1 AS pos, unnest(ws) AS w FROM {name}_l),
    {name} AS (SELECT {key}, CAST(pos AS BIGINT) AS pos, CASE WHEN regexp_matches(w, '{_RUNS}') THEN {_collapse('w')} ELSE w END AS term FROM {name}_w)"""


# Porter's conditions on a stem, as patterns: y is a vowel after a consonant
_CONS, _VOWEL = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"


def _matches(pattern: str) -> Callable[[str], str]:
    return lambda w: f"regexp_matches({w}, '{pattern}')"


_M0 = _matches(f"^({_CONS})?{_VOWEL}{_CONS}")
_M1 = _matches(f"^({_CONS})?{_VOWEL}{_CONS}({_VOWEL})?$")
_M2 = _matches(f"^({_CONS})?{_VOWEL}{_CONS}{_VOWEL}{_CONS}")
_HAS_VOWEL = _matches(f"^({_CONS})?[aeiouy]")
_SHORT = _matches(f"^{_CONS}[aeiouy][^aeiouwxy]$")


def _cases(pairs: dict[str, str], condition: Callable[[str, str], str]) -> str:
    """The longest suffix of `pairs` that w has, replaced if its condition holds."""
    whens = [f"WHEN w LIKE '%{x}' THEN CASE WHEN {condition(x, f'w[:-{len(x) + 1}]')} THEN w[:-{len(x) + 1}] || '{y}' ELSE w END" for x, y in sorted(pairs.items(), key=lambda p: -len(p[0]))]
    return f"CASE {' '.join(whens)} ELSE w END"


def _stems(source: str) -> str:
    """CTEs to a table stems (term, stem) of the words in `source` (term)."""
    mended = lambda x: f"CASE WHEN regexp_matches({x}, '(at|bl|iz)$') THEN {x} || 'e' WHEN {x}[-1] = {x}[-2] AND {x}[-1] NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') AND len({x}) > 1 THEN {x}[:-2] WHEN {_SHORT(x)} THEN {x} || 'e' ELSE {x} END"
    steps = [
        "CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END",
        f"CASE WHEN w LIKE '%eed' THEN CASE WHEN {_M0('w[:-4]')} THEN w[:-2] ELSE w END WHEN w LIKE '%ed' AND {_HAS_VOWEL('w[:-3]')} THEN {mended('w[:-3]')} WHEN w LIKE '%ing' AND {_HAS_VOWEL('w[:-4]')} THEN {mended('w[:-4]')} ELSE w END",
        f"CASE WHEN w LIKE '%y' AND {_HAS_VOWEL('w[:-2]')} THEN w[:-2] || 'i' ELSE w END",
        _cases(stem.STEP2, lambda x, y: _M0(y)),
        _cases(stem.STEP3, lambda x, y: _M0(y)),
        _cases({x: "" for x in stem.STEP4}, lambda x, y: _M2(y) + (f" AND regexp_matches({y}, '[st]$')" if x == "ion" else "")),
        f"CASE WHEN w LIKE '%e' AND ({_M2('w[:-2]')} OR {_M1('w[:-2]')} AND NOT {_SHORT('w[:-2]')}) THEN w[:-2] ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {_M2('w[:-2]')} THEN w[:-2] ELSE w END",
    ]
    ctes = [f"stem_0 AS (SELECT DISTINCT term, term AS w FROM {source})"]
    for k, step in enumerate(steps):
        ctes.append(f"stem_{k + 1} AS (SELECT term, CASE WHEN len(term) > 2 AND regexp_full_match(term, '[a-z]+') THEN {step} ELSE w END AS w FROM stem_{k})")
    return ", ".join([*ctes, f"stems AS (SELECT term, w AS stem FROM stem_{len(steps)})"])


_TOK = _tok("tok", "doc_id", "text", "documents")
_P = f"""{_TOK},
    p AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
    di AS (SELECT d.doc_id, coalesce(n, 0) AS doc_len FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id) USING (doc_id)),
    st AS (SELECT count(*) AS n_docs, CAST(sum(doc_len) AS BIGINT) AS total_len, (SELECT count(DISTINCT term) FROM p) AS vocab_size FROM di)"""
_LEX = f"""{_P},
    lx AS (SELECT term, count(*) AS df, max(doc_id) AS max_doc_id FROM p GROUP BY term),
    sc AS (SELECT p.term, p.doc_id, p.tf, log10(n_docs::DOUBLE / df) AS idf,
        tf / ({scoring.K1} * (1 - {scoring.B} + {scoring.B} * doc_len / (total_len::DOUBLE / n_docs)) + tf) * log10(n_docs::DOUBLE / df) AS bm25,
        (1 + log10(tf)) * log10(n_docs::DOUBLE / df) AS tfidf
        FROM p JOIN lx USING (term) JOIN di USING (doc_id), st)"""


def _query_cte(source: str) -> str:
    return _tok("qt", "qid", "body", f"(SELECT DISTINCT qid, body FROM ({source}) WHERE qid IS NOT NULL)") + ", q AS (SELECT qid, term, count(*) AS qtf FROM qt GROUP BY ALL)"


_BENCH = "SELECT CAST(item_id AS VARCHAR) AS qid, text AS body FROM benchmark"
_FILE = "SELECT qid, query_text AS body FROM queries"
_PLUS = "SELECT qid, '+' || query_text || ' zzunknown' AS body FROM queries WHERE query_text IS NOT NULL"


def _top(source: str, model: str, conjunctive: bool = False, lex: str = "", query: str = "") -> str:
    need = ", nd AS (SELECT qid, count(*) AS need FROM q JOIN lx USING (term) GROUP BY qid)" if conjunctive else ""
    keep = "JOIN nd USING (qid) WHERE have = need AND" if conjunctive else "WHERE"
    return f"""WITH {lex or _LEX}, {query or _query_cte(source)}{need},
    s AS (SELECT qid, doc_id, round(sum(qtf * {model}), 6) AS score, count(*) AS have FROM q JOIN sc USING (term) GROUP BY ALL),
    r AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s {keep} score > 0)
    """


def _ranked(source: str, model: str, conjunctive: bool = False) -> str:
    return f"{_top(source, model, conjunctive)} SELECT qid, doc_id, rank, score FROM r WHERE rank <= {K}"


def _ef(u: str, n: str) -> str:
    width = f"CAST(ceil(ln(({u} + 1)::DOUBLE / {n}) / ln(2)) AS BIGINT)"
    return f"(greatest(8, (({width} * {n} + 7) // 8) * 8) + ((2 * {n} + 7) // 8) * 8) // 8"


def _block_sql(bytes_: str, limit: int) -> str:
    return f"""WITH {_P},
    b AS (SELECT term, doc_id, count(*) OVER t AS df, max(doc_id) OVER t AS u, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS i FROM p WINDOW t AS (PARTITION BY term))
    SELECT term, CAST(i // CASE WHEN {bytes_} > {limit} THEN CAST(floor(sqrt(df)) AS BIGINT) ELSE df END AS BIGINT) AS block_no, max(doc_id) AS max_doc_id, count(*) AS n
    FROM b GROUP BY ALL"""


def _parsed_top(source: str, model: str) -> str:
    """As _ranked, over terms and query terms that are no stopwords, stemmed."""
    words = f"{_tok('tok0', 'doc_id', 'text', 'documents')}, {_query_cte(source).replace('qt', 'qt0').replace('q AS', 'q0 AS')}"
    both = f"stop(term) AS (VALUES {_STOP}), seen AS (SELECT term FROM tok0 UNION SELECT term FROM qt0), {_stems('seen')}"
    kept = "{0} AS (SELECT {1}, stem AS term FROM {0}0 JOIN stems USING (term) WHERE term NOT IN (SELECT term FROM stop))"
    lex = f"{words}, {both}, {kept.format('tok', 'doc_id')}, {_LEX.replace(_TOK + ',', '')}"
    query = f"{kept.format('qt', 'qid')}, q AS (SELECT qid, term, count(*) AS qtf FROM qt GROUP BY ALL)"
    return f"{_top(source, model, lex=lex, query=query)} SELECT qid, doc_id, rank, score FROM r WHERE rank <= {K}"


_STOP = ", ".join(f"('{w}')" for w in text.STOPWORDS)

ORACLES: dict[str, str] = {
    "parse_records": r"""SELECT line_no, regexp_extract(line, '([0-9]+)\t', 1) AS pid, line[strpos(line, regexp_extract(line, '[0-9]+\t')) + len(regexp_extract(line, '[0-9]+\t')):] AS body
        FROM collection_lines WHERE regexp_matches(line, '[0-9]+\t')""",
    "rejected_records": r"SELECT count(*) AS n_rejected FROM collection_lines WHERE regexp_matches(line, '\S') AND NOT regexp_matches(line, '[0-9]+\t')",
    "dense_docids": r"SELECT line_no, row_number() OVER (ORDER BY line_no) AS docid FROM collection_lines WHERE regexp_matches(line, '[0-9]+\t')",
    "tokenize_documents": f"WITH {_TOK} SELECT doc_id, pos, term FROM tok",
    "tokenize_lines": f"WITH {_tok('tok', 'line_no', 'line', 'collection_lines')} SELECT line_no, CAST(len(ws) AS BIGINT) AS n_tokens FROM tok_l",
    "stopword_filter": f"""WITH {_TOK}, s(term) AS (VALUES {_STOP})
        SELECT doc_id, count(*) AS n_before, count(*) FILTER (term NOT IN (SELECT term FROM s)) AS n_after FROM tok GROUP BY doc_id""",
    "stem_vocabulary": f"WITH {_TOK}, {_stems('tok')} SELECT term, stem FROM stems",
    "bm25_parsed_topk": _parsed_top(_BENCH, "bm25"),
    "doc_index": f"WITH {_P} SELECT doc_id, doc_len FROM di",
    "collection_stats": f"WITH {_P} SELECT n_docs, total_len, vocab_size, round(total_len::DOUBLE / n_docs, 6) AS avgdl FROM st",
    "postings": f"WITH {_P} SELECT term, doc_id, tf FROM p",
    "lexicon": f"WITH {_LEX} SELECT term, df, max_doc_id, round(log10(n_docs::DOUBLE / df), 6) AS idf FROM lx, st",
    "term_upper_bounds": f"WITH {_LEX} SELECT term, round(max(bm25), 6) AS bm25_ub, round(max(tfidf), 6) AS tfidf_ub FROM sc GROUP BY term",
    "spimi_merge": f"WITH {_P} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(doc_id) AS max_doc_id FROM p GROUP BY term",
    "posting_blocks_raw": _block_sql("4 * df", ix.BLOCK_BYTES),
    "posting_blocks_ef": _block_sql(_ef("u", "df"), ix.BLOCK_BYTES),
    "posting_blocks_ef_small": _block_sql(_ef("u", "df"), SMALL_BLOCK_BYTES),
    "codec_sizes": f"""WITH {_P}, a AS (SELECT term, count(*) AS n, CAST(sum(tf) AS BIGINT) AS s, max(doc_id) AS u FROM p GROUP BY term)
        SELECT term, {_ef('u', 'n')} AS ef_bytes, greatest(1, (s + n + 7) // 8) AS unary_bytes FROM a""",
    "codec_roundtrip": f"WITH {_P} SELECT DISTINCT term, true AS ok FROM p",
    "lexicon_lookup": f"WITH {_LEX}, {_query_cte(_BENCH)} SELECT qid, term, qtf, df FROM q JOIN lx USING (term)",
    "next_geq": f"""WITH {_P}, {_query_cte(_FILE)}, t AS (SELECT DISTINCT term, CAST((ascii(term) * 7919 + len(term) * 104729 + len(qid) * 37) % (top + top // 10 + 2) AS BIGINT) AS target FROM q, (SELECT max(doc_id) AS top FROM documents))
        SELECT t.term, target, min(doc_id) AS doc_id FROM t LEFT JOIN p ON p.term = t.term AND doc_id >= target GROUP BY ALL""",
    "next_geq_blocks": f"""WITH {_P}, {_query_cte(_FILE)}, t AS (SELECT DISTINCT term, CAST((ascii(term) * 7919 + len(term) * 104729 + len(qid) * 37) % (top + top // 10 + 2) AS BIGINT) AS target FROM q, (SELECT max(doc_id) AS top FROM documents))
        SELECT t.term, target, min(doc_id) AS doc_id FROM t LEFT JOIN p ON p.term = t.term AND doc_id >= target GROUP BY ALL""",
    "min_docid": f"WITH {_P}, {_query_cte(_FILE)} SELECT qid, min(doc_id) AS doc_id FROM q JOIN p USING (term) GROUP BY qid",
    "bm25_or_topk": _ranked(_BENCH, "bm25"),
    "tfidf_or_topk": _ranked(_BENCH, "tfidf"),
    "bm25_and_topk": _ranked(_FILE, "bm25", True),
    "tfidf_and_topk": _ranked(_FILE, "tfidf", True),
    "bm25_query_file_topk": _ranked(_FILE, "bm25"),
    "maxscore_topk": _ranked(_BENCH, "bm25"),
    "maxscore_query_file_topk": _ranked(_FILE, "bm25"),
    "tfidf_query_file_topk": _ranked(_FILE, "tfidf"),
    "bm25_compressed_topk": _ranked(_BENCH, "bm25"),
    "bm25_and_compressed_topk": _ranked(_FILE, "bm25", True),
    "dup_terms_topk": _ranked("SELECT qid, query_text || ' ' || query_text AS body FROM queries", "bm25"),
    "unknown_terms_and": _ranked(_PLUS, "tfidf", True),
    "single_term_topk": f"""WITH {_LEX}, q AS (SELECT term, term AS qid FROM lx ORDER BY df DESC, term LIMIT 20),
        s AS (SELECT qid, doc_id, round(bm25, 6) AS score FROM q JOIN sc USING (term)),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT qid, doc_id, rank, score FROM r WHERE rank <= {K}""",
    "every_term_topk": f"""WITH {_LEX},
        s AS (SELECT term AS qid, doc_id, round(bm25, 6) AS score FROM sc),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT qid, doc_id, rank, score FROM r WHERE rank <= {K}""",
    "essential_terms": f"""WITH {_LEX}, {_query_cte(_BENCH)}, ub AS (SELECT term, max(bm25) AS ub FROM sc GROUP BY term),
        b AS (SELECT qid, term, qtf, qtf * ub AS bound FROM q JOIN ub USING (term)),
        c AS (SELECT *, sum(bound) OVER (PARTITION BY qid ORDER BY bound, term ROWS UNBOUNDED PRECEDING) AS cum,
            row_number() OVER (PARTITION BY qid ORDER BY bound DESC, term) AS strength FROM b),
        s AS (SELECT qid, doc_id, sum(qtf * bm25) FILTER (strength <= 8) AS part, round(sum(qtf * bm25), 6) AS score FROM c JOIN sc USING (term) GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY part DESC, doc_id) AS r FROM s WHERE part IS NOT NULL),
        t AS (SELECT qid, min(score) AS score FROM o WHERE r <= {K} AND score > 0 GROUP BY qid HAVING count(*) = {K})
        SELECT qid, term, round(cum, 4) AS cum_ub, cum >= coalesce(score, 0) - 1e-5 AS is_essential FROM c LEFT JOIN t USING (qid)""",
    "run_file": f"""{_top(_FILE, 'bm25')} SELECT qid || ' Q0 ' || doc_id || ' ' || rank || ' ' || printf('%.6f', score) || ' bm25' AS line FROM r WHERE rank <= {K}""",
    "single_query": _ranked("SELECT 'q' AS qid, 'how long does the sturdy bridge last' AS body", "bm25").rpartition("SELECT qid, ")[0] + f"SELECT doc_id, rank, score FROM r WHERE rank <= {K}",
}
