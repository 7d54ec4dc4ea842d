"""Registered queries of the subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import counts, encodings, leaks, packing, sentences, topn, weights
from lodestar.storage import cut, fresh, table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    best = weights.distinctive_postings(table(spark, sf, "postings"), "docid", "term", "tf", "written_at")
    return best.select(F.col("doc").alias("docid"), "term")


def p3_graph(spark: SparkSession, sf: str) -> DataFrame:
    best = weights.distinctive_records(table(spark, sf, "parsed_documents"), "pid", "tokens")
    return best.select(F.col("doc").alias("pid"), "term", "weight")


def _loaded(spark: SparkSession, sf: str, shares: list[float]) -> counts.Store:
    """A store into which the rows of parsed_documents came in batches by the time they were parsed, cut at these shares of
    the rows; rows of one record may come in several, and those without a time come first."""
    rows = table(spark, sf, "parsed_documents").select("pid", "tokens", "parsed_at")
    store = counts.Store(spark, fresh(spark, "term-counts"))
    bounds = rows.select(F.percentile_approx(F.unix_micros("parsed_at"), shares).alias("b")).first()[0] if shares else []
    time = F.coalesce(F.unix_micros("parsed_at"), F.lit(-(2**62)))
    for low, high in zip([None, *(bounds or [])], [*(bounds or []), None], strict=True):
        own = rows if low is None else rows.where(time >= low)
        store.apply(own if high is None else own.where(time < high), "pid", "tokens", "parsed_at")
    return store


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """A first load of the earlier rows, and a delta of the last tenth."""
    found = counts.marked(_loaded(spark, sf, [0.9]).counts())
    return found.where(F.col("mark").isNotNull()).select("term", "mark")


def p4_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counts.term_counts(_loaded(spark, sf, []).counts())


def p4_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The counts again, reached in five batches."""
    return counts.term_counts(_loaded(spark, sf, [0.6, 0.7, 0.8, 0.9]).counts())


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return topn.top_n(table(spark, sf, "scored_hits"), "qid", "pid", "score", "scored_at", "hit_id").select("qid", "pid")


def p5_ranked(spark: SparkSession, sf: str) -> DataFrame:
    best = topn.top_n(table(spark, sf, "scored_hits"), "qid", "pid", "score", "scored_at", "hit_id")
    return best.select("qid", "pid", "score", F.col("rank").cast("bigint").alias("rank"))


def _garbled(spark: SparkSession, sf: str) -> DataFrame:
    lines, parsed = table(spark, sf, "collection_lines"), table(spark, sf, "parsed_documents")

    def records(name: str, rec_id, text, source, folded: bool, df: DataFrame) -> DataFrame:
        return df.select(text.alias("text"), source.alias("source"), F.lit(name).alias("kind"), F.lit(folded).alias("folded"), F.lit(name).alias("rec_table"), rec_id.alias("rec_id"))

    both = records("collection_lines", F.col("line_no").cast("string"), F.col("line"), F.col("part_file"), False, lines)
    return encodings.find_garbled(both.unionByName(records("parsed_documents", F.col("pid"), F.concat_ws(" ", "tokens"), F.lit(""), True, parsed)))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).select("rec_table", "rec_id").distinct()


def p6_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).select("rec_table", "rec_id", "chain", "restored")


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), table(spark, sf, "pack_specs"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.cut_documents(_packed(spark, sf))


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


def p7_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """What has gone into the containers of each document, and whether none of these holds more than its capacity."""
    packed, specs = cut(_packed(spark, sf), "packed"), table(spark, sf, "pack_specs").distinct()
    full = packed.groupBy("pack_id", "container").agg(F.sum("size").alias("held")).join(specs, "pack_id")
    checked = packed.join(full.select("pack_id", "container", (F.col("held") <= F.col("capacity")).alias("ok")), ["pack_id", "container"])
    sizes = checked.groupBy("pack_id", "doc_id").agg(F.sum("size").alias("size"), F.count("*").alias("n_pieces"), F.every("ok").alias("fits"))
    return sizes.select("pack_id", "doc_id", "size", "n_pieces", "fits")


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.summary(_packed(spark, sf), table(spark, sf, "pack_specs"))


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(_matches(spark, sf))


def p8_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf)


def p8_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus without the documents that hold a test passage."""
    return leaks.without_leaks(table(spark, sf, "documents").drop("fetched_at"), _matches(spark, sf))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf, "documents"), with_text=False).select("doc_id", "start_pos", "end_pos")


def p9_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.split_sentences(table(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p3_graph": p3_graph,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p4_incremental": p4_incremental,
    "p5_found": p5_found,
    "p5_ranked": p5_ranked,
    "p6_found": p6_found,
    "p6_repaired": p6_repaired,
    "p7_found": p7_found,
    "p7_packed": p7_packed,
    "p7_sizes": p7_sizes,
    "p7_containers": p7_containers,
    "p8_found": p8_found,
    "p8_matches": p8_matches,
    "p8_clean": p8_clean,
    "p9_found": p9_found,
    "p9_sentences": p9_sentences,
}

_COUNTS = """
    WITH t AS (SELECT pid, term, count(*) // count(DISTINCT r) AS n
        FROM (SELECT pid, row_number() OVER () AS r, unnest(tokens) AS term FROM parsed_documents WHERE pid IS NOT NULL)
        WHERE term IS NOT NULL GROUP BY ALL),
    c AS (SELECT term, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS records FROM t GROUP BY term)"""
_TOP = """
    WITH v AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid, pid
            ORDER BY scored_at DESC NULLS LAST, hit_id DESC NULLS LAST, score DESC) AS r FROM scored_hits
        WHERE qid IS NOT NULL AND pid IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)),
    k AS (SELECT qid, pid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM v WHERE r = 1)"""

_WORDS = r"""
    d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
    i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
    dg AS (SELECT doc_id, k, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
    ig AS (SELECT item_id, j, array_to_string(w[j:j + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS j FROM i)),
    m AS (SELECT doc_id, item_id, k, j FROM dg JOIN ig USING (g))"""

ORACLES: dict[str, str] = {
    "p8_clean": f"WITH {_WORDS} SELECT * EXCLUDE (fetched_at) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m)",
    "p8_matches": rf"""WITH {_WORDS},
        runs AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id, k - j ORDER BY k) AS r FROM m),
        whole AS (SELECT doc_id, item_id, CAST(count(*) + 11 AS INT) AS n_words, CAST(min(k) - 1 AS INT) AS doc_word, CAST(min(j) - 1 AS INT) AS item_word
            FROM runs GROUP BY doc_id, item_id, k - j, r),
        cut AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS x FROM d WHERE doc_id IN (SELECT doc_id FROM m)),
        parts AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS p FROM cut),
        ends AS (SELECT doc_id, i, p, sum(len(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM parts),
        place AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS word, CAST(e - len(p) AS INT) AS s, CAST(e AS INT) AS e
            FROM ends WHERE regexp_matches(p, '[\p{{L}}\p{{N}}]'))
        SELECT doc_id, item_id, n_words, doc_word, item_word, a.s AS start_pos, b.e AS end_pos
        FROM whole JOIN place a USING (doc_id) JOIN place b USING (doc_id) WHERE a.word = doc_word AND b.word = doc_word + n_words - 1""",
    "p7_sizes": """
        SELECT pack_id, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS size,
            CAST(greatest(1, (coalesce(strlen(text), 0) + capacity - 1) // capacity) AS BIGINT) AS n_pieces, true AS fits FROM documents, pack_specs""",
    "p7_found": """
        SELECT DISTINCT pack_id, doc_id FROM documents, pack_specs WHERE strlen(text) > capacity""",
    "p8_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
        dg AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
        ig AS (SELECT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p3_found": """
        WITH v AS (SELECT docid, term, tf, row_number() OVER (PARTITION BY docid, term ORDER BY written_at DESC NULLS LAST, tf DESC) AS r
            FROM postings WHERE docid IS NOT NULL AND term IS NOT NULL AND tf > 0),
        l AS (SELECT docid, term, tf, count(*) OVER (PARTITION BY term) AS df FROM v WHERE r = 1),
        w AS (SELECT docid, term, round((1 + log10(tf)) * log10((SELECT count(DISTINCT docid) FROM l) / df), 6) AS w FROM l WHERE df >= 2),
        k AS (SELECT docid, term, row_number() OVER (PARTITION BY docid ORDER BY w DESC, term) AS r FROM w WHERE w > 0)
        SELECT docid, term FROM k WHERE r = 1""",
    "p3_graph": """
        WITH r AS (SELECT pid, row_number() OVER () AS r, tokens FROM parsed_documents WHERE pid IS NOT NULL AND len(tokens) > 0),
        p AS (SELECT pid, r, generate_subscripts(tokens, 1) AS i, unnest(tokens) AS term FROM r),
        e AS (SELECT DISTINCT a.pid, a.r, a.term, b.term AS other FROM p a JOIN p b
            ON a.r = b.r AND b.i BETWEEN a.i - 4 AND a.i + 4 AND a.term <> b.term),
        g AS (SELECT pid, r, term, count(*) AS degree FROM e GROUP BY ALL),
        d AS (SELECT pid, term, coalesce(max(degree), 0) AS degree FROM (SELECT DISTINCT pid, r, term FROM p) LEFT JOIN g USING (pid, r, term) GROUP BY ALL),
        f AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM d),
        w AS (SELECT pid, term, round(degree * log10((SELECT count(DISTINCT pid) FROM d) / df), 6) AS weight FROM f WHERE df >= 2),
        k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY weight DESC, term) AS o FROM w WHERE weight > 0)
        SELECT pid, term, weight FROM k WHERE o = 1""",
    "p4_found": f"""{_COUNTS},
        n AS (SELECT count(DISTINCT pid) AS n FROM parsed_documents)
        SELECT term, CASE WHEN records < 3 THEN 'rare' ELSE 'common' END AS mark FROM c, n WHERE records < 3 OR records * 100 > n * 40""",
    "p4_counts": f"{_COUNTS} SELECT term, occurrences, records FROM c",
    "p4_incremental": f"{_COUNTS} SELECT term, occurrences, records FROM c",
    "p5_found": f"{_TOP} SELECT qid, pid FROM k WHERE rank <= 10",
    "p5_ranked": f"{_TOP} SELECT qid, pid, score, rank FROM k WHERE rank <= 10",
}
