"""The inverted index as tables: postings, lexicon, document lengths, collection statistics, posting blocks.

Building is one pass: tokenise, count terms per document (document length travels along), aggregate per term. Spark's
partial and final aggregation is what spilling partial indexes and merging them would be.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar import storage
from lodestar.functions import codec, scoring, stem, text
from lodestar.storage import cut, spread

#: A posting list larger than this is cut into blocks of floor(sqrt(df)) postings.
BLOCK_BYTES = 2048
#: Document ids with the same higher bits make a range; a term's postings of one range meet in one task.
RANGE_BITS = 16
#: A term in more documents than this is common: its postings are dealt to several tasks where they are shuffled.
HOT_ROWS = 1 << 20
#: The list of common terms is broadcast up to this length.
HOT_TERMS = 1 << 17


class IndexMissing(FileNotFoundError):
    """There is no whole index at the path."""


@dataclass(frozen=True)
class Index:
    """postings (term, doc_id, tf, doc_len), lexicon (term, df, max_doc_id, idf, bm25_ub, tfidf_ub), doc_index
    (doc_id, doc_len), stats (n_docs, total_len, vocab_size, avgdl), and how the text was parsed. An index that was saved
    compressed has its blocks too, and its postings are what these decode to; hot (term, slots) are the common terms of an
    index that was saved, if there are any, and into how many parts their postings are dealt."""

    postings: DataFrame
    lexicon: DataFrame
    doc_index: DataFrame
    stats: DataFrame
    parsed: bool = False
    stop: DataFrame | None = None
    blocks: DataFrame | None = None
    hot: DataFrame | None = None

    def n_docs(self) -> Column:
        return self.stats.select("n_docs").scalar()

    def avgdl(self) -> Column:
        return self.stats.select("avgdl").scalar()


def term_counts(terms: DataFrame) -> DataFrame:
    """term, doc_id, tf from one row for each token."""
    return terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def parse_terms(terms: DataFrame, stop: DataFrame | None) -> DataFrame:
    """Stopwords dropped, then terms stemmed, as the optional parsing step has it."""
    return stem.stem_terms(text.without_stopwords(terms, stop) if stop is not None else terms)


def document_lengths(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """doc_id, doc_len of every document, those without terms included."""
    return tokenised(docs, key, body).select("doc_id", "doc_len")


def tokenised(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """doc_id, doc_len, tokens: the one pass over the text; null texts have no tokens."""
    words = docs.select(F.col(key).alias("doc_id"), text.tokens(F.col(body)).alias("tokens"))
    return words.select("doc_id", F.size("tokens").cast("bigint").alias("doc_len"), "tokens")


def postings_from(words: DataFrame) -> DataFrame:
    """term, doc_id, tf, doc_len without a join: the length travels with the terms."""
    rows = words.select("doc_id", "doc_len", F.explode("tokens").alias("term"))
    return rows.groupBy("term", "doc_id", "doc_len").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf", "doc_len")


def postings_of(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    return postings_from(tokenised(docs, key, body))


def statistics(doc_index: DataFrame, postings: DataFrame) -> DataFrame:
    """n_docs, total_len, vocab_size, avgdl: one row. Documents without terms count."""
    docs = doc_index.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("total_len"))
    vocab = postings.select("term").distinct().agg(F.count("*").alias("v"))
    return docs.select("n_docs", "total_len", vocab.scalar().alias("vocab_size"), (F.col("total_len").cast("double") / F.nullif(F.col("n_docs"), F.lit(0))).alias("avgdl"))


def lexicon_of(postings: DataFrame, n_docs: Column, avgdl: Column) -> DataFrame:
    """term, df, max_doc_id, idf, bm25_ub, tfidf_ub: the bounds are the highest scores of the term in any document.

    A score is idf times a factor that does not depend on df, so bounds and df come out of one aggregation.
    """
    one = F.lit(1.0)
    per = postings.groupBy("term").agg(
        F.count("*").alias("df"),
        F.max("doc_id").alias("max_doc_id"),
        F.max(scoring.bm25(F.col("tf"), F.col("doc_len"), avgdl, one)).alias("b"),
        F.max(scoring.tfidf(F.col("tf"), one)).alias("t"),
    )
    idf = scoring.idf(n_docs, F.col("df"))
    return per.select("term", "df", "max_doc_id", idf.alias("idf"), (F.col("b") * idf).alias("bm25_ub"), (F.col("t") * idf).alias("tfidf_ub"))


def build(docs: DataFrame, key: str = "doc_id", body: str = "text", parsed: bool = False, stop: DataFrame | None = None) -> Index:
    """An index of the documents; with `parsed`, stopwords are dropped and terms stemmed. Null texts have no terms.

    The tokens are stored in the shared folder first, since every table of the index comes from them.
    """
    plain = spread(docs.select(F.col(key).alias("doc_id"), F.col(body).alias("text")))
    words = cut(tokenised(plain), "tokens")
    if parsed:  # counted before they are stemmed, so that a common word goes to Python once for a document
        terms = words.select("doc_id", F.explode("tokens").alias("term"))
        counts = term_counts(text.without_stopwords(terms, stop) if stop is not None else terms)
        stems = counts.select(stem.stemmed(F.col("term")).alias("term"), "doc_id", "tf")
        stems = cut(stems.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf")), "stems")
        lengths = stems.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))
        doc_index = words.select("doc_id").join(lengths, "doc_id", "left").select("doc_id", F.coalesce("doc_len", F.lit(0)).alias("doc_len"))
        postings = stems.join(lengths, "doc_id").select("term", "doc_id", "tf", "doc_len")
    else:
        doc_index, postings = words.select("doc_id", "doc_len"), postings_from(words)
    return over(doc_index, postings, parsed, stop if parsed else None)


def over(doc_index: DataFrame, postings: DataFrame, parsed: bool = False, stop: DataFrame | None = None) -> Index:
    """The index with the aggregates of these tables."""
    bare = Index(postings, postings, doc_index, statistics(doc_index, postings))
    return Index(postings, lexicon_of(postings, bare.n_docs(), bare.avgdl()), doc_index, bare.stats, parsed, stop)


def merge_partials(parts: list[DataFrame]) -> DataFrame:
    """term, df, cf, max_doc_id of partial postings over disjoint documents, as one index over all of them."""
    lexicons = [p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("doc_id").alias("max_doc_id")) for p in parts]
    all_ = lexicons[0]
    for p in lexicons[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("max_doc_id").alias("max_doc_id"))


def blocks(postings: DataFrame, limit: int = BLOCK_BYTES, compressed: bool = False) -> DataFrame:
    """term, block_no, max_doc_id, n, doc_ids, tfs (and doc_lens if `postings` has doc_len): posting lists cut into
    blocks, a pure function of the list.

    A list of more than `limit` bytes (4 a posting, or its Elias-Fano size if compressed) is cut into blocks of
    floor(sqrt(df)) postings, the last of them with the rest. The place of a posting in its list is its place in a range
    of document ids and the number of postings in the ranges before, so no task sees a whole list of a common term.
    """
    lens = [c for c in postings.columns if c == "doc_len"]
    ranged = postings.select("term", F.shiftright("doc_id", RANGE_BITS).alias("_range"), "doc_id", "tf", *lens)
    sizes = ranged.groupBy("term", "_range").agg(F.count("*").alias("_n"), F.max("doc_id").alias("_top"))
    by = Window.partitionBy("term")
    before = F.coalesce(F.sum("_n").over(by.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("term", "_range", before.alias("_before"), F.sum("_n").over(by).alias("df"), F.max("_top").over(by).alias("top"))
    bytes_ = codec.elias_fano_size_column(F.col("top"), F.col("df")) if compressed else 4 * F.col("df")
    size = F.when(bytes_ > limit, F.floor(F.sqrt("df"))).otherwise(F.col("df"))
    rows = ranged.withColumn("_r", F.row_number().over(Window.partitionBy("term", "_range").orderBy("doc_id")))
    rows = rows.join(sizes, ["term", "_range"]).select("term", "doc_id", "tf", *lens, F.floor((F.col("_before") + F.col("_r") - 1) / size).alias("block_no"))
    held = F.array_sort(F.collect_list(F.struct("doc_id", "tf", *lens))).alias("p")
    grouped = rows.groupBy("term", "block_no").agg(F.max("doc_id").alias("max_doc_id"), F.count("*").alias("n"), held)
    return grouped.select("term", "block_no", "max_doc_id", "n", F.col("p.doc_id").alias("doc_ids"), F.col("p.tf").alias("tfs"), *[F.col("p.doc_len").alias("doc_lens") for _ in lens])


def compress(blocks_: DataFrame) -> DataFrame:
    """The blocks with min_doc_id, ids_ef and tfs_unary in place of the lists of ids and frequencies; ids are coded by
    their distance from the one before the block's first, so that ids of any size or sign can be coded."""
    ids = F.transform("doc_ids", lambda d: d - F.col("doc_ids")[0] + 1)
    coded = blocks_.withColumns({"min_doc_id": F.col("doc_ids")[0], "ids_ef": codec.encode_ids(ids), "tfs_unary": codec.encode_freqs(F.col("tfs"))})
    return coded.drop("doc_ids", "tfs")


def decompress(blocks_: DataFrame) -> DataFrame:
    ids = codec.decode_ids(F.col("ids_ef"), F.col("n"), F.col("max_doc_id") - F.col("min_doc_id") + 1)
    lists = blocks_.withColumns({"_ids": ids, "tfs": codec.decode_freqs(F.col("tfs_unary"), F.col("n"))})
    return lists.withColumn("doc_ids", F.transform("_ids", lambda d: d + F.col("min_doc_id") - 1)).drop("_ids", "min_doc_id", "ids_ef", "tfs_unary")


def unblocked(blocks_: DataFrame) -> DataFrame:
    """term, doc_id, tf, doc_len of compressed blocks. A filter on columns of the blocks decodes those left only."""
    lists = decompress(blocks_).select("term", F.explode(F.arrays_zip("doc_ids", "tfs", "doc_lens")).alias("p"))
    return lists.select("term", F.col("p.doc_ids").alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.doc_lens").alias("doc_len"))


def next_at_least(postings: DataFrame, targets: DataFrame) -> DataFrame:
    """term, target, doc_id: for each (term, target) the first document of the term from target on, null if none.

    A target is looked for in its own range of document ids; if the term has none there from the target on, the ranges
    are gone through as documents were, each standing for its first document, by ranges of ranges. A task sees one range.
    """
    asks = targets.select("term", "target").distinct()
    all_ids = postings.select(F.col("doc_id").alias("v")).unionByName(asks.select(F.col("target").alias("v")))
    ends = [x for x in all_ids.agg(F.min("v"), F.max("v")).first() if x is not None] or [0]
    low, high = min(ends), max(ends)
    rows = postings.select("term", F.col("doc_id").alias("_v"), F.col("doc_id").alias("_low"))
    open_ = asks.select("term", "target", F.col("target").alias("_v"))
    done, bits = None, RANGE_BITS
    while True:
        last = high - low < 1 << bits
        cell = F.lit(0).cast("bigint") if last else F.shiftright("_v", bits)
        none = F.lit(None).cast("bigint")
        both = rows.select("term", cell.alias("_c"), "_v", "_low", none.alias("target")).unionByName(open_.select("term", cell.alias("_c"), "_v", none.alias("_low"), "target"))
        order = Window.partitionBy("term", "_c").orderBy(F.col("_v").desc(), F.col("target").asc_nulls_first())
        met = both.withColumn("_low", F.last("_low", True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("target is not null")
        if last:
            found = met.select("term", "target", F.col("_low").alias("doc_id"))
            return found if done is None else done.unionByName(found)
        met = cut(met.select("term", "_c", "target", "_low"), "seek")
        found = met.where("_low is not null").select("term", "target", F.col("_low").alias("doc_id"))
        done = found if done is None else done.unionByName(found)
        rows = rows.groupBy("term", cell.alias("_v")).agg(F.min("_low").alias("_low"))
        open_ = met.where("_low is null").select("term", "target", (F.col("_c") + 1).alias("_v"))
        low, high, bits = low >> bits, (high >> bits) + 1, min(bits, 8)


def blocks_at(blocks_: DataFrame, targets: DataFrame) -> DataFrame:
    """The columns of `blocks_`, and target: for each (term, target) the one block in which the first document from target
    on is, found by the blocks' last documents; no list is decoded. Targets beyond a term's last document have no row."""
    ends = next_at_least(blocks_.select("term", F.col("max_doc_id").alias("doc_id")), targets).where("doc_id is not null")
    return blocks_.join(ends.select("term", F.col("doc_id").alias("max_doc_id"), "target"), ["term", "max_doc_id"])


def next_at_least_in_blocks(blocks_: DataFrame, targets: DataFrame) -> DataFrame:
    """As `next_at_least`, over compressed blocks: of each list only the blocks that hold an answer are decoded."""
    hit = cut(blocks_at(blocks_, targets).select("term", "max_doc_id", "target"), "hits")
    wanted = blocks_.join(hit.select("term", "max_doc_id").distinct(), ["term", "max_doc_id"], "left_semi")
    lists = decompress(wanted).select("term", "max_doc_id", "doc_ids").join(hit, ["term", "max_doc_id"])
    found = lists.select("term", "target", F.array_min(F.filter("doc_ids", lambda d: d >= F.col("target"))).alias("doc_id"))
    return targets.select("term", "target").distinct().join(found, ["term", "target"], "left")


def postings_at(index: Index, wanted: DataFrame) -> DataFrame:
    """Postings among which are all of the (term, doc_id) in `wanted` that the index has: of a compressed index those of
    the blocks in which they may be, else all."""
    if index.blocks is None:
        return index.postings
    asked = wanted.select("term", F.col("doc_id").alias("target"))
    near = blocks_at(index.blocks.select("term", "max_doc_id", "min_doc_id"), asked).where("min_doc_id <= target")
    return unblocked(index.blocks.join(near.select("term", "max_doc_id").distinct(), ["term", "max_doc_id"], "left_semi"))


def with_postings(index: Index, asked: DataFrame) -> DataFrame:
    """The postings of the terms in `asked`, joined to its rows by term. If this comes to a shuffle, each common term goes to
    as many tasks as it has slots: a posting to the one that its document says, the rows of `asked` to all of them."""
    if index.hot is None:
        return index.postings.join(asked, "term")
    dealt = index.postings.join(F.broadcast(index.hot), "term", "left")
    dealt = dealt.withColumn("_slot", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("slots")).cast("int"), F.lit(0))).drop("slots")
    copies = asked.join(F.broadcast(index.hot), "term", "left")
    copies = copies.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1))).drop("slots")
    return dealt.join(copies, ["term", "_slot"]).drop("_slot")


def save(index: Index, path: str, compressed: bool = False) -> None:
    """Write the tables in a new folder below `path`, then name it as the current version, so a failure leaves the
    index that was there; older versions are deleted at the end.

    Postings (or their compressed blocks) and lexicon are range-partitioned and sorted by term, so that a filter on
    terms reads few row groups.
    """
    spark = index.postings.sparkSession
    old = storage.children(spark, path)
    version = f"{path}/v{max([int(p.rpartition('/v')[2]) for p, _, _ in old if p.rpartition('/v')[2].isdigit()], default=0) + 1}"
    if compressed:
        coded = compress(blocks(index.postings, BLOCK_BYTES, True))
        coded.repartitionByRange("term", "block_no").sortWithinPartitions("term", "block_no").write.parquet(f"{version}/blocks")
    else:
        index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{version}/postings")
    index.doc_index.write.parquet(f"{version}/doc_index")
    # the aggregates are made from what is stored now, not from the text again
    postings = unblocked(spark.read.parquet(f"{version}/blocks")) if compressed else spark.read.parquet(f"{version}/postings")
    index = over(spark.read.parquet(f"{version}/doc_index"), postings, index.parsed, index.stop)
    index.lexicon.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{version}/lexicon")
    index.stats.write.parquet(f"{version}/stats")
    if index.stop is not None:
        index.stop.write.parquet(f"{version}/stop")
    common = spark.read.parquet(f"{version}/lexicon").where(F.col("df") > HOT_ROWS)
    common.select("term", F.ceil(F.col("df") / HOT_ROWS).cast("int").alias("slots")).write.parquet(f"{version}/hot")
    flags = {"parsed": index.parsed, "stop": index.stop is not None, "compressed": compressed, "hot": spark.read.parquet(f"{version}/hot").count()}
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in flags.items()], F.current_timestamp().alias("created")).write.parquet(f"{version}/meta")
    for p, _, _ in old:
        storage.delete(spark, p)


def load(spark: SparkSession, path: str) -> Index:
    """The newest whole version; one whose writing was broken off has no meta table."""
    found = sorted((int(p.rpartition("/v")[2]), p) for p, _, _ in storage.children(spark, path) if p.rpartition("/v")[2].isdigit())
    whole = [p for _, p in found if storage.exists(spark, f"{p}/meta/_SUCCESS")]
    if not whole:
        raise IndexMissing(f"no whole index at {path}")
    at = whole[-1]
    meta = spark.read.parquet(f"{at}/meta").first()
    try:
        lexicon, doc_index, stats = (spark.read.parquet(f"{at}/{t}") for t in ("lexicon", "doc_index", "stats"))
        stored = spark.read.parquet(f"{at}/blocks" if meta["compressed"] else f"{at}/postings")
    except AnalysisException as e:
        raise IndexMissing(f"a part of the index at {path} is missing: {e}") from e
    blocks_ = stored if meta["compressed"] else None
    stop = spark.read.parquet(f"{at}/stop") if meta["stop"] else None
    hot = spark.read.parquet(f"{at}/hot") if 0 < meta["hot"] <= HOT_TERMS else None
    return Index(unblocked(stored) if meta["compressed"] else stored, lexicon, doc_index, stats, meta["parsed"], stop, blocks_, hot)
