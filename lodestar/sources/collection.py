"""Collections, query files and stop lists as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import STOPWORDS
from lodestar.storage import cut

LINE = T.StructType([T.StructField("line", T.StringType())])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: the lines of a text file or folder, compressed or not."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def unpack(spark: SparkSession, archive: str, folder: str, member: str = "collection.tsv") -> str:
    """Copy the member of that name out of a tar archive, compressed with gzip or not, into a folder; its path.

    Both may lie in any file system that Spark reads, and bytes stream from one to the other inside the JVM. A tar archive
    cannot be split, so this is done once, ahead of the distributed read.
    """
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(archive), jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{member.rpartition('/')[2]}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    raw = source.getFileSystem(conf).open(source)
    try:
        plain = jvm.java.util.zip.GZIPInputStream(raw) if archive.endswith("gz") else raw
        tar = jvm.org.apache.commons.compress.archivers.tar.TarArchiveInputStream(plain)
        while (entry := tar.getNextEntry()) is not None:
            if not entry.isDirectory() and entry.getName() == member:
                out = target.getFileSystem(conf).create(target, True)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(tar, out, 1 << 20, False)
                out.close()
                return target.toString()
    finally:
        raw.close()
    raise FileNotFoundError(f"{member} is not in {archive}")


def parse_lines(lines: DataFrame, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """Records (pid, text) and rejected lines of a collection.

    A record holds digits followed by a tab: the first such digits are the pid, what follows the tab is the text, what
    stands before is ignored. Blank lines are neither records nor rejected; null lines count as blank. Other columns
    are kept, but for any called pid or text.
    """
    value = F.col(line)
    full = lines.where(value.rlike(r"\S"))
    has = value.rlike(r"[0-9]+\t")
    kept = [c for c in lines.columns if c not in ("pid", "text")]
    pattern = r"(?s)^.*?([0-9]+)\t(.*)$"
    records = full.where(has).select(*kept, F.regexp_extract(value, pattern, 1).alias("pid"), F.regexp_extract(value, pattern, 2).alias("text"))
    return records, full.where(~has)


def with_docids(records: DataFrame, order: str) -> DataFrame:
    """Dense docid from 1 in the order of a column, without gathering the rows in one partition.

    The rows are range-partitioned once; each partition numbers its own and adds the count of those before it.
    """
    ranged = records.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    stored = cut(ranged, "ranged")
    sizes = stored.groupBy("_part").count()
    before = sizes.select("_part", (F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return stored.join(F.broadcast(before), "_part").withColumn("docid", (local + F.coalesce("_before", F.lit(0))).cast("bigint")).drop("_part", "_before")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, query_text: the lines of a query file with exactly two fields parted by a tab."""
    fields = F.split("value", "\t", -1)
    return spark.read.text(path).where(F.size(fields) == 2).select(fields[0].alias("qid"), fields[1].alias("query_text"))


def read_stopwords(spark: SparkSession, path: str | None = None) -> DataFrame:
    """word: a stop list, one word to a line, or the default list if no path is given."""
    if path is None:
        return spark.createDataFrame([(w,) for w in STOPWORDS], "word string")
    return spark.read.text(path).select(F.col("value").alias("word")).where(F.length("word") > 0)
