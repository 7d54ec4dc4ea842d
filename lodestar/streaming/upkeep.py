"""An index fed by a stream of new documents.

Each micro-batch becomes a partial index of its own, in a folder named by the stream and the batch: a batch that is run
again replaces its folder, so every document is indexed once. The stream's name is drawn when its checkpoint is new and kept
beside it, so a stream that begins anew over the same index adds parts and replaces none. Lexicon and statistics are
aggregates over the parts, made when the index is opened.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestar import storage
from lodestar.operators import index as ix


def write_part(docs: DataFrame, batch: int, path: str, key: str = "doc_id", body: str = "text", stream: str = "0") -> None:
    with storage.scratch(docs.sparkSession):
        words = storage.cut(ix.tokenised(docs, key, body), "tokens")
        ix.postings_from(words).write.mode("overwrite").parquet(f"{path}/postings/stream={stream}/part={batch}")
        words.select("doc_id", "doc_len").write.mode("overwrite").parquet(f"{path}/doc_index/stream={stream}/part={batch}")


def _name(spark: SparkSession, checkpoint: str) -> str:
    """The name of the stream whose state lies in the checkpoint."""
    at = f"{checkpoint.rstrip('/')}/stream-name"
    if not storage.exists(spark, at):
        spark.range(1).select(F.lit("s" + uuid.uuid4().hex)).write.text(at)
    return spark.read.text(at).first()[0]


def feed(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id", body: str = "text", **trigger) -> StreamingQuery:
    """Start indexing a stream of documents whose ids do not repeat."""
    name = _name(stream.sparkSession, checkpoint)
    writer = stream.writeStream.foreachBatch(lambda docs, batch: write_part(docs, batch, path, key, body, name))
    return writer.option("checkpointLocation", f"{checkpoint.rstrip('/')}/state").trigger(**(trigger or {"availableNow": True})).start()


def open_index(spark: SparkSession, path: str) -> ix.Index:
    """The index over all parts written so far."""
    tables = [spark.read.parquet(f"{path}/{t}").drop("stream", "part") for t in ("doc_index", "postings")]
    return ix.over(*tables)
