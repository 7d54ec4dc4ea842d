"""Command line: build an index from a collection, run a query file, or ask single queries.

Exit codes: 0, or 255 for wrong arguments, 254 if a file cannot be read or written, 253 if there is no whole index.
"""

from __future__ import annotations

import argparse
import logging
import sys
import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestar import storage
from lodestar.functions.scoring import MODELS
from lodestar.operators import index, search
from lodestar.sources import collection, runfile

ARGUMENTS, FILES, MISSING = 255, 254, 253
LOG = logging.getLogger("lodestar")


def _index(spark: SparkSession, a: argparse.Namespace) -> None:
    began = time.time()
    archive = a.collection.endswith((".tar.gz", ".tgz", ".tar"))
    path = collection.unpack(spark, a.collection, storage.fresh(spark, "unpacked")) if archive else a.collection
    records, rejected = collection.parse_lines(collection.read_lines(spark, path))
    docs = records.select(F.col("pid").cast("bigint").alias("doc_id"), "text")
    stop = collection.read_stopwords(spark, a.stopwords) if a.parse else None
    index.save(index.build(docs, parsed=a.parse, stop=stop), a.out, a.compress)
    done = f"indexed {index.load(spark, a.out).stats.first().n_docs} documents, rejected {rejected.count()} lines"
    LOG.info("%s in %.0f ms", done, 1000 * (time.time() - began))
    print(done)


def _search(spark: SparkSession, a: argparse.Namespace) -> None:
    ix = index.load(spark, a.index)
    queries = collection.read_queries(spark, a.queries)
    n, began = queries.count(), time.time()
    runfile.write_run(search.search_batch(queries, ix, a.k, a.model), a.run, a.tag)
    print(f"{n} queries, {1000 * (time.time() - began) / max(n, 1):.0f} ms each on average")


def _ask(spark: SparkSession, a: argparse.Namespace) -> None:
    ix = index.load(spark, a.index)
    for line in sys.stdin:
        query = line.strip()
        if query == "q":
            break
        if query:
            began = time.time()
            found = search.search(spark, ix, query, a.k, a.model).orderBy("rank").collect()
            for r in found:
                print(f"{r.doc_id}\t{r.score}")
            print(f"{len(found)} results in {1000 * (time.time() - began):.0f} ms")


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        self.print_usage(sys.stderr)
        self.exit(ARGUMENTS, f"{self.prog}: {message}\n")


def _k(text: str) -> int:
    if not text.isascii() or not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError("must be a number above 0")
    return int(text)


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    top = _Parser(prog="lodestar")
    top.add_argument("--shared", help="folder for intermediate tables that all executors share, if spark.checkpoint.dir names none")
    top.add_argument("--log", help="file to which messages go too")
    sub = top.add_subparsers(required=True, parser_class=_Parser)
    p = sub.add_parser("index", help="build an index from lines of pid, tab, text")
    p.add_argument("collection", help="text file or folder, or tar archive that holds collection.tsv")
    p.add_argument("out")
    p.add_argument("--parse", action="store_true", help="drop stopwords and stem")
    p.add_argument("--compress", action="store_true", help="store posting lists as compressed blocks")
    p.add_argument("--stopwords", help="file of words, instead of the built-in list")
    p.set_defaults(action=_index)
    p = sub.add_parser("search", help="run a file of qid, tab, query")
    p.add_argument("index")
    p.add_argument("queries")
    p.add_argument("run")
    p.add_argument("--tag", default="lodestar")
    p.set_defaults(action=_search)
    ask = sub.add_parser("ask", help="queries from standard input, q to end")
    ask.add_argument("index")
    ask.set_defaults(action=_ask)
    for q in (p, ask):
        q.add_argument("-k", type=_k, default=10)
        q.add_argument("--model", choices=MODELS, default="bm25")
    return top.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    a = _arguments(argv)
    handlers = [logging.StreamHandler(), *([logging.FileHandler(a.log)] if a.log else [])]
    for h in handlers:
        h.setFormatter(logging.Formatter("[%(asctime)s] -- %(levelname)s -- %(message)s", "%Y-%m-%d %H:%M:%S"))
        LOG.addHandler(h)
    LOG.setLevel(logging.INFO)
    builder = SparkSession.builder.appName("lodestar")
    spark = (builder.config("spark.checkpoint.dir", a.shared) if a.shared else builder).getOrCreate()
    try:
        with storage.scratch(spark):
            a.action(spark, a)
        return 0
    except index.IndexMissing as e:
        LOG.error("%s", e)
        return MISSING
    except (OSError, storage.NoSharedFolder, AnalysisException, Py4JJavaError) as e:
        LOG.error("%s", str(e).split("\n\tat ")[0])
        return FILES
    finally:
        for h in handlers:
            LOG.removeHandler(h)
            h.close()


if __name__ == "__main__":
    sys.exit(main())
