"""Every registered query of the subpackage against its SQL, on whole tables; what SQL cannot express, by its own laws."""

import pytest
from compare import SF, assert_same, sql_rows
from pyspark.sql import functions as F

from lodestar.llm import encodings
from lodestar.llm.queries import ORACLES, QUERIES
from lodestar.storage import table


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


def test_queries_without_sql_are_tested_here():
    assert QUERIES.keys() - ORACLES.keys() == {"p6_found", "p6_repaired", "p7_packed", "p7_containers", "p9_found", "p9_sentences"}


def damage(text, chain):
    for w, r in encodings.CHAINS[chain]:
        raw = text.encode(w)
        text = raw.decode(r) if r in encodings._MULTI else "".join(encodings._table(r)[b] for b in raw)
    return text


def test_restored_lines_give_the_garbled_ones_again(spark):
    """Token by token: a token of a restored line is the line's own, or the chain makes the line's of it."""
    repaired = QUERIES["p6_repaired"](spark, SF)
    lines = table(spark, SF, "collection_lines").select(F.col("line_no").cast("string").alias("rec_id"), "line")
    found = repaired.where("rec_table = 'collection_lines' and restored is not null").join(lines, "rec_id").collect()
    assert len(found) > 20
    for r in found:
        was, now = r.line.replace("\t", " ").split(" "), r.restored.replace("\t", " ").split(" ")
        assert len(was) == len(now) and was != now
        for a, b in zip(was, now, strict=True):
            same = encodings._CODECS[encodings.CHAINS[r.chain][-1]].encode  # a byte may show as a control character
            assert a == b or encodings.TORN_MARK in b or same(damage(b, r.chain)) == same(a)
    keys = repaired.select("rec_table", "rec_id").distinct()
    assert keys.exceptAll(QUERIES["p6_found"](spark, SF)).count() == QUERIES["p6_found"](spark, SF).exceptAll(keys).count() == 0
    marked = lines.where(F.contains("line", F.lit("\ufffd"))).select("rec_id")
    assert marked.exceptAll(found_of(repaired, "collection_lines")).count() == 0


def found_of(repaired, name):
    return repaired.where(F.col("rec_table") == name).select("rec_id").distinct()


def test_containers_are_few_and_full(spark):
    packed = QUERIES["p7_packed"](spark, SF)
    containers = {r.pack_id: r for r in QUERIES["p7_containers"](spark, SF).collect()}
    _, least = sql_rows("SELECT pack_id, CAST(ceil(sum(strlen(text)) / capacity) AS BIGINT) AS n FROM documents, pack_specs GROUP BY pack_id, capacity")
    assert {p: r.least_containers for p, r in containers.items()} == {p: n for n, p in least}
    for r in containers.values():
        assert r.least_containers <= r.n_containers <= 1.01 * r.least_containers + 1
    assert packed.where("size > 0").groupBy("pack_id", "doc_id", "piece").count().where("count > 1").count() == 0


def test_sentences_cover_the_documents(spark):
    """Each is the text between its places; together they leave out white space alone."""
    docs = table(spark, SF, "documents").select("doc_id", "text").where("text is not null")
    got = QUERIES["p9_sentences"](spark, SF).join(docs, "doc_id")
    assert got.where(F.col("sentence") != F.substring("text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos"))).count() == 0
    spans = QUERIES["p9_found"](spark, SF)
    assert spans.exceptAll(got.select("doc_id", "start_pos", "end_pos")).count() == 0
    texts = {r.doc_id: r.text for r in docs.collect()}
    by = {}
    for r in spans.collect():
        by.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    for doc, text in texts.items():
        own = sorted(by.get(doc, []))
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))
        assert "".join("".join(text[a:b].split()) for a, b in own) == "".join(text.split())
