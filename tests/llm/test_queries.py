"""The registered queries on the smallest tables: the columns and laws of their contracts."""

import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clearbrook.llm import queries
from clearbrook.llm.sharding import shard_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_op1_places_every_document_once(spark, documents):
    rows = queries.QUERIES["op1_sharding"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents) and {r.law for r in rows} == {"key"}
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    tickets = spark.createDataFrame([(i,) for i in documents], "k long").select("k", shard_of(F.col("k"), 8, 20).alias("a"), shard_of(F.col("k"), 9, 20).alias("b"))
    want = {r.k: (r.a, r.b) for r in tickets.collect()}
    for r in rows:
        t = documents[r.doc_id].text or ""
        assert r["size"] == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode()) and (r.shard, r.grown_shard) == want[r.doc_id] and r.grown_shard in (r.shard, 8)


def test_op3_never_reads_labels_of_what_it_judges(spark, documents, tmp_path):
    rows = {r.doc_id: r for r in queries.QUERIES["op3_language_id"](spark, SF).collect()}
    assert rows.keys() == documents.keys() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in rows.items())
    tried = [i for i, r in rows.items() if r.held_out and documents[i].lang]
    assert sum(rows[i].lang_pred == documents[i].lang for i in tried) >= 0.95 * len(tried)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    docs.withColumns({"lang": F.when(held, "zz").otherwise(F.col("lang")), "source": F.lit("x")}).write.parquet(f"{tmp_path}/documents.parquet")
    again = {r.doc_id: (r.lang_pred, r.score) for r in queries.QUERIES["op3_language_id"](spark, str(tmp_path)).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in rows.items()}


def test_op9_changes_nothing_but_its_entities(spark, documents):
    rows = queries.QUERIES["op9_pii"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        given, made, at, to = documents[r.doc_id].text or "", r.text or "", 0, 0
        for e in r.entities:
            assert given[at : at + e.gap] == made[to : to + e.gap]
            at, to = at + e.gap, to + e.gap
            assert made[to : to + len(e.surrogate)] == e.surrogate
            at, to = at + e.length, to + len(e.surrogate)
        assert given[at:] == made[to:] and r.n_entities == len(r.entities)
    by = Counter((e.type, e.id, e.surrogate.split("=")[-1].lower()) for r in rows for e in r.entities if e.type in ("email", "secret", "ip"))
    assert len({k[1] for k in by}) == len({(k[0], k[2]) for k in by})


def test_op10_ranks_toxic_documents_first(spark, documents):
    rows = queries.QUERIES["op10_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    seen = [r for r in rows if not r.held_out]
    yes, no = ([r.score for r in seen if (r.doc_id in toxic) == x] for x in (True, False))
    r = random.Random(1)
    assert not yes or sum(r.choice(yes) > r.choice(no) for _ in range(500)) > 400


def test_op8_gives_the_verdicts_of_its_contract(spark, tmp_path):
    urls = {"http://a.com/en/1": "block", "http://example.com/en/71": "allow", "http://example.net/de/1": "allow", "http://a.net/de/8": "allow", "http://example.net/de/81": "block", "http://x.org/es/": "block", "http://x.org/en/": "allow"}
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in queries.QUERIES["op8_url_filters"](spark, str(tmp_path)).collect()}
    assert [got[i][1] for i in range(len(urls))] == list(urls.values())
    assert got[2][0] == got[3][0] == "net/de/"
