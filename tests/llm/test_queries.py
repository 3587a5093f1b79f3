"""Every registered query over the smallest tables: columns, types, folds and values as its contract has them."""

import os
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from clinprep.llm import ORACLES, QUERIES, toxicity
from pyspark.sql import functions as F

from .helpers import documents

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

COLUMNS = {
    "op1_exact_topk": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op2_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op3_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op4_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op6_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op7_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_kd_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op9_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op10_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op11_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
    "op12_alignment": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_decontamination": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
}
#: Column, and the tables whose rows a query returns one each of.
EACH = {"op2", "op3", "op4", "op6", "op7", "op8", "op10", "op12", "op13"}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_all_are_registered():
    assert set(COLUMNS) == set(QUERIES) and set(ORACLES) < set(QUERIES)


@pytest.mark.parametrize("name", COLUMNS)
def test_query_keeps_its_contract(spark, texts, name):
    df = entry.queries()[name](spark, SF)
    kinds = dict(df.dtypes)
    assert all(kinds.get(c) == t for c, t in (x.split() for x in COLUMNS[name].split(", ")))
    rows = df.collect()
    assert rows
    if name.split("_")[0] in EACH:
        assert sorted(r.doc_id for r in rows) == sorted(texts)
    if name in ("op4_toxicity", "op7_quality_classifier"):
        parts, rest = (3, 1) if name.startswith("op4") else (4, 2)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest) for r in rows)
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    if name == "op8_kd_sharding":
        size = {}
        for r in rows:
            assert r.size == len((texts[r.doc_id] or "").encode()) + 1 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
            assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard <= 7
            size.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in size.values())
    if name == "op9_packing":
        by, whole = {}, {}
        for r in rows:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
            whole.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
        assert set(whole) == set(texts) and all(sum(n for _, n, _ in v) == v[0][2] for v in whole.values())
        assert all(sum(n for _, n in v) <= 4096 and sorted(v)[0][0] == 0 for v in by.values())
    if name == "op6_bpe":
        import hashlib

        assert all(r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() for r in rows)
    if name == "op5_url_filter":
        assert {r.verdict for r in rows} <= {"allow", "block"} and all(r.verdict == ("allow" if r.rule in ("org/", "com/fr/") else "block") for r in rows if r.rule)
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark", "pages", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        found = con.execute(entry.oracle_sql()[name])
        names = [c[0] for c in found.description]
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(found.fetchall())


def test_toxicity_of_an_empty_table(spark):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    some = documents(spark, [(1, "you are a vile fool"), (2, "a plain and friendly line of text")])
    model = toxicity.train(some, labels, F.lit(True))
    assert toxicity.toxicity(documents(spark, []), model).count() == 0
    assert toxicity.toxicity(documents(spark, [(5, None), (6, "")]), toxicity.train(documents(spark, []), labels, F.lit(True))).count() == 2
