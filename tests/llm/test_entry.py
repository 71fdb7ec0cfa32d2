"""The registered queries, their SQL twins, and the pipeline."""

import importlib
import struct

import duckdb
import pytest

from glintscan.llm import line_frequency, near_dedup, queries, secret_scan

ENTRY = importlib.import_module("__spark_entry__")
SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in queries.QUERIES}
    assert names == {f"op{n}" for n in range(1, 14)} and set(queries.QUERIES) | {"pipeline"} <= set(ENTRY.queries())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_and_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE[name])
    assert rel.columns == df.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rel.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_per_document(spark, name):
    df = queries.QUERIES[name](spark, SF)
    key = df.columns[0]
    docs = spark.read.parquet(f"{SF}/{'pages' if key == 'page_id' else 'documents'}.parquet")
    if key not in ("query_id", "word"):
        assert df.count() == docs.count() == df.select(key).distinct().count()


def test_pipeline(spark, documents):
    import tiktoken
    import corpus_pipeline
    from glintscan.llm import byte_bpe

    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, SF)
        seen[name] = [r.asDict() for r in new.collect()]
        if name != "byte-level BPE":
            assert new.columns == documents.columns
            docs = spark.createDataFrame(new.collect(), documents.schema)
    kept = {r.doc_id for r in line_frequency.judge(documents, spare_first=True).filter("kept").collect()}
    assert {r["doc_id"] for r in seen["quality rules"]} == kept
    first = near_dedup.deduplicate(spark.createDataFrame(seen["quality rules"], documents.schema))
    assert {r["doc_id"] for r in seen["near-duplicates"]} == {r.doc_id for r in first.filter("kept").collect()}
    assert len(seen["near-duplicates"]) == len(seen["secrets"])
    assert all(not secret_scan.base_spans(r["text"]) for r in seen["secrets"])
    ranks = byte_bpe.read_ranks(queries.RANKS)
    bpe = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in seen["mixing"]}
    assert sorted(r["doc_id"] for r in seen["mixing"]) == sorted(r["doc_id"] for r in seen["byte-level BPE"])
    for r in seen["byte-level BPE"]:
        ids = bpe.encode_ordinary(texts[r["doc_id"]])
        assert bytes(r["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
    assert corpus_pipeline.run(spark, SF).count() == len(seen["byte-level BPE"])
