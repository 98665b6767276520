"""The registered queries against their SQL, and the pipeline's stages."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import registry
from millrace.llm.common import pick

from .conftest import collected, odd_rows
from .test_tokens import check_packing

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, name):
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    expected = connection.sql(registry.ORACLE[name])
    df = registry.QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(expected.columns)
    assert Counter(collected(df.select(*expected.columns))) == Counter(expected.fetchall())


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))


def test_stages_on_odd_documents(spark, odd, tmp_path):
    docs = pick(odd, "doc_id", "text", "lang", "source", "n_chars", "part")
    counts = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        assert docs.filter("text IS NULL").isEmpty()
        assert docs.filter("n_chars <> length(text)").isEmpty()
    ids = {r["doc_id"] for r in docs.collect()}
    assert not ids & {50, 51, 52, 53, 60, 71} and 70 in ids and counts[0] > counts[1] > counts[2]
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF_DIR)
    check_packing(collected(last), [(r["doc_id"], r["text"]) for r in docs.collect()], 1024)


def test_stages_on_no_documents(spark, none):
    docs = pick(none, "doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert collected(stage(spark, docs, SF_DIR)) == []


def test_run_is_the_stages_in_order(spark, tmp_path):
    whole = collected(corpus_pipeline.run(spark, SF_DIR))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    kept = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "SimHash near-dedup":
            assert docs.count() <= kept and docs.select("doc_id").distinct().count() == docs.count()
    key = lambda rows: Counter(r[:5] for r in rows)
    assert key(whole) == key(collected(docs))
    # Few documents, half of them longer than half a sequence, leave some room.
    assert len({r[5] for r in whole}) <= 1.06 * sum(r[3] for r in whole) / 1024


def test_odd_rows_are_what_they_say():
    assert any(r[1] is None for r in odd_rows()) and any(r[0] is None for r in odd_rows())
