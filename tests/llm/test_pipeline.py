"""Every stage of the corpus pipeline on its own input, and all of them in order."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest

from dayslice.session import materialize

from .corpus import documents, frame, prose
from .test_copies import plain_lines
from .test_near import plain_kept
from .test_scoring import toxic_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of tables: odd documents, toxic ones with labels."""
    path = str(tmp_path_factory.mktemp("tables"))
    rows = documents() + [(10_000 + i, t) for i, t, _ in toxic_rows()]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    labels = [(10_000 + i, 1, y) for i, _, y in toxic_rows()]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def text_rows(df):
    return sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=str)


def test_stages_in_order(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "best_fit"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, text_rows(docs)
    clean = materialize(corpus_pipeline.drop_toxic(spark, docs, folder), "t")
    bad = {10_000 + i for i, _, y in toxic_rows() if y}
    assert clean.columns == columns
    assert text_rows(clean) == [r for r in before if r[0] not in bad]

    rest = materialize(corpus_pipeline.drop_common_lines(spark, clean, folder), "t")
    assert rest.columns == columns and {r.n_chars == len(r.text) for r in rest.collect()} == {True}
    want = sorted(((i, h) for i, _, _, h in plain_lines(text_rows(clean), 10)), key=str)
    assert sorted(((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in text_rows(rest)), key=str) == want

    single = corpus_pipeline.drop_near_copies(spark, rest, folder)
    assert single.columns == columns
    expected = plain_kept([(r.doc_id, r.text) for r in rest.select("doc_id", "text").collect()])
    assert text_rows(single) == expected

    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in expected}
    assert corpus_pipeline.ORACLE_SQL is None


def test_clean_documents_stay(spark, folder):
    own = frame(spark, [(i, prose(900 + i, 120)) for i in range(40)])
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_common_lines, corpus_pipeline.drop_near_copies):
        assert text_rows(stage(spark, own, folder)) == text_rows(own)


def test_empty_tables_pass(spark, folder):
    none = frame(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
