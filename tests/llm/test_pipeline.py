import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tallywright.llm import mixing, pii  # noqa: E402

from .cases import documents, shingles  # noqa: E402
from .test_packing import check  # noqa: E402


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    documents(spark).select(*corpus_pipeline.COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1 if i < 8 else 0, 0) for i in range(1, 13)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_dedup_keeps_one_of_each_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.dedup_stage(spark, docs, sf_dir).collect()
    rows = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    for i, s in rows:
        near = [j for j, t in rows if j is not None and i is not None and (i == j or (s and t and 100 * len(s & t) >= 75 * len(s | t)))]
        assert [r.doc_id for r in kept].count(i) == (1 if i is None or i == min(near) else 0)


def test_pii_stage_leaves_no_base_span(spark, sf_dir):
    docs = documents(spark, [(1, "write to a.b@c.com or +44 20 7946 0958", "en", "a", 1), (2, "nothing here", "en", "a", 1), (3, None, None, None, None)])
    out = {r.doc_id: r for r in corpus_pipeline.pii_stage(spark, docs, sf_dir).collect()}
    assert out[1].text == "write to [EMAIL] or [PHONE]" and out[1].n_chars == len(out[1].text) and out[2].text == "nothing here" and out[3].text == ""
    assert not any(v for r in out.values() for v in pii.base_spans(r.text).values())


def test_mix_repeats_rows(spark, sf_dir):
    docs = documents(spark)
    out = corpus_pipeline.mix_stage(spark, docs, sf_dir).collect()
    want = sum(r.taken for r in mixing.mix_report(docs).collect())
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in out) == want


def test_quality_stage_keeps_columns_and_clean_documents(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, "/root/testdata/sf0.01")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    good = labels.filter("quality = 1").join(docs, "doc_id")
    assert good.join(kept.select("doc_id"), "doc_id").count() > 0.97 * good.count()


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    check([(r.sequence_id, r.offset, r.length) for r in rows], 2048)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and rows


def test_dedup_keeps_unlike_texts_of_one_id(spark, sf_dir):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (2, None), (2, two), (3, one), (3, three), (3, three + " end"), (4, None), (4, None), (5, two), (None, one)]
    docs = documents(spark, [(i, t, "en", "a", 1) for i, t in rows])
    kept = sorted(((r.doc_id or 0, (r.text or "").removesuffix(" end")) for r in corpus_pipeline.dedup_stage(spark, docs, sf_dir).collect()))
    assert kept == [(0, one), (1, one), (2, two), (3, three), (4, "")]


def test_empty_tables_through_all_stages(spark, tmp_path):
    documents(spark).limit(0).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").collect() == []
