"""The pipeline's stages, each against what its operator says of its own input."""

from pathlib import Path

import pytest

import corpus_pipeline as C
from tracewell.llm import minhash

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_stages(spark, tmp_path):
    import test_decontaminate
    import test_minhash

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, texts = docs.columns, {}
    for name, stage in C.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        kept = {r.doc_id for r in rows}
        assert len(rows) == len(kept) and kept <= before.keys()
        if name != "bpe":
            assert docs.columns == columns
            texts = {r.doc_id: r.text for r in rows}
        if name == "quality":
            bad = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect() if r.quality == 0}
            assert not kept & bad and len(kept) > 0.8 * len(before)
        elif name == "near_duplicates":
            scheme = minhash.Scheme()
            assert (scheme.words, scheme.percent) == (5, 80)
            groups = test_minhash.brute(before.items(), 5, 80)
            assert kept == {d for d, (_, _, keep) in groups.items() if keep}
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
            found = test_decontaminate.brute(before.items(), items, 13)
            assert kept == {d for d in before if not found[d][3]}
        else:
            assert kept == before.keys()
        if name == "pseudonyms":
            assert texts != before and all("@" not in t or t != before[d] for d, t in texts.items())
    whole = {r.doc_id: r.ids for r in C.run(spark, SF_DIR).collect()}
    assert whole == {r.doc_id: r.ids for r in docs.collect()}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0
