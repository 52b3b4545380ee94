"""The registered queries on the test tables, against SQL where there is some and plain Python elsewhere."""

import hashlib
import re
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tracewell.llm import queries as Q

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_all_are_registered():
    names = entry.queries().keys()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if re.match(r"op\d+_", n)}
    assert "pipeline" in names and Q.oracle_sql().keys() <= entry.oracle_sql().keys() & names


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = Q.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    result = connection.execute(Q.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(row[names.index(c)] for c in columns) for row in result.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(expected, key=repr)


def test_bpe(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    library = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in Q.op3_bpe(spark, SF_DIR).collect()}
    assert got == {d: (len(i), digest(" ".join(map(str, i))), digest(library.decode(i, skip_special_tokens=False)))
                   for d, i in ids.items()}


def test_secrets(spark):
    from test_secrets import PATTERNS, brute

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in Q.op8_secrets(spark, SF_DIR).collect():
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
        assert all(r[f"n_{k}"] == base.count(f"{k}:") for k in PATTERNS)


@pytest.mark.parametrize("name,columns", [
    ("op4_lz_fingerprints", {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}),
    ("op6_quality", {"doc_id", "held_out", "score", "predicted"}), ("op7_pii", {"doc_id", "text", "lang", "source", "n_chars"})])
def test_whole_tables(spark, name, columns):
    df = Q.queries()[name](spark, SF_DIR)
    assert columns <= set(df.columns)
    assert df.count() == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
