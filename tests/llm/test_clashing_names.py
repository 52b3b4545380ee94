"""Columns that are named like those the operators use inside stay as they are."""

import pytest

from tracewell.llm import bpe, decontaminate, html, pii


def test_clashing_names(spark):
    df = spark.createDataFrame(
        [(1, "call 017-555-7713 now", "a", "b", "c", "d", "e")],
        "doc_id long, text string, _source string, _Found string, _low string, _html string, _HOST string")
    given = df.first().asDict()
    text = pii.pseudonymised(df, "k")
    found = decontaminate.matches(df, df.select("text", "doc_id"), item="doc_id")
    page = html.extracted(df.withColumnRenamed("text", "html").withColumnRenamed("_source", "url"), text="TEXT")
    for out, changed in ((text, {"text"}), (found, set())):
        row = out.first().asDict()
        assert {k: row[k] for k in given if k not in changed} == {k: v for k, v in given.items() if k not in changed}
    row = page.first().asDict()
    assert (row["_low"], row["_html"], row["_HOST"], row["TEXT"]) == ("c", "d", "e", given["text"])
    public = pytest.importorskip("public_tokenizers")
    row = bpe.encode(df.withColumnRenamed("_low", "IDS"), public.path("word_bpe_49k.json"), decoded="back").first().asDict()
    assert row["_source"] == "a" and "IDS" not in row and len(row["ids"]) > 3
