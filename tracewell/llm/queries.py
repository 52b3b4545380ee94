"""One query for each operator of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import (
    bpe, chat, decontaminate, html, infill, licenses, lz, manifest, minhash, pii, quality, secrets, sharding)
from tracewell.llm.oracles import oracle_sql  # noqa: F401  for whoever adds the queries


ROOT = str(Path(__file__).resolve().parents[2])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Workers of a session that was started elsewhere look for this package where the driver has it.
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_vocabulary() -> str:
    """The place of the public vocabulary file; a parameter of the operators, asked for only when one runs."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs: every conversation, and the same with the last answer of the next one."""
    pairs = chat.preferences(chat.against_next(table(spark, sf_dir, "conversations")))
    spans = {f"{s}_mask": F.array_join(F.transform(f"{s}_mask", lambda m: F.concat_ws(
        ":", m["start"].cast("string"), m["end"].cast("string"))), ",") for s in ("chosen", "rejected")}
    return pairs.withColumns(spans)


#: A document's place in the made-up file tree of the licence query: one to three directories deep.
DOCUMENT_PATH = """concat(source, '/', CASE WHEN doc_id % 3 > 0 THEN concat(lang, '/') ELSE '' END,
    CASE WHEN doc_id % 3 > 1 THEN concat(cast(floor(doc_id / 100) AS string), '/') ELSE '' END,
    cast(doc_id AS string), '.txt')"""


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document, seen as a file; whose licence lines are a tenth of its words speaks for others."""
    docs = table(spark, sf_dir, "documents").select(F.expr(DOCUMENT_PATH).alias("path"), "text")
    return licenses.licensed(docs, file_share=0.1)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as digests."""
    docs = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), word_vocabulary(), decoded="decoded")
    return docs.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lempel-Ziv fingerprints of every document and its edited text, and how near they and the next one are."""
    return lz.edited_and_next(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extracted(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each document is good, learnt from two thirds of the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The key of the pseudonyms in the queries and the pipeline; a user keeps an own one secret.
PSEUDONYM_KEY = "example key"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data under pseudonyms, and how many values of each kind that were."""
    return pii.pseudonymised(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, by pattern and by the Markov models."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = secrets.found(docs, secrets.fit(docs))
    return spans.select(
        "doc_id", *(secrets.count("base", k).alias(f"n_{k}") for k in secrets.PATTERNS),
        F.sha2(secrets.listed("base"), 256).alias("base_sha256"), secrets.listed("spans").alias("spans"),
        secrets.count("spans", "random").alias("n_random"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of near copies, on three-word shingles and a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.Scheme(words=3, percent=85))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document inside benchmark windows, and the items these come from."""
    found = decontaminate.matches(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-middle example, and the text that comes back from it, as digests."""
    docs = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", F.col("n_units").alias("n"), "form", F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(), 256).alias("restored_sha256"))


#: Shards of the sharding query.
SHARDS = 16


def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, by its id, its place there, and the shard it goes to when there is one more."""
    rows = sharding.assigned(
        table(spark, sf_dir, "documents"), sharding.even(SHARDS), sharding.even(SHARDS + 1))
    return rows.withColumn("law", F.lit("key"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf of a Merkle tree by language, and whether its witness proves it after tampering.

    Tampering adds 1 to the n_chars of every document whose id has a checksum that 7 divides.
    """
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    leaf, other = (manifest.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
                   for n in (F.col("n_chars"), tampered))
    built = manifest.built(docs, F.col("lang"), F.col("doc_id"), leaf, other)
    return manifest.proven(built, "doc_id").drop("other", "witness")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (
        op1_preferences, op2_licenses, op3_bpe, op4_lz_fingerprints, op5_html, op6_quality, op7_pii, op8_secrets,
        op9_near_dedup, op10_decontaminate, op11_infill, op12_shards, op13_manifest)
    return {f.__name__: f for f in operators}
