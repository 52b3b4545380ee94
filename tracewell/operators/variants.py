"""Variants: cases with the same trace, of which one can stand for all.

A trace is known by a tree of hashes: its events are cut into parts of ``PART_ROWS``, each part gets the digest of its
activities in order, digests are cut into parts in the same way, and so on until one is left for the case. No row, task or
shuffle key holds more of a case than a part, however long the case is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.ordering import block_of
from tracewell.functions.storage import materialize

#: Events, and digests of such parts, under one digest.
PART_ROWS = 1 << 10


def trace_digests(log: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``case_id, digest``: equal for two cases if and, but for collisions of SHA-256, only if their traces are equal.

    Each round makes the digests of one level. All cases go through the same rounds, of which there are as many as the longest
    one needs: one up to ``part_rows`` events, two up to its square.
    """
    if part_rows < 2:
        raise ValueError("a part must hold at least two events")
    # The length before a name says where it ends.
    names = log.select("case_id", "pos", F.concat(
        F.octet_length("activity").cast("string"), F.lit(":"), "activity").alias("digest"))
    while True:
        names = materialize(
            names.groupBy("case_id", block_of(F.col("pos"), part_rows).alias("part"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("part_of"))
            .select("case_id", (F.col("part") + 1).alias("pos"),
                    F.sha2(F.array_join("part_of.digest", ""), 256).alias("digest")),
            "digests")
        if names.filter("pos > 1").isEmpty():
            return names.select("case_id", "digest")


def variants(log: DataFrame, part_rows: int = PART_ROWS) -> tuple[DataFrame, DataFrame]:
    """A log with one case for each distinct trace, and ``case_id, variant``: which of them each case is like.

    A variant is named after its smallest case and has that case's events as they are in ``log``, blocks included. Both
    are written once; the log is read twice.
    """
    digests = trace_digests(log, part_rows)
    first = digests.groupBy("digest").agg(F.min("case_id").alias("variant"))
    cases = materialize(digests.join(first, "digest").select("case_id", "variant"), "case-variants")
    chosen = cases.filter("case_id = variant").select("case_id")
    return materialize(log.join(chosen, "case_id", "left_semi"), "variant-log"), cases
