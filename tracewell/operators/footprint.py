"""Footprint: the relation ``->``, ``<-``, ``||`` or ``#`` between any two activities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize

COUNTING_MODES = ("last_wins", "presence")


def oriented_pairs(rows: DataFrame, keys: list[str], counting: str) -> DataFrame:
    """Final orientation of each pair per case.

    ``rows`` has the ``keys``, ``pos`` and the flag ``fwd`` of every sighting of a pair.
    Under ``last_wins`` the last sighting decides; under ``presence`` both orientations may hold.
    """
    if counting not in COUNTING_MODES:
        raise ValueError(f"counting must be one of {COUNTING_MODES}, not {counting!r}")
    fwd = F.col("fwd").cast("bigint")
    if counting == "last_wins":
        # Position and orientation in one number, so that a plain max finds the last sighting.
        last = rows.groupBy(*keys).agg(F.max(F.col("pos") * 2 + fwd).alias("last"))
        forward = F.col("last") % 2 == 1
        return last.select(*keys, forward.alias("forward"), (~forward).alias("backward"))
    return rows.groupBy(*keys).agg(
        F.bool_or("fwd").alias("forward"), F.bool_or(~F.col("fwd")).alias("backward"))


def trace_follow_pairs(log: DataFrame, counting: str = "last_wins") -> DataFrame:
    """``case_id, a, b, forward, backward`` for each pair a <= b that is adjacent in the case."""
    sightings = log.filter(F.col("next1").isNotNull()).select(
        "case_id",
        F.least("activity", "next1").alias("a"),
        F.greatest("activity", "next1").alias("b"),
        (F.col("activity") <= F.col("next1")).alias("fwd"),
        "pos")
    return oriented_pairs(sightings, ["case_id", "a", "b"], counting)


def follow_flags(log: DataFrame, counting: str = "last_wins") -> DataFrame:
    """``a, b, forward, backward``: orientations seen in any case."""
    return trace_follow_pairs(log, counting).groupBy("a", "b").agg(
        F.bool_or("forward").alias("forward"), F.bool_or("backward").alias("backward"))


def log_profile(log: DataFrame, counting: str = "last_wins") -> DataFrame:
    """``kind, a, b, forward, backward, long``, all that the discovery of a net needs, from one pass over a log.

    Rows of kind ``pair`` are those of follow_flags(); those of kind ``start`` and ``end`` have the first
    and last activities of cases in ``a`` and ``b``. ``long`` says whether a case with the row is cut into blocks.
    """
    def row(kind: str, a, b):
        return F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))

    own, after = F.col("activity"), F.col("next1")
    sightings = log.select(
        "case_id", "pos", (own <= after).alias("up"), F.col("block").isNotNull().alias("long"), F.inline(F.array_compact(F.array(
            F.when(after.isNotNull(), row("pair", F.least(own, after), F.greatest(own, after)))
            .otherwise(row("end", own, own)),
            F.when(F.col("pos") == 1, row("start", own, own))))))
    keys = ["case_id", "kind", "a", "b", "long"]
    by_case = oriented_pairs(sightings.withColumn("fwd", F.coalesce("up", F.lit(True))), keys, counting)
    return by_case.groupBy("kind", "a", "b").agg(
        F.bool_or("forward").alias("forward"), F.bool_or("backward").alias("backward"), F.bool_or("long").alias("long"))


def profile_alphabet(profile: DataFrame) -> DataFrame:
    return profile.select(F.explode(F.array("a", "b")).alias("activity")).distinct()


def footprint(log: DataFrame, counting: str = "last_wins") -> DataFrame:
    """``a, b, relation`` for all ordered pairs of activities. A self-loop is ``->``. The log is read once."""
    return profile_footprint(materialize(log_profile(log, counting), "profile"))


def profile_footprint(profile: DataFrame) -> DataFrame:
    """The footprint of a log, from its profile."""
    return _matrix(profile.where("kind = 'pair'"), profile_alphabet(profile))


def related_cells(flags: DataFrame) -> DataFrame:
    """``a, b, relation``: the cells of a footprint but those with ``#``, from follow_flags() or a profile's pairs."""
    # A pair fills two cells of the matrix, a self-loop only one.
    return (
        flags.selectExpr("a", "b", "CASE WHEN forward AND backward THEN '||' WHEN forward THEN '->' ELSE '<-' END AS there",
                    "CASE WHEN forward AND backward THEN '||' WHEN forward THEN '<-' ELSE '->' END AS back")
        .selectExpr("stack(2, a, b, there, if(a = b, NULL, b), a, back) AS (a, b, relation)")
        .filter("a IS NOT NULL"))


def _matrix(flags: DataFrame, alphabet: DataFrame) -> DataFrame:
    seen = related_cells(flags)
    names = alphabet.agg(F.array_sort(F.collect_list("activity")).alias("names"))
    cells = alphabet.select(F.col("activity").alias("a"), names.scalar().alias("names")).select(
        "a", F.explode_outer("names").alias("b"))
    return cells.join(seen, ["a", "b"], "left").select(
        "a", "b", F.coalesce("relation", F.lit("#")).alias("relation"))


def footprint_rows(fp: DataFrame) -> DataFrame:
    """``activity, relations``: a row of the matrix, columns in name order."""
    return (
        fp.groupBy(F.col("a").alias("activity"))
        .agg(F.array_sort(F.collect_list(F.struct("b", "relation"))).alias("cells"))
        .select("activity", F.col("cells.relation").alias("relations")))


def footprint_text(fp: DataFrame) -> DataFrame:
    """``row_no, line``: the matrix as tab-separated text, header first, every cell followed by a tab."""
    cells = fp.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "relation"))).alias("cells"))
    header = cells.agg(F.array_sort(F.collect_list("a")).alias("names"))
    lines = cells.select(F.col("a"), header.scalar().alias("names"), F.col("cells.relation").alias("relations")).select(
        F.array_position("names", F.col("a")).alias("row_no"),
        F.concat("a", F.lit("\t"), F.array_join(F.transform("relations", lambda r: F.concat(r, F.lit("\t"))), ""))
        .alias("line"))
    top = header.select(
        F.lit(0).cast("bigint").alias("row_no"),
        F.concat(F.lit("\t"), F.array_join(F.transform("names", lambda n: F.concat(n, F.lit("\t"))), ""))
        .alias("line"))
    return top.unionByName(lines)


def relation_lookup(pairs: DataFrame, fp: DataFrame) -> DataFrame:
    """Relation of each given ``a, b``; null for a pair with an unknown activity."""
    return pairs.join(fp, ["a", "b"], "left").select(*pairs.columns, "relation")


def connected_pairs(fp: DataFrame) -> DataFrame:
    return fp.filter(F.col("relation") != "#")


def sequence_pairs(fp: DataFrame) -> DataFrame:
    return fp.filter(F.col("relation") == "->").select("a", "b")


def relation_sets(fp: DataFrame) -> DataFrame:
    """``activity, unrelated, followers, preceders``: all b with ``#``, ``->`` and ``<-``."""
    def related(relation: str):
        return F.array_sort(F.collect_list(F.when(F.col("relation") == relation, F.col("b"))))

    return fp.groupBy(F.col("a").alias("activity")).agg(
        related("#").alias("unrelated"), related("->").alias("followers"), related("<-").alias("preceders"))


def sets_connected(pairs: DataFrame, fp: DataFrame) -> DataFrame:
    """For each row ``pair_id, in_set, out_set``: may a place have these inputs and outputs?

    ``connected`` is true when the members of each set are mutually (and each with itself)
    unrelated and every input is followed by every output. Unknown activities fit nowhere.
    """
    members = pairs.select("pair_id", "in_set", "out_set", F.explode_outer(F.concat(
        F.transform("in_set", lambda a: F.struct(a.alias("activity"), F.lit(True).alias("is_input"))),
        F.transform("out_set", lambda a: F.struct(a.alias("activity"), F.lit(False).alias("is_input"))),
    )).alias("member")).select("pair_id", "in_set", "out_set", "member.*")

    def within(members_of: str, allowed: str):
        return F.size(F.array_except(members_of, allowed)) == 0

    fits = F.when(
        F.col("is_input"), within("in_set", "unrelated") & within("out_set", "followers")
    ).otherwise(within("out_set", "unrelated"))
    return (
        members.join(relation_sets(fp), "activity", "left")
        .groupBy("pair_id").agg(F.bool_and(F.coalesce(fits, F.col("activity").isNull())).alias("connected")))
