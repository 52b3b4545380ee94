"""Preference pairs as training text: one prompt for what both conversations share, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.storage import materialize
from tracewell.llm.common import ranked

# Fixed markers of the chat format.
START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


def _header(turn: Column) -> Column:
    return F.concat(F.lit(START), turn["role"], F.lit("\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END + "\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def _mask(turns: Column, trained: str) -> Column:
    """The code points [start, end) of what is trained on: bodies of turns of that role, end marker included."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(s: Column, t: Column) -> Column:
        start = s["at"] + F.length(_header(t))
        end = start + F.length(_body(t))
        span = F.array(F.struct(start.alias("start"), (end - 1).alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == trained, F.concat(s["out"], span)).otherwise(
            s["out"]).alias("out"))

    return F.aggregate(turns, begin, add, lambda s: s["out"])


def preferences(turns: DataFrame, pair: str = "pair_id", side: str = "side", turn: str = "turn", role: str = "role",
                text: str = "text", trained: str = "assistant") -> DataFrame:
    """One row for each pair of conversations: ``pair, n_prompt_turns, prompt, chosen, rejected`` and two masks.

    ``turns`` has a row for each turn of either side, ``chosen`` or ``rejected``; other sides and rows without
    a pair count for nothing, other columns play no part. Turns are in order of ``turn``, then of role and text,
    so repeated ones follow each other; a null turn comes first, a null role or text is empty. The prompt holds
    the longest prefix of turns equal in role and text; each completion the rest of its side, empty if there is
    none. Masks are the code points [start, end) of a completion that loss is taken on: what turns of the role
    ``trained`` say, with the end marker. Markers inside a text are set apart by blanks and so mean nothing.

    A pair's turns come together in one row, as they must in the result; nothing else is shuffled. An empty table gives no
    rows, and a very long text is rendered as a whole.
    """
    clean = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<\|(im_start|im_end)\|>", "<| $1 |>")
    row = F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   clean.alias("text"))

    def of(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col(side) == name, row))).cast(TURNS)

    both = turns.where(F.col(side).isin("chosen", "rejected") & F.col(pair).isNotNull()).groupBy(
        F.col(pair).alias(pair)).agg(of("chosen").alias("_c"), of("rejected").alias("_r"))
    shared = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.least(F.size("_c"), F.size("_r")), F.lit(0))), F.lit(0),
        lambda n, i: F.when((n == i) & (F.get("_c", i)["role"] == F.get("_r", i)["role"])
                            & (F.get("_c", i)["text"] == F.get("_r", i)["text"]), n + 1).otherwise(n))
    both = both.withColumn("_n", shared)
    rest = {name: F.slice(f"_{name[0]}", F.col("_n") + 1, F.size(f"_{name[0]}")) for name in ("chosen", "rejected")}
    return both.select(
        pair, F.col("_n").alias("n_prompt_turns"), _rendered(F.slice("_c", F.lit(1), F.col("_n"))).alias("prompt"),
        *(_rendered(t).alias(name) for name, t in rest.items()),
        *(_mask(t, trained).alias(f"{name}_mask") for name, t in rest.items()))


def against_next(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", answers: str = "assistant") -> DataFrame:
    """``pair_id, side, turn, role, text`` for ``preferences``: every conversation with the last answer of the next one.

    Each conversation is a chosen side. Its rejected side ends before its last turn of the role ``answers`` and goes on with
    the last one of the conversation of the next id, that of the last with the first's. Where one of the two has no answer, nothing takes
    its place; a conversation alone is its own next. Turns without an id or a turn count for nothing, nulls in role and text stay, repeated
    turns stay repeated, of equal last turns that of the greatest text answers. Other columns play no part.

    Conversations meet as one row each, numbered by id in ranges; turns are then joined with those by id.
    """
    said = turns.select(F.col(f"`{conversation}`").alias("pair_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
                        F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text")).dropna(subset=["pair_id", "turn"])
    is_answer = F.coalesce(F.col("role") == answers, F.lit(False))
    last = materialize(said.groupBy("pair_id").agg(
        F.max(F.when(is_answer, F.struct("turn", "text"))).alias("answer")), "last-answers")
    places = materialize(ranked(last, [], ["pair_id"], "place"), "conversations")
    count = max(places.count(), 1)
    after = places.select(((F.col("place") + (count - 1)) % count).alias("place"), F.col("answer").alias("other"))
    pairs = places.join(after, "place").select("pair_id", F.col("answer.turn").alias("last"), "other")
    both = said.join(pairs, "pair_id")
    is_last = F.coalesce(F.col("turn") == F.col("last"), F.lit(False)) & is_answer

    def side(name: str, words: str) -> Column:
        return F.array(F.struct(F.lit(name).alias("side"), F.col(words).alias("said")))

    before = F.col("last").isNull() | (F.col("turn") < F.col("last"))
    return both.select("pair_id", "turn", "role", F.inline(
        F.when(before, F.concat(side("chosen", "text"), side("rejected", "text")))
        .when(is_last & F.col("other").isNotNull(), F.concat(side("chosen", "text"), side("rejected", "other.text")))
        .otherwise(side("chosen", "text")))).withColumnRenamed("said", "text")
