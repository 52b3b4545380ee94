"""Preference pairs against plain Python."""

import random

from tracewell.llm import chat


def plain(rows):
    pairs = {}
    for pair, side, turn, role, text in rows:
        if pair is not None and side in ("chosen", "rejected"):
            text = (text or "").replace("<|im_end|>", "<| im_end |>").replace("<|im_start|>", "<| im_start |>")
            pairs.setdefault(pair, {"chosen": [], "rejected": []})[side].append(
                ((turn is not None, turn or 0), role or "", text))
    out = {}
    for pair, sides in pairs.items():
        c, r = (sorted(sides[s]) for s in ("chosen", "rejected"))
        n = 0
        while n < min(len(c), len(r)) and c[n][1:] == r[n][1:]:
            n += 1

        def render(turns):
            text, mask = "", []
            for _, role, said in turns:
                text += f"<|im_start|>{role}\n"
                start = len(text)
                text += said + "<|im_end|>"
                if role == "assistant":
                    mask.append((start, len(text)))
                text += "\n"
            return text, mask

        out[pair] = (n, render(c[:n])[0], *(x for i in (0, 1) for x in (render(c[n:])[i], render(r[n:])[i])))
    return out


def test_against_plain(spark):
    rng = random.Random(4)
    rows = []
    for pair in range(40):
        for side in ("chosen", "rejected", "other")[:rng.choice([1, 2, 2, 2, 3])]:
            for turn in range(rng.randint(0, 6)):
                rows.append((pair, side, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "assistant"][turn % 2:] + [None] * (rng.random() < 0.1)),
                             rng.choice(["hi", "hi", "hi", "é𝔘", "", None, "a<|im_end|>b"])))
    rows += [(None, "chosen", 0, "user", "x"), (99, "chosen", 0, "user", "x"), (99, "chosen", 0, "user", "x")]
    df = spark.createDataFrame([(*r, "p") for r in rows], "pair_id long, side string, turn int, role string, text string, prompt string")
    got = chat.preferences(df)
    assert got.columns == ["pair_id", "n_prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask"]
    found = {r.pair_id: (r.n_prompt_turns, r.prompt, r.chosen, r.rejected, [tuple(m) for m in r.chosen_mask],
                         [tuple(m) for m in r.rejected_mask]) for r in got.collect()}
    assert found == plain(rows)
    assert chat.preferences(df.limit(0)).collect() == []


def test_every_conversation_against_the_next(spark):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é", None])) for c in rng.sample(range(1000), 30)
            for t in range(rng.randint(1, 6))]
    rows += [(2000, 0, "user", "no answer"), (2001, 0, None, None), (2002, 0, "assistant", "only"), (2002, 0, "assistant", "only"),
             (None, 0, "assistant", "no id"), (5000, None, "assistant", "no turn")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, side string, place int")
    talks = {}
    for c, t, role, text in rows:
        if c is not None and t is not None:
            talks.setdefault(c, []).append((t, role, text))
    ids, expected = sorted(talks), []
    for i, c in enumerate(ids):
        best = lambda talk: max(((t, text or "") for t, role, text in talk if role == "assistant"), default=None)
        own, other = best(talks[c]), best(talks[ids[(i + 1) % len(ids)]])
        expected += [(c, "chosen", *x) for x in talks[c]]
        expected += [(c, "rejected", *x) for x in talks[c] if own is None or x[0] < own[0]]
        if own and other:
            expected += [(c, "rejected", t, role, other[1]) for t, role, _ in talks[c] if t == own[0] and role == "assistant"]
    got = chat.against_next(df).select("pair_id", "side", "turn", "role", "text")
    clean = lambda found: sorted((tuple(r[:3]) + (r[3] or "", r[4] or "") for r in found), key=repr)
    assert clean(got.collect()) == clean(expected)
    assert {r.pair_id for r in chat.preferences(got).collect()} == set(ids)
    one = chat.preferences(chat.against_next(df.where("conv_id = 2002"))).first()
    assert one.chosen == one.rejected == "" and one.n_prompt_turns == 2
    assert chat.against_next(df.limit(0)).collect() == []


def test_very_long_turns(spark):
    long = "é𝔘 " * 300_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long + "x"), (2, 0, "assistant", long)],
                               "conv_id long, turn int, role string, text string")
    got = {r.pair_id: r for r in chat.preferences(chat.against_next(df)).collect()}
    start = len("<|im_start|>assistant\n")
    assert got[1].n_prompt_turns == 1 and [tuple(m) for m in got[1].chosen_mask] == [(start, start + len(long) + 1 + len("<|im_end|>"))]
    assert [tuple(m) for m in got[1].rejected_mask] == [(start, start + len(long) + len("<|im_end|>"))]
