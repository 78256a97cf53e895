"""Collapsed conversations against comparing all of them."""

import itertools
import random

from textrec.llm.chat import maximal_conversations, numbered_turns, prefix_hashes, render_conversations, rendered_turns

SCHEMA = "conv_id long, turn long, role string, text string, at int, last string"


def slow(rows):
    turns = {}
    for conv, turn, role, text in rows:
        turns.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    out = {}
    for conv, own in turns.items():
        if any(len(o) > len(own) and o[: len(own)] == own for o in turns.values()):
            continue
        same = [c for c, o in turns.items() if o == own]
        named = [c for c in same if c is not None]
        text = "".join(f"<|{r if has else 'unknown'}|>\n{t}<|end|>\n" for has, r, _, t in own)
        out[min(named) if named else None] = (len(own), len(same), text)
    return out


def test_as_comparing_all(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            rows.append((conv, turn, ["user", "assistant"][turn % 2], rng.choice("aab")))
    rows += [(100, 0, "user", None), (101, 0, "user", ""), (102, 0, None, "x"), (102, 0, None, "x"), (None, 0, "user", "z"), (103, None, "user", "n")]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(4)
    got = {r.conv_id: (r.n_turns, r.copies, r.rendered) for r in render_conversations(df).collect()}
    assert got == slow(rows)


def test_one_first_turn_for_all_and_long_texts(spark):
    rows = [(c, t, "user", "same" if t == 0 else f"{c}" * 1000) for c, t in itertools.product(range(300), range(2))]
    rows += [(1000 + c, 0, "user", "same") for c in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kept = maximal_conversations(df).collect()
    assert sorted(r.conv_id for r in kept) == list(range(300)) and {r.copies for r in kept} == {1}


def test_a_hot_conversation_in_blocks(spark):
    """Prefixes of a conversation of many turns, and the rows without an id, are added up block by block."""
    rows = [(c, t, "user", f"t{t}") for c, n in ((1, 900), (2, 500), (3, 899), (None, 700)) for t in range(n)] + [(4, t, "user", "other") for t in range(5)]
    random.Random(2).shuffle(rows)
    placed = numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5), "conv_id", "turn", "role", "text")
    whole = {(r.conv, r.at): (r.h1, r.h2, r["last"]) for r in prefix_hashes(placed, 10_000).collect()}
    for block in (1, 64):
        assert {(r.conv, r.at): (r.h1, r.h2, r["last"]) for r in prefix_hashes(placed, block).collect()} == whole
    assert whole[1, 500][:2] == whole[2, 500][:2] == whole[None, 500][:2] and whole[2, 500][2] and not whole[1, 500][2]
    long = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = rendered_turns(long).collect()
    assert sorted((r.conv_id, r.at) for r in turns) == [(1, i + 1) for i in range(900)] + [(4, i + 1) for i in range(5)]
    texts = {r.conv_id: r.rendered for r in render_conversations(long).collect()}
    assert {c: "".join(r.rendered for r in sorted(turns, key=lambda r: r.at) if r.conv_id == c) for c in (1, 4)} == texts


def test_no_turns_and_no_python(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = render_conversations(df)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()
