"""Lookup-table placement."""

from collections import Counter

import pytest

from textrec.llm.sharding import _digest, place, slot_of, slot_table, write_shards


def slow_table(shards, slots):
    orders = [[(_digest(f"offset {s}") + i * (_digest(f"step {s}") % (slots - 1) + 1)) % slots for i in range(slots)] for s in shards]
    owner = {}
    while True:
        for n, order in enumerate(orders):
            if len(owner) == slots:
                return tuple(owner[i] for i in range(slots))
            owner[next(x for x in order if x not in owner)] = n


def test_turns():
    names = tuple("abcdefg")
    assert slot_table(names, 251) == slow_table(names, 251)
    shares = Counter(slot_table(names, 1009)).values()
    assert max(shares) - min(shares) <= 1


def test_few_slots_move():
    before, after = slot_table(tuple("abcdefgh"), 10007), slot_table(tuple("abcdefg"), 10007)
    moved = sum(x != y for x, y in zip(before, after) if x != 7)
    assert moved < 0.05 * 10007


def test_bad_tables():
    for shards, slots in (((), 7), (("a", "a"), 7), (("a",), 8), (tuple("abcde"), 3)):
        with pytest.raises(ValueError):
            slot_table(shards, slots)


def test_rows(spark, tmp_path):
    rows = [(None, "a"), (None, "b"), ("", "c"), ("x", "d"), ("x", "d"), ("x" * 100_000, None)]
    df = spark.createDataFrame(rows, "key string, text string")
    out = place(df, ["key"], ["s1", "s2", "s3"]).collect()
    table = slot_table(("s1", "s2", "s3"))
    assert len(out) == len(rows) and all(r.shard == f"s{table[r.slot] + 1}" for r in out)
    assert len({r.slot for r in out if r.key is None}) == 1 and len({r.slot for r in out}) == 4
    with pytest.raises(ValueError):
        place(df.withColumnRenamed("text", "slot"), ["key"], ["s1"])
    assert place(df.limit(0), ["key"], ["s1"]).count() == 0
    write_shards(place(df, ["key"], ["s1", "s2"]), f"{tmp_path}/shards")
    assert spark.read.parquet(f"{tmp_path}/shards").count() == len(rows)
    assert df.select(slot_of(["key", "text"])).distinct().count() == 5
