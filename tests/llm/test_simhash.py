"""SimHash near-duplicates against comparing all pairs."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from textrec.llm import simhash


def slow_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def texts():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(200)]
    out = ["", None, " \t\n", "one", "One two", "ÉCOLE École a b", "x" * 100_000 + " y z " * 40_000]
    for _ in range(30):
        base = list(rng.choice(words, 120))
        out.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            near[rng.integers(120)] = "changed"
            out.append(" ".join(near))
            base = near
    return out + out[7:20]


def test_components_as_from_all_pairs(spark):
    own = texts()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(own)], "doc_id long, text string, print string, u int")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs.repartition(5)).collect()}
    prints = [slow_print(t) for t in own]
    assert [got[i].print & (2**64 - 1) for i in range(len(own))] == prints
    assert [got[i].component_id for i in range(len(own))] == slow_components(prints)


def test_crowded_anchors_lose_no_link(spark):
    rng = np.random.default_rng(5)
    prints = {0, 2**63}
    for _ in range(20):
        centre = int(rng.integers(2**62))
        prints |= {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (12, 2))}
    prints = sorted(prints)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "print long")
    label = slow_components(prints)
    for members in (20_000, 2):
        links = simhash.stars(simhash.fingerprint_links(df, (3,), 2, members)).collect()
        root = {p: p for p in prints} | {r.u & (2**64 - 1): r.v & (2**64 - 1) for r in links}
        groups = lambda names: sorted(sorted(p for p, n in names.items() if n == x) for x in set(names.values()))
        assert groups(root) == groups(dict(zip(prints, label)))


def test_empty_null_ids_and_repeats(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (None, "other words here now")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, schema)).orderBy(F.col("doc_id")).collect()
    assert sorted([r.component_id for r in got], key=str) == [7, 7, 7, None]


def test_two_prints_in_four_blocks(spark):
    """All links within 7 bits of the first fingerprint, if the second agrees."""
    rng = np.random.default_rng(7)
    rows = set()
    for _ in range(15):
        a, b = (int(x) for x in rng.integers(0, 2**62, 2))
        for _ in range(8):
            flips = lambda n: sum(1 << int(i) for i in set(rng.integers(0, 62, n).tolist()))
            rows.add((a ^ flips(rng.integers(0, 5)), b ^ flips(rng.integers(0, 9))))
    rows = sorted(rows)
    label = list(range(len(rows)))
    for i, x in enumerate(rows):
        for j in range(i):
            if (x[0] ^ rows[j][0]).bit_count() <= 7 and (x[1] ^ rows[j][1]).bit_count() <= 6:
                label = [min(label[i], label[j]) if n in (label[i], label[j]) else n for n in label]
    df = spark.createDataFrame(rows, "print long, print1 long")
    links = simhash.fingerprint_links(df, (7, 6), 4)
    own = simhash.stars(links.selectExpr("struct(u a, u1 b) u", "struct(v a, v1 b) v")).collect()
    root = {r: r for r in rows} | {tuple(r.u): tuple(r.v) for r in own}
    groups = lambda names: sorted(sorted(p for p, n in names.items() if n == x) for x in set(names.values()))
    assert groups(root) == groups(dict(zip(rows, label)))


def test_one_row_of_each_group_stays(spark):
    base = [f"w{i}" for i in range(200)]
    near = " ".join(base[:100] + ["other"] + base[101:])
    rows = [(5, " ".join(base)), (3, near), (9, near), (1, "alone here in text"), (1, "alone here in text"), (2, None), (4, ""), (None, near), (None, "no id at all here"), (None, "no id at all here"), (7, "seven one two"), (7, "seven other words now")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, print string, n long")
    options = {"shingle_words": simhash.SIMILAR_WORDS, "thresholds": simhash.SIMILAR_BITS, "blocks": simhash.SIMILAR_BLOCKS}
    kept = simhash.one_of_each_group(docs, **options)
    assert kept.columns == docs.columns
    got = sorted([(r.doc_id, r.text) for r in kept.collect()], key=str)
    assert got == sorted([(3, near), (1, "alone here in text"), (2, None), (None, "no id at all here"), (7, "seven one two"), (7, "seven other words now")], key=str)
    unique = docs.where("doc_id in (3, 5, 9, 2)")
    assert sorted(r.doc_id for r in simhash.one_of_each_group(unique, **options).collect()) == [2, 3]
    assert simhash.one_of_each_group(docs.limit(0)).count() == 0


def linked_groups(spark, rows, thresholds, blocks, members):
    signed = [tuple(x - 2**64 if x >= 2**63 else x for x in r) for r in rows]
    links = simhash.fingerprint_links(spark.createDataFrame(signed, "print long, print1 long"), thresholds, blocks, members)
    own = simhash.stars(links.selectExpr("struct(u a, u1 b) u", "struct(v a, v1 b) v")).collect()
    root = {r: r for r in signed} | {tuple(r.u): tuple(r.v) for r in own}
    names = [root[r] for r in signed]
    return [names.index(n) for n in names]


def test_crowded_anchors_keep_links_of_the_pipeline(spark):
    """Bits that differ in every byte, 8 to 12 of them, and the same groups whatever the crowding."""
    rng = np.random.default_rng(11)
    one_a_byte = sum(1 << 8 * j for j in range(8))
    rows = []
    for n in range(24):
        a, b = (int(x) for x in rng.integers(0, 2**63, 2))
        other = a ^ one_a_byte << int(rng.integers(8))
        for _ in range(n % 5):
            other ^= 1 << int(rng.integers(64))
        rows += [(a, b), (other, b ^ 0xFFF << int(rng.integers(50)))]
    expected = []
    for i, x in enumerate(rows):
        near = [j for j in range(i) if (x[0] ^ rows[j][0]).bit_count() <= 11 and (x[1] ^ rows[j][1]).bit_count() <= 12]
        expected.append(near[0] if near else i)
    for members in (20_000, 1):
        assert linked_groups(spark, rows, (11, 12), 4, members) == expected


def test_near_copies_without_end_are_compared_in_bounded_sets(spark, monkeypatch):
    rng = np.random.default_rng(13)
    a, b = (int(x) for x in rng.integers(0, 2**62, 2))
    rows = [(a ^ 1 << i ^ 1 << j, b) for i in range(0, 60, 4) for j in range(i)][:250]
    rows += [(a ^ 0xFFFFF << 20, b), (a ^ 0xFFFFF << 40, b)]
    made, largest = simhash._anchor_links, []

    def measured(copies, thresholds):
        largest.append(copies.groupBy("key").count().agg(F.max("count")).first()[0] or 0)
        return made(copies, thresholds)

    monkeypatch.setattr(simhash, "_anchor_links", measured)
    whole = linked_groups(spark, rows, (11, 12), 4, 20_000)
    assert largest.pop() >= 100
    assert linked_groups(spark, rows, (11, 12), 4, 60) == whole == [0] * 250 + [250, 251]
    assert max(largest) <= 90  # sets are dealt by hash and differ a little


def test_query_as_from_all_pairs(spark, tmp_path):
    from textrec.llm.query_dedup import op1_simhash

    own = texts()
    spark.createDataFrame(list(enumerate(own)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    prints = [slow_print(t) for t in own]
    got = sorted(tuple(r) for r in op1_simhash(spark, str(tmp_path)).collect())
    assert got == [(i, f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, slow_components(prints)))]
