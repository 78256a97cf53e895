"""Decontamination against sliding every window over every document."""

import random
import re

import pytest

from textrec.llm import decontaminate
from textrec.llm.decontaminate import clean_documents, contamination, positional_index, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, size, slop=0):
    out = []
    for doc, text in docs:
        w, hit, names = split(text), set(), set()
        for item, other in items:
            v = split(other)
            for win in {tuple(v[s : s + size]) for s in range(max(1, len(v) - size + 1))} if v else ():
                for s in range(-slop, len(w) + slop):
                    if all(any(0 <= p < len(w) and w[p] == x for p in range(s + i - slop, s + i + slop + 1)) for i, x in enumerate(win)):
                        hit |= set(range(max(s, 0), min(s + len(win), len(w))))
                        names |= {str(item)} if item is not None else set()
        out.append((doc, len(w), len(hit), sorted(names)))
    return sorted(out, key=repr)


def tables(seed, vocabulary, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["É", "Ñandú", "été"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 14)))) for i in range(12)]
    items += [(50, None), (51, "--"), (None, "w1 w2 w3 w4"), (3, items[3][1])]
    docs = []
    for i in range(n):
        own = rng.choices(words, k=rng.randint(0, 40))
        if rng.random() < 0.6:
            own[5:5] = split(rng.choice(items)[1])
        docs.append((i, ", ".join(own).upper() if i % 2 else "\n".join(own)))
    docs += [(100, None), (101, ""), (None, items[2][1]), (7, items[3][1]), (7, items[3][1]), (102, " ".join(["w1 w2"] * 20_000))]
    return docs, items


@pytest.mark.parametrize("size,vocabulary,slop", [(10, 30, 0), (4, 4, 0), (1, 30, 0), (4, 12, 1)])
def test_as_sliding_windows(spark, size, vocabulary, slop):
    docs, items = tables(size, vocabulary, 60)
    docs = docs[:-1] if slop else docs
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id long, term string").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id long")
    got = sorted((tuple(r) for r in contamination(d, b, size=size, slop=slop).collect()), key=repr)
    assert got == slow(docs, items, size, slop)


def test_empty_tables_and_clean_rows(spark):
    docs, items = tables(1, 30, 20)
    d = spark.createDataFrame([(*r, "more") for r in docs], "doc_id long, text string, lang string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {r.n_hit for r in contamination(d, b.limit(0)).collect()} == {0}
    assert contamination(d.limit(0), b).count() == 0
    assert sorted(str(r.doc_id) for r in clean_documents(d, b).collect()) == sorted(str(r[0]) for r in slow(docs, items, 10) if not r[2])


def test_rows_are_judged_by_their_own_text(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(None, passage), (None, "clean"), (1, passage + " more"), (1, "clean too"), (1, passage + " more"), (2, None), (None, None), (3, "clean")]
    # Other columns with the names that the operator's own tables have.
    schema = "doc_id long, text string, id long, doc string, n_hit int, items string"
    d = spark.createDataFrame([(*r, 5, "x", 1, "y") for r in rows], schema).repartition(3)
    b = spark.createDataFrame([(0, passage)], "item_id long, text string")
    kept = clean_documents(d, b)
    assert kept.columns == d.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(None, "clean"), (1, "clean too"), (2, None), (None, None), (3, "clean")], key=repr)


def test_proximity_query_as_sliding_windows(spark, tmp_path):
    from textrec.llm.query_dedup import near_passages

    rng = random.Random(8)
    drawn = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(i, " ".join(drawn(13))) for i in range(4)]
    docs = []
    for i in range(12):
        own = drawn(30)
        passage = items[i % 4][1].split()
        if i % 3:
            j = rng.randrange(11)
            passage[j], passage[j + 1] = passage[j + 1], passage[j]
        docs.append((i, " ".join(own[:9] + (passage if i < 9 else passage[::-1]) + own[9:])))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in near_passages(spark, str(tmp_path)).collect())
    assert got == sorted((i, n, hit, ",".join(found)) for i, n, hit, found in slow(docs, items, 10, 1))
    assert sum(r[2] > 0 for r in got) >= 9


def test_each_text_is_cut_into_words_once(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "stored", lambda df, label: df)
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    terms = spark.createDataFrame([("a", 2), ("\n", 1)], "word string, term long")
    index = positional_index(docs, terms, "doc_id", "text")
    assert sorted((r.at, r.term) for r in index.collect()) == [(0, 2), (2, 1)]
    assert index._jdf.queryExecution().optimizedPlan().toString().count(r"\x3A-\x60") == 1


def test_words_of_odd_texts(spark):
    texts = [None, "", " ", "--", "a", "-a", "a-", "--a--", "a\x00b", "A\tÉ\x7fe\u0301 \u00a0z", "Ç9d 漢字 😀x", "\x80\u2028[Q]"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", words("text").alias("w")).collect()
    assert {r.i: r.w for r in got} == {i: split(t) for i, t in enumerate(texts)}
