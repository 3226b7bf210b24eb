"""Near duplicates and components against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import near_dups
from ledgerline.llm.components import components
from ledgerline.llm.near_dups import estimated, near_duplicates, signatures

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n):
    words = WORD.findall((text or "").translate(FOLD))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def expected(docs, n):
    sets = {d: shingle_set(t, n) for d, t in docs}
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def made(seed, groups=6, size=14):
    """Chains and stars of copies with a few words changed; some pairs lie near 0.8."""
    pick, docs = random.Random(seed), []
    for g in range(groups):
        text = [f"w{pick.randrange(400)}" for _ in range(pick.randrange(3, 120))]
        for k in range(size):
            copy = list(text)
            for _ in range(pick.randrange(0, 4)):
                copy[pick.randrange(len(copy))] = f"n{pick.randrange(99)}"
            if g % 2:
                text = copy
            docs.append((" ".join(w.upper() if k % 5 == 0 else w for w in copy)))
    pick.shuffle(docs)
    return list(enumerate(docs + ["", None, "one", "ONE", "one two", " \n"]))


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("seed,n,block", [(1, 4, None), (2, 5, None), (3, 4, 2)])
def test_equals_all_pairs(spark, monkeypatch, seed, n, block):
    if block:      # clusters of several blocks
        monkeypatch.setattr(near_dups, "LEAST_BLOCK", block)
    docs = made(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(near_duplicates(df, n)) == expected(docs, n)


def test_edges(spark):
    rows = [(None, "a b c d e f", 1), (None, "a b c d e f", 1), (3, "a b c d e f", 1), (3, "a b c d e f", 1),
            (5, "A B C D E F", 1), (9, "x" * 100_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep int")
    got = sorted(map(tuple, near_duplicates(df, 4).collect()), key=str)
    assert got == sorted([(None, 3, None, True)] * 2 + [(3, 3, 3, True)] * 2 + [(5, 3, 3, False), (9, 1, 9, True)], key=str)
    assert near_duplicates(df.filter("false"), 4).count() == 0
    lone = near_duplicates(df.filter("doc_id = 9"), 4).collect()
    assert [tuple(r) for r in lone] == [(9, 1, 9, True)]


def test_low_bits_estimate_similarity(spark):
    words = [f"w{i}" for i in range(2000)]
    texts = [" ".join(words[a:a + 1000]) for a in (0, 100, 500, 1000)]
    df = signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1).select("id", "low")
    pairs = df.withColumnsRenamed({"id": "a", "low": "low_a"}).filter("a = 0").join(
        df.withColumnsRenamed({"id": "b", "low": "low_b"}))
    got = {r["b"]: r["e"] for r in pairs.select("b", estimated("low_a", "low_b").alias("e")).collect()}
    for b, true in ((0, 1.0), (1, 900 / 1100), (2, 500 / 1500), (3, 0.0)):
        assert abs(got[b] - true) < 0.16


def test_short_texts_are_one_shingle():
    values, first = near_dups.shingles(pa.array(["a b", "B A", "a", "", None, "a b c d", "A B"]), 4)
    assert np.diff(first).tolist() == [1, 1, 1, 0, 0, 1, 1] and values[0] == values[4] != values[1]


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    pick = random.Random(seed)
    links = [(pick.randrange(60), pick.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)] + [
        (200, 200 + i) for i in range(1, 30)] + [(None, 1), (2, None), (7, 7)]
    least = {n: n for pair in links for n in pair if n is not None}
    for _ in least:
        for a, b in links:
            if a is not None and b is not None:
                least[a] = least[b] = min(least[a], least[b])
    got = {r["node"]: r["component"] for r in components(
        spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    joined = {n for a, b in links if None not in (a, b) and a != b for n in (a, b)}
    assert {n: got.get(n, n) for n in least if n in joined} == {n: least[n] for n in joined}
