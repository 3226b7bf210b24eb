"""Targets by repeated sharing, and the words that a mix takes."""

import random
from collections import defaultdict

import pytest

from ledgerline.llm.mixing import mix, targets


def shared_again(sizes, weights=(5, 2, 1), most=3):
    """Share all words by weight; give what is above a stop to the others, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in stopped]
        left, w = total - sum(stopped.values()), sum(weight[s] for s in rest)
        share = {s: left * weight[s] / w for s in rest} if rest else {}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped.update({s: most * sizes[s] for s in over})


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    pick = random.Random(seed)
    sizes = {f"s{i}": int(10 ** pick.uniform(0, 4)) for i in range(9)} | {None: 500, "é": 3, "z": 0}
    got = {r["source"]: r["target"] for r in targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = shared_again(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_no_fourth_copy_of_texts_without_words(spark):
    """A small source at its stop, half of whose rows are empty."""
    rows = [(i, "w " * 5 if i % 2 else pick, "b") for i, pick in enumerate([None, "", " "] * 20)]
    rows += [(1000 + i, "w " * 400, "a") for i in range(60)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    small = [r for r in got if r["doc_id"] < 1000]
    assert {r["copies"] for r in small} == {3} and max(r["copies"] for r in got) <= 3
    assert sum(r["taken"] for r in small) == 3 * small[0]["source_size"]


def made(seed):
    pick = random.Random(seed)
    rows = [(i, " ".join("w" * 3 for _ in range(pick.randrange(40))) if i % 11 else None,
             pick.choice(["a"] * 9 + ["b", "c", "d", None])) for i in range(400)]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_mix_keeps_to_the_targets(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mix(df).collect()
    again = mix(df.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    by = {r["doc_id"]: r for r in got}
    assert len(by) == len(rows) == len(got)
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for doc, text, source in rows:
        r, n = by[doc], len((text or "").split())
        assert r["size"] == n and r["taken"] == r["copies"] * n and r["copies"] <= 3
        size[source] += n
        taken[source] += r["taken"]
        largest[source] = max(largest[source], n)
    for doc, _, source in rows:
        assert by[doc]["source_size"] == size[source]
    want = shared_again(size)
    for source in size:
        assert abs(taken[source] - want[source]) <= largest[source] / 2 + 1
    copies = defaultdict(set)
    for doc, _, source in rows:
        copies[source].add(by[doc]["copies"])
    assert all(max(c) - min(c) <= 1 for c in copies.values())


def test_edges(spark):
    kind = "doc_id long, text string, source string, size string, copies string"
    df = spark.createDataFrame([(1, "", "a", "", ""), (None, "x y", None, "", ""), (None, "x y", None, "", ""),
                                (2, " ", "b", "", "")], kind)
    got = sorted((r["doc_id"] or 0, r["size"], r["source_size"], r["taken"]) for r in mix(df).collect())
    assert got == [(0, 2, 4, 2), (0, 2, 4, 2), (1, 0, 0, 0), (2, 0, 0, 0)] or sum(g[3] for g in got) == 4
    assert mix(df.filter("false")).count() == 0
    assert [r["taken"] for r in mix(df.filter("doc_id = 1")).collect()] == [0]
