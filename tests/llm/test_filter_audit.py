"""Every order of the filters applied to the rows one by one, and the sorted lists by themselves."""

import random
import re
from itertools import combinations, permutations

import numpy as np

from ledgerline.llm.filter_audit import FILTERS, LISTS, audit, block_sizes, failures, posting_lists

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KIND = "doc_id long, text string, lang string, part string, id int, digest string, _key int, own int"


def fails(i, text, rows):
    text, words = text or "", WORD.findall(text or "")
    return {name for name, failed in {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
        "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
    }.items() if failed}


def brute(rows, labels):
    """One row at a time through every order."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(i, fails(i, t, rows)) for i, t, lang in rows if (lang or "") == part]
        shapley = dict.fromkeys(FILTERS, 0)
        for order in map("".join, permutations(FILTERS)):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                left = [r for r in left if name not in r[1]]
                shapley[name] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(name in f for _, f in mine) - len(gone),
                    sum(f == {name} for _, f in mine), sum(i in good for i, _ in gone),
                    sum(i in toxic for i, _ in gone), name]
        for key, values in out.items():
            if key[0] == part:
                values[-1] = shapley[values[-1]]
    return {k: tuple(v) for k, v in out.items()}


def made(seed=3, n=260):
    pick = random.Random(seed)
    pool = ["", None, "Short", "a # b", "W " * 210, " ".join(f"w{k}" for k in range(230)), "é" * 40, "\n", "UP and down " * 80]
    rows = []
    for _ in range(n):
        words = [pick.choice(["a", "bb", "Ccc", "d%", "é", "漢字", f"v{pick.randrange(900)}"]) for _ in range(pick.choice([3, 150, 199, 200, 260]))]
        text = pick.choice(pool) if pick.random() < 0.5 else pick.choice([" ", "\n", "\t "]).join(words)
        rows.append((pick.choice([None, pick.randrange(-5, 150)]), text, pick.choice(["en", "de", "", None])))
    rows += [(7, "the same text", "en")] * 60 + [(None, "the same text", None)] * 40 + [(1, "x" * 300_000, "long")]
    labels = [(pick.choice([None, pick.randrange(150)]), pick.choice([0, 1, None]), pick.choice([0, 1, None])) for _ in range(90)]
    return rows, labels + labels[:10]


def test_every_order_against_rows_one_by_one(spark):
    rows, labels = made()
    docs = spark.createDataFrame([(*r, "x", 1, "d", 0, 0) for r in rows], KIND).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in audit(docs, marks).collect()}
    assert got == brute(rows, labels)


def test_nothing_gives_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit(docs, marks).count() == 0
    one = spark.createDataFrame([(None, None, None)], docs.schema)
    found = audit(one, marks).collect()
    assert len(found) == 600 and {r["part"] for r in found} == {""} and {r["shapley"] for r in found if r["filter_order"][0] == "E" and r["step"] == 1} == {0}


def test_lists_of_ids(spark):
    rows, labels = made(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = failures(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    blocks = posting_lists(found).collect()
    assert sum(len(b["ids"]) for b in blocks) == len(rows)
    by_part = {}
    for b in blocks:
        assert b["ids"] == sorted(b["ids"], key=lambda i: (i is not None, i or 0))
        for name in LISTS:
            assert b[name] == sorted(set(b[name]))
        by_part.setdefault(b["part"], []).extend(b["ids"][p] for p in b["E"])
    for part, ids in by_part.items():
        want = [i for i, t, lang in rows if (lang or "") == part and "E" in fails(i, t, rows)]
        assert sorted(ids) == sorted(want)


def test_sizes_of_unions_and_differences():
    pick = np.random.default_rng(1)
    for share in (0.0, 0.01, 0.4, 1.0):
        lists = {name: np.flatnonzero(pick.random(500) < share).astype(np.int32) for name in LISTS}
        sets = {name: set(ids.tolist()) for name, ids in lists.items()}
        got = {(before, name): sizes for before, name, sizes in block_sizes(lists)}
        assert len(got) == 112
        for n in range(6):
            for before in combinations(FILTERS, n):
                union = set().union(*(sets[b] for b in before))
                assert got["".join(before), ""][0] == len(union)
                for name in set(FILTERS) - set(before):
                    left = sets[name] - union
                    assert got["".join(before), name] == (len(left), len(left & sets["good"]), len(left & sets["toxic"]))
