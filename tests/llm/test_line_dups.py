"""Line dedup against all pairs."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from ledgerline.llm import line_dups
from ledgerline.llm.line_dups import line_removals, without_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs):
    """doc_id -> (lines with a word, numbers of removed lines)."""
    lines = [(doc, n, frozenset(WORD.findall(line.translate(FOLD))))
             for doc, text in docs for n, line in enumerate((text or "").split("\n"))]
    lines = sorted((d, n, w) for d, n, w in lines if w)
    out = {doc: (0, []) for doc, _ in docs}
    for at, (doc, n, words) in enumerate(lines):
        count, gone = out[doc]
        like = any(9 * len(words & w) >= 4 * (len(words) + len(w)) for d, k, w in lines[:at] if (d, k) < (doc, n))
        out[doc] = (count + 1, gone + [n] if like else gone)
    return out


def made(seed, n=60):
    """Texts whose lines are copies, or copies with words left out or changed."""
    pick = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "É"]
    base = [[pick.choice(words) for _ in range(pick.randrange(1, 30))] for _ in range(12)]

    def line():
        kind = pick.randrange(8)
        if kind == 0:
            return ""
        if kind < 3:
            return " ".join(pick.choice(words) for _ in range(pick.randrange(1, 25)))
        some = list(pick.choice(base))
        for _ in range(pick.randrange(4)):
            some[pick.randrange(len(some))] = pick.choice(words)
        return ("\t" if kind == 3 else " ").join(w.upper() if kind == 4 else w for w in some)

    return [(i, "\n".join(line() for _ in range(pick.randrange(1, 8)))) for i in range(n)]


def found(df):
    return {r["id"]: (r["n_lines"], r["removed"]) for r in df.collect()}


@pytest.mark.parametrize("seed,span", [(1, None), (2, None), (3, 2), (4, 1)])
def test_equals_all_pairs(spark, monkeypatch, seed, span):
    if span:      # words with more lines than that take the pivots and the exact pass behind them
        monkeypatch.setattr(line_dups, "SPAN", span)
        monkeypatch.setattr(line_dups, "PIVOTS", 1)
    docs = made(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert found(line_removals(df)) == expected(docs)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(70_000))
    docs = [(1, None), (2, ""), (3, "\n \n"), (4, "one"), (5, "ONE\nuno"), (6, long), (7, long + " more"),
            (8, "a b c d"), (9, "a b c d e"), (10, "a b c"), (11, "a b c d e f")]
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in docs], "doc_id long, text string, size int, `kind` string")
    got = found(line_removals(df))
    assert got == expected(docs)
    assert got[5] == (2, [0]) and got[7] == (1, [0]) and got[9] == (1, [0]) and got[11] == (1, [0])
    kept = {r["doc_id"]: r["text"] for r in without_lines(df, line_removals(df)).collect()}
    assert kept == {1: None, 2: "", 3: "\n \n", 4: "one", 5: "uno", 6: long, 8: "a b c d", 10: "a b c"}
    assert without_lines(df, line_removals(df)).columns == df.columns
    assert line_removals(df.filter("false")).count() == 0


def test_repeated_rows_and_null_ids(spark):
    rows = [(1, "x y z"), (1, "x y z"), (None, "p q"), (2, "p q\nx y z"), (1, "other text\nx y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found_ = defaultdict(list)
    for r in line_removals(df).collect():
        found_[r["id"]].append(r["removed"])
    assert found_[None] == [[]] and found_[2] == [[0, 1]]
    assert sorted(found_[1], key=str) in ([[1], [], []], [[], [], [1]], [[0], [0], []], [[], [0], [0]])
    assert sum(map(bool, found_[1])) in (1, 2)     # rows alike stand at one place, and go or stay together
    text_ids = spark.createDataFrame([("b", "s t"), ("a", "s t")], "doc_id string, text string")
    assert found(line_removals(text_ids)) == {"a": (1, []), "b": (1, [0])}


def test_a_hot_line_is_sent_once_a_task(spark):
    """A line of every document, ids falling, so that each copy is earlier than the one before."""
    line = "a line of many words that every document has somewhere in it"
    docs = [(n, f"{line}\nown w{n} x{n} y{n} z{n}\n{line}") for n in range(400)]
    df = spark.createDataFrame(docs, "id long, text string").coalesce(1)
    rarity = np.zeros(1 << line_dups.RARITY_BITS, np.uint8)
    for rows, orders, most in ((df, [], 1), (df, [100.0, 300.0], 1), (df.orderBy("id", ascending=False).coalesce(1), [100.0, 300.0], 3)):
        sent = line_dups._entries(rows, rarity, orders, 4).collect()
        entries = np.frombuffer(b"".join(bytes(r["entries"]) for r in sent), line_dups.ENTRY)
        refs, counts = np.unique(entries["ref"], return_counts=True)
        prefix = int(line_dups._probed(np.array([len(set(line.split()))]))[0])
        assert len(refs) == 401 and counts.max() <= max(most * prefix, 4)
    seen = {}
    refs, order = np.array([5, 5, 7, 5], np.uint64), np.array([3, 2, 9, 2])
    assert line_dups._fresh(refs, order, seen).tolist() == [False, True, True, False]
    assert line_dups._fresh(refs, order, seen).tolist() == [False] * 4
    assert line_dups._fresh(refs[:1], np.array([1]), seen).tolist() == [True]
