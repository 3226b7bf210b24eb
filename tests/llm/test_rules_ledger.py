"""Measurements against plain Python, policies and ablations."""

import random
import re
from collections import Counter

from ledgerline.llm.rules_ledger import BASE, MEASURES, POLICIES, RULES, ablations, ledger, mask, passes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    letters = re.findall("[A-Za-z]", text)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered), len(lines), sum(c.isupper() for c in letters), len(letters), text.count("!"))


def made():
    pick = random.Random(5)
    texts = [None, "", "\n\n", "one", "a a a a", "x y z x y z x", "É!\n É!\nÉ!\n\n É!", "\na\n", "a\n", "w " * 60]
    texts += ["".join(pick.choice(["a", "b", "C ", " ", "\n", "ab\n", "#", "é ", "!", "漢 "]) for _ in range(pick.randrange(200)))
              for _ in range(150)]
    return list(enumerate(texts)) + [(None, "no id"), (3, "one")]


def test_measurements_and_bits(spark):
    rows = made()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int").repartition(4)
    got = sorted((tuple(r) for r in ledger(df).collect()), key=str)
    want = []
    for doc, text in rows:
        values = measures(text)
        named = dict(zip(MEASURES, values))
        bits = sum(eval(rule, {}, named) << i for i, rule in enumerate(RULES.values()))
        want.append((doc, *values, bits))
    assert got == sorted(want, key=str)
    assert ledger(df.filter("false")).count() == 0


def test_policies_and_ablations(spark):
    entries = ledger(spark.createDataFrame(made(), "doc_id long, text string"))
    bits = [r["failures"] for r in entries.select("failures").collect()]
    kept = entries.filter(passes("corpus-1")).count()
    assert kept == sum(b & mask(POLICIES["corpus-1"]) == 0 for b in bits)
    got = {(r["policy"], r["rule"]): (r["rejected"], r["only_this"]) for r in ablations(entries).collect()}
    order = list(RULES)
    for policy, names in POLICIES.items():
        for name in names:
            bit = 1 << order.index(name)
            assert got[policy, name] == (sum(b & bit != 0 for b in bits), sum(b & mask(names) == bit for b in bits))
    assert mask(BASE) == 3 and ablations(entries.filter("false")).count() == 0
