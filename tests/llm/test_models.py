"""Language identification and toxicity."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm.language import PIECE, Parser, _normalised, identify, learn, suffix_automaton
from ledgerline.llm.toxicity import ALPHA, BETA, EPOCHS, L1, L2, Ftrl, Model, _features, fit, score


@pytest.mark.parametrize("seed", range(4))
def test_automaton_knows_all_substrings_and_no_other(seed):
    pick = random.Random(seed)
    text = [pick.randrange(3) for _ in range(60)]
    table = suffix_automaton(np.array(text), 4)
    have = {tuple(text[a:b]) for a in range(60) for b in range(a + 1, 61)}

    def reads(some):
        state = 0
        for code in some:
            state = table[state, code]
            if state < 0:
                return False
        return True

    assert all(map(reads, have))
    for _ in range(500):
        some = tuple(pick.randrange(3) for _ in range(pick.randrange(1, 9)))
        assert reads(some) == (some in have)
    assert len(table) <= 2 * 60


def phrases(text, trained):
    """Greedy longest matches, one character where none matches."""
    at = n = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size] in trained and text[at:at + size + 1] in trained:
            size += 1
        at, n = at + size, n + 1
    return n


def test_phrases_are_greedy_longest_matches():
    pick = random.Random(2)
    train = {"x": "".join(pick.choice("abc ") for _ in range(300)).strip(), "y": "".join(pick.choice("abd ") for _ in range(300)).strip()}
    train = {k: " ".join(v.split()) for k, v in train.items()}
    parser = Parser(train)
    texts = ["".join(pick.choice("abcde") for _ in range(pick.randrange(1, PIECE))) for _ in range(40)]
    codes = sorted((parser.codes(t) for t in texts), key=len, reverse=True)
    lengths = np.array(list(map(len, codes)))
    pieces = np.zeros((len(codes), lengths[0]), np.uint8)
    for i, c in enumerate(codes):
        pieces[i, : len(c)] = c
    for lang, table in zip(parser.langs, parser.tables):
        got = parser.phrases(pieces, lengths, table).tolist()
        assert got == [phrases(t, train[lang]) for t in sorted(texts, key=len, reverse=True)]


def test_languages(spark):
    pick = random.Random(4)
    stems = {"aa": ["lo", "mar", "ti"], "bb": ["zu", "kre", "vo"], "cc": ["éa", "ui", "nô"]}

    def text(lang, n):
        return " ".join("".join(pick.choice(stems[lang]) for _ in range(3)) for _ in range(n))

    rows = [(i, text(lang, 80), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    docs = spark.createDataFrame(rows + [(100, None, "aa"), (101, "lomar", None), (102, "  ", "bb")],
                                 "doc_id long, text string, lang string").repartition(3)
    texts = learn(docs)
    assert set(texts) == set(stems)
    ask = [(1, text("aa", 3).upper()), (2, text("bb", 9000)), (3, None), (4, "12 !?"), (5, ""), (6, text("cc", 5)), (6, text("cc", 5)),
           (None, text("bb", 4)), (7, "漢字")]
    got = identify(spark.createDataFrame([(i, t, "x", 1) for i, t in ask], "doc_id long, text string, score string, lang_pred int"), texts)
    found = sorted(((r["doc_id"], r["lang_pred"]) for r in got.collect()), key=str)
    assert found[:-2] + found[-1:] == sorted([(1, "aa"), (2, "bb"), (3, "und"), (4, "und"), (5, "und"), (6, "cc"), (6, "cc"), (None, "bb")], key=str)
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    none = identify(docs, learn(docs.filter("false")))
    assert {(r["lang_pred"], r["score"]) for r in none.collect()} == {("und", 0.0)}
    assert identify(docs.filter("false"), texts).count() == 0


def of_letters(letters, seed):
    """A maker of texts of n words from a vocabulary over the letters."""
    pick = random.Random(seed)
    words_ = ["".join(pick.choice(letters) for _ in range(pick.randrange(2, 5))) for _ in range(len(letters))] + list(letters)
    return lambda n: " ".join(pick.choice(words_) for _ in range(n))


SCRIPTS = {
    "bg": "".join(map(chr, range(0x430, 0x450))), "de": "abcdefghijklmnopqrstuvwxyzäöüß", "el": "αβγδεζηθικλμνξοπρσςτυφχψω",
    "hy": "".join(map(chr, range(0x561, 0x587))), "zh": "".join(map(chr, range(0x4E00, 0x4E00 + 900))),
}


def test_every_script_is_known(spark):
    """Five alphabets, of which the least used has the fewest occurrences of a letter."""
    made = {lang: of_letters(letters, i) for i, (lang, letters) in enumerate(SCRIPTS.items())}
    docs = [(100 * i + j, made[lang](300 if lang != "zh" else 60), lang) for i, lang in enumerate(SCRIPTS) for j in range(20)]
    texts = learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    ask = [(i, made[lang](40), lang) for i, lang in enumerate(list(SCRIPTS) * 4)]
    got = identify(spark.createDataFrame(ask, "doc_id long, text string, lang string"), texts)
    assert {r["doc_id"]: r["lang_pred"] for r in got.collect()} == {i: lang for i, _, lang in ask}


def test_phrases_over_more_letters_than_a_table_has_columns():
    pick = random.Random(5)
    train = {"x": "".join(pick.choice(SCRIPTS["zh"][:200]) for _ in range(900)), "y": "".join(pick.choice(SCRIPTS["zh"][100:300]) for _ in range(900))}
    parser = Parser(train)
    texts = [train[lang][at:at + 9] + train["x"][at:at + 5] for lang in train for at in range(0, 800, 40)]
    pieces = np.array([parser.codes(t) for t in texts])
    lengths = np.full(len(texts), 14)
    for lang, table in zip(parser.langs, parser.tables):
        assert parser.phrases(pieces, lengths, table).tolist() == [phrases(t, train[lang]) for t in texts]


def test_whole_texts_of_rows_with_letters_are_learned(spark):
    """Texts without a letter take no place of the 64; each of 64 rows has a letter of its own at its end."""
    body = of_letters(SCRIPTS["el"], 2)
    docs = [(i, f"{body(300)} {chr(0x4E00 + i)}", "el") for i in range(64)]
    docs += [(1000 + i, f"{i} 12 -- !?", "el") for i in range(3000)]
    found = learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"))["el"]
    assert {chr(0x4E00 + i) for i in range(64)} <= set(found) and len(found) == sum(
        len(_normalised(t)) + 1 for _, t, _ in docs[:64]) - 1
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} here", "q") for i in range(100)] + [(i, "99", "q") for i in range(100, 3100)]
    assert learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["q"].count("here") == 64
    # a language whose texts are all too long has its shortest, whole; others have none of these
    long = [(1, "abc " * 3000 + "xyz", "q"), (2, "abd " * 2000 + "end", "q"), (3, "efg " * 2000, "r"), (4, "short", "r"), (None, "ß", "r")]
    found = learn(spark.createDataFrame(long, "doc_id long, text string, lang string"))
    assert found["q"] == "abd " * 2000 + "end" and set(found["r"].split()) == {"short", "ß"}


def test_phrases_do_not_end_with_a_piece():
    """Texts of many pieces, and runs that a whole piece does not end, against the greedy parse of the whole."""
    pick = random.Random(7)
    train = {"x": "".join(pick.choice("abc ") for _ in range(300)).strip() + "a" * 700,
             "y": "".join(pick.choice("abd ") for _ in range(900)).strip()}
    train = {k: " ".join(v.split()) for k, v in train.items()}
    parser = Parser(train)
    texts = ["a" * 1500, "b" + "a" * 3000 + "b", "".join(pick.choice("abcde") for _ in range(2000)), train["x"] * 3, train["y"][5:] + train["x"],
             "".join(pick.choice(["aaaa" * 60, "b", "ab"]) for _ in range(60)), "c", "a" * PIECE, "a" * (PIECE + 1)]
    texts += ["".join(pick.choice("abcd ") for _ in range(pick.randrange(1, 900))) for _ in range(60)]
    texts = [" ".join(t.split()) for t in texts]
    names, scores = parser.predict(pa.array(texts))
    for text, name, score_ in zip(texts, names, scores):
        rates = {lang: phrases(text, known) / len(text) for lang, known in train.items()}
        assert name == min(sorted(rates), key=rates.get)
        assert abs(score_ - (1 / rates[name]) / sum(1 / r for r in rates.values())) < 1e-9


def test_ftrl_weighs_what_marks_a_label():
    pick, model = np.random.default_rng(1), Ftrl(100)
    for _ in range(400):
        label = int(pick.integers(2))
        model.learn(np.append(pick.choice(90, 5, replace=False), 95 if label else 96), label)
    w = model.weights(np.arange(101))
    assert w[95] > 1 > -1 > w[96] and (w[:90] != 0).sum() < 45


def test_toxicity(spark):
    pick = random.Random(3)
    words = [f"w{i}" for i in range(300)]

    def text(toxic):
        some = [pick.choice(words) for _ in range(60)]
        if toxic:
            for mark in ("slur", "SLUR!", "vile,"):
                some.insert(pick.randrange(60), mark)
        return " ".join(some)

    rows = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(600)]
    docs = spark.createDataFrame([(i, t, "q") for i, t, _ in rows] + [(None, "w1", "q"), (700, None, "q"), (701, "", "q")],
                                 "doc_id long, text string, `label` string").repartition(4)
    labels = spark.createDataFrame([(i, int(y), 1) for i, _, y in rows if i < 400] + [(0, None, 1), (None, 1, 1), (4, 0, 1), (900, 1, 1)],
                                   "doc_id long, toxic int, quality int")
    scored = score(spark, docs, fit(docs, labels), into="p")
    assert scored.columns == ["doc_id", "text", "label", "p"]
    got = {r["doc_id"]: r["p"] for r in scored.collect()}
    held = [(got[i] >= 0.5) == y for i, _, y in rows if i >= 400]
    assert sum(held) / len(held) > 0.97
    assert got[700] == got[701] < 0.5 and len(got) == 603
    empty = fit(docs, labels.filter("false"))
    assert empty.bias is None and {r["score"] for r in score(spark, docs, empty).collect()} == {0.0}
    assert score(spark, docs.filter("false"), Model(np.array([1]), np.array([0.5]), 0.1)).count() == 0
    assert pa.array([]).null_count == 0


def grams_of(text):
    """Words, pairs, triples, and pairs over one and over two words, each once."""
    words_ = re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {(n, step, *words_[i:i + (n - 1) * step + 1:step]) for n, step in ((1, 1), (2, 1), (3, 1), (2, 2), (2, 3))
            for i in range(len(words_) - (n - 1) * step)}


def test_features_are_the_grams_of_a_text(monkeypatch):
    monkeypatch.setattr("ledgerline.llm.toxicity.BITS", 48)      # so that no two share a number
    pick = random.Random(8)
    texts = ["", "one", "a b a b a", "É é,É x-Y_z"] + [
        "".join(pick.choice(["a", "B", "cc", "é", "漢", "7"]) + pick.choice([" ", ", ", "\n", "-", ""]) for _ in range(pick.randrange(40)))
        for _ in range(120)]
    for text, found in zip(texts, _features(pa.array(texts))):
        found = found.tolist()
        assert found == sorted(set(found)) and len(found) == len(grams_of(text))
    # a gram has one number, wherever it stands, and no other has it
    by_gram = {}
    alone = [" ".join(p) for p in {g[2:] for t in texts for g in grams_of(t) if g[0] == 1}]
    for word, found in zip(alone, _features(pa.array(alone))):
        by_gram[word] = int(found[0])
    assert len(set(by_gram.values())) == len(by_gram)
    for text, found in zip(texts, _features(pa.array(texts))):
        assert {by_gram[g[2]] for g in grams_of(text) if g[0] == 1} <= set(found.tolist())


def test_weights_and_scores_against_plain_python(spark):
    """Every step of FTRL-proximal, coordinate by coordinate, in the order that the fit takes."""
    pick = random.Random(9)
    rows = [(i, " ".join(pick.choice(["slur", "vile"] if i % 3 == 0 and pick.random() < 0.5 else ["w", "x", "y", "z", "q"])
                         for _ in range(pick.randrange(1, 30))), int(i % 3 == 0)) for i in range(80)]
    rows += [(7, "another row of seven", rows[7][2])]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = fit(docs, labels)

    texts = [f.tolist() for f in _features(pa.array([t for _, t, _ in rows]))]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0], len(texts[k])))
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if k == "bias":
            return -z[k] / ((BETA + math.sqrt(n[k])) / ALPHA + L2)
        return 0.0 if abs(z[k]) <= L1 else -(z[k] - math.copysign(L1, z[k])) / ((BETA + math.sqrt(n[k])) / ALPHA + L2)

    for epoch in range(EPOCHS):
        for at in np.random.default_rng(epoch).permutation(np.array(order)):
            keys = [*texts[at], "bias"]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - rows[at][2]
            for k in keys:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / ALPHA * w[k]
                n[k] += g * g
    want = {k: weight(k) for k in z if k != "bias" and weight(k)}
    assert dict(zip(model.buckets.tolist(), model.weights)) == pytest.approx(want, rel=1e-9) and len(want) > 5
    assert model.bias == pytest.approx(weight("bias"), rel=1e-9)
    ask = ["", None, "slur w x", "vile slur", "w x y z", "unseen words only", "SLUR, slur!" * 400]
    scored = score(spark, spark.createDataFrame(list(enumerate(ask)), "doc_id int, text string"), model)
    for r in scored.collect():
        logit = weight("bias") + sum(want.get(k, 0.0) for k in _features(pa.array([r["text"] or ""]))[0].tolist())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, logit)))), rel=1e-9)
