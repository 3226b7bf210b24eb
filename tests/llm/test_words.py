"""Word spans, hashes and grams against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from ledgerline.llm.words import SLICE_BYTES, distinct_in_rows, grams, mix, slices, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = ["a b  c", "", None, "  Foo\tbar\nA B", "x", " ", "é ü\x0bz\x0c", "end", " start", "a b   c", "İ I i"]


def test_words_are_those_of_the_pattern():
    pick = random.Random(1)
    texts = TEXTS + ["".join(pick.choice("aB é\n\t漢\x1f") for _ in range(pick.randrange(30))) for _ in range(300)]
    found = words_of(pa.array(texts))
    want = [WORD.findall(t or "") for t in texts]
    assert found.counts.tolist() == list(map(len, want))
    assert [bytes(found.data[a:b]).decode() for a, b in zip(found.starts, found.ends)] == [w for ws in want for w in ws]


def test_hashes_tell_words_apart_and_fold_ascii_only():
    words = ["a", "b", "ab", "ba", "aa", "aaa", "É", "é", "A", "the", "teh"] + [f"w{i}" for i in range(5000)]
    found = words_of(pa.array([" ".join(words), " ".join(reversed(words))]))
    hashes = found.hashes()
    assert len(set(hashes.tolist())) == len(words)
    assert hashes[: len(words)].tolist() == hashes[len(words):][::-1].tolist()
    folded = words_of(pa.array(["The É the é"])).hashes(fold=True).tolist()
    assert folded[0] == folded[2] and folded[1] != folded[3]


def test_a_word_longer_than_a_segment():
    long = "x" * (1 << 20)
    hashes = words_of(pa.array([f"a {long} b {long}y {long}"])).hashes()
    assert len(hashes) == 5 and hashes[1] == hashes[4] != hashes[3]


def test_grams_stay_in_their_rows():
    found = words_of(pa.array(["a b c d", "b c", "", "b c d a b c"]))
    pairs, first = grams(found.hashes(), found.first, 2)
    assert np.diff(first).tolist() == [3, 1, 0, 5]
    assert pairs[1] == pairs[3] == pairs[4] == pairs[8]
    skips, first = grams(found.hashes(), found.first, 2, step=2)
    assert np.diff(first).tolist() == [2, 0, 0, 4] and len({*skips.tolist()} & {*pairs.tolist()}) == 0


def test_distinct_values_of_rows():
    rng = np.random.default_rng(0)
    for _ in range(100):
        counts = rng.integers(0, 6, rng.integers(0, 8))
        first = np.concatenate([[0], np.cumsum(counts)]).astype(int)
        values = mix(rng.integers(0, 4, first[-1]).astype(np.uint64))
        found, upto = distinct_in_rows(values, first)
        for i in range(len(counts)):
            assert found[upto[i]:upto[i + 1]].tolist() == np.unique(values[first[i]:first[i + 1]]).tolist()


def test_slices_hold_whole_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "y" * (SLICE_BYTES + 5), "", "z"])], names=["text"])
    parts = list(slices(batch, "text"))
    assert [p.num_rows for p in parts] == [2, 1, 2] or sum(p.num_rows for p in parts) == 5
    assert [v for p in parts for v in p.column(0).to_pylist()] == batch.column(0).to_pylist()
