"""Token counts and codes against the library itself."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import tokenizers_io
from ledgerline.llm.token_counts import BYTE_BPE, _count, _Lengths, token_counts
from ledgerline.llm.tokenizers_io import BYTE_SPLIT, byte_bpe, frequent_words, public_path, word_bpe
from ledgerline.llm.word_codes import WORD_BPE, _one_for_each_partition, decode, encode

TEXTS = [
    None, "", "   ", "Hello world, it's the wörld's end!", "Hello world, it's the wörld's end!", "a\x85b\xa0c \x1c d",
    "x<|endoftext|>y <|startoftext|>z<|endoftext|>", "<|endoftext|>", "漢字 и кириллица 𝔘 ﬁ é İstanbul ΣΑΣ",
    "J̌ ẞ K 5² ½ 12345", "tab\tnl\n\n  x  ", "ab " * 4000, "q" * 3000, "don't we'll they've I'd 'tis ''s",
    "\U0001f600 ok ﻿ ​", "É É é",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "n", 1.0) for i, t in enumerate(TEXTS)] + [(None, "no id", "n", 1.0), (3, TEXTS[3], "n", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes double").repartition(3)


def test_plain_characters_are_cut_as_the_library_cuts_them():
    byte, word = byte_bpe(public_path(BYTE_BPE)), word_bpe(public_path(WORD_BPE))
    for code in range(256):
        c = chr(code)
        text = f"a{c}1 {c}{c}b'{c} {c}s  {c}\n'{c}ll"
        pieces = [p for p, _ in byte.whole.pre_tokenizer.pre_tokenize_str(text)]
        assert [len(p.encode()) for p in BYTE_SPLIT.findall(text)] == list(map(len, pieces)), hex(code)
        ids = word.whole.encode(text, add_special_tokens=False).ids
        assert [i for ids in word.encode_words(word.words(text)) for i in ids] == ids, hex(code)


def test_counts_are_the_librarys(docs):
    whole = byte_bpe(public_path(BYTE_BPE)).whole
    got = token_counts(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
    want = [(r["doc_id"], len((r["text"] or "").encode()), len(whole.encode(r["text"] or "", add_special_tokens=False).ids))
            for r in docs.collect()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


SCRIPTS = ["it\u2019s plain \u2014 but for a quote", "Съешь же ещё этих мягких французских булок, съешь же ещё", "漢字 仮名 漢字",
           "a1² ½ don\u2019t don't \U0001f600\u200d\U0001f600", "\u2028 x\u3000y\x85z ", "ἀρχὴ 12٣٤ e\u0301"]


def test_texts_of_every_script_take_both_tiers():
    """Each piece is encoded once at most, and pieces of the first tier never."""
    bpe, asked = byte_bpe(public_path(BYTE_BPE)), []

    def encode_piece(piece):
        asked.append(piece)
        return bpe.piece_length(piece)

    first, second = {" же": bpe.piece_length(" же")}, _Lengths(encode_piece)
    for _ in range(2):
        for text in SCRIPTS:
            assert "".join(bpe.split(text)) == text
            assert _count(text, bpe, first, second) == len(bpe.whole.encode(text, add_special_tokens=False).ids)
    assert len(asked) == len(set(asked)) and " же" not in asked and " ещё" in asked


def test_one_block_for_each_partition(spark):
    for n in (1, 7, 51, 200):
        keys = spark.range(1).select(F.explode(_one_for_each_partition(spark, n)).alias("k"))
        dealt = keys.repartition(n, "k").groupBy(F.spark_partition_id().alias("p")).count()
        assert dealt.count() == n


def test_a_full_cache_changes_no_count(docs, monkeypatch):
    from ledgerline.llm import token_counts as module
    lengths = module._Lengths(lambda piece: len(piece))
    monkeypatch.setattr(module, "WORKER_PIECES", 3)
    assert [lengths[p] for p in ("a", "bb", "ccc", "a", "dddd", "a")] == [1, 2, 3, 1, 4, 1] and len(lengths) <= 3


def test_codes_and_their_text_are_the_librarys(docs):
    whole = word_bpe(public_path(WORD_BPE)).whole
    got = decode(encode(docs, decoded="same"))
    assert got.columns == ["doc_id", "ids", "n_tokens", "same", "text"]
    found = sorted(((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["n_tokens"], r["same"], r["text"])
                    for r in got.collect()), key=str)
    want = []
    for row in docs.collect():
        ids = whole.encode(row["text"] or "", add_special_tokens=False).ids
        text = whole.decode(ids, skip_special_tokens=False)
        want.append((row["doc_id"], ids, len(ids), text, text))
    assert found == sorted(want, key=str)


def test_words_that_no_table_knows(docs, monkeypatch):
    """Every word goes by the join."""
    none = docs.sparkSession.createDataFrame([], "word string")
    monkeypatch.setattr("ledgerline.llm.word_codes.frequent_words", lambda *a: none)
    monkeypatch.setattr("ledgerline.llm.word_codes.ASKED_AT_ONCE", 3)
    monkeypatch.setattr("ledgerline.llm.word_codes.BLOCK_BYTES", 1 << 10)
    whole = word_bpe(public_path(WORD_BPE)).whole
    for row in encode(docs.dropDuplicates(["doc_id"])).join(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").collect():
        assert np.frombuffer(row["ids"], "<u4").tolist() == whole.encode(row["text"] or "", add_special_tokens=False).ids


def test_empty_tables(docs):
    none = docs.filter("false")
    assert token_counts(none).count() == 0 and encode(none).count() == 0
    assert frequent_words(none, "text").count() == 0
    assert decode(encode(docs.filter("doc_id = 1"))).first()["text"] == ""


def test_frequent_words_are_found(spark):
    docs = spark.createDataFrame([("b a a, a.",), ("a c\na",), (None,)], "text string").repartition(4)
    assert frequent_words(docs, F.upper("text")).first()["word"] == "A"
    assert tokenizers_io.is_plain("é") and not tokenizers_io.is_plain("漢")


def test_words_are_counted_outside_the_heap(spark):
    """Of the executors: a sketch of words there took it to its whole size."""
    docs = spark.createDataFrame([("x y",), (None,)], "text string")
    plan = frequent_words(docs, "text")._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


def test_counts_of_words_are_whole_while_they_fit(spark, monkeypatch):
    texts = ["a b", "c", "", None, "b.c|d", "\x0bé\u3000é(é)", "w" * 24 + " " + "w" * 25, "漢" * 24, "漢" * 25]
    monkeypatch.setattr("ledgerline.llm.words.SLICE_BYTES", 4)
    docs = spark.createDataFrame([(t,) for t in texts * 3], "text string")
    for parts in (1, 5):
        found = [r["word"] for r in frequent_words(docs.repartition(parts), "text").collect()]
        assert found == ["b", "c", "a", "d", "w" * 24, "é", "é\u3000é", "漢" * 24]
        assert [r["word"] for r in frequent_words(docs.repartition(parts), "text", 2).collect()] == ["b", "c"]


def test_counts_of_words_are_bounded_and_keep_the_frequent():
    import pyarrow as pa

    parts = [pa.table({"word": [f"r{i}-{k}" for k in range(50)] + ["often"], "n": [1] * 50 + [9]}) for i in range(40)]
    found = tokenizers_io._summed(iter(parts), 20)
    assert found.num_rows <= 20 and found["word"][pa.compute.index(found["n"], pa.compute.max(found["n"])).as_py()].as_py() == "often"
    total = sum(sum(t["n"].to_pylist()) for t in parts)
    assert 9 * 40 - total / 21 <= pa.compute.max(found["n"]).as_py() <= 9 * 40
