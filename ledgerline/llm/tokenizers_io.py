"""Public tokenizer files inside tasks: the library itself, and the same pieces by a fast path.

A text of Latin-1 characters is cut by the ``re`` module with the classes written out,
which cuts it as the library does (tests hold every such character against it); any
other text is cut by the library's own splitter. Pieces are encoded by the library's own
model either way, a piece at a time. Only tasks load a vocabulary; the driver does not.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.words import SPACE, slices, words_of

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Latin-1 letters, numbers and white space, and the two splits over them.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
BYTE_SPLIT = re.compile(f" ?[{_L}]+|{_ENDINGS}| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
WORD_SPLIT = re.compile(f"[{_L}]+|{_ENDINGS}|[{_N}]|[^{_S}{_L}{_N}]+")

FREQUENT_WORDS = 32_768      # entries of the broadcast table; its words have at most
FREQUENT_CHARS = 24          # so many characters, so it stays below 4 MB
TRACKED_WORDS = 131_072      # words whose counts are kept to find them
MERGERS = 64                 # first-level mergers of counts
WORKER_PIECES = 400_000      # entries a worker's cache may hold before it starts anew
WORKER_PIECE_CHARS = 64      # longer pieces are encoded each time

_MARKS = SPACE.copy()        # bytes that stand between words
_MARKS[np.frombuffer(b".,;:!?\"()|", np.uint8)] = True
_NO_WORDS = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})


def is_plain(text: str) -> bool:
    """Whether the text has only Latin-1 characters."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _heaviest(parts: Sequence[pa.Table], most: int) -> pa.Table:
    """``word`` and ``n`` of at most ``most`` words, summed up; what the next one has is taken from each (Misra and Gries)."""
    table = pa.concat_tables([_NO_WORDS, *parts]).group_by("word", use_threads=False).aggregate([("n", "sum")])
    counts = table["n_sum"].to_numpy()
    if len(counts) > most:
        at = len(counts) - most - 1
        counts = counts - np.partition(counts, at)[at]
        table, counts = table.filter(pa.array(counts > 0)), counts[counts > 0]
    return pa.table({"word": table["word"], "n": counts}, schema=_NO_WORDS.schema)


def _summed(parts: Iterator[pa.Table], most: int) -> pa.Table:
    """The same over a stream of parts, of which few are held at once."""
    held: list[pa.Table] = []
    for part in parts:
        held.append(part)
        if sum(t.num_rows for t in held) > 2 * most:
            held = [_heaviest(held, most)]
    return _heaviest(held, most)


def _counted(texts: pa.Array) -> pa.Table:
    """The words of the texts, without their punctuation, and how often each stands there."""
    found = words_of(texts, _MARKS)
    ends = np.concatenate([[0], np.cumsum(found.ends - found.starts)]).astype(np.int32)
    solid = found.data[~_MARKS[found.data]]                # the words, one after the other
    words = pa.StringArray.from_buffers(len(found.starts), pa.py_buffer(ends), pa.py_buffer(solid))
    counts = pc.value_counts(words.filter(pc.less_equal(pc.utf8_length(words), FREQUENT_CHARS)))
    return pa.table([counts.field(0), counts.field(1)], schema=_NO_WORDS.schema)


def frequent_words(docs: DataFrame, text: str | Column, k: int = FREQUENT_WORDS,
                   tracked: int = TRACKED_WORDS) -> DataFrame:
    """``word``: about the ``k`` most frequent words of all texts, without their punctuation.

    Bounded counts of ``tracked`` words are taken in the tasks of the texts and merged in two
    levels, one row each: counts travel, texts do not. They are held in Arrow, outside the heap
    of the JVM. The list only decides what is looked up first, never what a result is.
    """
    column = F.col(text) if isinstance(text, str) else text
    texts = docs.select(column.cast("string").alias("text"), (F.spark_partition_id() % MERGERS).alias("merger"))

    def packed(merger: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        if table.num_rows:
            words = table["word"].combine_chunks()
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")
            yield pa.RecordBatch.from_arrays(
                [pa.array([merger], pa.int32()), joined, pa.array([table["n"].to_numpy().tobytes()], pa.binary())],
                names=["merger", "words", "counts"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for words, counts in zip(batch.column(1), batch.column(2)):
                words = pc.split_pattern(pa.array([words.as_py()], pa.string()), " ").flatten()
                yield pa.table([words, pa.array(np.frombuffer(counts.as_py(), np.int64))], schema=_NO_WORDS.schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = 0

        def parts() -> Iterator[pa.Table]:
            nonlocal merger
            for batch in batches:
                for part in slices(batch, "text"):
                    merger = part.column(1)[0].as_py()
                    yield _counted(part.column(0))

        table = _summed(parts(), tracked)
        yield from packed(merger, table)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed(0, _summed(unpacked(batches), tracked))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _summed(unpacked(batches), tracked).sort_by([("n", "descending"), ("word", "ascending")])
        yield from table.select(["word"]).slice(0, k).to_batches()

    kind = "merger int, words string, counts binary"
    return (
        texts.mapInArrow(count, kind).repartition("merger").mapInArrow(merge, kind)
        .repartition(1).mapInArrow(first, "word string")
    )


def _config(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


class ByteBpe:
    """A byte-level BPE file: pieces of a text, and the length of one piece in tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        config = _config(path)
        self.whole = Tokenizer.from_file(path)
        self._cut = self.whole.pre_tokenizer
        self.special = [t["content"] for t in config["added_tokens"]]
        config["pre_tokenizer"]["use_regex"] = False
        config["added_tokens"] = []
        self.one = Tokenizer.from_str(json.dumps(config))

    def split(self, text: str) -> list[str]:
        """The pieces that the library would encode one by one, special tokens aside."""
        if is_plain(text):
            return BYTE_SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self._cut.pre_tokenize_str(text)]

    def piece_length(self, piece: str) -> int:
        return len(self.one.encode(piece, add_special_tokens=False).ids)


class WordBpe:
    """A word-level BPE file (lower case, ends of words, no white space): words and their ids."""

    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        config = _config(path)
        self.whole = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self._marks = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")")
        pattern = config["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._cut = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        config["normalizer"] = None
        config["pre_tokenizer"] = config["pre_tokenizer"]["pretokenizers"][1]
        config["added_tokens"] = []
        self.one = Tokenizer.from_str(json.dumps(config))

    def words(self, text: str) -> list[str]:
        """The words the library would encode one by one; a special token is a word of its own."""
        if "<|" in text:
            parts = self._marks.split(text)
            if len(parts) > 1:
                return [w for i, part in enumerate(parts)
                        for w in ([part] if i % 2 else self._plain_words(part))]
        return self._plain_words(text)

    def _plain_words(self, text: str) -> list[str]:
        if is_plain(text):
            return WORD_SPLIT.findall(text.lower())
        text = self.whole.normalizer.normalize_str(text)
        return [piece for piece, _ in self._cut.pre_tokenize_str(text)]

    def encode_words(self, words: Sequence[str]) -> list[list[int]]:
        found = self.one.encode_batch(list(words), add_special_tokens=False)
        return [[self.special[w]] if w in self.special else e.ids for w, e in zip(words, found)]

    @cached_property
    def narrow(self) -> str:
        """The kind of number that holds every id."""
        return "<u2" if self.whole.get_vocab_size(True) <= 1 << 16 else "<u4"

    def pieces(self) -> list[str]:
        """The piece of each id; what decoding joins ids with."""
        return [self.whole.id_to_token(i) or "" for i in range(self.whole.get_vocab_size(True))]


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def public_path(name: str) -> str:
    """Where the installed package of public vocabularies keeps a file."""
    import public_tokenizers

    return public_tokenizers.path(name)
