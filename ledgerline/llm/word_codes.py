"""BPE encoding through a table of distinct words, and decoding through the table of pieces."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from ledgerline.llm.tokenizers_io import frequent_words, public_path, word_bpe
from ledgerline.llm.words import slices, text_bytes

WORD_BPE = "word_bpe_49k.json"
KNOWN_WORDS = 131_072        # words of at most 24 characters that are resolved by broadcast
KNOWN_TRACKED = 262_144
BLOCK_BYTES = 16 << 20       # of text in a block, which one task puts together
JOIN_IDS = 1 << 19           # ids turned into text at once
TEXTS_AT_ONCE = 200          # texts of a block that are assembled together
ASKED_AT_ONCE = 10_000       # words in one Arrow batch


class _Letters(dict):
    """Known words as one character each, whose code points number them from 1; any other word is 0.

    UTF-8 then writes frequent words in a byte or two, and reads them back in one call.
    """

    def __init__(self, words: Sequence[str]):
        super().__init__((w, chr(n if n < 0xD800 else n + 0x800)) for n, w in enumerate(words, 1))

    def __missing__(self, word: str) -> str:
        return "\0"


def _numbers(letters: bytes) -> np.ndarray:
    points = np.frombuffer(letters.decode().encode("utf-32-le"), "<u4").astype(np.int64)
    return np.where(points < 0xD800, points, points - 0x800)


class _Codes:
    """Ids of numbered words, the word 0 having none: one flat array and the size of each."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, np.concatenate([[0], sizes])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])

    def of(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.starts[numbers] - before, sizes) + np.arange(sizes.sum())]


def _packed(ids: list[int], kind: str) -> bytes:
    return np.asarray(ids, kind).tobytes()


def _known(docs: DataFrame, text: str, path: str) -> tuple[str, np.ndarray, np.ndarray]:
    """Frequent words, joined by spaces, their ids in one array and the number of each word's ids."""
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            words = [w for w in batch.column(0).to_pylist() if bpe.words(w) == [w]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([_packed(ids, "<u4") for ids in bpe.encode_words(words)], pa.binary())],
                names=["word", "ids"])

    found = frequent_words(docs, F.lower(text), KNOWN_WORDS, KNOWN_TRACKED).mapInArrow(
        encoded, "word string, ids binary").toArrow()
    flat, ends = text_bytes(found["ids"])
    return " ".join(found["word"].to_pylist()), flat.view("<u4"), np.diff(ends) // 4


def _one_for_each_partition(session: SparkSession, n: int) -> Column:
    """An array of ``n`` numbers that hash partitioning over ``n`` partitions deals one to each."""
    numbers = session.range(n * (8 + n.bit_length())).select(F.col("id").cast("int").alias("number"))
    first = numbers.groupBy(F.pmod(F.hash("number"), F.lit(n)).alias("to")).agg(F.min("number").alias("number"))
    found = sorted(r["number"] for r in first.select("number").collect())        # one row a partition
    return F.array(*(F.lit(found[k % len(found)]) for k in range(n)))


def encode(docs: DataFrame, tokenizer: str = WORD_BPE, text: str = "text", id_col: str = "doc_id",
           path: str | None = None, decoded: str | None = None) -> DataFrame:
    """``id_col``, ``ids`` (little-endian unsigned 32-bit, packed) and ``n_tokens`` of every text.

    ``decoded``: a column for the text that the ids decode to, made in the same task.

    Texts are split into words once and dealt to blocks of measured size, as letters for known
    words and a list of the other words. Each block numbers its distinct other words in their
    order and asks for them; these meet by word, so each is encoded once, and the codes go back
    to the blocks under their numbers, where they take the positions of their words. Known
    words are those that most blocks have (KNOWN_WORDS, a bounded broadcast): no word is asked
    for by a share of all rows. The list of known words only decides the way of a word.

    A null or empty text, or one of white space, has no ids. Null ids and repeated rows
    are kept; an empty table gives none; other columns of ``docs`` are not read.
    """
    path = path or public_path(tokenizer)
    session = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    known = session.sparkContext.broadcast(_known(docs, text, path))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.element_at(
        _one_for_each_partition(session, blocks), (F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) + 1).cast("int")))
    id_kind = rows.schema["id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = word_bpe(path), zstandard.ZstdCompressor(level=6)
        letters = _Letters(known.value[0].split(" "))
        for batch in batches:
            coded, others = [], []
            for value in batch.column(1):
                words = bpe.words(value.as_py())
                found = "".join(map(letters.__getitem__, words))
                coded.append(packer.compress(found.encode()))
                others.append(packer.compress(" ".join(w for w, n in zip(words, found) if n == "\0").encode()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2), batch.column(0), pa.array(coded, pa.binary()), pa.array(others, pa.binary())],
                names=["block", "id", "letters", "others"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct words of each block that are not known yet, numbered in their order."""
        opener, held = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(3)):
                held.setdefault(block, set()).update(opener.decompress(body.as_py()).decode().split(" "))
        for block in list(held):
            words = sorted(held.pop(block) - {""})
            for at in range(0, len(words), ASKED_AT_ONCE):
                some = words[at:at + ASKED_AT_ONCE]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), block, np.int32)), pa.array(np.arange(at, at + len(some), dtype=np.int32)),
                     pa.array(some, pa.string())], names=["block", "number", "word"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Codes of sorted words; a word is encoded where it first stands."""
        bpe, last, code = word_bpe(path), None, b""
        for batch in batches:
            runs = batch.column(2).to_pylist()
            new = [w for w, before in zip(runs, [last, *runs]) if w != before]
            fresh, out = (_packed(ids, bpe.narrow) for ids in bpe.encode_words(new)), []
            for word in runs:
                if word != last:
                    last, code = word, next(fresh)
                out.append(code)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["block", "number", "code"])

    def assemble(texts: pa.Table, codes: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()           # of the block before
        opener, bpe, (_, flat, sizes) = zstandard.ZstdDecompressor(), word_bpe(path), known.value
        others: set[str] = set()
        for body in texts["others"]:
            others.update(opener.decompress(body.as_py()).decode().split(" "))
        # the block's numbers again
        book = {w: i for i, w in enumerate(sorted(others - {""}), len(sizes) + 1)}
        own, ends = text_bytes(codes["code"].take(pc.sort_indices(codes["number"])))
        own, ends = own.view(bpe.narrow).astype("<u4"), ends // np.dtype(bpe.narrow).itemsize
        table = _Codes(np.concatenate([flat, own]), np.concatenate([sizes, np.diff(ends)]))
        words_of_ids = pa.array(bpe.pieces(), pa.string()) if decoded else None
        out = []
        for batch in texts.to_batches(TEXTS_AT_ONCE):
            ids = []
            for coded, rest in zip(batch["letters"], batch["others"]):
                numbers = _numbers(opener.decompress(coded.as_py()))
                if not numbers.all():
                    words = opener.decompress(rest.as_py()).decode().split(" ")
                    numbers[numbers == 0] = list(map(book.__getitem__, words))
                ids.append(table.of(numbers).tobytes())
            columns = [batch["id"], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if decoded:
                columns.append(_texts(ids, words_of_ids))
            out.append(pa.RecordBatch.from_arrays(columns, schema=made))
        return pa.Table.from_batches(out, schema=made)

    made = to_arrow_schema(StructType([
        StructField("id", rows.schema["id"].dataType), StructField("ids", BinaryType()), StructField("n_tokens", LongType()),
        *([StructField(decoded, StringType())] if decoded else [])]))
    dealt = rows.mapInArrow(
        split, f"block int, id {id_kind}, letters binary, others binary").repartition(blocks, "block")
    codes = (
        dealt.mapInArrow(ask, "block int, number int, word string")
        .repartition(blocks, "word").sortWithinPartitions("word", "block")
        .mapInArrow(answer, "block int, number int, code binary")
    )
    return (
        dealt.groupBy("block").cogroup(codes.groupBy("block"))
        .applyInArrow(assemble, f"id {id_kind}, ids binary, n_tokens bigint" + (f", `{decoded}` string" if decoded else ""))
        .withColumnRenamed("id", id_col)
    )


def _texts(ids: Sequence[bytes], pieces: pa.Array) -> pa.Array:
    """The text of each packed list of ids: their pieces, joined by position, a space between them."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    ends = np.concatenate([[0], np.cumsum([len(v) // 4 for v in ids])])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces.take(pa.array(flat))), " ")


def decode(encoded: DataFrame, tokenizer: str = WORD_BPE, ids: str = "ids", text: str = "text",
           path: str | None = None) -> DataFrame:
    """``encoded`` with a column ``text``: the pieces of ``ids``, a space between them.

    A map-side join of every id with the table of pieces that each worker has of the
    vocabulary. Null or empty ids give an empty text; a column named ``text`` is replaced.
    """
    path = path or public_path(tokenizer)
    encoded = encoded.drop(text)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(word_bpe(path).pieces(), pa.string())
        for batch in batches:
            for part in slices(batch, ids, 4 * JOIN_IDS):
                packed = [v.as_py() or b"" for v in part.column(part.schema.get_field_index(ids))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, _texts(packed, table)], names=[*part.schema.names, text])

    return encoded.mapInArrow(join, StructType([*encoded.schema, StructField(text, StringType())]))
