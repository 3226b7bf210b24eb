"""Line dedup: an exact set-similarity join of lines, whose later matches are removed.

Words of a line are ordered by rarity. Two lines with a Jaccard similarity of 0.8 share a
word within a short prefix of that order, so lines meet by the words of their prefixes;
positions in the prefix, lengths and a parity bitmap rule most pairs out without their
words, and the words of the others decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.settle import settled, unused
from ledgerline.llm.words import Words, hash_spans, mix, row_order, slices, text_bytes, words_in

RARITY_BITS = 20             # counters of words: 2**20
RARITY_CHUNK = 1 << 14       # counters that are merged together
MERGE_FANIN = 256            # parts of a chunk that are merged at first
SHARDS_PER_PARTITION = 4     # groups of words for each shuffle partition
SEEN_LINES = 1 << 16         # sets that a task remembers to have sent, before it starts anew
SPAN = 20_000                # a word's lines of fitting length that are all compared with a line
PARTNERS = 4                 # lines that an entry proposes at first
PIVOTS = 64                  # earliest entries of a word beyond SPAN, with which its others are compared at first
ASKED_BITS = 23              # bits of the broadcast filter of lines that are asked for
SIGNATURE_WORDS = 8          # longs of a line's wide bitmap

#: One word's entry for one line: 32 bytes.
ENTRY = np.dtype([("token", "<u4"), ("size", "<u2"), ("place", "u1"), ("order", "u1"), ("ref", "<u8"), ("bits", "<u8", 2)])
FAR = 1 << 30
KEY = ["set_a", "set_b", "size"]


@dataclass
class _Lines:
    """Lines with a word: distinct word hashes in ``first`` ranges, their row and number in it."""
    tokens: np.ndarray
    first: np.ndarray
    row: np.ndarray
    number: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits that name each line's set of words: sums of their hashes and of the squares."""
        return self.sums(self.tokens), self.sums(self.tokens * self.tokens)

    def sums(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return np.diff(total[self.first])

    def parities(self, width: int) -> np.ndarray:
        """For each line, ``width`` bits as longs: each word flips the bit that its hash names."""
        step = 1 << 12
        out = np.empty((len(self.row), width // 64), dtype=np.uint64)
        for at in range(0, len(self.row), step):
            first = self.first[at:at + step + 1]
            hashes = self.tokens[first[0]:first[-1]]
            lines = np.repeat(np.arange(len(first) - 1), np.diff(first))
            flips = np.bincount(lines * width + (hashes % np.uint64(width)).astype(np.int64),
                                minlength=(len(first) - 1) * width).reshape(-1, width) & 1
            out[at:at + step] = np.packbits(flips.astype(np.uint8), axis=1).view(np.uint64)
        return out


def _lines(column: pa.Array, rarity: np.ndarray | None = None) -> _Lines:
    """The lines of a slice; their words by rarity, if it is given."""
    data, offsets = text_bytes(column)
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 0x0A) + 1]))
    words: Words = words_in(data, cuts)
    full = np.flatnonzero(words.counts)
    first = np.concatenate([words.first[full], words.first[-1:]])
    hashes = hash_spans(data, words.starts, words.ends, fold=True)
    lead = None if rarity is None else rarity[hashes >> np.uint64(64 - RARITY_BITS)]
    order, new = row_order(hashes, first, lead)
    upto = np.concatenate([[0], np.cumsum(new)])
    row = np.searchsorted(offsets, cuts[full], "right") - 1
    number = full - np.searchsorted(cuts, offsets[row])
    return _Lines(hashes[order[new]], upto[first], row, number)


def _surveyed(rows: DataFrame) -> DataFrame:
    """One row for each line with a word, each document, and each word counter that is not zero.

    ``kind`` line: KEY, id, body, number; doc: id, body, size (its lines); count: number
    (the chunk), size (the part), ``counts`` (counter and count, packed).
    """
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts = np.zeros(1 << RARITY_BITS, dtype=np.int64)
        names = ["kind", *KEY, "id", "body", "number", "counts"]

        def out(kind, a, b, size, id_, body, number, packed=None):
            n = len(size)
            return pa.RecordBatch.from_arrays([
                pa.array([kind] * n, pa.string()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)),
                pa.array(size, pa.int64()), id_, body, pa.array(number, pa.int64()),
                packed if packed is not None else pa.nulls(n, pa.binary())], names=names)

        kind_of_id = None
        for batch in batches:
            kind_of_id = batch.schema.field("id").type
            for part in slices(batch, "text"):
                lines = _lines(part.column(1))
                counts += np.bincount((lines.tokens >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(counts))
                a, b = lines.names()
                at = pa.array(lines.row)
                yield out("line", a, b, lines.sizes, part.column(0).take(at), part.column(2).take(at), lines.number)
                n = part.num_rows
                none = np.zeros(n, np.uint64)
                yield out("doc", none, none, np.bincount(lines.row, minlength=n), part.column(0), part.column(2), none.view(np.int64))
        if counts.any():
            packed, chunks = [], range(0, len(counts), RARITY_CHUNK)
            for at in chunks:
                found = np.flatnonzero(counts[at:at + RARITY_CHUNK])
                packed.append(np.stack([found, counts[at + found]]).astype("<i8").tobytes())
            n = len(packed)
            none, task = np.zeros(n, np.uint64), TaskContext.get().partitionId()
            yield out("count", none, none, np.full(n, task), pa.nulls(n, kind_of_id), pa.nulls(n, pa.int64()),
                      np.arange(n), pa.array(packed, pa.binary()))

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(survey, f"kind string, set_a bigint, set_b bigint, size bigint, id {kind}, "
                                   "body bigint, number bigint, counts binary")


def _rarities(counts: DataFrame) -> np.ndarray:
    """Of each counter, the logarithm of its lines in sixths of an octave: 2**RARITY_BITS bytes."""
    def merge(table: pa.Table) -> pa.Table:
        total = np.zeros(RARITY_CHUNK, dtype=np.int64)
        for part in table["counts"]:
            at, n = np.frombuffer(part.as_py(), "<i8").reshape(2, -1)
            total[at] += n
        at = np.flatnonzero(total)
        return pa.table({"chunk": table["chunk"][:1], "counts": pa.array([np.stack([at, total[at]]).tobytes()], pa.binary())})

    parts = counts.select(F.col("number").alias("chunk"), F.floor(F.col("size") / MERGE_FANIN).alias("part"), "counts")
    kind = "chunk bigint, counts binary"
    merged = parts.groupBy("chunk", "part").applyInArrow(lambda t: merge(t), kind).groupBy("chunk").applyInArrow(merge, kind)
    out = np.zeros(1 << RARITY_BITS, dtype=np.uint8)
    for row in merged.collect():
        at, n = np.frombuffer(row["counts"], "<i8").reshape(2, -1)
        out[row["chunk"] * RARITY_CHUNK + at] = np.minimum(255, np.round(6 * np.log2(n + 1)))
    return out


def _probed(sizes: np.ndarray) -> np.ndarray:
    """Words of a line's prefix: any line of 0.8 of its size or more that is like it has one of them."""
    return sizes - (4 * sizes + 4) // 5 + 1


def _indexed(sizes: np.ndarray) -> np.ndarray:
    """The prefix that will do towards lines that are not smaller."""
    return sizes - (8 * sizes + 8) // 9 + 1


def _fresh(refs: np.ndarray, order: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """Of each set the copy with the least order, unless the task sent one that is no later."""
    out = np.zeros(len(refs), dtype=bool)
    if not len(refs):
        return out
    by_set = np.lexsort((order, refs))
    new = np.concatenate([[True], refs[by_set[1:]] != refs[by_set[:-1]]])
    for at, ref, mine in zip(by_set[new].tolist(), refs[by_set[new]].tolist(), order[by_set[new]].tolist()):
        if seen.get(ref, FAR) > mine:
            seen[ref], out[at] = mine, True
    if len(seen) > SEEN_LINES:
        seen.clear()
    return out


def _entries(rows: DataFrame, rarity: np.ndarray, orders: list, shards: int) -> DataFrame:
    """``shard`` and packed ENTRY records of the prefixes of all sets of four words or more.

    Smaller lines are like none but their equals. A task sends a set once, however many lines have
    it, and again only for an earlier order or when it has forgotten it.
    """
    session = rows.sparkSession
    shared = session.sparkContext.broadcast((rarity, orders))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, orders = shared.value
        seen: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                lines = _lines(part.column(1), rarity)
                sizes, refs = lines.sizes, lines.names()[0]
                if orders:
                    ids = part.column(0).cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    order = np.searchsorted(orders, ids, "right")[lines.row]
                else:
                    order = np.zeros(len(lines.row), np.int64)
                sent = np.flatnonzero(sizes >= 4)
                sent = sent[_fresh(refs[sent], order[sent], seen)]
                take = np.zeros(len(sizes), dtype=np.int64)
                take[sent] = _probed(sizes[sent])
                upto = np.cumsum(take)
                place = np.arange(take.sum()) - np.repeat(upto - take, take)
                token = lines.tokens[np.repeat(lines.first[:-1], take) + place]
                records = np.empty(len(token), dtype=ENTRY)
                records["token"] = token.astype(np.uint32)
                records["size"] = np.repeat(np.minimum(sizes, 0xFFFF), take)
                records["place"] = np.minimum(place, 0xFF)
                records["order"] = np.repeat(order, take)
                records["ref"] = np.repeat(refs, take)
                records["bits"] = np.repeat(lines.parities(128), take, axis=0)
                shard = (token >> np.uint64(32)) % np.uint64(shards)
                sort = np.argsort(shard, kind="stable")
                found, at = np.unique(shard[sort], return_index=True)
                blobs = [r.tobytes() for r in np.split(records[sort], at[1:])] if len(found) else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.astype(np.int32)), pa.array(blobs, pa.binary())], names=["shard", "entries"])

    partitions = max(1, shards // SHARDS_PER_PARTITION)
    return rows.mapInArrow(deal, "shard int, entries binary").repartition(partitions, "shard")


def _differ(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the bitmaps of two lines differ."""
    return np.bitwise_count(e["bits"][x] ^ e["bits"][y]).astype(np.int64).sum(axis=-1)


def _may_match(e: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether lines of entries ``x`` and ``y``, of one word and ``y`` not the larger, may reach 0.8."""
    size_x, size_y = e["size"][x].astype(np.int64), e["size"][y].astype(np.int64)
    place_x, place_y = e["place"][x].astype(np.int64), e["place"][y].astype(np.int64)
    both, huge = size_x + size_y, size_x == 0xFFFF
    index = (place_y < _indexed(size_y)) | (place_y == 0xFF) | ((size_x == size_y) & (place_x < _indexed(size_x)))
    most = 1 + np.minimum(size_x - place_x, size_y - place_y) - 1
    ok = index & (9 * most >= 4 * both)
    ok &= 9 * _differ(e, x, y) <= both
    return (ok | huge) & (e["ref"][x] != e["ref"][y])


def _proposals(entries: DataFrame) -> DataFrame:
    """Pairs of lines that may match, and the crowded words that have more of them.

    A pair: ``later``, ``earlier`` (refs), ``score``, ``more``: each entry proposes the
    PARTNERS earliest others of its word that it may match, and tells if there are, or
    may be, more. Orders are coarse, so a pair of one order is proposed both ways and the
    lines themselves tell which is later. All entries of a word with such an entry
    follow as its crowd: ``crowd`` (the word), ``later`` (the ref), ``size``, ``bits``.
    So rows are as many as entries, however many lines are alike.
    """
    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        blobs = [v.as_py() for batch in batches for v in batch.column(1)]
        e = np.frombuffer(b"".join(blobs), ENTRY)
        # by word, size, then set (16 bits of its name): copies of a set count once, with the least order
        e = e[np.argsort(e["token"].astype(np.uint64) << np.uint64(32) | e["size"].astype(np.uint64) << np.uint64(16)
                         | e["ref"] >> np.uint64(48))]
        if len(e):
            fresh = np.ones(len(e), dtype=bool)
            fresh[1:] = (e["token"][1:] != e["token"][:-1]) | (e["ref"][1:] != e["ref"][:-1])
            least = np.minimum.reduceat(e["order"], np.flatnonzero(fresh))
            e = e[fresh]
            e["order"] = least
        n, size, token = len(e), e["size"].astype(np.int64), e["token"]
        best = np.full((n, PARTNERS), FAR, dtype=np.int64)
        partner = np.zeros((n, PARTNERS), dtype=np.int64)
        seen = np.zeros(n, dtype=np.int64)

        def take(one: np.ndarray, other: np.ndarray, differ: np.ndarray) -> None:
            """Earlier partners take the place of the worst that an entry has; each entry at most once."""
            score = e["order"][other].astype(np.int64) * 256 + differ
            worst = best[one].argmax(axis=1)
            less = score < best[one, worst]
            best[one[less], worst[less]], partner[one[less], worst[less]] = score[less], other[less]

        active, step = np.arange(1, n), 1
        while len(active):
            y = active - step
            fits = (token[y] == token[active]) & (5 * size[y] >= 4 * size[active])
            active, y = active[fits], y[fits]
            if step > SPAN:
                break
            ok = _may_match(e, active, y)
            x, y = active[ok], y[ok]
            differ = _differ(e, x, y)
            for one, other in ((x, y), (y, x)):
                good = e["order"][other] <= e["order"][one]
                seen[one[good]] += 1
                take(one[good], other[good], differ[good])
            step += 1
            active = active[active >= step]
        for group in np.unique(token[active]):     # words of very many lines of like size
            block = np.flatnonzero(token == group)
            seen[block] += PARTNERS + 1
            best[block] = FAR
            for pivot in block[np.argsort(e["order"][block], kind="stable")[:PIVOTS]]:
                x, y = np.maximum(block, pivot), np.minimum(block, pivot)
                near = block[(5 * size[y] >= 4 * size[x]) & _may_match(e, x, y) & (e["order"][block] >= e["order"][pivot])]
                take(near, np.full(len(near), pivot), _differ(e, near, np.full(len(near), pivot)))

        crowded = seen > PARTNERS
        one, place = np.nonzero(best < FAR)
        crowd = np.flatnonzero(np.isin(token, token[crowded]))
        ref = e["ref"].view(np.int64) if n else np.zeros(0, np.int64)
        word = (np.int64(TaskContext.get().partitionId()) << np.int64(32)) + token.astype(np.int64)
        kinds = ["later", "earlier", "score", "more", "crowd", "size", "bits"]
        for at in range(0, len(one), 1 << 15):
            x, k = one[at:at + (1 << 15)], place[at:at + (1 << 15)]
            yield pa.RecordBatch.from_arrays([
                pa.array(ref[x]), pa.array(ref[partner[x, k]]), pa.array(best[x, k]), pa.array(crowded[x]),
                pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.list_(pa.int64()))], names=kinds)
        for at in range(0, len(crowd), 1 << 15):
            x = crowd[at:at + (1 << 15)]
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 2, pa.int32()), pa.array(e["bits"][x].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([
                pa.array(ref[x]), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int64()), pa.array(crowded[x]),
                pa.array(word[x]), pa.array(size[x]), bits], names=kinds)

    return entries.mapInArrow(propose, "later bigint, earlier bigint, score bigint, more boolean, "
                                       "crowd bigint, size bigint, bits array<bigint>")


def _crowd_pairs(open_refs: DataFrame, crowds: DataFrame) -> DataFrame:
    """All pairs ``later, earlier`` of open lines with those that may match them in their crowds."""
    mine = crowds.join(open_refs, "later").select("crowd", "later", F.col("size").alias("size_m"), F.col("bits").alias("bits_m"))
    every = crowds.select("crowd", F.col("later").alias("earlier"), "size", "bits")
    most, least = F.greatest("size", "size_m"), F.least("size", "size_m")
    differ = reduce(Column.__add__, (
        F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_m", F.lit(i)))) for i in range(2)))
    may = (5 * least >= 4 * most) & ((9 * differ <= most + least) | (most == 0xFFFF))
    return mine.join(every, (mine.crowd == every.crowd) & (F.col("later") != F.col("earlier")) & may).select(
        "later", "earlier").distinct()


def _asked(filter_: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Whether the filter holds each ref (it may hold others besides those put in)."""
    bit = mix(refs) >> np.uint64(64 - ASKED_BITS)
    return (filter_[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _filter_of(refs: DataFrame) -> np.ndarray:
    """A filter of 2**ASKED_BITS bits, one megabyte, with the refs of all columns."""
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << ASKED_BITS, dtype=bool)
        for column in (c for batch in batches for c in batch.columns):
            held[mix(column.to_numpy().view(np.uint64)) >> np.uint64(64 - ASKED_BITS)] = True
        words = np.packbits(held, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["word", "bits"])

    rows = refs.mapInArrow(bits, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()
    out = np.zeros(1 << (ASKED_BITS - 6), dtype=np.uint64)
    for row in rows:
        out[row["word"]] = np.int64(row["bits"]).view(np.uint64)
    return out


def _sets(rows: DataFrame, asked: np.ndarray) -> DataFrame:
    """``ref``, KEY, ``place`` (its first line), ``words`` and ``wide`` (bitmap) of the lines in the filter."""
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                lines = _lines(part.column(1))
                a, b = lines.names()
                hit = np.flatnonzero(_asked(shared.value, a))
                at = pa.array(lines.row[hit])
                packed = [lines.tokens[lines.first[i]:lines.first[i + 1]].tobytes() for i in hit]
                sizes = lines.sizes[hit]
                picked = _Lines(np.frombuffer(b"".join(packed), np.uint64), np.concatenate([[0], np.cumsum(sizes)]),
                                lines.row[hit], lines.number[hit])
                wide = picked.parities(64 * SIGNATURE_WORDS).view(np.int64)
                ends = pa.array(np.arange(len(hit) + 1) * SIGNATURE_WORDS, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[hit].view(np.int64)), pa.array(b[hit].view(np.int64)), pa.array(sizes),
                     part.column(0).take(at), part.column(2).take(at), pa.array(lines.number[hit]),
                     pa.array(packed, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(wide.ravel()))],
                    names=[*KEY, "id", "body", "number", "words", "wide"])

    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(pick, f"set_a bigint, set_b bigint, size bigint, id {kind}, body bigint, number bigint, "
                                  "words binary, wide array<bigint>")
    return found.groupBy(*KEY).agg(
        F.min(F.struct("id", "body", "number")).alias("place"), F.first("words").alias("words"),
        F.first("wide").alias("wide")).withColumn("ref", F.col("set_a"))


def _far(a: str, b: str) -> Column:
    """Bits in which two wide bitmaps differ: no more than the words in which the lines do."""
    return reduce(Column.__add__, (
        F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SIGNATURE_WORDS)))


def _only(sets: DataFrame, asked: np.ndarray) -> DataFrame:
    """The sets in the filter: what a join need not move."""
    shared = sets.sparkSession.sparkContext.broadcast(asked)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            refs = batch.column(batch.schema.get_field_index("ref")).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(_asked(shared.value, refs)))

    return sets.mapInArrow(keep, sets.schema)


def _losers(pairs: DataFrame, sets: DataFrame, at_most: int | None = None, told_apart: bool = True) -> DataFrame:
    """KEY of the later line of each pair ``later, earlier`` whose words reach 0.8.

    ``told_apart``: compare wide bitmaps before words, for pairs of which few will reach it.
    """
    pairs = settled(pairs, "line-pairs", at_most)
    sets = settled(_only(sets, _filter_of(pairs)), "line-asked")

    def side(name: str, *columns: str) -> DataFrame:
        return sets.select(F.col("ref").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))

    if told_apart:
        pairs = (
            pairs.join(side("later", "size", "wide"), "later").join(side("earlier", "size", "wide"), "earlier")
            .filter(9 * _far("wide_later", "wide_earlier") <= F.col("size_later") + F.col("size_earlier"))
            .select("later", "earlier")
        )
    every = (*KEY, "place", "words")
    joined = pairs.join(side("later", *every), "later").join(side("earlier", *every), "earlier")
    second = F.col("place_later") > F.col("place_earlier")
    loser = [F.when(second, F.col(f"{c}_later")).otherwise(F.col(f"{c}_earlier")).alias(c) for c in KEY]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for one, other in zip(batch.column(3), batch.column(4)):
                one, other = (np.frombuffer(v.as_py(), np.uint64) for v in (one, other))
                both = len(np.intersect1d(one, other, assume_unique=True))
                linked.append(9 * both >= 4 * (len(one) + len(other)))
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=KEY).filter(pa.array(linked, pa.bool_()))

    rows = joined.select(*loser, "words_later", "words_earlier")
    return rows.mapInArrow(verify, "set_a bigint, set_b bigint, size bigint").distinct()


def line_removals(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id``, ``body`` (a hash of the text), ``n_lines`` and ``removed`` (line numbers) of every row.

    A line is a part of a text between line feeds; its set is its distinct words, A-Z in
    lower case. A line is removed if an earlier line's set has a Jaccard similarity of 0.8
    or more with its own, whether or not that one stays. Earlier is the order of id (null
    first), body and line number, so rows alike in id and text stand at one place and lose
    the same lines. Lines without a word are neither counted nor removed. A null or empty
    text has no lines; an empty table gives none; other columns are not read.

    Equal sets are found by name. The others meet by the words of their prefixes, and
    each proposes the earliest lines that it may match; what the best of them confirms is
    settled. Lines still open then meet the rest of their proposals and, where a word had
    more, all lines of that word: nothing that may match is passed over.
    """
    session = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("body", F.xxhash64("text"))
    survey = settled(_surveyed(rows), "line-survey")
    lines = survey.filter("kind = 'line'")
    rarity = _rarities(survey.filter("kind = 'count'"))
    numeric = rows.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    orders = sorted(set(rows.approxQuantile("id", [i / 255 for i in range(1, 255)], 1e-3))) if numeric else []
    shards = SHARDS_PER_PARTITION * int(session.conf.get("spark.sql.shuffle.partitions"))
    found = settled(_proposals(_entries(rows, rarity, orders, shards)), "line-proposals")
    crowds = found.filter("crowd is not null")
    offers = found.filter("crowd is null").groupBy("later", "earlier").agg(
        F.min("score").alias("score"), F.max("more").alias("more"))
    offers = settled(offers, "line-offers", found.count())
    n_offers = offers.count()
    sets = settled(_sets(rows, _filter_of(found.select("later", F.coalesce("earlier", "later")))), "line-sets")

    best = offers.groupBy("later").agg(F.min(F.struct("score", "earlier")).alias("best"))
    lost = settled(_losers(best.select("later", "best.earlier"), sets, n_offers, told_apart=False), "line-lost", n_offers)
    gone = lost.select(F.col("set_a").alias("later")).distinct()
    still = settled(offers.join(gone, "later", "left_anti"), "line-still", n_offers)
    lost = lost.unionByName(settled(_losers(still.select("later", "earlier"), sets, n_offers), "line-lost", n_offers))

    gone = lost.select(F.col("set_a").alias("later")).distinct()
    unsure = crowds.filter("more").select("later").distinct().join(gone, "later", "left_anti")
    lost = settled(lost.unionByName(_losers(_crowd_pairs(unsure, crowds), sets)).distinct(), "line-lost")

    place = F.struct("id", "body", "number")
    firsts = lines.groupBy(*KEY).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    firsts = firsts.join(lost.withColumn("lost", F.lit(True)), KEY, "left")
    # written, so that the join below stands alone and a line that many documents have is split
    firsts = settled(firsts.filter(F.col("lost") | (F.col("first") < F.col("last"))).drop("last"), "line-firsts")
    removed = (
        lines.join(firsts, KEY).filter(F.coalesce("lost", F.lit(False)) | (place > F.col("first")))
        .groupBy(F.col("id").alias("of"), F.col("body").alias("in")).agg(F.sort_array(F.collect_set("number")).alias("removed"))
    )
    all_docs = survey.filter("kind = 'doc'").select("id", "body", F.col("size").alias("n_lines"))
    return all_docs.join(
        removed, F.col("id").eqNullSafe(F.col("of")) & F.col("body").eqNullSafe(F.col("in")), "left",
    ).select("id", "body", "n_lines", F.coalesce("removed", F.array().cast("array<bigint>")).alias("removed"))


def without_lines(docs: DataFrame, removals: DataFrame, text: str = "text", id_col: str = "doc_id",
                  into: str = "text") -> DataFrame:
    """``docs`` with the column ``into``: the text without the lines that ``removals`` names.

    A text that loses none is unchanged. A row whose lines with a word are all removed is
    left out. Other columns, and rows without a word, stay.
    """
    own, at, gone = unused(docs, "is", "at", "cut")
    cut = removals.filter(F.size("removed") > 0).dropDuplicates(["id", "body"]).select(
        F.struct("id", "body").alias(at), F.struct("n_lines", "removed").alias(gone))
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(f"{gone}.removed", i.cast("long")))
    joined = docs.withColumn(own, F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("body")))
    joined = joined.join(cut, F.col(own) == F.col(at), "left")
    joined = joined.filter(F.col(gone).isNull() | (F.size(f"{gone}.removed") < F.col(f"{gone}.n_lines")))
    return joined.withColumn(
        into, F.when(F.col(gone).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop(own, at, gone)
