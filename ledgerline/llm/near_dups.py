"""Near duplicates by b-bit MinHash: bands propose, packed low bits estimate, whole sets confirm."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.llm.settle import settled
from ledgerline.llm.words import distinct_in_rows, grams, mix, slices, words_of

PERMUTATIONS = 128
BANDS = 32                   # of 4 minima: a pair at 0.8 meets in none with a chance of 5e-8
LOW_BITS = 4                 # kept of each minimum
LEAST_ESTIMATE = 0.616       # that a pair at the threshold falls short of by 5 deviations
LEAST_MATCHES = 82           # agreeing low bits of 128 that make this estimate
THRESHOLD = 80               # per cent
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 128, 16_384, 64   # sets of a block; blocks of a cluster, if those sizes allow it

_rng = np.random.default_rng(71)
_FLIP = _rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)
_TIMES = _rng.integers(0, 2**31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of ``n`` words in a row, and the rows' ranges; a shorter text is one shingle."""
    words = words_of(column)
    hashes = words.hashes(fold=True)
    found, first = grams(hashes, words.first, n)
    values, rows = [found], [np.repeat(np.arange(len(column)), np.diff(first))]
    for size in range(1, n):
        short = np.flatnonzero(words.counts == size)
        at = words.first[short][:, None] + np.arange(size)
        whole, _ = grams(hashes[at.ravel()], np.arange(len(short) + 1) * size, size)
        values.append(whole)
        rows.append(short)
    values, rows = np.concatenate(values), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return distinct_in_rows(values[order], np.searchsorted(rows[order], np.arange(len(column) + 1)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return np.diff(total[first])


def _minima(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """PERMUTATIONS x rows: the least value of each row that has one under each permutation."""
    starts = first[:-1][np.diff(first) > 0]
    narrow = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((PERMUTATIONS, len(starts)), dtype=np.uint32)
    held = np.empty_like(narrow)
    for k in range(PERMUTATIONS):
        np.bitwise_xor(narrow, _FLIP[k], out=held)
        np.multiply(held, _TIMES[k], out=held)
        out[k] = np.minimum.reduceat(held, starts) if len(starts) else 0
    return out


def _lists(matrix: np.ndarray, full: np.ndarray) -> pa.Array:
    """One list of longs for each row in ``full``, an empty one for the others."""
    ends = np.concatenate([[0], np.cumsum(np.where(full, matrix.shape[1], 0))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(matrix.ravel().view(np.int64)))


def signatures(docs: DataFrame, n: int, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id``, ``n_shingles``, ``set_a`` and ``set_b`` (128 bits that name the set), ``bands``, ``low``.

    ``low`` holds LOW_BITS of each minimum as bit planes, 64 permutations to a long.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, first = shingles(part.column(1), n)
                least = _minima(values, first)
                per_band = PERMUTATIONS // BANDS
                keys = np.zeros((BANDS, least.shape[1]), dtype=np.uint64)
                for k in range(per_band):
                    keys = mix(keys ^ least[k::per_band])
                keys = mix(keys + np.arange(BANDS, dtype=np.uint64)[:, None])
                planes = [np.packbits((least >> np.uint32(bit)) & np.uint32(1) == 1, axis=0).T
                          for bit in range(LOW_BITS)]
                low = np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.uint64)
                full = np.diff(first) > 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(first)),
                     pa.array(_sums(mix(values), first).view(np.int64)),
                     pa.array(_sums(mix(values ^ np.uint64(0x5851F42D4C957F2D)), first).view(np.int64)),
                     _lists(np.ascontiguousarray(keys.T), full), _lists(low, full)],
                    names=["id", "n_shingles", "set_a", "set_b", "bands", "low"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"id {kind}, n_shingles bigint, set_a bigint, set_b bigint, "
                                 "bands array<bigint>, low array<bigint>")


def matches(a: str, b: str) -> Column:
    """Permutations whose low bits agree: those that differ in no plane."""
    half = PERMUTATIONS // 64
    differ = [
        reduce(Column.bitwiseOR, (
            F.get(a, F.lit(bit * half + word)).bitwiseXOR(F.get(b, F.lit(bit * half + word)))
            for bit in range(LOW_BITS)))
        for word in range(half)
    ]
    return F.lit(PERMUTATIONS) - reduce(Column.__add__, map(F.bit_count, differ))


def estimated(a: str, b: str) -> Column:
    """Jaccard similarity by the share of agreeing low bits, less the share that agree by chance."""
    chance = 2.0 ** -LOW_BITS
    return (matches(a, b) / PERMUTATIONS - chance) / (1 - chance)


def _alike(one: np.ndarray, other: np.ndarray) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= THRESHOLD * (len(one) + len(other) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose whole sets reach THRESHOLD."""
    of_a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    of_b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [_alike(np.frombuffer(one.as_py(), np.uint64), np.frombuffer(other.as_py(), np.uint64))
                      for one, other in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    joined = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "set_a", "set_b")
    kind = joined.schema["a"].dataType.simpleString()
    return joined.mapInArrow(confirm, f"a {kind}, b {kind}")


def _linked_in(rows: DataFrame) -> DataFrame:
    """Links ``a, b`` between the components of each cluster.

    ``rows``: rep, component, cluster, low, shingles. A cluster is cut into blocks by hash
    and each pair of blocks is a cell, so that a large cluster is many tasks; the
    pairs of a cell are told apart by size and low bits, then by their whole sets.
    """
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    size = F.least(F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("n") / BLOCKS)), F.lit(MOST_BLOCK))
    sizes = sizes.filter("n > 1").select("cluster", F.ceil(F.col("n") / size).alias("blocks"))
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    cells = (
        rows.join(sizes, "cluster").withColumn("mine", mine)
        .withColumn("theirs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("cluster", F.least("mine", "theirs").alias("x"), F.greatest("mine", "theirs").alias("y"), "mine",
                "rep", "component", F.col("low"), "shingles")
    )

    def link(cell: pa.Table) -> pa.Table:
        low = np.array(cell["low"].to_pylist(), dtype=np.int64).view(np.uint64).reshape(len(cell), LOW_BITS, -1)
        held = [np.frombuffer(v.as_py(), np.uint64) for v in cell["shingles"]]
        count = np.array([len(v) for v in held])
        component = np.unique(cell["component"].to_numpy(), return_inverse=True)[1]
        mine, x, y = (cell[c].to_numpy() for c in ("mine", "x", "y"))
        ones, others = np.flatnonzero(mine == x), np.flatnonzero(mine == y)
        a, b = [], []
        for one in ones:
            other = others[others > one] if x[0] == y[0] else others
            fits = (component[other] != component[one]) & (100 * np.minimum(count[other], count[one])
                                                           >= THRESHOLD * np.maximum(count[other], count[one]))
            other = other[fits]
            differ = np.bitwise_or.reduce(low[other] ^ low[one], axis=1)
            alike = PERMUTATIONS - np.bitwise_count(differ).astype(np.int64).sum(axis=1)
            for two in other[alike >= LEAST_MATCHES]:
                if _alike(held[one], held[two]):
                    a.append(one)
                    b.append(two)
        return pa.table({"a": cell["rep"].take(pa.array(a, pa.int64())), "b": cell["rep"].take(pa.array(b, pa.int64()))})

    kind = rows.schema["rep"].dataType.simpleString()
    return cells.groupBy("cluster", "x", "y").applyInArrow(link, f"a {kind}, b {kind}")


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are not of one component yet."""
    of_a = comps.select(F.col("node").alias("a"), F.col("component").alias("in_a"))
    of_b = comps.select(F.col("node").alias("b"), F.col("component").alias("in_b"))
    return (
        pairs.join(of_a, "a", "left").join(of_b, "b", "left")
        .filter(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b")
    )


def near_duplicates(docs: DataFrame, n: int = 5, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``.

    Documents whose sets of ``n``-word shingles (A-Z in lower case) have a Jaccard
    similarity of 0.8 or more are linked; ``component_id`` is the smallest id reachable
    over links, ``kept`` says that it is the row's own. Repeated texts are one set, with
    its smallest id for all; a text of fewer than ``n`` words is one shingle; a text
    without words, or null, has no shingle and no link. A null id has a null component,
    no links, and is kept. Rows that share an id are judged each by its own text, and reach what
    that reaches. Empty tables give none; other columns are not read.

    Candidates share a band. First each set meets the centre of one of its bands that it
    looks most like, then the other centres; what that confirms is joined into components.
    Then sets of one band that are still in different components meet pairwise, if their
    low bits allow it: so a group of copies costs a comparison or a few for each member,
    yet no link between components is left out. Whatever passes is confirmed on whole sets.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    signed = settled(signatures(rows, n, "text", "id"), "near-signatures")
    name = ["n_shingles", "set_a", "set_b"]
    classes = settled(
        signed.filter("n_shingles > 0 and id is not null").groupBy(*name)
        .agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("low").alias("low")), "near-classes")
    bands = classes.select("rep", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = settled(bands.join(shared, "band"), "near-members")
    n_classes, n_members = classes.count(), members.count()
    needed = members.select(F.col("rep").alias("id")).distinct()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, first = shingles(part.column(1), n)
                packed = [values[a:b].tobytes() for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(packed, pa.binary())], names=["id", "shingles"])

    kind = rows.schema["id"].dataType.simpleString()
    sets = settled(
        rows.join(needed, "id", "left_semi").mapInArrow(whole, f"id {kind}, shingles binary"), "near-sets")
    low = classes.select("rep", "low")

    # a band's centre: the member that shares most bands with most sets, as an original does with its copies
    weights = members.groupBy("rep").agg(F.sum("n").alias("weight"))
    centres = members.join(weights, "rep").groupBy("band").agg(
        F.max(F.struct("weight", "rep")).alias("centre")).select("band", F.col("centre.rep").alias("b"))
    star = settled(
        members.join(centres, "band").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
        .join(low.select(F.col("rep").alias("a"), F.col("low").alias("low_a")), "a")
        .join(low.select(F.col("rep").alias("b"), F.col("low").alias("low_b")), "b")
        .select("a", "b", estimated("low_a", "low_b").alias("alike"))
        .filter(F.col("alike") >= LEAST_ESTIMATE), "near-star", n_members, 50_000)
    best = star.groupBy("a").agg(F.min(F.struct((-F.col("alike")).alias("unlike"), "b")).alias("best"))
    best = best.select("a", "best.b")
    links = settled(_confirmed(best, sets), "near-links", n_classes)
    comps = components(links, "a", "b", n_classes)

    # then the other centres, where they are of another component
    others = _apart(star.select("a", "b").join(best, ["a", "b"], "left_anti"), comps)
    links = links.unionByName(settled(_confirmed(others, sets), "near-links", n_members))
    comps = components(links, "a", "b", n_classes + n_members)

    # then all sets that open bands connect, in blocks, where they are of different components
    placed = (
        members.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .select("band", "rep", F.coalesce("component", "rep").alias("component"))
    )
    open_bands = (
        placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .filter("least < most")
    )
    left = settled(
        placed.join(open_bands.select("band", "least"), "band").select("rep", "component", "least"), "near-open", n_members)
    clusters = components(left.select("component", "least"), "component", "least", left.count())
    links = links.unionByName(settled(_linked_in(
        left.select("rep", "component").distinct()
        .join(clusters.select(F.col("node").alias("component"), F.col("component").alias("cluster")), "component", "left")
        .withColumn("cluster", F.coalesce("cluster", "component"))
        .join(low, "rep").join(sets.select(F.col("id").alias("rep"), "shingles"), "rep")), "near-links"))
    comps = components(links, "a", "b", links.count())

    named = signed.select("id", *name).join(classes.select(*name, "rep"), name, "left")
    found = named.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep", "id"))
    return found.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"))
