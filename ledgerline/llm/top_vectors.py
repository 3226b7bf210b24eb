"""Exact top-k by inner product: tiles of queries against shards of vectors, then merged lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_NUMBERS = 1 << 21       # components of one side of a cell
QUERY_TILE, SHARD_TILE = 512, 4096
MERGE_FANIN = 64             # first-level lists of a query that are merged at once


def quantised(vectors: DataFrame, id_col: str, vector: str, scale: int) -> DataFrame:
    """``id`` and ``vector`` of the rows that take part: no null, no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (
        vectors.filter(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).filter(~bad)
        .select(F.col(id_col).cast("long").alias("id"),
                F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("vector"))
    )


def _matrices(side: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by dimension, ids ascending."""
    column = side["vector"].combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    starts = column.offsets.to_numpy()[:-1]
    flat = column.values.to_numpy(zero_copy_only=False)
    ids = side["id"].to_numpy()
    out = {}
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        rows = rows[np.argsort(ids[rows], kind="stable")]
        out[int(dim)] = ids[rows], flat[starts[rows][:, None] + np.arange(dim)]
    return out


def _kind(queries: np.ndarray, shard: np.ndarray):
    """The narrowest type that holds every score exactly."""
    if not queries.size or not shard.size:
        return np.float64
    bound = float(np.abs(queries).max()) * float(np.abs(shard).max()) * queries.shape[1]
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


def _exact(matrix: np.ndarray, kind) -> np.ndarray:
    if kind is not object:
        return matrix.astype(kind)
    return np.array([[int(x) for x in row] for row in matrix], dtype=object).reshape(matrix.shape)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids and scores of the ``k`` best of each row; ``ids`` ascend, so ties go to the smaller."""
    if scores.shape[1] > k and scores.dtype != object:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        rows, cols = np.nonzero(scores >= least[:, None])
    else:
        rows, cols = (x.ravel() for x in np.indices(scores.shape))
    values = scores[rows, cols]
    order = np.lexsort((cols, -values, rows))
    rows, cols, values = rows[order], cols[order], values[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[cols[keep]], values[keep]


def _cell(queries: pa.Table, shard: pa.Table, k: int) -> pa.Table:
    """The ``k`` best of one shard for each query of the cell, tile by tile."""
    out_q, out_v, out_s = [], [], []
    vectors = _matrices(shard)
    for dim, (q_ids, q) in _matrices(queries).items():
        if dim not in vectors:
            continue
        v_ids, v = vectors[dim]
        kind = _kind(q, v)
        q, v = _exact(q, kind), _exact(v, kind)
        for at in range(0, len(q_ids), QUERY_TILE):
            ask = q_ids[at:at + QUERY_TILE]
            found = []
            for to in range(0, len(v_ids), SHARD_TILE):
                have = v_ids[to:to + SHARD_TILE]
                scores = q[at:at + QUERY_TILE] @ v[to:to + SHARD_TILE].T
                rows, ids, values = _best(scores, have, k + 1)    # one may be the query itself
                other = ask[rows] != ids
                found.append((rows[other], ids[other], values[other]))
            rows, ids, values = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((ids, -values, rows))
            rows, ids, values = rows[order], ids[order], values[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
            out_q.append(ask[rows[keep]])
            out_v.append(ids[keep])
            out_s.append(values[keep])
    out_s = [np.clip(s, -2**63, 2**63 - 1) if s.dtype == object else s for s in out_s]
    columns = [np.concatenate([c.astype(np.int64) for c in x]) if x else np.zeros(0, np.int64) for x in (out_q, out_v, out_s)]
    return pa.table({
        "query_id": pa.array(columns[0]), "vec_id": pa.array(columns[1]), "score": pa.array(columns[2])})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
          vector: str = "embedding", scale: int = 256) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of each query's ``k`` best vectors.

    Components are floor(scale * x); the score is the integer inner product; ties go to
    the smaller id; a query is not its own candidate, nor is a row with its id (an id
    should be unique). Only vectors of the query's dimension are candidates. Rows with a
    null id, or a vector that is null or holds a null or non-finite component, take no
    part; a query with no candidate has no rows; empty tables give none; other columns
    are not read. A score beyond 64 bits stands at their end.

    Queries and vectors are dealt by hash to the cells of a grid, a bounded number of
    components a side. A cell multiplies tiles and keeps ``k`` a query; lists are merged
    in two levels.
    """
    shards, tiles = quantised(vectors, id_col, vector, scale), quantised(queries, id_col, vector, scale)
    n, dim = shards.agg(F.count("*"), F.max(F.size("vector"))).first()
    asked = tiles.count()
    rows = max(1, CELL_NUMBERS // max(1, dim or 1))
    across, down = max(1, math.ceil(n / rows)), max(1, math.ceil(asked / rows))
    shards = shards.select(
        "id", "vector", F.pmod(F.xxhash64("id"), F.lit(across)).alias("x"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("y"))
    tiles = tiles.select(
        "id", "vector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("x"),
        F.pmod(F.xxhash64("id"), F.lit(down)).alias("y"))

    def cell(key, left: pa.Table, right: pa.Table) -> pa.Table:
        part = _cell(left, right, k)
        return part.append_column("x", pa.array(np.full(len(part), key[0].as_py(), np.int64)))

    lists = tiles.groupBy("x", "y").cogroup(shards.groupBy("x", "y")).applyInArrow(
        cell, "query_id bigint, vec_id bigint, score bigint, x bigint")
    best = [F.desc("score"), F.asc("vec_id")]
    merged = lists.withColumn("part", F.floor(F.col("x") / MERGE_FANIN))
    for keys in (["query_id", "part"], ["query_id"]):
        merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best)))
        merged = merged.filter(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
