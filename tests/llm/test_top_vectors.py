"""Exact top-k against all products."""

import math
import random

import pytest

from ledgerline.llm import top_vectors
from ledgerline.llm.top_vectors import top_k


def expected(rows, k, scale=256):
    vectors = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
               if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vectors:
        if q % 3 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors if i != q and len(a) == len(b))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def made(seed, n=150, dim=6):
    pick = random.Random(seed)
    rows = [(i, [pick.choice([-0.5, 0.0, 0.25, 0.1]) if seed else pick.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    return rows + [(900, None), (901, [0.1] * 5 + [None]), (903, [float("nan")] * 6), (906, [float("inf")] * 6),
                   (909, [0.5, 0.5]), (912, [0.25, 0.5]), (None, [0.1] * 6), (915, []), (918, []), (921, [4e6] * 6), (923, [-3e6] * 6)]


@pytest.mark.parametrize("seed", [0, 1, 2])
@pytest.mark.parametrize("numbers", [None, 60])
def test_equals_all_products(spark, monkeypatch, seed, numbers):
    if numbers:      # many cells and tiles; ties run over their borders
        monkeypatch.setattr(top_vectors, "CELL_NUMBERS", numbers)
        monkeypatch.setattr(top_vectors, "SHARD_TILE", 3)
        monkeypatch.setattr(top_vectors, "QUERY_TILE", 2)
        monkeypatch.setattr(top_vectors, "MERGE_FANIN", 2)
    rows = made(seed, 150 if not numbers else 40)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = top_k(df, df.filter("vec_id % 3 = 0"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == expected(rows, 5)


def test_scores_beyond_64_bits_stand_at_their_end(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [-1e30])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, top_k(df, df.filter("vec_id = 0")).collect()))
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -2**63)]


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (3, [2.0])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, top_k(df, df.filter("vec_id = 0"), k=7).collect()))
    assert got == [(0, 1, 1, 131072), (0, 2, 3, 131072)]
    assert top_k(df.filter("false"), df).count() == 0 and top_k(df, df.filter("false")).count() == 0
    assert top_k(df.filter("vec_id = 0"), df.filter("vec_id = 0")).count() == 0
