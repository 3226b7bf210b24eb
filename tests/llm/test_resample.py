"""CRC-32 against zlib, and resampling against the formulas applied row by row."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from ledgerline.llm.crc import REACH, crc32_spans
from ledgerline.llm.resample import bucket_counts, buckets, drawn, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
KIND = "doc_id long, text string, id int, own string, weight string, score int, bucket int, range int"


def features(text, longest):
    words = WORD.findall((text or "").translate(FOLD))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def bucket(feature, n):
    return zlib.crc32(feature.encode()) % n


def brute(docs, target, longest=1, n=10_000, least=20, percent=10):
    raw = Counter(bucket(f, n) for _, t in docs for f in features(t, longest)[1])
    want = Counter(bucket(f, n) for t in target for f in features(t, longest)[1])
    all_s, all_t = sum(raw.values()), sum(want.values())
    gain = [math.floor(1000 * math.log(((want[b] + 1.0) * (all_s + n)) / ((raw[b] + 1.0) * (all_t + n)))) for b in range(n)]
    out = []
    for i, text in docs:
        words, found = features(text, longest)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f, n)] for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    ranked = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(ranked[:len(ranked) * percent // 100], 1):
        row[4] = rank
    return [tuple(r[:5]) for r in out]


def made(n=500):
    pick = random.Random(9)
    vocabulary = ["The", "the", "a1", "naïve", "漢字仮名", "x" * 70, "é" * 200, "42", "z"] + [f"w{k}" for k in range(60)]
    docs = [(pick.choice([None, *range(300)]), pick.choice([" ", "-", "\x00", "\n", "_", " \t"]).join(pick.choice(vocabulary) for _ in range(pick.choice([0, 1, 19, 20, 60])))) for _ in range(n)]
    docs += [(1, None), (2, ""), (3, "..."), (4, "漢" * 50_000), (5, "long word " * 40_000)]
    docs += [(77, "copies of one row " * 9)] * 120 + [(None, "w1 " * 30)] * 40
    return docs, ["w3 w4 w5 naïve", None, "", "w3-W3", "漢字仮名 42"] * 3


def test_crc_of_spans_of_any_length():
    pick = np.random.default_rng(2)
    data = pick.integers(0, 256, 20_000).astype(np.uint8)
    starts = np.concatenate([pick.integers(0, 9_000, 400), np.zeros(300, int)])
    ends = starts + np.concatenate([pick.integers(0, 3 * REACH, 400), np.arange(300)])
    starts, ends = np.append(starts, 0), np.append(ends, len(data))
    raw = data.tobytes()
    assert crc32_spans(data, starts, ends).tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(starts, ends)]
    assert len(crc32_spans(data[:0], starts[:0], ends[:0])) == 0


def test_buckets_of_runs():
    texts = [t for _, t in made(60)[0]]
    for longest in (1, 2, 3):
        found, edges, words = buckets(pa.array(texts), longest, 1_000)
        for i, text in enumerate(texts):
            n, want = features(text, longest)
            assert words[i] == n
            assert sorted(found[edges[i]:edges[i + 1]]) == sorted(bucket(f, 1_000) for f in want)


def test_rows_against_formulas(spark):
    docs, target = made()
    df = spark.createDataFrame([(*r, 0, "", "", 1, 2, 3) for r in docs], KIND).repartition(6)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for longest, n in ((1, 10_000), (2, 500)):
        found = resample(df, goal, longest=longest, n_buckets=n)
        assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(brute(docs, target, longest, n), key=repr)


def test_draws_are_numbered_through(spark):
    rows = spark.range(5_000).selectExpr("id % 7 as score", "id % 3 as id", "0L as n_features", "id as own")
    for most in (0, 1, 1234, 5_000):
        found = {r["own"]: r["rank"] for r in drawn(rows, most).collect()}
        want = sorted(range(5_000), key=lambda i: (-(i % 7), i % 3, i))[:most]
        assert found == {own: k for k, own in enumerate(want, 1)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (None, None)], none.schema)
    assert resample(none, none.select("text")).count() == 0
    assert bucket_counts(none).count() == 0
    assert sorted(map(tuple, resample(some, none.select("text")).collect()), key=repr) == sorted(brute([(1, "a b"), (None, None)], []), key=repr)
