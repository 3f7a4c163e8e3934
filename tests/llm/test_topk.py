import math
import random

import numpy as np
import pytest

from dockett.llm import topk

SCHEMA = "vec_id long, embedding array<float>, query_id string, rank string"


def brute(data, queries, k):
    ints = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, *_ in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ints if queries(i)):
        scored = sorted((-min(max(sum(a * b for a, b in zip(ints[q], v)), -(2**63 - 1)), 2**63 - 1), i) for i, v in ints.items() if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("sizes", [(2048, 4096, 8), (3, 7, 2), (1, 1, 1)])
def test_against_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("QUERY_ROWS", "TILE_ROWS", "GROUP"), sizes):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(1)
    data = [(i, [rng.choice([0.5, -0.25, rng.uniform(-1, 1)]) for _ in range(6)], "x", "y") for i in range(90)]
    data += [(100 + i, [0.5] * 6, "x", "y") for i in range(12)] + [(-5, [0.1] * 3, "x", "y"), (150, [], "x", "y"), (-50, [1.0, 2.0], "x", "y")]
    data += [(200, None, "x", "y"), (250, [1.0, None], "x", "y"), (300, [float("nan")], "x", "y"), (350, [float("inf")] * 6, "x", "y"), (None, [9.0] * 6, "x", "y")]
    vectors = topk.integers(spark.createDataFrame(data, SCHEMA))
    got = topk.exact_top_k(vectors, vectors.filter("vec_id % 10 = 0"), 5).collect()
    assert sorted(map(tuple, got)) == brute(data, lambda i: i % 10 == 0, 5)


def test_few_vectors_and_none(spark):
    empty = topk.integers(spark.createDataFrame([], SCHEMA))
    assert topk.exact_top_k(empty, empty, 5).count() == 0
    two = topk.integers(spark.createDataFrame([(0, [1.0], None, None), (50, [1.0], None, None), (50, [1.0], None, None)], SCHEMA))
    got = topk.exact_top_k(two, two, 5).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 50, 65536), (0, 2, 50, 65536), (50, 1, 0, 65536)]


def test_numbers_beyond_doubles(spark):
    data = [(i, [3e6 + i, -2e6, 1.5 * i], None, None) for i in range(20)] + [(50, [3e38, 3e38, 3e38], None, None)]
    vectors = topk.integers(spark.createDataFrame(data, SCHEMA))
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_top_k(vectors, vectors.filter("vec_id = 0"), 3).collect()}
    want = {(q, n): (i, s) for q, n, i, s in brute(data, lambda i: i == 0, 3)}
    assert got == want
