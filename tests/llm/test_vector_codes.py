import hashlib
import math
import random

import numpy as np
import pytest

from dockett.llm import vector_codes
from dockett.llm.vector_codes import compressed

SCHEMA = "vec_id long, embedding array<double>, label int, code string, entry string, `a.b` string"


def brute(data, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab, *_ in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    kept = [(i, v + [0] * (parts * width - len(v)), lab) for i, v, lab in kept]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, book: min((far(v, c), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = [[] for _ in books[p]]
            for _, v, _ in kept:
                got[nearest(cut(v, p), books[p])[1]].append(cut(v, p))
            books[p] = [[sum(x) // len(own) for x in zip(*own, strict=True)] if own else c for own, c in zip(got, books[p], strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    rows, sums = [], {}
    for i, v, lab in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = min(sum(d for d, _ in best), 2**63 - 1)
        sums[lab] = sums.get(lab, 0) + error
        rows.append((i, lab, "".join(f"{e:02x}" for _, e in best), error))
    return sorted(((*r, min(sums[r[1]], 2**63 - 1), digest) for r in rows), key=str)


def frame(spark, data):
    return spark.createDataFrame([(*d, "x", "y", "z") for d in data], SCHEMA).repartition(3)


def vectors(n, dim, spread=1.0, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.choice([0.5, rng.gauss(0, spread)]) for _ in range(dim)], rng.choice([None, 1, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("spread", [1.0, 1e6, 1e12])
def test_against_brute_force(spark, spread):
    data = vectors(120, 12, spread) + [(7, [0.5] * 12, 1), (7, [0.5] * 12, 1), (None, [0.25] * 12, 3), (500, None, 1), (501, [1.0, None], 1), (502, [math.nan] * 12, 1), (503, [math.inf] * 12, 9)]
    got = compressed(frame(spark, data), parts=4, entries=8)
    assert sorted(map(tuple, got.collect()), key=str) == brute(data, 4, 8, 2)


def test_parts_that_do_not_divide_and_short_vectors(spark):
    data = vectors(40, 10) + [(100, [1.0], 1), (101, [], 1)]
    assert sorted(map(tuple, compressed(frame(spark, data), parts=4, entries=5).collect()), key=str) == brute(data, 4, 5, 2)


def test_few_vectors_none_and_many_labels(spark, monkeypatch):
    assert compressed(frame(spark, [(1, None, 1)])).count() == 0
    data = vectors(5, 32)
    assert sorted(map(tuple, compressed(frame(spark, data)).collect()), key=str) == brute(data, 16, 64, 2)
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, compressed(frame(spark, data)).collect()), key=str) == brute(data, 16, 64, 2)


def test_limbs_and_products():
    rng = random.Random(2)
    for bits, top in ((25, 40), (22, 60), (10, 62), (25, 200)):
        whole = [[rng.randrange(-(2**top), 2**top) >> rng.randrange(top) for _ in range(6)] for _ in range(9)]
        a = np.array([[float(x) for x in r] for r in whole])
        exact = np.array([[int(x) for x in r] for r in a.tolist()], dtype=object)
        for made in (vector_codes.limbs(a, bits), vector_codes.int_limbs(exact, bits)):
            assert all(np.abs(x).max() < 2**bits for x in made)
            assert (sum(np.vectorize(int, otypes=[object])(x) << bits * j for j, x in enumerate(made)) == exact).all()
        b = vector_codes.int_limbs(exact[:4], bits)
        assert (vector_codes.gemm(vector_codes.limbs(a, bits), b, bits, True) == exact @ exact[:4].T).all()
        assert (vector_codes.squares(vector_codes.limbs(a, bits), bits, True) == (exact * exact).sum(axis=1)).all()


def test_products_of_64_bits_are_exact():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-(2**29), 2**29, (50, 4)), rng.integers(-(2**29), 2**29, (8, 4))
    bits = vector_codes.limb_bits(4)
    assert 4 * 2 ** (2 * bits) <= 2**53 and len(vector_codes.limbs(a.astype(float), bits)) == 2
    assert (vector_codes.gemm(vector_codes.limbs(a.astype(float), bits), vector_codes.int_limbs(b.astype(object), bits), bits) == a @ b.T).all()


def test_first_of_equally_near_entries():
    best, error = vector_codes.nearest(np.array([[1.0], [3.0]]), np.array([[2], [0], [2], [4]], dtype=object))
    assert best.tolist() == [0, 0] and error.tolist() == [1, 1]
