import math
import random
import re
from collections import Counter

import numpy as np

from dockett.llm import lexical

DOCS = "doc_id long, text string, score string, term string, n string"
ITEMS = "item_id long, text string, rank string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, k):
    counts = [(i, Counter(t)) for i, t in ((i, terms(t)) for i, t, *_ in docs) if t]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text, *_ in items:
        found = []
        for doc, c in counts:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -minus) for rank, (minus, _, _, doc) in enumerate(sorted(f for f in found if f[0] < 0)[:k], 1)]
    return sorted(out, key=str)


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdé") for _ in range(3)) for _ in range(60)] + ["The", "x9", "Ünder", "日本"]
    own = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "_", " "]) for _ in range(n))
    docs = [(i, own(rng.randrange(0, 40)), "x", "y", "z") for i in range(150)]
    docs += [(200, None, "x", "y", "z"), (201, "", "x", "y", "z"), (202, " -- !", "x", "y", "z"), (203, own(60_000), "x", "y", "z"), (None, own(30), "x", "y", "z"), (5, docs[5][1], "x", "y", "z")]
    docs += [(300 + i, docs[7][1], "x", "y", "z") for i in range(25)]
    items = [(i, own(rng.randrange(1, 12)), "r") for i in range(20)] + [(50, None, "r"), (51, "...", "r"), (None, "The the THE x9", "r"), (52, own(400), "r"), (53, docs[7][1], "r")]
    return items, docs


def test_against_brute_force(spark, monkeypatch):
    items, docs = corpus()
    asked, frame = spark.createDataFrame(items, ITEMS), spark.createDataFrame(docs, DOCS).repartition(3)
    want = brute(items, docs, 10)
    assert sorted(map(tuple, lexical.search(asked, frame, 10).collect()), key=str) == want
    # Many small indexes, slices of texts, hits and documents.
    for name, value in (("INDEX_TERMS", 30), ("AT_ONCE", 500), ("CELLS", 40), ("HITS", 50), ("MERGED", 3)):
        monkeypatch.setattr(lexical, name, value)
    assert sorted(map(tuple, lexical.search(asked, frame, 10).collect()), key=str) == want


def test_nothing_to_search(spark):
    items, docs = corpus()
    asked, frame = spark.createDataFrame(items, ITEMS), spark.createDataFrame(docs, DOCS)
    for a, b in ((asked.limit(0), frame), (asked, frame.limit(0)), (asked.filter("item_id = 50"), frame), (asked, frame.filter("doc_id in (200, 201, 202)"))):
        assert lexical.search(a, b, 3).count() == 0


def test_repeated_items_are_searched_once(spark):
    asked = spark.createDataFrame([(1, "b", "r"), (1, "a", "r"), (1, "a", "s")], ITEMS)
    frame = spark.createDataFrame([(1, "a", "", "", ""), (2, "b", "", "", ""), (3, "c", "", "", "")], DOCS)
    assert [(r.item_id, r.rank, r.doc_id) for r in lexical.search(asked, frame, 3).collect()] == [(1, 1, 1)]


def test_lengths_beyond_64_bits():
    sizes = np.array([10**9, 0, 5], dtype=np.int64)
    assert lexical.normal_lengths(sizes, 10**11, 10**13).tolist() == [25 + 75 * s * 10**11 // 10**13 for s in sizes.tolist()]


def test_heaps_keep_the_best():
    rng = np.random.default_rng(4)
    scores, ids = rng.integers(0, 9, (500, 3)), rng.permutation(500).tolist()
    heaps = lexical.Heaps(3, 7)
    for a in range(0, 500, 60):
        heaps.update(scores[a : a + 60], ids[a : a + 60])
    for item, heap in enumerate(heaps.heaps):
        assert sorted(heap, reverse=True) == sorted(((int(s), -i) for s, i in zip(scores[:, item], ids, strict=True) if s), reverse=True)[:7]
