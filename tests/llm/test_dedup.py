import hashlib
import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from dockett.llm import exact_dedup, simhash, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(texts, ids=None):
    return [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def prose(rng, n, words=("a", "b", "of", "the", "x1", "é", "long-word")):
    return " ".join(rng.choice(words) + (str(rng.randrange(40)) if rng.random() < 0.6 else "") for _ in range(n))


EDGE = [None, "", " \t\n", "One two", "One  two", "one two", "One\ttwo", " x", "x" * 70 + "1", "x" * 70 + "2", "x" * 70 + "1", "q " * 30_000]


def test_exact_groups(spark):
    ids = [5, 3, 9, 7, 1, 4, 8, None, 10, 12, 11, 2]
    data = rows(EDGE, ids) + rows(["hot copy"] * 300, range(100, 400)) + rows(["One two"], [7])
    got = exact_dedup.exact_groups(frame(spark, data)).collect()
    assert len(got) == len(data)
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = {hashlib.sha256(k.encode()).hexdigest(): (min((i for i in v if i is not None), default=None), len(v)) for k, v in groups.items()}
    for r in got:
        assert (r.keep_id, r.group_size) == want[r.text_sha256]
    kept = [(r.doc_id, r.text_sha256) for r in got if r.kept]
    assert sorted(kept, key=str) == sorted(((v[0], k) for k, v in want.items()), key=str)
    stays = exact_dedup.exact_dedup(frame(spark, data))
    assert stays.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id or -1 for r in stays.collect()) == sorted(i or -1 for i, _ in kept)


def test_exact_cut_groups(spark):
    data = rows(["same text"] * 4000 + ["other"] * 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_dedup.exact_groups(frame(spark, data).repartition(8)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.keep_id, r.group_size) for r in got} == {(0, 4000), (4000, 50)} and [r.doc_id for r in got if r.kept] in ([0, 4000], [4000, 0])


def test_empty_tables(spark):
    none = frame(spark, [])
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.exact_dedup(none).count() == 0
    assert simhash.near_groups(none).count() == 0
    assert substring_dedup.substring_dedup(none).count() == 0


def brute_windows(data, n):
    order = sorted({(2**63 - 1 if i is None else i, k) for i, t, *_ in data for k in range(len(WORD.findall(t or "")))})
    first = {}
    per = [(2**63 - 1 if i is None else i, WORD.findall(t or "")) for i, t, *_ in data]
    for i, w in sorted(per):
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), (i, k))
            first[tuple(w[k : k + n])] = min(first[tuple(w[k : k + n])], (i, k))
    out = []
    for i, w in per:
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] != (i, k) for j in range(k, k + n)}
        out.append((len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return out


def substring_fixture():
    rng = random.Random(5)
    passage, other = prose(rng, 60), prose(rng, 24)
    texts = [prose(rng, 100) for _ in range(30)]
    texts += [prose(rng, 10) + " " + passage + " " + prose(rng, 15) for _ in range(12)]
    texts += [other + "\n\t" + other + " " + prose(rng, 5), other, passage[:90], "w " * 50, "w " * 19, "w " * 20, None, "", texts[3], texts[3] + " tail"]
    texts += [" ".join([passage] * 3)]
    data = rows(texts)
    rng.shuffle(data)
    return data + [(None, texts[3], None, None, None), (7, texts[7], "en", "s", 1)]


def test_substring_levels(spark):
    data = substring_fixture()
    for start in (20, 10, 5):
        got = substring_dedup.substring_dedup(frame(spark, data).repartition(5), 20, start).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((d[0] or -1, *w) for d, w in zip(data, brute_windows(data, 20)))


def test_substring_cut_runs(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        data = rows([f"z{i % 3} " + " ".join(map(str, range(40))) for i in range(500)])
        got = substring_dedup.substring_dedup(frame(spark, data).repartition(6)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((d[0], *w) for d, w in zip(data, brute_windows(data, 20)))


def brute_fingerprint(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    spans = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, radius):
    root = list(range(len(fps)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    low = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return [low.get(find(i)) for i in range(len(fps))]


def test_near_groups(spark):
    rng = random.Random(9)
    texts = [prose(rng, 200) for _ in range(60)]
    for t in texts[:20]:
        words = t.split()
        words[rng.randrange(200)] = "changed"
        texts += [" ".join(words), t.upper(), t]
    texts += [None, "", "x", "X", "Ä x", " \n", "a b", "A b"]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    ids[3] = None
    data = rows(texts, ids) + rows(["a b"], [ids[0]])
    got = {}
    for r in simhash.near_groups(frame(spark, data)).collect():
        got.setdefault(r.doc_id, set()).add((r.fp % 2**64, r.component_id))
    fps = [brute_fingerprint(d[1], 3) for d in data]
    want = {}
    for d, f, c in zip(data, fps, brute_components(fps, [d[0] for d in data], 2)):
        want.setdefault(d[0], set()).add((f, c))
    assert got == want


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 3), st.integers(0, 4))
def test_tree_loses_no_pair(seed, radius, depth):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fps = np.unique(np.concatenate((base, near)))
    at, shard = simhash.route(fps, *simhash.grow(fps, depth, radius), radius)
    met = {}
    for a, s in zip(at, shard):
        met.setdefault(int(s), set()).add(int(a))
    close = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    for i, j in np.argwhere(np.triu(close, 1)):
        assert any(i in m and j in m for m in met.values())


def test_stars_divide_large_shards(monkeypatch):
    monkeypatch.setattr(simhash, "LOCAL", 3000)
    rng = np.random.default_rng(1)
    fps = np.unique(np.concatenate((rng.integers(0, 2**63, 6000, dtype=np.uint64), np.arange(1500, dtype=np.uint64))))
    whole = {}
    for members, centre in simhash.stars(fps, 2):
        for m in members:
            whole.setdefault(int(m), set()).add(int(centre))
    monkeypatch.setattr(simhash, "LOCAL", 10**9)
    assert set(whole) == {int(m) for members, _ in simhash.stars(fps, 2) for m in members}


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 500)], "u long, v long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 501: 500}
