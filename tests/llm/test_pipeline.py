import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from dockett.llm import mixing, near_forest, piece_sampling, toxicity
from dockett.llm.common import public_tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def vocabulary(rng):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(3000)]


def edited(rng, text, n):
    words = text.split()
    for i in rng.sample(range(len(words)), n):
        words[i] = "edited" + str(rng.randrange(1000))
    return " ".join(words)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rng = random.Random(8)
    words = vocabulary(rng)
    docs = []
    for i in range(260):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(80, 300)))
        if rng.random() < 0.2:
            t += " vilebrute vilebrute"
        docs.append(t)
    near = [edited(rng, t, len(t.split()) // 100 + 1) for t in docs[:60]]
    return docs + near + docs[20:50] + [None, "", " ", "one two", "one two", "two one three"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts = corpus()
    data = [(i, t, "en", ["a", "b", "c", None][i % 4] if i % 3 else "a", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int("vilebrute" in (t or ""))) for i, t in enumerate(texts) if i % 5 < 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, data


def test_stages_against_brute_force(spark, sf_dir):
    path, data = sf_dir
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    clean = stages["toxicity"](spark, docs, path).cache()
    assert clean.columns == columns
    assert {r.doc_id for r in clean.collect()} == {d[0] for d in data if "vilebrute" not in (d[1] or "")}

    unique = stages["exact_dedup"](spark, clean, path).cache()
    first = {}
    for r in clean.collect():
        key = " ".join((r.text or "").split(" "))
        first[key] = min(first.get(key, r.doc_id), r.doc_id)
    assert unique.columns == columns and sorted(r.doc_id for r in unique.collect()) == sorted(first.values())

    apart = stages["near_dedup"](spark, unique, path).cache()
    rows = sorted((r.doc_id, shingles(r.text or "")) for r in unique.collect())
    root = {i: i for i, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if jaccard(a, b) >= 0.8:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {i for i in root if find(i) == i}
    got = {r.doc_id for r in apart.collect()}
    assert apart.columns == columns and len(got ^ want) <= 0.02 * len(want) + 1 and want - got == set() or len(want - got) <= 1

    mixed = stages["mixing"](spark, apart, path)
    assert mixed.columns == columns
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {r.doc_id: r.copies for r in mixing.mix(apart).collect() if r.copies}

    pieces = stages["pieces"](spark, mixed, path).collect()
    model = piece_sampling.pieces(public_tokenizer("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in apart.collect()}
    assert all(model.decode(r.pieces).decode() == (texts[r.doc_id] or "") for r in pieces)
    whole = corpus_pipeline.run(spark, path)
    assert sorted(map(str, whole.drop("pieces").collect())) == sorted(str(r.asDict() and type(r)(**{k: v for k, v in r.asDict().items() if k != "pieces"})) for r in pieces)


def test_empty_stages(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir[0])
        assert out.count() == 0


def test_recall_of_the_forest(spark):
    """Pairs at every similarity of 0.8 and more in a corpus deep enough for many shards."""
    rng = random.Random(6)
    words = vocabulary(rng)
    texts = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(1500)]
    pairs = [(i, len(texts) + i) for i in range(400)]
    texts += [edited(rng, texts[i], 1 + i % 3) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    before = near_forest.SHARD
    near_forest.SHARD = 32
    try:
        got = {r.did: r.component_id for r in near_forest.near_duplicates(docs).collect()}
    finally:
        near_forest.SHARD = before
    close = [(i, j) for i, j in pairs if jaccard(shingles(texts[i]), shingles(texts[j])) >= 0.8]
    assert len(close) > 250 and sum(got[j] == i for i, j in close) / len(close) > 0.95
    assert all(got[i] == i for i in range(400, 1500))


def test_links_are_checked(spark):
    """Pairs of less than the similarity stay apart, also with one passage repeated; chains of similar texts hold."""
    rng = random.Random(7)
    words = vocabulary(rng)
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    texts, below, chained = [], [], []
    for i in range(300):
        base = draw(150)
        other = base[:]
        for at in rng.sample(range(5, 145), 3 + i % 5):
            other[at] = "edited" + str(at)
        below.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(other)]
    passage = " ".join(draw(10) * 60)
    for _ in range(3):
        texts.append(" ".join(draw(300)) + " " + passage)
    for _ in range(5):
        base, at = draw(150), len(texts)
        for step in range(6):
            base = [*base[:-7], *draw(7)]
            texts.append(" ".join([*draw(7), *base[:-7]] if step % 2 else base))
        chained.append(range(at, at + 6))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.did: r.component_id for r in near_forest.near_duplicates(docs).collect()}
    sets = [shingles(t) for t in texts]
    apart = [(i, j) for i, j in below if jaccard(sets[i], sets[j]) < 0.8]
    assert len(apart) > 150 and all(got[i] != got[j] for i, j in apart)
    assert all(got[i] == i for i in range(600, 603))
    for group in chained:
        root = {i: i for i in group}
        for i in group:
            for j in range(group[0], i):
                if jaccard(sets[i], sets[j]) >= 0.8:
                    a, b = sorted((root[i], root[j]))
                    root = {k: a if r == b else r for k, r in root.items()}
        assert {i: got[i] for i in group} == root


def bands(spark, shared):
    """(caught, pairs) in the bands 0.80 to 0.82 and 0.82 to 0.85, of planted pairs among other texts in many shards;
    shared texts hold a passage that many others hold too."""
    rng = random.Random(9)
    words = vocabulary(rng)
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [draw(30) for _ in range(4)]
    texts, pairs = [" ".join(draw(150)) for _ in range(600)], []
    while len(pairs) < 1000:
        base = draw(rng.choice([60, 150, 300])) + (rng.choice(passages) if shared else [])
        n, other = len(base), base[:]
        cut = round((n - 4) * rng.uniform(0.08, 0.115))
        # One run of new words replaces cut + 4 shingles at most; runs at the ends fewer.
        other[-cut:] = ["new" + str(rng.randrange(10**6)) for _ in range(cut)]
        rng.random() < 0.5 and (base.reverse(), other.reverse())
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(base), " ".join(other)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    before, near_forest.SHARD = near_forest.SHARD, 32
    try:
        got = {r.did: r.component_id for r in near_forest.near_duplicates(docs).collect()}
    finally:
        near_forest.SHARD = before
    found = {(0.8, 0.82): [], (0.82, 0.85): []}
    for i, j in pairs:
        share = jaccard(shingles(texts[i]), shingles(texts[j]))
        assert share >= 0.8 or got[i] != got[j]
        for low, high in found:
            if low <= share < high:
                found[low, high].append(got[i] == got[j])
    return [(sum(x), len(x)) for x in found.values()]


@pytest.mark.parametrize("shared", [False, True])
def test_recall_at_the_threshold(spark, shared):
    found = bands(spark, shared)
    print(found)
    assert all(n > 150 and caught / n > 0.98 for caught, n in found)


@pytest.mark.parametrize("widths", [[16], [64], [256], [16, 8]])
def test_pairs_meet_as_often_as_assumed(widths):
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 2**64, (6000, near_forest.WORDS), dtype=np.uint64)
    bits = np.unpackbits(fps[:2000].view(np.uint8), axis=1)
    for row in bits:
        row[rng.choice(near_forest.BITS, near_forest.NEAR, replace=False)] ^= 1
    other, tree = np.packbits(bits, axis=1).view(np.uint64), near_forest.grow(fps, widths, 1)
    own = set(zip(*map(list, near_forest.route(fps[:2000], tree, near_forest.MARGIN)), strict=True))
    at, shard = near_forest.route(other, tree, near_forest.MARGIN)
    met = len({i for i, s in zip(at, shard, strict=True) if (i, s) in own}) / 2000
    assert met > np.prod([near_forest.MEET * n**-near_forest.FADE for n in widths]) - 0.03


def test_rejected_rows_are_those_predicted(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir[0]}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    assert out and out == {d[0] for d in sf_dir[1]} - {r.doc_id for r in toxicity.without_toxic(docs, labels).collect()}


def test_families_of_nearly_similar_texts_are_not_paired(spark, monkeypatch):
    """Rows handed over grow with a family, not with its square; links inside it are those of brute force."""
    rng = random.Random(12)
    words = vocabulary(rng)
    base = [rng.choice(words) for _ in range(70)]
    texts = []
    for i in range(160):
        words = base[:]
        for at in rng.sample(range(70), 1 if i % 8 == 0 else 2):
            words[at] = f"edited{i}x{at}"
        texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows, keep = {}, near_forest.materialize

    def counted(df, name):
        out = keep(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(near_forest, "materialize", counted)
    got = {r.did: r.component_id for r in near_forest.near_duplicates(docs).collect()}
    sets, root = [shingles(t) for t in texts], {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if r == b else r for k, r in root.items()}
    assert got == root and 1 < len(set(root.values())) < len(texts)
    assert rows["parted-pairs"] <= 4 * len(texts) and rows["near-links"] <= 4 * len(texts)


def test_tiles_and_their_links():
    rng = np.random.default_rng(3)
    sizes = np.concatenate((rng.integers(1, 400, 1100), [near_forest.TILE_SHINGLES * 2], rng.integers(1, 400, 300)))
    met = np.zeros((len(sizes),) * 2, dtype=int)
    for _, places, sides in near_forest.tiles(sizes):
        assert len(places) <= 2 * near_forest.TILE
        pairs = (sides[:, None] != sides) if sides.any() else ~np.eye(len(places), dtype=bool)
        met[np.ix_(places, places)] += pairs
    assert (met == 1 - np.eye(len(sizes), dtype=int)).all()
    sets = [np.unique(rng.integers(0, 9000, n)).astype(np.uint64) for n in rng.integers(0, 6000, 30)]
    common = near_forest.common_counts(sets)
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)
    held = np.triu(rng.random((60, 60)) < 0.02, 1)
    held |= held.T
    one, other = near_forest.forest(held)

    def reach(links):
        root = list(range(60))
        for a, b in links:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        return root

    assert held[one, other].all() and reach(zip(one, other, strict=True)) == reach(zip(*np.nonzero(held), strict=True)) and len(one) == 60 - len(set(reach(zip(one, other, strict=True))))
