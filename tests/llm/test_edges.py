"""Each operator and stage on one awkward table: clashing and dotted column names, null and repeated ids, repeated rows,
null, empty and very long texts, and no rows at all."""

import json
import random
from collections import Counter

import numpy as np
import pytest

from dockett.llm import common, edit_counts, exact_dedup, language, lexical, mixing, near_forest, piece_sampling, simhash, sstable, substring_dedup, topk, toxicity, url_filter, vector_codes
from dockett.llm.common import public_tokenizer

CLASH = ["norm", "did", "th", "fp", "key", "score", "__row", "__key", "__id", "copies", "taken", "term", "h", "pos", "size", "toxic", "rid", "low", "node", "root", "by", "a.b"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)
KINDS = "doc_id long, quality int, toxic int"


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    own = lambda n: " ".join(rng.choice(words) for _ in range(n))
    unrelated = [own(40) for _ in range(6)]
    return [
        *zip([None, None, None, 7, 7, 8], unrelated, strict=True), (1, unrelated[0]), (2, None), (3, ""), (4, " \t\n"), (5, own(30_000)), (6, "short"), (6, "short"), (9, own(40)),
        (-4, unrelated[5]), (None, None), (2**62, own(40)),
    ]


@pytest.fixture(scope="module")
def rows():
    return [(i, t, "en", ["a", None, "b"][n % 3], n, *[f"{c}{n}" for c in CLASH]) for n, (i, t) in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (8, 1, 0), (9, 1, 0), (7, 1, 0), (None, 1, 1)], KINDS)


def entries(docs, labels):
    spark, pieces, bpe = docs.sparkSession, public_tokenizer("piece_bpe_32k.model"), public_tokenizer("word_bpe_49k.json")
    import public_tokenizers

    ranks = public_tokenizer("byte_bpe_50k.tiktoken")
    return {
        "mix": lambda: mixing.mix(docs), "exact_groups": lambda: exact_dedup.exact_groups(docs), "shards": lambda: sstable.read_table(sstable.write_table(docs, bpe)),
        "toxicity": lambda: toxicity.toxicity(docs, labels), "edits": lambda: edit_counts.edit_aware_counts(docs, edit_counts.scripted_edits(docs), ranks, public_tokenizers.PATTERN),
        "pieces": lambda: piece_sampling.sampled_pieces(docs, pieces, k=1), "windows": lambda: substring_dedup.substring_dedup(docs), "simhash": lambda: simhash.near_groups(docs),
        "near": lambda: near_forest.near_duplicates(docs), "urls": lambda: url_filter.url_filter(docs.withColumnsRenamed({"doc_id": "page_id", "text": "url"})),
        "languages": lambda: language.languages(docs, pieces),
    }


def stages(docs, labels):
    return {"toxic": lambda: toxicity.without_toxic(docs, labels), "exact": lambda: exact_dedup.exact_dedup(docs), "near": lambda: near_forest.near_dedup(docs), "mixed": lambda: mixing.mixed(docs)}


def test_every_row_comes_back_once(docs, rows, labels):
    ids = Counter(r[0] for r in rows)
    for name, run in entries(docs, labels).items():
        got = Counter(r[0] for r in run().collect())
        if name == "near":
            got = Counter({None if i == common.NULL_LAST else i: n for i, n in got.items()})
        assert got == ids, name


def test_stages_keep_columns_as_they_were(docs, rows, labels):
    every = Counter(rows)
    for name, run in stages(docs, labels).items():
        out = run()
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        got = Counter(map(tuple, out.collect()))
        assert set(got) <= set(every) and (name == "mixed" or all(n == 1 for n in got.values())), name


def test_dedup_keeps_unrelated_rows_of_equal_and_null_ids(docs, rows, labels):
    """Of the rows, only copies go: the row of id 1 repeats one without an id, that of 8 repeats that of -4, and the
    repeated and the wordless rows are one each."""
    for run in (stages(docs, labels)["exact"], stages(docs, labels)["near"]):
        got = Counter((r.doc_id, r.text) for r in run().collect())
        unrelated = [r[:2] for r in rows[:6]]
        wanted = Counter([(1, unrelated[0][1]), *unrelated[1:5], (-4, unrelated[5][1]), *[r[:2] for r in rows if r[0] in (5, 9, 2**62)], (6, "short")])
        wordless = [k for k in got if not (k[1] or "").split()]
        assert Counter({k: n for k, n in got.items() if k not in wordless}) == wanted
        assert 2 in [k[0] for k in wordless] and len(wordless) <= 2


def test_empty_tables(spark, docs, labels):
    none = docs.limit(0)
    for name, run in {**entries(none, labels), **stages(none, labels.limit(0))}.items():
        assert run().count() == 0, name


def test_rows_that_repeat_id_and_text_are_chosen_alike(spark):
    made = lambda n: spark.createDataFrame([(1, "one two three four five six", "x", s, 1) for s in "bca"], "doc_id long, text string, lang string, source string, n_chars long").repartition(n, "source")
    for stage in (exact_dedup.exact_dedup, near_forest.near_dedup):
        assert len({json.dumps(stage(made(n)).collect()) for n in (1, 2, 3)}) == 1


def test_words_that_a_power_sum_confuses(spark):
    """Words of two letters in the order in which sums of powers modulo 2**64 agree, and the same with letters swapped."""
    def word(i, flip):
        return "".join("ab"[(bin(n).count("1") + flip) % 2] for n in range(1024)) + str(i)

    data = [(d, " ".join(word(i, d) for i in range(20))) for d in (0, 1)] + [(2, " ".join(word(i, 0) for i in range(20)))]
    got = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 20}


def test_shards_are_read_by_several_tasks(spark, docs):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        manifest = sstable.write_table(docs, public_tokenizer("word_bpe_49k.json"))
    finally:
        spark.conf.unset(key)
    assert manifest.count() > 1 and sstable.read_table(manifest).rdd.getNumPartitions() == manifest.count()
    assert sstable.read_table(manifest).filter("n_tokens > 0").count() == docs.count()


def test_heavy_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "PART_ROWS", 10)
    rows = spark.range(600).selectExpr("id", "if(id % 3 = 0, 0, id) as k")
    one = spark.range(600).selectExpr("id as k", "id * 2 as twice")
    got = common.dealt_join(rows, one, ["k"])
    assert sorted((r.id, r.twice) for r in got.collect()) == [(i, 0 if i % 3 == 0 else 2 * i) for i in range(600)]
    # A join that is not written: dealt by its own columns, so the parts do not follow from the order of rows.
    again = common.dealt_join(rows.repartition(5).join(one, "k"), one.withColumnRenamed("twice", "more"), ["k"], by=["id"], counted=rows)
    assert sorted((r.id, r.more) for r in again.collect()) == [(i, 0 if i % 3 == 0 else 2 * i) for i in range(600)]
    assert "monotonically_increasing_id" not in again._jdf.queryExecution().toString()


def test_repeated_queries_and_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-50, 50, (300, 8)).astype(float)
    data = [(int(i), v.tolist()) for i, v in enumerate(base)] + [(50, [9.0] * 8), (50, [-9.0] * 8)] + [(7, base[7].tolist())] * 40
    vectors = spark.createDataFrame(data, "vec_id long, v array<double>")
    got = topk.exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), 4).collect()
    for q in {d[0] for d in data if d[0] % 50 == 0}:
        asked = min(v for i, v in data if i == q)
        best = sorted(((-int(np.dot(asked, v)), i) for i, v in data if i != q))[:4]
        assert [(r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(-s, i) for s, i in best]


def test_trees_of_lists_and_groups(spark, monkeypatch):
    for name, value in (("TILE_ROWS", 10), ("GROUP", 2), ("FAN", 3), ("QUERY_ROWS", 4), ("BLOCK_ROWS", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    data = [(i, rng.integers(-9, 9, 4).astype(float).tolist()) for i in range(400)]
    vectors = spark.createDataFrame(data, "vec_id long, v array<double>")
    got = {(r.query_id, r.rank): (r.score, r.vec_id) for r in topk.exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), 3).collect()}
    for q in range(0, 400, 50):
        best = sorted((-int(np.dot(data[q][1], v)), i) for i, v in data if i != q)[:3]
        assert [got[q, n + 1] for n in range(3)] == [(-s, i) for s, i in best]


def test_a_long_list_of_rules_agrees_with_a_short_filter(spark, monkeypatch):
    rng = random.Random(6)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net"]
    pages = [(rng.choice([None, 1, n]), rng.choice([None, "no url", f"http://{rng.choice(hosts)}/{rng.choice(['', 'en/', 'en/x', 'de/y'])}"])) for n in range(300)]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    rules = spark.createDataFrame([("a.com", "/en/", "block"), ("com", "/", "allow"), ("x.net", "/de/", "block")], "host string, path string, verdict string")
    short = Counter(map(tuple, url_filter.judge(frame, rules).collect()))
    monkeypatch.setattr(url_filter, "LITERAL_BLOCKS", 1)
    assert Counter(map(tuple, url_filter.judge(frame, rules).collect())) == short and sum(short.values()) == 300


def test_local_levels_of_the_forest():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**64, (6000, near_forest.WORDS), dtype=np.uint64)
    parts = list(near_forest.divided(fps, [8, 4], 1))
    assert 8 <= len(parts) <= 32 and set(np.concatenate(parts).tolist()) == set(range(6000)) and max(map(len, parts)) < 3000
    assert [len(p) for p in near_forest.divided(fps, [], 1)] == [6000]
    assert near_forest.widths_of(0) == near_forest.widths_of(near_forest.SHARD) == [] and near_forest.trees_for([]) == 1
    assert near_forest.widths_of(near_forest.SHARD * 300) == [256, 2] and near_forest.widths_of(near_forest.SHARD << 24) == [256, 256, 256]


VECTOR_CLASH = ["v", "copy", "copies", "tile", "query", "group", "path", "embedding_", "part", "entry", "place", "limb", "total", "code", "error", "__label", "__null", "a.b"]


def test_vectors_beside_clashing_columns(spark):
    rng = np.random.default_rng(8)
    data = [(i, rng.normal(size=16).tolist(), 1) for i in range(60)]
    bare = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    clash = spark.createDataFrame([(*d, *["x"] * len(VECTOR_CLASH)) for d in data], "vec_id long, embedding array<double>, label int, " + ", ".join(f"`{c}` string" for c in VECTOR_CLASH))
    best = lambda t: sorted(map(tuple, topk.exact_top_k(topk.integers(t), topk.integers(t).filter("vec_id % 50 = 0"), 3).collect()))
    codes = lambda t: sorted(map(tuple, vector_codes.compressed(t).collect()))
    assert best(bare) == best(clash) and codes(bare) == codes(clash)


def test_search_beside_clashing_columns(docs):
    bare = docs.select("doc_id", "text")
    found = lambda t: sorted(map(tuple, lexical.search(t.filter("doc_id in (1, 5, 9)").withColumnRenamed("doc_id", "item_id"), t, 4).collect()), key=str)
    assert found(docs) == found(bare) and len(found(bare)) == 12


def test_many_rows_without_an_id_or_alike(spark):
    """A third of all rows is one text without an id: they are spread over buckets, and each takes its part."""
    rows = [(None, "a b c", "s")] * 400 + [(n, "w " * (n % 7), "st"[n % 2]) for n in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 1200 and sum(r.doc_id is None for r in got) == 400
    for source in "st":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and all(r.taken <= 3 * r.size for r in own)
    sizes = spark.createDataFrame([(None, "s", 3, 5)] * 400, "doc_id long, source string, size long, digest long")
    begins = [r.begin for r in mixing.placed(sizes, spark.createDataFrame([("s", 1)], "source string, more int")).collect()]
    assert sorted(begins) == [3 * n for n in range(400)]
    assert sum(r.copies for r in got) == mixing.mixed(docs).count()


def test_edits_of_the_last_id_leave_rows_without_id_alone(spark):
    import public_tokenizers

    last = 2**63 - 1
    docs = spark.createDataFrame([(None, "one two")] * 50 + [(last, "one two"), (1, "one two")], "doc_id long, text string")
    edits = spark.createDataFrame([(last, 0, 0, 0, "more "), (None, 0, 0, 0, "none ")], "doc_id long, seq long, start long, stop long, new string")
    ranks = public_tokenizer("byte_bpe_50k.tiktoken")
    got = [(r.doc_id, r.n_edits, r.n_chars) for r in edit_counts.edit_aware_counts(docs, edits, ranks, public_tokenizers.PATTERN).collect()]
    assert sorted(got, key=str) == sorted([(None, 0, 7)] * 50 + [(last, 1, 12), (1, 0, 7)], key=str)


def test_long_url_list_with_keys_that_many_pages_share(spark, monkeypatch):
    rules = spark.createDataFrame([("com", "/", "block"), ("a.com", "/x/", "allow"), ("net", "/", "block"), *[(f"h{n}.org", "/", "block") for n in range(300)]], "host string, path string, verdict string")
    urls = [f"http://p{n}.com/{'x/' * (n % 3)}{n}" for n in range(300)] + [f"http://a.com/x/{n}" for n in range(100)] + ["http://h7.org/y", "none", None, "http://elsewhere.de/"]
    pages = spark.createDataFrame([(None if n % 9 == 0 else n, u) for n, u in enumerate(urls)], "page_id long, url string")
    short = sorted(map(str, url_filter.judge(pages, rules).collect()))
    monkeypatch.setattr(url_filter, "LITERAL_BLOCKS", 0)
    monkeypatch.setattr(common, "PART_ROWS", 20)
    assert sorted(map(str, url_filter.judge(pages, rules).collect())) == short
