import random
import zlib

from dockett.llm import toxicity

SCHEMA = "doc_id long, text string, label string, toxic string"


def corpus():
    rng = random.Random(4)
    common = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    docs, labels = [], []
    for i in range(1500):
        words = [rng.choice(common) for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.15
        for _ in range(rng.randrange(1, 4) * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["grumpf", "Zonker", "Gr\u00fcmlix", "z0nker", "zonk\u0435r"]))
        if rng.random() < 0.1:
            words += ["cereal", "grumpf", "brand"]
        docs.append((i, " ".join(words), "x", "y"))
        if i % 10 < 8:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    truth = {i: t for i, _, t in labels}
    extra = [(5000, None, "a", "b"), (5001, "", "a", "b"), (None, "grumpf " * 5, "a", "b"), (3, docs[3][1], "x", "y"), (5002, "plain " * 40_000, "a", "b")]
    frame = spark.createDataFrame(docs + extra, SCHEMA)
    known = spark.createDataFrame(labels + [(7, 1, None), (None, 1, 1), (8, 1, 7)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(frame, known).collect()
    assert len(got) == len(docs) + len(extra)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[5000].predicted == by[5001].predicted == by[5002].predicted == 0 and by[None].predicted == 1


def test_labels_of_one_kind_or_none(spark):
    frame = spark.createDataFrame([(i, "some text", "x", "y") for i in range(20)], SCHEMA)
    for labels in ([], [(i, 1, 0) for i in range(20)]):
        got = toxicity.toxicity(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(got) == 20 and not any(r.predicted for r in got)
    assert toxicity.toxicity(frame.limit(0), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).count() == 0


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, SCHEMA)
    out = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5]
    wrong = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    kind = "doc_id long, quality int, toxic int"
    assert toxicity.learn(frame, spark.createDataFrame(out, kind)) == toxicity.learn(frame, spark.createDataFrame(wrong, kind))


def test_folding_and_phrases():
    lexicon = toxicity.Lexicon({"idiot": 2.0}, frozenset({"useful idiot"}))
    auto = lexicon.automaton()
    weigh = lambda t: toxicity.weigh(toxicity.folded(t), lexicon, auto)
    assert weigh("1d10t!") == 2 and weigh("\u0406D\u0406OT and Idiots") == 4 and weigh("a useful idiot") == 0 and weigh("preidiot") == 0 and weigh("") == 0


def naive_hits(text, terms):
    """Terms at the beginnings of words, whole short words, the longest of each word, with their neighbours."""
    runs, at = [], 0
    while at < len(text):
        if text[at].isalpha():
            end = at
            while end < len(text) and text[end].isalpha():
                end += 1
            runs.append((at, end))
            at = end
        else:
            at += 1
    found = []
    for n, (a, b) in enumerate(runs):
        word = text[a:b]
        fits = [t for t in terms if (word == t[:-1] if t.endswith("$") else word.startswith(t))]
        if fits:
            before = text[runs[n - 1][0] : runs[n - 1][1]] if n else ""
            after = text[runs[n + 1][0] : runs[n + 1][1]] if n + 1 < len(runs) else ""
            found.append((max(fits, key=len), before, word, after))
    return found


def test_matching_and_weights_against_a_naive_scan():
    rng = random.Random(9)
    terms = {"idio": 1.0, "idiot": 2.5, "moro": 1.5, "ab$": 3.0, "xyz$": 0.5, "zonk": 1.25}
    lexicon = toxicity.Lexicon(terms, frozenset({"dear idiot", "moron now"}))
    auto = lexicon.automaton()
    words = ["idiot", "idiotic", "idio", "moron", "ab", "abc", "xab", "xyz", "xyzz", "dear", "now", "zonker", "preidiot", "7", "x9ab"]
    for _ in range(500):
        text = toxicity.folded("".join(rng.choice(words) + rng.choice([" ", ", ", "-", "\n", ". "]) for _ in range(rng.randrange(8))))
        want = naive_hits(text, terms)
        assert sorted(toxicity.hits(text, auto)) == sorted(want)
        kept = [t for t, b, w, a in want if f"{b} {w}" not in lexicon.exceptions and f"{w} {a}" not in lexicon.exceptions]
        assert abs(toxicity.weigh(text, lexicon, auto) - sum(terms[t] for t in kept)) < 1e-9


def test_folding_of_disguises():
    fold = toxicity.folded
    same = ["moron", "MORON", "mоrоn", "ｍｏｒｏｎ", "\U0001d426\U0001d428\U0001d42b\U0001d428\U0001d427", "mórön", "m0r0n", "mo​ron", "m.o.r.o.n", "m-o-r-o-n", "m o r o n"]
    assert {fold(t) for t in same} == {"moron"}
    assert fold("id!ot |diot") == "idiot |diot" and fold("$illy @pe") == "silly ape" and fold("stop!") == "stop!" and fold("") == ""
    assert fold("u.s. a b c") == "u.s. a b c"


def test_short_words_are_learned_whole(spark):
    rng = random.Random(1)
    words = [f"word{chr(97 + i)}" for i in range(20)] + ["zaps", "gaz"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(20)) + (" zap" if i % 4 == 0 else ""), "x", "y") for i in range(400)]
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    lexicon = toxicity.learn(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert list(lexicon.weights) == ["zap$"]


def test_score_is_the_logistic_of_weight_and_length(spark):
    import math

    lexicon = toxicity.Lexicon({"moro": 2.0, "ab$": 1.0}, frozenset({"no moron"}), (-3.0, 2.0, 1.5))
    texts = ["moron", "no moron", "ab moron " * 3, "x " * 4000 + "moron", "", None]
    got = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), lexicon).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        text = toxicity.folded(t or "")
        w = sum(lexicon.weights[h[0]] for h in naive_hits(text, lexicon.weights) if f"{h[1]} {h[2]}" not in lexicon.exceptions)
        z = -3.0 + 2.0 * math.log1p(w) + 1.5 * math.log1p(w / max(len(text) / 1000, 1))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9
