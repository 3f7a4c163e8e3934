import math
import random
import zlib

import numpy as np

from dockett.llm import language
from dockett.llm.common import public_tokenizer
from dockett.llm.piece_sampling import SPACE, pieces

MODEL = public_tokenizer("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, score string, name string, word string"
SYLLABLES = {"en": ["the", "ing", "er", "and", "ou", "sh", "th"], "es": ["ción", "os", "que", "ll", "ñ", "rr", "la"], "de": ["ung", "sch", "ich", "ö", "ver", "keit", "tz"]}


def corpus(n=450):
    rng = random.Random(3)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4)))
    docs = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        docs.append((i, " ".join(word(lang) for _ in range(rng.randrange(6, 60))).capitalize() + ".", lang, "x", "y", "z"))
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, SCHEMA).repartition(3)


def test_held_out_accuracy(spark):
    docs = corpus()
    extra = [(1000, None, "en", "x", "y", "z"), (1001, "", "en", "x", "y", "z"), (1002, "12 -- 7!", "es", "x", "y", "z"), (None, "la llción que los rrción", None, "x", "y", "z"), (5, docs[5][1], docs[5][2], "x", "y", "z")]
    extra += [(1003, "schungkeit " * 20_000, None, "x", "y", "z"), (1004, "ungich" * 30_000, None, "x", "y", "z"), (1005, "日本語", "en", "x", "y", "z")]
    got = language.languages(frame(spark, docs + extra), MODEL).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {d[0]: d[2] for d in docs}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1000, 1001, 1002))
    assert by[None].lang_pred == "es" and by[1003].lang_pred == by[1004].lang_pred == "de" and by[1005].lang_pred in truth.values() and not by[None].held_out


def test_held_out_languages_do_not_matter(spark):
    docs = corpus(150)
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang, *more) for i, t, lang, *more in docs]
    a, b = (sorted(map(tuple, language.languages(frame(spark, d), MODEL).collect())) for d in (docs, wrong))
    assert a == b and all(r[2] != "xx" for r in a)


def test_reruns_and_partitions_agree(spark):
    docs = corpus(100)
    runs = [sorted(map(tuple, language.languages(spark.createDataFrame(docs, SCHEMA).repartition(n), MODEL).collect())) for n in (1, 4)]
    assert runs[0] == runs[1]


def test_nothing_to_learn_from(spark):
    docs = [(i, "some text", None, "x", "y", "z") for i in range(9)]
    got = language.languages(frame(spark, docs), MODEL).collect()
    assert len(got) == 9 and all(r.lang_pred == "und" and r.score == 0 for r in got)
    assert language.languages(frame(spark, docs).limit(0), MODEL).count() == 0


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    try:
        language.learn(frame(spark, corpus(60)), MODEL)
    except ValueError as e:
        assert "languages" in str(e)
    else:
        raise AssertionError


def ways(model, word, logs):
    """All segmentations of a word by recursion: chance of each in each language, and how often it uses each piece."""
    text, index = SPACE + word, {t: i for i, t in enumerate(model.texts)}

    def cut(at):
        if at == len(text):
            yield []
            return
        for to in range(at + 1, len(text) + 1):
            i = index.get(text[at:to])
            if i is not None and np.isfinite(model.weights[i]) and model.bytes[i].decode("utf-8", "replace") == text[at:to]:
                own = [i]
            elif to == at + 1 and not any(text[at:to] == model.texts[j] and np.isfinite(model.weights[j]) for j in [index.get(text[at:to], -1)] if j >= 0):
                own = [int(b) for b in model.byte_ids[list(text[at:to].encode())]]
            else:
                continue
            for rest in cut(to):
                yield own + rest

    return list(cut(0))


def test_all_segmentations_are_summed():
    model = pieces(MODEL)
    usable = np.isfinite(model.weights[:-1])
    usable[model.byte_ids] = True
    rng = np.random.default_rng(2)
    logs = language._smoothed(rng.random((len(usable), 3)) * 5, usable)
    given = ["the", "lesson", "ción", "a", "日x", "zzzz"]
    got = language.likelihoods(model, given, logs)
    for w, row in zip(given, got, strict=True):
        found = ways(model, w, logs)
        want = np.log(sum(np.exp(logs[s].sum(axis=0)) for s in found))
        assert len(found) >= 1 and np.allclose(row, want)


def test_expected_counts_are_those_of_all_segmentations():
    import pyarrow as pa

    model = pieces(MODEL)
    usable = np.isfinite(model.weights[:-1])
    usable[model.byte_ids] = True
    logs = language._smoothed(np.random.default_rng(3).random((len(usable), 2)) * 5, usable)
    given = [(0, "lesson", 3), (1, "lesson", 2), (1, "日x", 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([g[0] for g in given], pa.int32()), pa.array([g[1] for g in given]), pa.array([g[2] for g in given], pa.int64())], names=["lang", "word", "n"])
    (out,) = language._expected(iter([batch]), MODEL, logs)
    got = {(r["lang"], r["piece"]): r["n"] / language.UNIT for r in out.to_pylist()}
    want: dict = {}
    for lang, w, n in given:
        found = ways(model, w, logs)
        chance = np.exp([logs[s, lang].sum() for s in found])
        for s, c in zip(found, chance / chance.sum(), strict=True):
            for piece in s:
                want[lang, piece] = want.get((lang, piece), 0) + n * c
    assert all(math.isclose(got.get(k, 0), v, abs_tol=0.01) for k, v in want.items()) and set(got) <= set(want)


def test_long_words_fall_into_several():
    assert [len(w) for w in language.words("a" * 150 + " b")] == [64, 64, 22, 1]
    assert language.words("L'Été 2x हिन्दी") == ["l", "été", "x", "हिन्दी"]
