import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dockett.llm import edit_counts, piece_sampling, queries
from dockett.llm.common import mix, public_tokenizer

RANKS, PATTERN = public_tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
MODEL = public_tokenizer("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, tokens string, n_tokens string"
PROSE = "It's the ship's log, day 12: we don't sail  until 3.5 hours\npast noon. Über Straße, señor! "


def count(text):
    return len(edit_counts.encoding(RANKS, PATTERN).encode_ordinary(text))


@settings(max_examples=60, deadline=None)
@given(st.text("ab é'st1 .\n ½漢", max_size=400), st.lists(st.tuples(st.integers(-3, 500), st.integers(0, 60), st.text("ab 's1\n", max_size=90)), max_size=6))
def test_tree_follows_edits(text, edits):
    before = edit_counts.SEGMENT
    edit_counts.SEGMENT = 8
    try:
        tree = edit_counts.SegmentTree(edit_counts.encoding(RANKS, PATTERN), text)
        for at, n, new in edits:
            tree.edit(at, at + n, new)
            a = min(max(at, 0), len(text))
            text = text[:a] + new + text[min(max(at + n, a), len(text)) :]
            assert tree.text() == text and tree.tokens == count(text) and tree.chars == len(text)
    finally:
        edit_counts.SEGMENT = before


def test_edits_on_spark(spark):
    rng = random.Random(3)
    texts = [PROSE * rng.randrange(1, 60) for _ in range(40)] + [None, "", "x", PROSE * 3000]
    data = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, PROSE, "x", "y"), (2, "other text", "x", "y"), (2, texts[2], "x", "y")]
    docs = spark.createDataFrame(data, SCHEMA)
    edits = [(d[0], s, rng.randrange(-5, 3000), rng.randrange(3000), rng.choice(["", " new words", "'s", None])) for d in data for s in range(rng.randrange(4))] + [(999, 0, 0, 0, "gone"), (1, 0, None, None, "in front")]
    frame = spark.createDataFrame(edits, "doc_id long, seq int, start int, stop int, new string")
    got = edit_counts.edit_aware_counts(docs, frame, RANKS, PATTERN).collect()
    want = []
    for i, text, *_ in data:
        text = after = text or ""
        own = sorted((s, a or 0, b or 0, n or "") for d, s, a, b, n in edits if d == i and i is not None)
        for _, a, b, new in own:
            a = min(max(a, 0), len(after))
            after = after[:a] + new + after[min(max(b, a), len(after)) :]
        want.append((i, count(text), len(own), count(after), len(after)))
    assert sorted((r.doc_id or -1, r.tokens_before, r.n_edits, r.n_tokens, r.n_chars) for r in got) == sorted((w[0] or -1, *w[1:]) for w in want)
    long = next(r for r in got if r.doc_id == 43)
    assert long.chars_encoded < 0.1 * long.n_chars * max(1, long.n_edits)
    assert edit_counts.edit_aware_counts(docs.limit(0), frame, RANKS, PATTERN).count() == 0


def segmentations(model, text):
    """Every segmentation of a text with its exact probability."""
    norm = piece_sampling.normalised(text)
    known = {model.texts[i]: i for i in range(len(model.texts)) if np.isfinite(model.weights[i])}

    def ways(at):
        if at == len(norm):
            yield (), 0.0
            return
        for end in range(at + 1, len(norm) + 1):
            piece = norm[at:end]
            if piece in known:
                step, weight = (known[piece],), model.weights[known[piece]]
            elif end == at + 1:
                step, weight = tuple(model.byte_ids[list(piece.encode())].tolist()), model.unknown
            else:
                continue
            for rest, w in ways(end):
                yield step + rest, weight + w

    found = dict(ways(0))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: float(v - total) for k, v in found.items()}


TEXTS = ["", "a", "the cat", "x  y", "né漢\nit", " ", "\n\n", "▁b", "ship ahoy"]


def test_samples_are_distinct_and_weighed_right():
    model = piece_sampling.pieces(MODEL)
    keys = mix(np.arange(len(TEXTS), dtype=np.uint64))
    for k in (1, 3, 7):
        for text, found in zip(TEXTS, piece_sampling.sample(model, TEXTS, keys, k), strict=True):
            exact = segmentations(model, text)
            got = [tuple(f[0].tolist()) for f in found]
            assert len(set(got)) == len(got) == min(k, len(exact))
            for ids, log_prob, inclusion in found:
                assert log_prob == pytest.approx(exact[tuple(ids.tolist())], abs=1e-9) and 0 < inclusion <= 1
                assert model.decode(ids.tolist()).decode() == text.replace("▁", " ")
            if len(exact) <= k:
                assert all(f[2] == 1.0 for f in found)


@pytest.mark.parametrize("text", ["the sea", "is it"])
def test_frequencies_match_sampling_without_replacement(monkeypatch, text):
    model = piece_sampling.pieces(MODEL)
    monkeypatch.setattr(piece_sampling, "LOOK", 2)
    exact = {k: np.exp(v) for k, v in segmentations(model, text).items()}
    n = 6000
    found = list(piece_sampling.sample(model, [text] * n, mix(np.arange(n, dtype=np.uint64)), 2))
    pairs = Counter((tuple(a[0].tolist()), tuple(b[0].tolist())) for a, b in found)
    first = Counter(p[0] for p in pairs.elements())
    for s, p in exact.items():
        assert abs(first[s] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3
    for a, b in itertools.permutations(sorted(exact, key=exact.get)[-4:], 2):
        p = exact[a] * exact[b] / (1 - exact[a])
        assert abs(pairs[a, b] / n - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-3
    # Inclusion scores make unbiased weights: their inverses count every segmentation's mass once.
    total = np.mean([sum(np.exp(x[1]) / x[2] for x in f) for f in found])
    assert total == pytest.approx(1.0, abs=0.05)


def test_rows_on_spark(spark):
    data = [(i, t, "x", "y") for i, t in enumerate([*TEXTS, None, PROSE * 40, "w" * 5000, "long word " * 20_000])] + [(None, PROSE, "x", "y"), (3, PROSE, "x", "y")]
    docs = spark.createDataFrame(data, SCHEMA)
    got = piece_sampling.sampled_pieces(docs, MODEL, 2).collect()
    again = piece_sampling.sampled_pieces(docs.repartition(5), MODEL, 2).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    for r in got:
        assert r.n_pieces == len(r.pieces) and r.ids_crc32 == zlib.crc32(np.array(r.pieces, dtype="<i4").tobytes()) and r.decodes
    ranks = Counter((r.doc_id, r.rank) for r in got)
    assert ranks[0, 1] == 1 and ranks[0, 2] == 0 and ranks[9, 1] == 1 and ranks[10, 2] == 1 and ranks[11, 2] == 1 and ranks[3, 1] == 2 and ranks[None, 2] == 1
    assert piece_sampling.sampled_pieces(docs.limit(0), MODEL).count() == 0


def test_query_returns_its_pieces(tmp_path, spark):
    """op8 hands over the sampled pieces, not only digests of them (F14)."""
    data = [(i, t, "x", "y") for i, t in enumerate([*TEXTS, None, PROSE])]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    model = piece_sampling.pieces(MODEL)
    rows = queries.op8_piece_sampling(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(range(len(data)))
    for r in rows:
        text = (data[r.doc_id][1] or "").replace(piece_sampling.SPACE, " ")
        assert model.decode(r.pieces).decode() == text and r.n_pieces == len(r.pieces) and r.ids_crc32 == zlib.crc32(np.array(r.pieces, dtype="<i4").tobytes())


def test_only_what_begins_a_piece_is_read_on(monkeypatch):
    """op8: lattices looked up every length at every character before."""
    model, asked = piece_sampling.pieces(MODEL), []
    look_up = piece_sampling.Pieces.look_up
    monkeypatch.setattr(piece_sampling.Pieces, "look_up", lambda self, h: asked.append(h.size) or look_up(self, h))
    units = ["qxzjvkwq" * 4, "▁seven", "jjqqxxzzvv" * 3]
    piece_sampling.Lattices(model, units)
    every = sum(sum(len(u) - k for k in range(min(model.longest, len(u)))) for u in units)
    assert 0 < sum(asked) < every / 3
