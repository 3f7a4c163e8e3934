import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dockett.llm import sstable
from dockett.llm.common import public_tokenizer

SCHEMA = "doc_id long, text string, start string, tokens string"
PATH = public_tokenizer("word_bpe_49k.json")
EDGE = [None, "", " \n", "Hello, World!!", "don't can't 'tis x's", "<|endoftext|> foo<|endoftext|>bar <|endoftext|", "a\x1cb\x85c d e", "é é ́x É ÑÜß İI Σας ΣΑΣ", "漢字テスト 12345 3.14 ½ ²", "x" * 3000, "$$$ enè$$$ %%%", "😀😀a", "​ zero", "word " * 20_000, "A_b_c __ `q` {z}~"]


def whole(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [e.ids for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]


def test_words_encode_as_whole_texts():
    encode = sstable.Encoder(PATH)
    got = [np.frombuffer(x, dtype="<u2").tolist() for x in encode([(t or "").encode() for t in EDGE])]
    assert got == whole(EDGE)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30) | st.text("aBé'st .,!\n\t<|>0́Σß", max_size=30), max_size=4))
def test_any_text_encodes_the_same(texts):
    assert [np.frombuffer(x, dtype="<u2").tolist() for x in sstable.encoder(PATH)([t.encode() for t in texts])] == whole(texts)


@pytest.mark.parametrize("shard_bytes", [1 << 26, 200])
def test_round_trip(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(sstable, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 64)
    rng = random.Random(1)
    ids = rng.sample(range(-500, 10**12), len(EDGE) + 60)
    data = [(i, t, "x", "y") for i, t in zip(ids, EDGE + [" ".join(rng.choice(["the", "Ships", "sail,", "x9"]) for _ in range(rng.randrange(30))) for _ in range(60)])]
    data += [(None, "no id", "x", "y"), (ids[4], "again", "x", "y"), (ids[4], EDGE[4], "x", "y")]
    manifest = sstable.write_table(spark.createDataFrame(data, SCHEMA).repartition(3), PATH)
    got = sstable.read_table(manifest).collect()
    start, want = 0, []
    ordered = sorted(data, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    for d, ids_ in zip(ordered, whole([d[1] for d in ordered])):
        tokens = np.array([*ids_, 1], dtype="<u4")
        want.append((d[0], start, len(tokens), zlib.crc32(tokens.tobytes())))
        start += len(tokens)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    asked = [ids[0], ids[4], ids[-1], 10**13, -(10**13)]
    found = sorted((r.doc_id, list(r.ids)) for r in sstable.look_up(manifest, asked).collect())
    assert found == sorted((d[0], [*i, 1]) for d, i in zip(ordered, whole([d[1] for d in ordered])) if d[0] in asked)


def test_reader_skips_by_filter_and_index(tmp_path):
    path = str(tmp_path / "a.sst")
    writer = sstable.Writer(path, 2)
    for i in range(0, 40_000, 2):
        writer.add(sstable.key_of(i, i), np.array([i % 60_000, 1], dtype="<u2").tobytes())
    writer.close()
    reader = sstable.Reader(path)
    assert len(reader.index) > 3 and reader.documents == 20_000 and reader.tokens == 40_000
    opened = []
    monkey = reader.entries
    reader.entries = lambda block: opened.append(block) or monkey(block)
    assert [x.tolist() for x in reader.get(20_000)] == [[20_000, 1]] and len(opened) <= 2
    assert reader.get(-1) == [] and sum(bool(reader.may_hold(i)) for i in range(1, 20_000, 2)) < 500
    reader.close()


def test_no_documents(spark):
    manifest = sstable.write_table(spark.createDataFrame([], SCHEMA), PATH)
    assert sstable.read_table(manifest).count() == 0 and sstable.look_up(manifest, [1]).count() == 0
