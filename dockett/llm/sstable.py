"""Token ids in sorted-string-table shards.

A shard holds documents by rising key in blocks of prefix-compressed entries, then a sparse index (first
key, place and length of each block), a Bloom filter of its keys, and a footer of fixed length. Shards
are written under a name of their own and moved into place when whole, and only shards that a finished
task reported are part of a table, so a task that is run again or twice does no harm.

Layout of a shard, little-endian:
    block   zstd of entries; entry: shared key bytes, other key bytes, value bytes (varints), key, value
    index   per block: key (17 bytes), offset (8), length (4)
    bloom   bits of the filter
    footer  index offset, index length, bloom offset, bloom length, documents, tokens (8 bytes each),
            bytes of a token (4), magic (4)
A key is 1 byte (0 for a null id, else 1), the id with its sign bit turned, big-endian, and the place of
the row among the shard's rows, so repeated ids are separate entries. A value is the ids as unsigned
integers of 2 or 4 bytes.
"""

from __future__ import annotations

import array
import bisect
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, shared_path

BLOCK_BYTES, SHARD_BYTES, SHARD_ROWS, BLOOM_BITS, BLOOM_PROBES, LOOKUP_IDS, MOST_READERS = 1 << 16, 64 << 20, 1 << 18, 10, 6, 10_000, 100_000
_FOOTER, _INDEX, _MAGIC = struct.Struct("<6QI4s"), struct.Struct("<17sQI"), b"SST1"
KEY_BYTES = 17
_MANIFEST = "shard string, part int, first_id long, documents long, tokens long"


def key_of(doc_id: int | None, row: int) -> bytes:
    return struct.pack(">BQQ", 0, 0, row) if doc_id is None else struct.pack(">BQQ", 1, doc_id + 2**63, row)


def id_of(key: bytes) -> int | None:
    return struct.unpack_from(">Q", key, 1)[0] - 2**63 if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    """Bits of the filter for a key; the row number is left out, so a lookup by id can ask."""
    h = xxhash.xxh3_128_intdigest(key[:9])
    a, b = h & (2**64 - 1), h >> 64 | 1
    return [(a + i * b) % 2**64 % bits for i in range(BLOOM_PROBES)]


class Writer:
    """Writes one shard; entries come by rising key. Holds one block, the index and a digest of the keys."""

    def __init__(self, path: str, width: int) -> None:
        self.fs, self.path = open_fs(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.fs.create_dir(self.path.rpartition("/")[0])
        self.out, self.at, self.width = self.fs.open_output_stream(self.part), 0, width
        self.zstd = zstandard.ZstdCompressor(level=1)
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.documents = self.tokens = 0
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.size, self.last, self.first = [], 0, b"", None

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.last:
            while shared < KEY_BYTES and self.last[shared] == key[shared]:
                shared += 1
        entry = (_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value)
        self.block += entry
        self.size += sum(map(len, entry))
        self.first, self.last = self.first or key, key
        self.documents += 1
        self.tokens += len(value) // self.width
        if not self.keys or self.keys[-1][:9] != key[:9]:
            self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._end_block()

    def _put(self, data: bytes) -> tuple[int, int]:
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at, len(data)

    def _end_block(self) -> None:
        if self.first is not None:
            self.index.append((self.first, *self._put(self.zstd.compress(b"".join(self.block)))))
        self._new_block()

    def close(self) -> None:
        self._end_block()
        index = self._put(b"".join(_INDEX.pack(*x) for x in self.index))
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros(-(-bits // 8), dtype=np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        filter_ = self._put(struct.pack("<Q", bits) + bloom.tobytes())
        self._put(_FOOTER.pack(*index, *filter_, self.documents, self.tokens, self.width, _MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)


class Reader:
    """Reads one shard: the footer, index and filter at once, blocks as they are asked for."""

    def __init__(self, path: str) -> None:
        fs, at = open_fs(path)
        self.file = fs.open_input_file(at)
        self.file.seek(self.file.size() - _FOOTER.size)
        i, il, b, bl, self.documents, self.tokens, self.width, magic = _FOOTER.unpack(self.file.read(_FOOTER.size))
        if magic != _MAGIC:
            raise ValueError(f"{path} is no shard")
        index = self._get(i, il)
        self.index = [_INDEX.unpack_from(index, k) for k in range(0, il, _INDEX.size)]
        self.firsts = [x[0] for x in self.index]
        bloom = self._get(b, bl)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def close(self) -> None:
        self.file.close()

    def entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, n = self.index[block]
        data, at, key = zstandard.ZstdDecompressor().decompressobj().decompress(self._get(at, n)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, data[at : at + size]
            at += size

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype=f"<u{self.width}").astype("<u4")

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in range(len(self.index)):
            for key, value in self.entries(block):
                yield key, self.ids(value)

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id, 0), self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Token ids of every row with that id: the filter, then a binary search of the index."""
        if not self.index or not self.may_hold(doc_id):
            return []
        low, found = key_of(doc_id, 0), []
        for block in range(max(0, bisect.bisect_right(self.firsts, low) - 1), len(self.index)):
            if self.firsts[block][:9] > low[:9]:
                break
            found += [self.ids(v) for k, v in self.entries(block) if k[:9] == low[:9]]
        return found


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A path or URI of a store that all executors share."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return pyarrow.fs.LocalFileSystem(), path


#: Encoded words that a Python worker keeps; words beyond are encoded each time they come.
CACHE = 1_000_000
_CORE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)\Z")  # letters, then ASCII marks but the apostrophe
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Encodes texts word by word with a cache.

    That gives the ids of the whole text where the tokenizer splits at white space, drops it, and splits
    letters from what is neither letter nor digit, lower-casing; `word_bpe` vocabularies do. Added tokens
    may hold no white space either.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 2**16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"": b""}

    def _encode(self, parts: list[str]) -> None:
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False), strict=True):
            self.parts[part] = array.array(self.code, e.ids).tobytes()

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.words) > CACHE or len(self.parts) > CACHE:
            self.words, self.parts = {}, {"": b""}
        words, split = self.words, [t.split() for t in texts]  # of bytes: at ASCII white space only
        new = {}
        for w in {w for s in split for w in s}:
            if w not in words:
                text = w.decode()
                m = _CORE.match(text)
                new[w] = (m[1].lower(), m[2]) if m else (text, "")
        self._encode([p for p in {p for cut in new.values() for p in cut} if p not in self.parts])
        words.update((w, self.parts[a] + self.parts[b]) for w, (a, b) in new.items())
        return [b"".join([words[w] for w in s]) for s in split]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, part, writer, row, number, first = encoder(tokenizer), TaskContext.get().partitionId(), None, 0, 0, None
    end, done = np.array([end_id], dtype=f"<u{encode.width}").tobytes(), []

    def finish() -> None:
        writer.close()
        done.append((path, part, first, writer.documents, writer.tokens))

    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
        for at in range(0, len(ids), 256):
            values = encode([t or b"" for t in texts[at : at + 256]])
            for doc_id, value in zip(ids[at : at + 256], values, strict=True):
                if writer is None:
                    path, first = f"{folder}/part-{part:06d}-{number:05d}-{uuid.uuid4().hex[:8]}.sst", doc_id
                    writer, number = Writer(path, encode.width), number + 1
                writer.add(key_of(doc_id, row), value + end)
                row += 1
                if writer.at >= SHARD_BYTES or writer.documents >= SHARD_ROWS:
                    finish()
                    writer = None
    if writer is not None:
        finish()
    cols = list(zip(*done, strict=True)) if done else [[]] * 5
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "part", "first_id", "documents", "tokens"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
            reader, out = Reader(shard), []
            for key, ids in reader:
                out.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes())))
                start += len(ids)
                if len(out) == 4096:
                    yield _digests(out)
                    out = []
            yield _digests(out)
            reader.close()


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def write_table(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes docs as shards by rising doc_id and returns the manifest: shard, start, first_id, documents, tokens.

    Every row is written, null and repeated ids too (nulls first, equal ids by a digest of the text and the text,
    so that many rows of one id are cut over several ranges); null texts count as empty and hold the end id
    alone, texts of any length are written whole. start is the number of ids in all shards before. An empty
    table gives an empty manifest; further columns are ignored. The tokenizer file must be at the same path
    on every executor; folder is a new one in the shared folder by default.
    """
    bounded_batches(docs.sparkSession)
    folder = folder or shared_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    done = ranged.mapInArrow(partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id), _MANIFEST)
    path = f"{folder}/manifest"
    done.write.parquet(path)
    spark: SparkSession = docs.sparkSession
    # One row a shard of about SHARD_BYTES.
    before = W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)
    return spark.read.schema(_MANIFEST).parquet(path).withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def readers(manifest: DataFrame) -> int:
    """Tasks that read a table's shards. Given as a number, it is not merged away: a manifest's rows are tiny, what they
    stand for is not."""
    return min(max(1, manifest.count()), MOST_READERS)


def read_table(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a written table, read from its shards, about one
    of them a task."""
    rows = manifest.select("shard", "start").repartition(readers(manifest))
    return rows.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _look_up(batches: Iterator[pa.RecordBatch], wanted: list[int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for shard, low, high in zip(*(batch.column(c).to_pylist() for c in ("shard", "first_id", "next_id")), strict=True):
            own = [i for i in wanted if (low is None or i >= low) and i <= high]
            reader = Reader(shard) if own else None
            out += [(i, ids.tolist()) for i in own for ids in reader.get(i)]
            if reader:
                reader.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], names=["doc_id", "ids"])


def look_up(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of at most LOOKUP_IDS ids: only shards whose range of ids may hold one are opened, and
    of those only blocks that the filter and the index point to."""
    if len(doc_ids) > LOOKUP_IDS:
        raise ValueError(f"{LOOKUP_IDS} ids at once are the most")
    spans = manifest.withColumn("next_id", F.coalesce(F.lead("first_id").over(W.orderBy("part", "shard")), F.lit(2**63 - 1)))
    return spans.repartition(readers(manifest)).mapInArrow(partial(_look_up, wanted=sorted(set(doc_ids))), "doc_id long, ids array<long>")
