"""Vectors as short codes: each part of a vector becomes the number of its nearest codebook entry, in whole numbers.

Products of parts and entries are matrix products of doubles. So that they are exact, whole numbers are broken into
limbs of so few bits that a sum of products stays below 2**53; the products of limbs are put together again as 64-bit
integers, or as Python's where 64 bits do not hold a distance. Codebooks are learned in rounds: tasks add up the
limbs of the parts that each entry got, so sums are exact in any order, and one small aggregate gives the next entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, dealt_join, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows multiplied at once; labels up to which their sums are broadcast (some 30 MB).
AT_ONCE, BROADCAST_ROWS = 8192, 1_000_000
_MOST = 2**63 - 1


def limb_bits(width: int) -> int:
    """Bits of a limb, so that width products of two limbs add up to no more than 2**53."""
    return (53 - max(width - 1, 0).bit_length()) // 2


def limbs(v: np.ndarray, bits: int) -> list[np.ndarray]:
    """Whole-numbered doubles as limbs with the signs of the numbers, lowest first: v = sum of limb j times 2**(bits * j)."""
    n, out = max(1, -(-int(np.abs(v).max(initial=0)).bit_length() // bits)), []
    for j in range(n - 1, 0, -1):
        high = np.trunc(np.ldexp(v, -bits * j))
        v = v - np.ldexp(high, bits * j)
        out.append(high)
    return [v, *out[::-1]]


def int_limbs(v: np.ndarray, bits: int) -> list[np.ndarray]:
    """The same of Python's integers, which a mean of large numbers may need."""
    top = max(map(abs, v.ravel().tolist()), default=0)
    cut = lambda x, j: ((abs(x) >> bits * j) & (1 << bits) - 1) * (1 if x >= 0 else -1)
    return [np.array([cut(x, j) for x in v.ravel().tolist()], dtype=np.float64).reshape(v.shape) for j in range(max(1, -(-top.bit_length() // bits)))]


def joined(parts: Iterator[tuple[int, np.ndarray]], wide: bool) -> np.ndarray:
    """The sum of products of limbs, each times 2 to its power."""
    total: np.ndarray | int = 0
    for power, part in parts:
        whole = part.astype(np.int64)
        total = total + (whole.astype(object) if wide else whole) * (1 << power)
    return total


def gemm(a: list[np.ndarray], b: list[np.ndarray], bits: int, wide: bool = False) -> np.ndarray:
    """Exact products of the rows of a with those of b, both as limbs."""
    return joined(((bits * (i + j), x @ y.T) for i, x in enumerate(a) for j, y in enumerate(b)), wide)


def squares(a: list[np.ndarray], bits: int, wide: bool = False) -> np.ndarray:
    """Exact squared lengths of rows."""
    return joined(((bits * (i + j), (x * y).sum(axis=1)) for i, x in enumerate(a) for j, y in enumerate(a)), wide)


def nearest(v: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of whole-numbered doubles the first nearest row of book (Python's integers), and the squared distance."""
    width = v.shape[1]
    bits, top = limb_bits(width), int(np.abs(v).max(initial=0)) + max(map(abs, book.ravel().tolist()), default=0)
    wide = width * top * top >= 2**62
    x, c = limbs(v, bits), int_limbs(book, bits)
    far = squares(c, bits, wide)[None, :] - 2 * gemm(x, c, bits, wide)
    best = far.argmin(axis=1)
    return best, squares(x, bits, wide) + far[np.arange(len(v)), best]


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """floor(SCALE * x) of vectors as whole-numbered doubles, dim columns; shorter vectors end in zeros."""
    lengths = np.asarray(vectors.value_lengths())
    flat = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = flat
    return out


def _learned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums of the limbs of the parts that each entry got: (part, entry, place, limb, total); as place -1 their number."""
    parts, entries, width = books.shape
    bits, sums, counts = limb_bits(width), [], np.zeros((parts, entries), dtype=np.int64)
    for batch in batches:
        for at in range(0, len(batch), AT_ONCE):
            v = matrix(batch.column("embedding").slice(at, AT_ONCE), parts * width)
            for p in range(parts):
                own = v[:, p * width : (p + 1) * width]
                best, _ = nearest(own, books[p])
                counts[p] += np.bincount(best, minlength=entries)
                for j, limb in enumerate(limbs(own, bits)):
                    if j == len(sums):
                        sums.append(np.zeros(books.shape, dtype=np.int64))
                    np.add.at(sums[j][p], best, limb.astype(np.int64))
    p, e = np.nonzero(counts)
    rows = [(p, e, np.full(len(p), -1), np.zeros(len(p), dtype=np.int64), counts[p, e])]
    for j, total in enumerate(sums):
        p, e, i = np.nonzero(total)
        rows.append((p, e, i, np.full(len(p), j), total[p, e, i]))
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows, strict=True)], names=["part", "entry", "place", "limb", "total"])


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch in batches:
        for at in range(0, len(batch), AT_ONCE):
            own = batch.slice(at, AT_ONCE)
            v = matrix(own.column("embedding"), parts * width)
            found = [nearest(v[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            text = np.column_stack([best for best, _ in found]).astype(np.uint8).tobytes().hex()
            errors = np.minimum(sum(d.astype(object) for _, d in found), _MOST).astype(np.int64)
            codes = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(codes, pa.string()), pa.array(errors)], names=["vec_id", "label", "code", "error"])


def learn(sound: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, position) of Python's integers, from vec_id and embedding; None if there are no vectors.
    The driver sees the first vectors and one row an entry's component, never the vectors."""
    first = sound.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).collect()
    if not first:
        return None
    width = max(1, -(-sound.agg(F.max(F.size("embedding"))).first()[0] // parts))
    given = matrix(pa.array([r.embedding for r in first], pa.list_(pa.float64())), parts * width)
    whole = np.array([[int(x) for x in row] for row in given.tolist()], dtype=object).reshape(len(first), parts, width)
    books, bits = np.ascontiguousarray(whole.transpose(1, 0, 2)), limb_bits(width)
    for _ in range(rounds):
        got = sound.select("embedding").mapInArrow(partial(_learned, books=books), "part long, entry long, place long, limb long, total long")
        # No more rows than components of entries times limbs.
        rows = got.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
        counts = {(r.part, r.entry): int(r.total) for r in rows if r.place < 0}
        sums = np.zeros(books.shape, dtype=object)
        for r in rows:
            if r.place >= 0:
                sums[r.part, r.entry, r.place] += int(r.total) << bits * r.limb
        books = books.copy()
        for (p, e), n in counts.items():
            books[p, e] = sums[p, e] // n
    return books


def compressed(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), one row a sound vector.

    Codebooks start as the parts of the vectors of the smallest ids (null ids last, equal ids by vector) and are
    learned from all vectors, rounds times. code has two hex digits a part; error is the squared distance to the
    entries, label_error its sum over equal labels, nulls together; both stop at 2**63 - 1. Vectors that are null or
    hold null or non-finite components (SCALE-fold ones too) have no row. A shorter vector counts as ending in
    zeros, and so do all if parts does not divide the longest. Fewer vectors than entries make smaller codebooks. Rows
    that repeat an id are vectors of their own. Empty tables give no rows; further columns are ignored.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    given = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf"))
    sound = given.filter(F.col("embedding").isNotNull() & F.forall("embedding", good))
    label = given.schema["label"].dataType.simpleString()
    books = learn(sound, parts, entries, rounds)
    if books is None:
        return spark.createDataFrame([], f"vec_id long, label {label}, code string, error long, label_error long, codebooks_sha256 string")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = materialize(sound.mapInArrow(partial(_coded, books=books), f"vec_id long, label {label}, code string, error long"), "codes")
    keyed = coded.withColumns({"__label": F.coalesce(F.col("label").cast("string"), F.lit("")), "__null": F.col("label").isNull()})
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    sums = materialize(keyed.groupBy("__label", "__null").agg(total.alias("label_error")), "label-errors")
    key = ["__label", "__null"]
    out = keyed.join(F.broadcast(sums), key) if sums.count() <= BROADCAST_ROWS else dealt_join(keyed, sums, key)
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
