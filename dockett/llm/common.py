"""Helpers shared by the corpus operators: words, shared storage and written intermediate tables."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"

NULL_LAST = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_tokenizer(name: str) -> str:
    """Where an installed public vocabulary lies: at the same path on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets
    a temporary one; on a cluster no folder of one machine will do, so that is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="dockett-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/dockett-{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    """Shuffle files of a finished write go at once: what it wrote replaces them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    try:
        spark.conf.set(key, "true")
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes of rows that go to Python at once.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python hold BATCH_BYTES at most (Spark's own bound is eight times that), so that some very long texts
    among the rows do not fill an executor. Stays set, as plans read it when they run."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(key, "64m").lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30}.get(given[-1:], 0)
    if int(given.rstrip("kmg")) << unit > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that lost executors cost no more than one stage."""
    spark = df.sparkSession
    bounded_batches(spark)
    path = shared_path(spark, name)
    with _shuffles_dropped(spark):
        df.write.parquet(path)
    _MADE.append(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


_MADE: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(table: DataFrame) -> None:
    """Deletes a table that materialize wrote, once nothing reads it any more."""
    delete(table.sparkSession, table.scratch_path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that materialize writes inside are deleted at the end, but those that the block puts into the given list."""
    before, kept = len(_MADE), []
    yield kept
    gone = _MADE[before:]
    del _MADE[before:]
    for path in gone:
        if path in {t.scratch_path for t in kept}:
            _MADE.append(path)
        else:
            delete(spark, path)


#: A key that holds more than a HEAVY-th of all rows (there are fewer than HEAVY such keys) and more than
#: PART_ROWS rows is dealt over several parts.
HEAVY, PART_ROWS = 65_536, 512


def dealt_join(rows: DataFrame, one: DataFrame, key: list[str], by: list[str] | None = None, counted: DataFrame | None = None) -> DataFrame:
    """rows joined with one, which has one row a key. Rows of a heavy key are dealt over parts, each of which gets
    a copy of the key's row, so no task takes them all. The list of heavy keys has fewer than HEAVY rows, so it
    may be broadcast. rows should be a written table, as it is read up to three times and dealt by place. What is not
    written is dealt by a digest of the columns by, which tell its rows apart, so that a task that runs again deals
    them as before; counted is then a table with the same keys as often."""
    counts = (rows if counted is None else counted).groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    total, top = counts.agg(F.sum("__n"), F.max("__n")).first()
    most = max(PART_ROWS, -(-(total or 0) // HEAVY))
    if (top or 0) <= most:
        return rows.join(one, key)
    heavy = F.broadcast(counts.filter(F.col("__n") > most).select(*key, F.ceil(F.col("__n") / most).alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1).cast("long"))
    left = rows.withColumn("__at", F.xxhash64(*by) if by else F.monotonically_increasing_id()).join(heavy, key, "left").withColumn("__part", F.pmod("__at", parts)).drop("__at", "__parts")
    right = one.join(heavy, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("__parts")
    return left.join(right, [*key, "__part"]).drop("__part")


def by_others(names: list[str], but: list[str]) -> Column:
    """A digest of the columns but some, to choose one of rows that differ in these alone the same way each time."""
    rest = [F.col(f"`{c}`") for c in names if c not in but]
    return F.xxhash64(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(rest)]))) if rest else F.lit(0).cast("long")


def squeezed(text: Column) -> Column:
    """Null as empty, and each run of white space as one space; only runs that differ from one space are touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def word_count(text: Column) -> Column:
    """Words of a text, null for none, as long; counts the starts of words without keeping them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chunks(sizes: list[int], most: int):
    """(from, to) ranges of rows whose sizes add up to about most; a larger row stands alone."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


SEQ_P = np.uint64(0xD6E8FEB86659FD93)
SEQ_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(p: np.uint64, n: int, inverse: bool = False) -> np.ndarray:
    """p**0 .. p**(n-1) modulo 2**64, or those of its inverse; kept and grown by doubling."""
    have = _POWERS.get((int(p), inverse))
    if have is None or len(have) < n:
        base = pow(int(p), -1, 2**64) if inverse else int(p)
        size = 1 << max(10, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _POWERS[int(p), inverse] = have
    return have[:n]


_WS = np.zeros(256, dtype=bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_MASKS = np.array([2 ** (8 * n) - 1 for n in range(9)], dtype=np.uint64)


@functools.cache
def _lane(seed: int, j: int) -> np.uint64:
    return mix(np.array([seed * 0x9E3779B97F4A7C15 + j * 0xD1B54A32D192ED03 & 2**64 - 1], dtype=np.uint64))[0]


def hashed_words(texts: list[bytes], seeds: tuple[int, ...] = (1,)) -> tuple[list[np.ndarray], np.ndarray]:
    """64-bit hashes of the words of the texts, in order, for each seed, and for each text the place of its first word
    (and the end).

    A word's hash adds up its eight-byte pieces, each scrambled together with its place and the seed, so words that
    differ in any way have unrelated hashes, and so have the seeds.
    """
    data = b"\n".join(texts) + b"\n"
    n = len(data)
    data += bytes(8)
    inside = ~_WS[np.frombuffer(data, dtype=np.uint8, count=n)]
    steps = np.diff(inside.view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    sizes, lanes = ends - starts, np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,))
    sums = [np.zeros(len(starts), dtype=np.uint64) for _ in seeds]
    which, at, left, j = np.flatnonzero(sizes <= LONG_WORD), starts, sizes, 0
    if len(which) < len(starts):
        at, left = starts[which], sizes[which]
    while len(which):
        piece = lanes[at] & _MASKS[np.minimum(left, 8)]
        for s, seed in zip(sums, seeds, strict=True):
            s[which] += mix(piece ^ _lane(seed, j))
        on = left > 8
        which, at, left, j = which[on], at[on] + 8, left[on] - 8, j + 1
    for i in np.flatnonzero(sizes > LONG_WORD):
        for s, seed in zip(sums, seeds, strict=True):
            s[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]], seed)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    firsts = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))
    return [mix(s + sizes.astype(np.uint64)) for s in sums], firsts


def windows(words: np.ndarray, n: int, p: np.uint64) -> np.ndarray:
    """A 64-bit hash of each run of n words, by the place of its first; empty if there are fewer words."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(mix(words ^ p) * powers(p, len(words)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(p, len(words) + 1, inverse=True)[: len(words) - n + 1])
