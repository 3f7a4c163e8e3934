"""Removal of repeated word windows by level-wise doubling.

Windows repeated at one length alone are candidates for twice that length, up to the wanted one or until no
candidates survive. Below the wanted length a level need not look at every window: of the short windows inside
one of the wanted length, the one with the smallest hash speaks for it (winnowing), and equal long windows have
equal speakers. At each level the hashes are dealt out by sampled splitters over (hash, document, place),
sorted, and compared with their neighbours, so that a passage which a third of all documents share is
cut over several ranges instead of filling one.

At the wanted length windows are told apart by 96 bits of two hashes that rest on independent hashes of each
word; below it a hash that is equal by chance costs work but changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_LAST, SEQ_P, SEQ_Q, chunks, drop, hashed_words, materialize, windows

WINDOW, START = 20, 5
#: Bytes of text that are hashed at once.
AT_ONCE = 1 << 20
#: rid, a digest of id and text, stands for a row, so rows without an id or of one id do not meet.
_LEVEL = "h long, rid long, pos int"
_FULL = "h long, g int, did long, rid long, pos int"
_DROPS = "rid long, pos int, edge int, part int, h long, g int"


def speakers(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of span consecutive hashes the place of its smallest (the first of equals), by doubling."""
    value, at, wide = hashes, np.arange(len(hashes)), 1
    while wide < span:
        step = min(wide, span - wide)
        left, right = value[: len(value) - step], value[step:]
        less = right < left
        value, at, wide = np.where(less, right, left), np.where(less, at[step:], at[: len(at) - step]), wide + step
    return at


def opened(n_words: int, window: int, length: int, alive: np.ndarray) -> np.ndarray:
    """Which windows are still candidates: those inside of which a repeated run of that length starts. A window's
    speaker is such a run if the window repeats, so none that does is left out."""
    change = np.zeros(n_words + 2, dtype=np.int64)
    np.add.at(change, np.maximum(alive - (window - length), 0), 1)
    np.add.at(change, alive + 1, -1)
    return np.cumsum(change)[: max(0, n_words - window + 1)] > 0


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[bytes]]]:
    texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
    for a, b in chunks(list(map(len, texts)), AT_ONCE):
        yield a, b, texts[a:b]


def _level_rows(batches: Iterator[pa.RecordBatch], window: int, length: int, before: int | None) -> Iterator[pa.RecordBatch]:
    """One row per speaker of a candidate window; at the full length one row per candidate window."""
    for batch in batches:
        dids, rids = batch.column("did").to_numpy(), batch.column("rid").to_numpy()
        alive = batch.column("alive") if before else None
        for a, _, texts in _texts(batch):
            (words, *again), firsts = hashed_words(texts, (1, 2) if length >= window else (1,))
            out: list[tuple] = []
            for k in range(len(texts)):
                own = words[firsts[k] : firsts[k + 1]]
                if len(own) < window:
                    continue
                open_ = np.ones(len(own) - window + 1, dtype=bool)
                if before:
                    open_ = opened(len(own), window, before, alive[a + k].values.to_numpy().astype(np.int64))
                hashes = windows(own, length, SEQ_P)
                if length < window:
                    pos = np.unique(speakers(hashes, window - length + 1)[open_])
                    out.append((hashes[pos], np.full(len(pos), rids[a + k]), pos))
                else:
                    pos = np.flatnonzero(open_)
                    second = (windows(again[0][firsts[k] : firsts[k + 1]], length, SEQ_Q)[pos] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    out.append((hashes[pos], second, np.full(len(pos), dids[a + k]), np.full(len(pos), rids[a + k]), pos))
            if out:
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                cols[0], cols[-1] = cols[0].view(np.int64), cols[-1].astype(np.int32)
                names = ["h", "rid", "pos"] if length < window else ["h", "g", "did", "rid", "pos"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a sorted range whose hash has a neighbour with the same one. The first and the last hash of
    a range may go on in the next, so their rows stay candidates."""
    kept, started = None, False
    for batch in batches:
        h, rid, pos = (batch.column(c).to_numpy() for c in ("h", "rid", "pos"))
        if not len(h):
            continue
        if kept is not None:
            h, rid, pos = np.concatenate((kept[0], h)), np.concatenate((kept[1], rid)), np.concatenate((kept[2], pos))
        same = h[1:] == h[:-1]
        again = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        if kept is not None:
            again[0] |= kept[3]
        if not started:
            again |= h == h[0]
            started = True
        kept = (h[-1:], rid[-1:], pos[-1:], bool(again[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(rid[:-1][again[:-1]]), pa.array(pos[:-1][again[:-1]])], names=["rid", "pos"])
    if kept is not None:
        yield pa.RecordBatch.from_arrays([pa.array(kept[1]), pa.array(kept[2])], names=["rid", "pos"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of a sorted range that also start earlier: all of a run but its first place.

    edge 0: such a window. Edge 1: rows at the first place of the range, which are later ones only if the
    range before ends on the same window; edge 2: that last window. Only edges carry their hashes.
    """
    part, head, last = TaskContext.get().partitionId(), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in ("h", "g", "did", "rid", "pos")]
        before = last if last is not None else [c[0] for c in cols]
        h, g, did, _, pos = (np.concatenate(([b], c)) for b, c in zip(before, cols, strict=True))
        fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
        # The row put in front stands for its whole run, at the place where that run began.
        later = ((did != did[run]) | (pos != pos[run]))[1:]
        run = run[1:]
        if head is None:
            head = [c[0] for c in cols]
        first = ~later & (cols[0] == head[0]) & (cols[1] == head[1])
        last = [h[run[-1]], g[run[-1]], did[run[-1]], cols[3][0], pos[run[-1]]]
        keep = later | first
        n, inner = int(keep.sum()), ~first[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[3][keep]), pa.array(cols[4][keep]), pa.array(first[keep].astype(np.int32)), pa.array(np.full(n, part, dtype=np.int32)), pa.array(cols[0][keep], mask=inner), pa.array(cols[1][keep], mask=inner)],
            names=["rid", "pos", "edge", "part", "h", "g"],
        )
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in ((0, pa.int64()), (0, pa.int32()), (2, pa.int32()), (part, pa.int32()), (last[0], pa.int64()), (last[1], pa.int32()))], names=["rid", "pos", "edge", "part", "h", "g"])


def _cut(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        starts = batch.column("starts")
        for text, at in zip(batch.column("text").cast(pa.binary()), starts, strict=True):
            words = (text.as_py() or b"").split()
            at = at.as_py()
            if at:
                change = np.zeros(len(words) + 1, dtype=np.int64)
                at = np.unique(np.asarray(at, dtype=np.int64))
                at = at[at + window <= len(words)]
                change[at] += 1
                change[at + window] -= 1
                kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
            else:
                kept = words
            out[0].append(len(words))
            out[1].append(len(words) - len(kept))
            out[2].append(b" ".join(kept))
        shas = [hashlib.sha256(x).hexdigest() for x in out[2]]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string()), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])


def repeated_windows(docs: DataFrame, window: int = WINDOW, start: int = START) -> DataFrame:
    """(rid, pos) of every window of that many words whose words also start earlier. docs: did, rid, text."""
    if window % start or (window // start) & (window // start - 1):
        raise ValueError("the window must be the starting length times a power of two")
    length, before, rows, level = start, None, docs, None
    while True:
        if level is not None:
            alive = level.groupBy("rid").agg(F.collect_set("pos").alias("alive"))  # bounded by the document
            rows = docs.join(alive, "rid")
        full = length >= window
        # Written, as splitters are sampled from it before it is dealt out.
        hashed = materialize(rows.mapInArrow(partial(_level_rows, window=window, length=length, before=before), _FULL if full else _LEVEL), f"hashes-{length}")
        key = ["h", "g", "did", "pos"] if full else ["h", "rid", "pos"]
        ranged = hashed.repartitionByRange(*key).sortWithinPartitions(*key)
        if level is not None:
            drop(level)
        level = materialize(ranged.mapInArrow(_later, _DROPS), "later-windows") if full else materialize(ranged.mapInArrow(_repeated, "rid long, pos int"), f"repeated-{length}")
        drop(hashed)
        if full:
            break
        if level.isEmpty():
            return level
        length, before = 2 * length, length
    found = level
    # One row a range: does the range before it (with rows) end on the window that it begins with?
    ends = found.filter("edge = 2").select("part", F.struct("h", "g").alias("end")).withColumn("previous", F.lag("end").over(W.orderBy("part"))).select("part", "previous")
    heads = found.filter("edge = 1").join(ends, "part").filter(F.struct("h", "g") == F.col("previous"))
    return found.filter("edge = 0").select("rid", "pos").union(heads.select("rid", "pos"))


def substring_dedup(docs: DataFrame, window: int = WINDOW, start: int = START, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text, kept_sha256.

    A word goes if a window of consecutive words covers it whose word sequence also starts earlier: in a
    row with a smaller doc_id (null ids come last) or earlier in the same document. Rows that repeat a
    doc_id stand at the same place in that order, so equal windows at equal starts of them both stay; so
    do those of rows without an id. Null and empty texts have no words; texts shorter than the window lose
    nothing, long ones are taken whole. An empty table gives no rows; further columns are ignored.
    """
    text, did = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_LAST))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), did.alias("did"), F.xxhash64(did, text).alias("rid"), text.alias("text"))
    gone = repeated_windows(keyed.select("did", "rid", "text"), window, start).groupBy("rid").agg(F.collect_set("pos").alias("starts"))
    return keyed.join(gone, "rid", "left").select("doc_id", "text", "starts").mapInArrow(partial(_cut, window=window), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
