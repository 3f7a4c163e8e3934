"""Language by unigrams of pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary; what is learned is how likely each is in each language. A word's
likelihood is the sum over all ways to cut it into pieces, by a forward pass over its letters for all languages at
once, and a text's is the product over its words. Learning takes words with their counts from a bounded number of
documents a language and goes a few rounds of expected piece counts (forward and backward passes) spread over tasks;
the driver gets one row a language and piece. Expected counts are whole numbers, so reruns agree whatever the order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, drop, materialize
from .piece_sampling import SPACE, Pieces, pieces

#: Documents that a language is learned from, about, chosen by digest; rounds; how much all languages' pieces add to
#: each one's; languages at most (more are an error).
LEARN_DOCS, ROUNDS, SMOOTH, LANGUAGES = 4000, 2, 200.0, 1000
#: Letters of a word at most (a longer run falls into several), words remembered by a task, characters of texts judged
#: at once, and cells worked on at once.
LONGEST, REMEMBERED, AT_ONCE, CELLS = 64, 200_000, 1 << 21, 1 << 18
#: Expected counts are in units of 1 / UNIT.
UNIT = 1 << 12
_WORD = regex.compile(rf"\p{{L}}[\p{{L}}\p{{M}}]{{0,{LONGEST - 1}}}")
UNKNOWN = "und"


def words(text: str) -> list[str]:
    """Runs of letters and the marks that follow them, in lower case."""
    return _WORD.findall(text.lower())


class Grid:
    """Words of one length, each behind a space sign, with the pieces that begin at each of their characters.

    ids: (words, characters, piece lengths), -1 for none. A character that is no piece stands for its bytes; extra has
    these as (word, character, piece of a byte).
    """

    def __init__(self, model: Pieces, group: list[str]) -> None:
        n = len(group[0]) + 1
        codes = np.frombuffer("".join(SPACE + w for w in group).encode("utf-32-le"), dtype="<u4").reshape(len(group), n)
        self.ids, bare = model.starting(codes)
        self.extra = np.zeros((0, 3), dtype=np.int64)
        word, at = np.nonzero(bare)
        if len(word):
            seen, which = np.unique(codes[word, at], return_inverse=True)
            spelt = [model.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))] for c in seen.tolist()]
            sizes = np.array(list(map(len, spelt)))
            n, ends = sizes[which], np.cumsum(sizes[which])
            piece = np.concatenate(spelt)[np.repeat((np.cumsum(sizes) - sizes)[which] - ends + n, n) + np.arange(n.sum())]
            self.extra = np.column_stack((np.repeat(word, n), np.repeat(at, n), piece))

    def weights(self, logs: np.ndarray) -> np.ndarray:
        """(words, characters, piece lengths, languages) of log probabilities; logs: (pieces and none, languages)."""
        out = logs[self.ids]
        if len(self.extra):
            w, i, b = self.extra.T
            out[w, i, 0] = 0
            np.add.at(out, (w, i, 0), logs[b])
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top[~np.isfinite(top)] = 0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def forward(weights: np.ndarray) -> np.ndarray:
    """Log of the summed chance of all segmentations of each word's first characters: (words, characters + 1, languages)."""
    m, n, wide, languages = weights.shape
    out = np.full((m, n + 1, languages), -np.inf)
    out[:, 0] = 0
    for i in range(1, n + 1):
        ks = np.arange(1, min(wide, i) + 1)
        out[:, i] = _log_sum(out[:, i - ks] + weights[:, i - ks, ks - 1], 1)
    return out


def backward(weights: np.ndarray) -> np.ndarray:
    """The same of each word's last characters."""
    m, n, wide, languages = weights.shape
    out = np.full((m, n + 1, languages), -np.inf)
    out[:, n] = 0
    for i in range(n - 1, -1, -1):
        ks = np.arange(1, min(wide, n - i) + 1)
        out[:, i] = _log_sum(out[:, i + ks] + weights[:, i, ks - 1], 1)
    return out


def grids(model: Pieces, given: list[str], languages: int) -> Iterator[tuple[list[int], Grid]]:
    """Places of words of equal length, with their grid; bounded by CELLS."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(given):
        by.setdefault(len(w), []).append(i)
    for n, own in by.items():
        step = max(1, CELLS // ((n + 1) * min(model.longest, n + 1) * max(languages, 1)))
        for a in range(0, len(own), step):
            yield own[a : a + step], Grid(model, [given[i] for i in own[a : a + step]])


def likelihoods(model: Pieces, given: list[str], logs: np.ndarray) -> np.ndarray:
    """(words, languages): logs of the summed chances of all segmentations."""
    out = np.zeros((len(given), logs.shape[1]))
    for own, grid in grids(model, given, logs.shape[1]):
        out[own] = forward(grid.weights(logs))[:, -1]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            counts.update((lang, w) for w in words(text or ""))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def _expected(batches: Iterator[pa.RecordBatch], path: str, logs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Expected counts of the pieces of the words, each in its own language."""
    model = pieces(path)
    totals = np.zeros(logs.shape, dtype=np.int64)
    for batch in batches:
        langs, given, times = batch.column("lang").to_numpy(), batch.column("word").to_pylist(), batch.column("n").to_numpy()
        for own, grid in grids(model, given, 1):
            lang, n = langs[own], times[own]
            weights = np.take_along_axis(grid.weights(logs), lang[:, None, None, None].astype(np.int64), 3)
            a, b = forward(weights), backward(weights)
            m, chars, wide, _ = weights.shape
            ends = np.minimum(np.arange(chars)[:, None] + np.arange(1, wide + 1), chars)
            share = np.exp(a[:, :chars, None, 0] + weights[..., 0] + b[:, ends, 0] - a[:, -1, None, None, 0])
            whole = np.rint(share * UNIT).astype(np.int64) * n[:, None, None]
            word, at, k = np.nonzero((whole > 0) & (grid.ids >= 0))
            np.add.at(totals, (grid.ids[word, at, k], lang[word]), whole[word, at, k])
            if len(grid.extra):
                w, i, piece = grid.extra.T
                np.add.at(totals, (piece, lang[w]), whole[w, i, 0])
    piece, lang = np.nonzero(totals)
    yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(totals[piece, lang])], names=["lang", "piece", "n"])


class Languages:
    """Names in order, log shares of documents, and log probabilities (pieces and none, languages)."""

    def __init__(self, names: list[str], prior: np.ndarray, logs: np.ndarray) -> None:
        self.names, self.prior, self.logs = names, prior, logs


def _smoothed(counts: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """Log probabilities from counts (pieces, languages); pieces that a language lacks follow from all languages'."""
    shared = (counts.sum(axis=1) + 1.0) * usable
    shared /= shared.sum()
    p = (counts + SMOOTH * shared[:, None]) / (counts.sum(axis=0) + SMOOTH)
    with np.errstate(divide="ignore"):
        return np.concatenate((np.log(p), np.full((1, counts.shape[1]), -np.inf)))


def fold_of(doc_id) -> F.Column:
    """crc32 of the id as text, mod 3; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def learn(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages | None:
    """What is learned of each language from rows with one outside fold 1: its share of all of them, and its pieces from
    about LEARN_DOCS rows. None if there are no such rows."""
    model = pieces(path)
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("name")).filter(F.col("name").isNotNull() & (fold_of(F.col("doc_id")) != 1))
    sizes = known.groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy("name").limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return None
    n = np.array([r.n for r in sizes], dtype=np.float64)
    share = docs.sparkSession.createDataFrame([(r.name, i, int(min(1.0, LEARN_DOCS / r.n) * 2**31)) for i, r in enumerate(sizes)], "name string, lang int, share long")
    digest = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(2**31))
    some = known.join(F.broadcast(share), "name").filter(digest < F.col("share")).select("lang", "text")  # at most LANGUAGES rows
    listed = materialize(some.mapInArrow(_counted, "lang int, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    usable = np.isfinite(model.weights[:-1])
    usable[model.byte_ids] = True
    logs = _smoothed(np.zeros((len(usable), len(sizes))), usable)
    for _ in range(ROUNDS):
        rows = listed.mapInArrow(partial(_expected, path=path, logs=logs), "lang int, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((len(usable), len(sizes)))
        counts[rows.piece, rows.lang] = rows.n / UNIT
        logs = _smoothed(counts, usable)
    drop(listed)
    return Languages([r.name for r in sizes], np.log(n / n.sum()), logs)


class Remembered:
    """Likelihoods of the words that a task has met, up to REMEMBERED (or one chunk's) at once."""

    def __init__(self, model: Pieces, known: Languages) -> None:
        self.model, self.known = model, known
        self.places: dict[str, int] = {}
        self.table = np.zeros((REMEMBERED, len(known.names)))

    def of(self, given: list[str]) -> np.ndarray:
        """(words, languages)"""
        new = [w for w in set(given) if w not in self.places]
        if len(self.places) + len(new) > len(self.table):
            # Full: forgotten, and larger for a chunk of very many words.
            self.places.clear()
            new = list(set(given))
            self.table = np.zeros((max(REMEMBERED, len(new)), len(self.known.names)))
        at = len(self.places)
        self.table[at : at + len(new)] = likelihoods(self.model, new, self.known.logs)
        self.places.update(zip(new, range(at, at + len(new)), strict=True))
        return self.table[np.fromiter(map(self.places.__getitem__, given), dtype=np.int64, count=len(given))]


def judged(texts: list[str], memory: Remembered) -> tuple[list[str], list[float]]:
    """Language and its probability of each text."""
    known, split = memory.known, list(map(words, texts))
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    sums = np.concatenate((np.zeros((1, len(known.names))), np.cumsum(memory.of(list(chain.from_iterable(split))), axis=0)))
    ends = np.cumsum(counts)
    total = sums[ends] - sums[ends - counts] + known.prior
    best = total.argmax(axis=1)
    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return [known.names[i] if n else UNKNOWN for i, n in zip(best.tolist(), counts.tolist(), strict=True)], np.where(counts > 0, score, 0.0).tolist()


def _predicted(batches: Iterator[pa.RecordBatch], path: str, known: Languages) -> Iterator[pa.RecordBatch]:
    memory = Remembered(pieces(path), known)
    for batch in batches:
        texts, found = [t or "" for t in batch.column("text").to_pylist()], ([], [])
        for a, b in chunks(list(map(len, texts)), AT_ONCE):
            for out, more in zip(found, judged(texts[a:b], memory), strict=True):
                out += more
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found[0], pa.string()), pa.array(found[1], pa.float64())], names=["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, known: Languages | None, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs, from whole texts alone."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if known is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(partial(_predicted, path=path, known=known), "doc_id long, lang_pred string, score double")


def languages(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Languages of rows in fold 1 are never learned from. lang_pred is und with score 0 where a text is null or has no
    letters, and everywhere if no row has a language to learn from; equal chances go to the first language by code
    point. score is the chance of the language given the text. A null id has fold 0; rows that repeat an id or a
    text are judged alike. Texts of any length are read whole. An empty table gives no rows; further columns are
    ignored.
    """
    bounded_batches(docs.sparkSession)
    found = predict(docs, learn(docs, path, id_col, text_col, lang_col), path, id_col, text_col)
    return found.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score")
