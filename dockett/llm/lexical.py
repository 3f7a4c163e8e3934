"""Ranked lexical search turned round: documents stream past an inverted index of the items.

Items (the queries) are few next to the documents, so it is their terms that are indexed and broadcast, and only
once their number has been counted: more items than one index may hold are dealt over several, each of which sees
all documents. A first pass over the documents counts them, their terms and in how many each indexed term is; a
second one scores. A task keeps a heap of at most k documents an item and hands over what is in them at its end;
the heaps are merged in two turns.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial, reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, drop, materialize

#: Terms of an index at most (of one item's, if it has more), bytes of text split into terms at once, cells of scores
#: and hits of the index worked on at once, and parts that the heaps of an item are merged in.
INDEX_TERMS, AT_ONCE, CELLS, HITS, MERGED = 1 << 19, 1 << 20, 1 << 21, 1 << 21, 64
#: Fixed values of the scores: thousandths of a weight, a term's share, and what a document's length counts.
WEIGHT, SHARE, TF, LENGTH, FLAT, SLOPE = 1000, 1_000_000_000, 1000, 8, 25, 75
_NONE = 2**63
#: Terms are runs of ASCII letters and digits and of everything beyond ASCII: bytes from 128 on in UTF-8.
_LOWER = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in lists of about AT_ONCE bytes."""
    text, at = text.translate(_LOWER), 0
    while at < len(text):
        to = text.find(b" ", at + AT_ONCE)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column("item_id"), _texts(batch), strict=True):
            found, n = np.unique(np.array(list(chain.from_iterable(terms(text))), dtype=object), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([item.as_py()] * len(found), pa.int64()), pa.array(found.tolist(), pa.binary()), pa.array(n, pa.int64())], names=["item_id", "term", "n"])


class Index:
    """Terms by number, and for each the items that have it and how often; weights once they are known."""

    def __init__(self, rows: list[tuple[int | None, bytes, int]]) -> None:
        rows = sorted(rows, key=lambda r: r[1])
        self.items = sorted({r[0] for r in rows}, key=lambda i: (i is None, i))
        number = {item: i for i, item in enumerate(self.items)}
        self.terms = list(dict.fromkeys(r[1] for r in rows))
        self.item = np.array([number[r[0]] for r in rows], dtype=np.int64)
        self.times = np.array([r[2] for r in rows], dtype=np.int64)
        first = {t: i for i, t in reversed(list(enumerate(r[1] for r in rows)))}
        self.first = np.array([*(first[t] for t in self.terms), len(rows)], dtype=np.int64)
        self.weights = np.zeros(len(self.terms), dtype=np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, n_docs: int, n_terms: int, df: dict[int, int]) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(self.terms))], dtype=np.int64)

    def places(self) -> dict[bytes, int]:
        return {t: i for i, t in enumerate(self.terms)}


def counted(texts: list[bytes], places: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the number of its terms; and text, indexed term and occurrences of each hit."""
    sizes, own, hits = np.zeros(len(texts), dtype=np.int64), [], []
    for i, text in enumerate(texts):
        for found in terms(text):
            sizes[i] += len(found)
            ids = np.fromiter(map(places.get, found, repeat(-1)), dtype=np.int64, count=len(found))
            ids = ids[ids >= 0]
            own.append((i, len(ids)))
            hits.append(ids)
    who, n = np.array(own, dtype=np.int64).reshape(-1, 2).T
    wide = max(len(places), 1)
    keys, tf = np.unique(np.repeat(who, n) * wide + np.concatenate([np.zeros(0, dtype=np.int64), *hits]), return_counts=True)
    return sizes, keys // wide, keys % wide, tf


def _statistics(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    """In how many of a task's documents each term is; as term -1 the documents with terms, as -2 all their terms."""
    places = index.value.places()
    df, docs, total = np.zeros(len(places), dtype=np.int64), 0, 0
    for batch in batches:
        texts = _texts(batch)
        for a, b in chunks(list(map(len, texts)), AT_ONCE):
            sizes, _, term, _ = counted(texts[a:b], places)
            df += np.bincount(term, minlength=len(df))
            docs, total = docs + int((sizes > 0).sum()), total + int(sizes.sum())
    seen = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-1, -2], seen))), pa.array(np.concatenate(([docs, total], df[seen])))], names=["term", "n"])


def normal_lengths(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What the lengths count, the mean as 100; products beyond 64 bits are taken as Python's."""
    if SLOPE * int(sizes.max(initial=0)) * n_docs < 2**63:
        return FLAT + SLOPE * sizes * n_docs // n_terms
    return np.array([FLAT + SLOPE * int(n) * n_docs // n_terms for n in sizes], dtype=np.int64)


class Heaps:
    """For each item its k best documents so far; of equal scores those of smaller ids, null ids last."""

    def __init__(self, items: int, k: int) -> None:
        self.k, self.heaps, self.least = k, [[] for _ in range(items)], np.zeros(items, dtype=np.int64)

    def update(self, scores: np.ndarray, ids: list[int]) -> None:
        """scores: a row a document, a column an item. What cannot get into a heap is not looked at one by one."""
        k, n = self.k, len(scores)
        least = np.maximum(self.least, 1)
        if n > k:
            least = np.maximum(least, np.partition(scores, n - k, axis=0)[n - k])
        for row, item in zip(*(x.tolist() for x in np.nonzero(scores >= least)), strict=True):
            entry, heap = (int(scores[row, item]), -ids[row]), self.heaps[item]
            if len(heap) < k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == k:
                self.least[item] = heap[0][0]


def scored(sizes: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, index: Index, docs: int) -> np.ndarray:
    """Scores of documents (rows) for items (columns) from their hits."""
    lengths = normal_lengths(sizes, index.n_docs, index.n_terms)
    worth = index.weights[term] * ((SHARE * tf) // (TF * tf + LENGTH * lengths[doc]))
    out = np.zeros(docs * len(index.items), dtype=np.int64)
    n = index.first[term + 1] - index.first[term]
    for a, b in chunks(n.tolist(), HITS):
        own = n[a:b]
        ends = np.cumsum(own)
        at = np.repeat(index.first[term[a:b]] - ends + own, own) + np.arange(own.sum())
        np.add.at(out, np.repeat(doc[a:b], own) * len(index.items) + index.item[at], np.repeat(worth[a:b], own) * index.times[at])
    return out.reshape(docs, len(index.items))


def _searched(batches: Iterator[pa.RecordBatch], index, k: int) -> Iterator[pa.RecordBatch]:
    index = index.value
    places, heaps = index.places(), Heaps(len(index.items), k)
    most = max(1, CELLS // max(len(index.items), 1))
    for batch in batches:
        texts, ids = _texts(batch), [_NONE if i is None else i for i in batch.column("doc_id").to_pylist()]
        for a, b in chunks([max(len(t), AT_ONCE // most) for t in texts], AT_ONCE):
            sizes, doc, term, tf = counted(texts[a:b], places)
            some = index.weights[term] > 0
            heaps.update(scored(sizes, doc[some], term[some], tf[some], index, b - a), ids[a:b])
    rows = [(index.items[i], None if minus == -_NONE else -minus, score) for i, heap in enumerate(heaps.heaps) for score, minus in heap]
    for a in range(0, len(rows), 100_000):
        columns = zip(*rows[a : a + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])


def merged(kept: DataFrame, k: int) -> DataFrame:
    """The k best documents of each item from the tasks' heaps, first by parts of them."""
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    parted = W.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(MERGED))).orderBy(*best)
    some = kept.withColumn("rank", F.row_number().over(parted)).filter(F.col("rank") <= k).drop("rank")
    return some.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(*best))).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """Item terms with the block that their item belongs to, so that none has more than INDEX_TERMS rows unless it is
    one item's; and the number of blocks."""
    items = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    total, largest = items.agg(F.sum("n"), F.max("n")).first()
    number = max(1, -(-(total or 0) // INDEX_TERMS))
    while True:
        block = F.pmod(F.xxhash64("item_id"), F.lit(number)).alias("block")
        most = items.groupBy(block).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= max(INDEX_TERMS, largest or 0) or number > 64 * (total or 0):
            return rows.select("*", block), number
        number *= 2


def search(items: DataFrame, docs: DataFrame, k: int, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item its k documents of the highest score above 0.

    The score of a document is the sum over an item's terms, repeats included, of the term's weight times a share that
    grows with the term's occurrences and falls with the document's length, all whole numbers. Equal scores go by
    rising doc_id, null ids last. Every row of docs is a document of its own, so rows that repeat an id or a text may
    fill several ranks. Of items that repeat an id (null is one) the smallest text is searched for, null as
    empty. Null and empty texts have no terms: such items and documents have no rows, and such documents count for
    nothing. Empty tables give no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(text_col, F.lit("")).alias("text")).groupBy("item_id").agg(F.min("text").alias("text"))
    listed = materialize(asked.mapInArrow(_item_terms, "item_id long, term binary, n long"), "item-terms")
    rows, number = _blocks(listed)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found: list[DataFrame] = []
    for block in range(number):
        index = Index([tuple(r) for r in rows.filter(F.col("block") == block).select("item_id", "term", "n").collect()])
        if not index.terms:
            continue
        sent = spark.sparkContext.broadcast(index)
        counts = texts.select("text").mapInArrow(partial(_statistics, index=sent), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        df = {r.term: r.n for r in counts.collect()}  # no more rows than the index has terms
        sent.unpersist()
        n_docs, n_terms = df.pop(-1, 0), df.pop(-2, 0)
        if not n_docs:
            break
        index.weigh(n_docs, n_terms, df)
        best = merged(texts.mapInArrow(partial(_searched, index=spark.sparkContext.broadcast(index), k=k), "item_id long, doc_id long, score long"), k)
        found.append(materialize(best, "heaps") if number > 1 else best)
    drop(listed)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
