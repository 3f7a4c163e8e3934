"""Toxicity by a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, takes letters out of their presentation forms, drops accents and characters of no width,
turns look-alike letters, digits and signs that stand for letters into plain letters, and closes up words
that are spelt out letter by letter. The lexicon holds beginnings of words, and whole words of two or three
letters, whose share of toxic documents is significantly raised; phrases of a lexicon word and its neighbour
that clean documents repeat are exceptions, and such hits do not count. Weights are smoothed log odds. A
document's summed weight, plain and per length, goes through a logistic curve. All of this is learned from a
bounded sample of labelled rows outside the held-out fold.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import bounded_batches

#: Labelled ids that are learned from at most (those with the smallest digests), one text each. What is learned
#: follows from significance alone; more than LEXICON_ROWS terms or phrases (some 100 bytes each) are an error.
LEARN_ROWS, LEXICON_ROWS = 12_000, 500_000
#: Shortest and longest word beginnings, the shortest whole word, and the least G-test statistic of a term.
SHORT, LONG, WHOLE, SIGNIFICANT = 4, 12, 2, 25.0
#: Characters around a hit in which its neighbours are looked for, and letters of a word that a phrase keeps.
AROUND = 64

# Look-alikes of Latin letters (Cyrillic, Greek, Armenian, Latin), digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ɡ": "g", "ո": "n",
    "ӏ": "l", "ԛ": "q", "ԝ": "w", "һ": "h", "ѵ": "v", "г": "r", "п": "n", "ь": "b", "ә": "e", "ց": "g", "հ": "h", "օ": "o", "ս": "u", "ք": "p", "ɑ": "a", "ø": "o", "đ": "d", "ł": "l", "ħ": "h",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k", "ε": "e", "ı": "i", "η": "n", "ω": "w", "χ": "x", "γ": "y", "σ": "o", "β": "b", "μ": "u",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l",
}
_FOLD = str.maketrans(LOOKALIKES)
_MARKS = re.compile("[\u00ad\u0300-\u036f\u200b-\u200f\u2060\ufeff]")
_BETWEEN = re.compile(r"(?<=[^\W\d_])[!|](?=[^\W\d_])")
_SPELT = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[.*_-][^\W\d_]){2,}(?![^\W\d_])|(?<![^\W\d_])[^\W\d_](?: [^\W\d_]){3,}(?![^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
_LAST = re.compile(r"([^\W\d_]+)[\W\d_]*$")


def folded(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    text = text.translate(_FOLD)
    if "!" in text or "|" in text:
        text = _BETWEEN.sub("i", text)
    return _SPELT.sub(lambda m: m[0][::2], text)


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    coefficients: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def automaton(self):
        found = ahocorasick.Automaton()
        for term in self.weights:
            found.add_word(term.rstrip("$"), term)
        if self.weights:
            found.make_automaton()
        return found


def terms_of(word: str) -> list[str]:
    """What of a word may be a term: its beginnings, or all of a short one, which a dollar sign ends."""
    return [word + "$"] if WHOLE <= len(word) < SHORT else [word[:k] for k in range(SHORT, min(LONG, len(word)) + 1)]


def hits(text: str, automaton) -> Iterator[tuple[str, str, str, str]]:
    """(term, word before, word, word after) of each lexicon term that begins a word of folded text, or is one.

    Of terms at one place the longest counts.
    """
    best: dict[int, str] = {}
    for end, term in automaton.iter(text) if len(automaton) else ():
        whole = term[-1] == "$"
        start = end + 1 - len(term) + whole
        if (start == 0 or not text[start - 1].isalpha()) and not (whole and text[end + 1 : end + 2].isalpha()) and len(term) > len(best.get(start, "")):
            best[start] = term
    for start, term in best.items():
        word = _WORD.match(text, start)[0]
        before = _LAST.search(text, max(0, start - AROUND), start)
        after = _WORD.search(text, start + len(word), start + len(word) + AROUND)
        yield term, before[1] if before else "", word, after[0] if after else ""


def phrases(before: str, word: str, after: str) -> tuple[str, str]:
    word = word[:AROUND]
    return f"{before} {word}", f"{word} {after}"


def weigh(text: str, lexicon: Lexicon, automaton) -> float:
    return sum(lexicon.weights[t] for t, *near in hits(text, automaton) if not lexicon.exceptions.intersection(phrases(*near)))


def features(weight, length):
    """Summed weight, by its logarithm, and per thousand characters (of at least a thousand)."""
    return np.log1p(np.maximum(weight, 0)), np.log1p(np.maximum(weight, 0) / np.maximum(np.asarray(length) / 1000, 1))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, toxic = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = set(_WORD.findall(folded(text or "")))
            found = {t for w in words for t in terms_of(w)}
            out += found
            toxic += [label] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.int32())], names=["term", "toxic"])


def _near(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    automaton = lexicon.automaton()
    for batch in batches:
        out, toxic = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = {p for _, *near in hits(folded(text or ""), automaton) for p in phrases(*near)}
            out += found
            toxic += [label] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.int32())], names=["term", "toxic"])


def _used(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    automaton = lexicon.automaton()
    for batch in batches:
        out, toxic = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {near[1] for _, *near in hits(folded(text or ""), automaton) if not lexicon.exceptions.intersection(phrases(*near))}
            found = {t for w in words for t in terms_of(w) if t in lexicon.weights}
            out += found
            toxic += [label] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(toxic, pa.int32())], names=["term", "toxic"])


def _weighed(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    automaton = lexicon.automaton()
    for batch in batches:
        texts = [folded(t or "") for t in batch.column("text").to_pylist()]
        weights = np.array([weigh(t, lexicon, automaton) for t in texts], dtype=np.float64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(weights), pa.array(list(map(len, texts)), pa.int64())], names=["doc_id", "toxic", "weight", "length"])


def _scored(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    automaton = lexicon.automaton()
    a, b, c = lexicon.coefficients
    for batch in batches:
        texts = [folded(t or "") for t in batch.column("text").to_pylist()]
        x, y = features(np.array([weigh(t, lexicon, automaton) for t in texts], dtype=np.float64), np.array(list(map(len, texts)), dtype=np.float64))
        score = 1 / (1 + np.exp(-np.clip(a + b * x + c * y, -40, 40)))
        own = [batch.column(n) for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*own, pa.array(score)], names=[n for n in batch.schema.names if n != "text"] + ["score"])


def _doc_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))


def g_test(toxic: int, clean: int) -> Column:
    """Signed G statistic of a of the toxic and b of the clean documents; positive if toxic ones have more."""
    a, b, n = F.col("a"), F.col("b"), toxic + clean
    cell = lambda got, row, of: F.when(got > 0, got * F.log(got * n / (row * of))).otherwise(0.0)
    g = 2 * (cell(a, a + b, toxic) + cell(b, a + b, clean) + cell(toxic - a, n - a - b, toxic) + cell(clean - b, n - a - b, clean))
    return F.when(a / toxic > b / clean, g).otherwise(-g)


def _bounded(rows: DataFrame) -> list:
    found = rows.limit(LEXICON_ROWS + 1).collect()
    if len(found) > LEXICON_ROWS:
        raise ValueError(f"more than {LEXICON_ROWS} terms or phrases are significant")
    return found


def choose(counts: list[tuple[str, int, int, float]], toxic: int, clean: int) -> dict[str, float]:
    """Terms (term, toxic documents, clean ones, G) by falling G, none of which begins another, with their smoothed
    log odds."""
    weights: dict[str, float] = {}
    begun: set[str] = set()
    for term, a, b, _ in sorted(counts, key=lambda c: (-round(c[3], 6), -len(c[0]), c[0])):
        if term in begun or any(term[:k] in weights for k in range(SHORT, len(term))):
            continue
        weight = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
        if weight > 1:
            weights[term] = weight
            begun.update(term[:k] for k in range(SHORT, len(term)))
    return weights


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack((np.ones(len(x)), x))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6] + [0.1] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
    return w


def fold_of(doc_id) -> F.Column:
    """crc32 of the id as text, mod 5; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Lexicon:
    """A lexicon from labelled rows of docs outside fold 0: about LEARN_ROWS ids at most, chosen by digest. Of rows
    that repeat an id the smallest text is learned from, null as empty."""
    bounded_batches(docs.sparkSession)
    given = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = given.count()
    share = min(1.0, LEARN_ROWS / max(n, 1))
    # Bounded by LEARN_ROWS, so it may be broadcast.
    pick = given.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < F.lit(int(share * 2**31)))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(pick), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).persist()
    try:
        counted = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        toxic, clean = counted.get(1, 0), counted.get(0, 0)
        if not toxic or not clean:
            prior = min(max((toxic + 0.5) / (toxic + clean + 1), 1e-3), 1 - 1e-3) if toxic + clean else 1e-3
            return Lexicon(coefficients=(math.log(prior / (1 - prior)), 0.0, 0.0))
        texts, g = rows.select("text", "toxic"), g_test(toxic, clean)
        lift = (F.col("a") / toxic) / ((F.col("b") + 0.5) / clean)
        seen = _bounded(_doc_counts(texts.mapInArrow(_terms, "term string, toxic int")).filter((F.col("a") >= 3) & (lift > 2) & (g >= SIGNIFICANT / 2)).select("term"))
        rough = Lexicon({r.term: 1.0 for r in seen})
        near = _doc_counts(texts.mapInArrow(partial(_near, lexicon=rough), "term string, toxic int"))
        rough.exceptions = frozenset(r.term for r in _bounded(near.filter((F.col("b") >= 2) & (F.col("b") / clean > F.col("a") / toxic * 0.5)).select("term")))
        used = _bounded(_doc_counts(texts.mapInArrow(partial(_used, lexicon=rough), "term string, toxic int")).withColumn("g", g).filter(F.col("g") >= SIGNIFICANT))
        lexicon = Lexicon(choose([(r.term, r.a, r.b, r.g) for r in used], toxic, clean))
        # Phrases around words that are no terms after all except nothing.
        automaton = lexicon.automaton()
        lexicon.exceptions = frozenset(p for p in rough.exceptions if any(True for _ in hits(p, automaton)))
        # One row an id, so bounded as the ids are; sorted, so that reruns add up in the same order.
        weighed = rows.mapInArrow(partial(_weighed, lexicon=lexicon), "doc_id long, toxic int, weight double, length long").toPandas().sort_values("doc_id")
        x = np.column_stack(features(weighed.weight.to_numpy(), weighed.length.to_numpy()))
        lexicon.coefficients = tuple(map(float, logistic(x, weighed.toxic.to_numpy().astype(float))))
        return lexicon
    finally:
        rows.unpersist()


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all but the text by default) and score, from 0 to 1; null texts count as empty."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("text").schema.fields)
    return rows.mapInArrow(partial(_scored, lexicon=lexicon), f"{schema}, score double")


def _clean(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        (scored,) = _scored(iter([pa.RecordBatch.from_arrays([batch.column(0).field(at)], names=["text"])]), lexicon)
        yield batch.filter(pa.array(scored.column("score").to_numpy() < 0.5))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that toxicity() predicts to be toxic, all columns, of any name, as they were.

    Null and empty texts are scored like any other and stay unless nearly all labelled documents are toxic;
    rows with null or repeated ids are judged by their texts.
    """
    lexicon = learn(docs, labels, id_col, text_col)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    kept = whole.mapInArrow(partial(_clean, lexicon=lexicon, at=docs.columns.index(text_col)), StructType([StructField("__row", docs.schema)]))
    return kept.select([F.col(f"__row.`{c}`").alias(c) for c in docs.columns])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels of rows in fold 0 are never learned from. Labels other than 0 and 1 are ignored; a doc_id
    labelled twice is toxic if either label says so. Without labels of both kinds every score is the same.
    Null texts count as empty; a null doc_id has no label and counts as held out.
    Texts of any length are scored whole. An empty table gives no rows; further columns are ignored.
    """
    lexicon = learn(docs, labels, id_col, text_col)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return score(ids, lexicon).select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
