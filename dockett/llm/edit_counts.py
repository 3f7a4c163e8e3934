"""Token counts that follow edits without encoding whole texts again.

A document is cut into segments where the tokenizer's pre-tokens always part, whatever stands around: at
a space between two letters. A tree over the segments holds sums of characters and of tokens. An edit
finds its segments by the character sums, encodes them again together with neighbours as far as needed
for both ends to be such places, and updates the sums above them.

The cutting holds for patterns that try a letter run with at most one space in front, such as the byte
level vocabularies' own pattern.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_LAST, materialize

#: Characters of a segment at least (more if no place to cut follows), and how far a segment may grow by
#: edits before the document is cut anew.
SEGMENT, GROWN = 256, 16
_CUT = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
_ENCODINGS: dict[tuple[str, str], object] = {}


def encoding(ranks_path: str, pattern: str):
    if (ranks_path, pattern) not in _ENCODINGS:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[ranks_path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[ranks_path, pattern]


def segments(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _CUT.search(text, at + SEGMENT)
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


class SegmentTree:
    """Segments of one document under sums of characters (row 0) and tokens (row 1); node i over 2i and 2i+1."""

    def __init__(self, encoder, text: str, lengths: list[int] | None = None, tokens: list[int] | None = None) -> None:
        self.encoder, self.encoded = encoder, 0
        if lengths is None:
            self.texts = segments(text)
            tokens = [self._count(t) for t in self.texts]
            lengths = list(map(len, self.texts))
        else:
            ends = np.cumsum([0, *lengths]).tolist()
            self.texts = [text[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        self.size = 1 << max(0, len(self.texts) - 1).bit_length()
        self.sums = np.zeros((2, 2 * self.size), dtype=np.int64)
        self.sums[0, self.size : self.size + len(lengths)] = lengths
        self.sums[1, self.size : self.size + len(lengths)] = tokens
        level = self.size
        while level > 1:
            self.sums[:, level // 2 : level] = self.sums[:, level : 2 * level].reshape(2, -1, 2).sum(axis=2)
            level //= 2

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.encoder.encode_ordinary(text))

    @property
    def chars(self) -> int:
        return int(self.sums[0, 1])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaves(self) -> tuple[list[int], list[int]]:
        n = len(self.texts)
        return self.sums[0, self.size : self.size + n].tolist(), self.sums[1, self.size : self.size + n].tolist()

    def text(self) -> str:
        return "".join(self.texts)

    def _find(self, place: int) -> tuple[int, int]:
        """The segment that holds a place, and where it begins; the end of the text is in the last one."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            left = int(self.sums[0, node])
            if place >= begin + left and self.sums[0, node + 1] > 0:
                begin += left
                node += 1
        return node - self.size, begin

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.texts[leaf] = text
        node = leaf + self.size
        change = np.array([len(text), tokens]) - self.sums[:, node]
        while node:
            self.sums[:, node] += change
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Puts new in the place of characters start to end; places beyond the text are its end."""
        start = min(max(start, 0), self.chars)
        end = min(max(end, start), self.chars)
        if not self.texts:
            self.__init__(self.encoder, new)
            return
        first, begin = self._find(start)
        last, last_begin = self._find(max(start, end - 1))
        text = self.texts[first][: start - begin] + new + self.texts[last][end - last_begin :]
        while first > 0 and not (len(text) > 1 and text[0] == " " and _CUT.match(self.texts[first - 1][-1:] + text[:2], 1)):
            first -= 1
            text = self.texts[first] + text
        while last + 1 < len(self.texts) and not (text and _CUT.match(text[-1] + self.texts[last + 1][:2], 1)):
            last += 1
            text += self.texts[last]
        for leaf in range(first + 1, last + 1):
            self._set(leaf, "", 0)
        self._set(first, text, self._count(text))
        if len(text) > GROWN * SEGMENT and _CUT.search(text, SEGMENT):
            done = self.encoded
            self._split(first, text)
            self.encoded += done

    def _split(self, leaf: int, text: str) -> None:
        """A grown segment is cut, counted in its parts, and the tree built over the new list."""
        lengths, tokens = self.leaves()
        parts = segments(text)
        self.encoded = 0
        counts = [self._count(p) for p in parts]
        lengths[leaf : leaf + 1], tokens[leaf : leaf + 1] = list(map(len, parts)), counts
        kept = [(n, t) for n, t in zip(lengths, tokens, strict=True) if n]
        again = self.encoded
        self.__init__(self.encoder, self.text(), [k[0] for k in kept], [k[1] for k in kept])
        self.encoded = again


def _built(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = encoding(ranks, pattern)
    for batch in batches:
        trees = [SegmentTree(encoder, t or "") for t in batch.column("text").to_pylist()]
        leaves = [t.leaves() for t in trees]
        yield pa.RecordBatch.from_arrays(
            [batch.column("did"), batch.column("th"), pa.array([x[0] for x in leaves], pa.list_(pa.int32())), pa.array([x[1] for x in leaves], pa.list_(pa.int32())), pa.array([t.tokens for t in trees], pa.int64())],
            names=["did", "th", "lengths", "counts", "n_tokens"],
        )


def _edited(batches: Iterator[pa.RecordBatch], ranks: str, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = encoding(ranks, pattern)
    for batch in batches:
        out: list[tuple] = []
        for row in batch.select(["text", "lengths", "counts", "n_tokens", "edits"]).to_pylist():
            edits = row["edits"] or []
            if not edits:
                out.append((row["n_tokens"], 0, row["n_tokens"], len(row["text"]), 0))
                continue
            tree = SegmentTree(encoder, row["text"], row["lengths"], row["counts"])
            for e in edits:
                tree.edit(e["start"], e["stop"], e["new"] or "")
            out.append((row["n_tokens"], len(edits), tree.tokens, tree.chars, tree.encoded))
        cols = list(zip(*out, strict=True)) if out else [()] * 5
        names = ["tokens_before", "n_edits", "n_tokens", "n_chars", "chars_encoded"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], names=["doc_id", *names])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_LAST)).alias("did"), F.xxhash64(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def build_trees(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, th, lengths, counts, n_tokens): the segments of each whole text and their token counts.

    did is the id (for null a value that sorts last) and th a digest of the text. Null texts count as empty.
    """
    return _keyed(docs, id_col, text_col).select("did", "th", "text").mapInArrow(partial(_built, ranks=ranks, pattern=pattern), "did long, th long, lengths array<int>, counts array<int>, n_tokens long")


def edited_counts(docs: DataFrame, trees: DataFrame, edits: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, tokens_before, n_edits, n_tokens, n_chars, chars_encoded.

    edits has doc_id, seq, start, stop, new: by rising seq (equal ones by their other values), new replaces
    characters start to stop of the text as it is by then; null bounds are 0 and null text is empty. Edits
    of unknown or null ids are ignored, and every row with an id takes its edits. chars_encoded counts the
    characters that the edits made it encode again. trees is build_trees(docs), kept from before. Rows that
    repeat id and text share a tree; empty tables give no rows; further columns are ignored.
    """
    whole = F.struct(F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("start").cast("long"), F.lit(0).cast("long")).alias("start"), F.coalesce(F.col("stop").cast("long"), F.lit(0).cast("long")).alias("stop"), F.coalesce("new", F.lit("")).alias("new"))
    # A document's edits meet in one row, as its text does.
    listed = edits.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("did")).agg(F.array_sort(F.collect_list(whole)).alias("edits"))
    once = trees.groupBy("did", "th").agg(F.first("lengths").alias("lengths"), F.first("counts").alias("counts"), F.first("n_tokens").alias("n_tokens"))
    # Trees without an id, which may be many, meet no list but that of the one id that stands for none.
    last = F.col("did") == NULL_LAST
    kept = once.filter(~last).join(listed, "did", "left").unionByName(once.filter(last).join(F.broadcast(listed.filter(last)), "did", "left"))
    rows = _keyed(docs, id_col, text_col).join(kept, ["did", "th"]).withColumn("edits", F.when(F.col("doc_id").isNotNull(), F.col("edits")))
    return rows.select("doc_id", "text", "lengths", "counts", "n_tokens", "edits").mapInArrow(partial(_edited, ranks=ranks, pattern=pattern), "doc_id long, tokens_before long, n_edits long, n_tokens long, n_chars long, chars_encoded long")


def scripted_edits(docs: DataFrame, each: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Edits for trials, `each` a document, their places, lengths and words drawn by digest of (id, seq)."""
    draw = lambda n: F.xxhash64("doc_id", "seq", F.lit(n))
    words = F.array(*[F.lit(w) for w in ("", " the", "x", " amended clause 7", "'s", "\n", " é1", "  ")])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(each - 1))).alias("seq"))
    start = F.pmod(draw(1), F.col("n") + 1)
    return rows.select("doc_id", "seq", start.alias("start"), (start + F.pmod(draw(2), F.lit(24))).alias("stop"), F.element_at(words, (F.pmod(draw(3), F.lit(8)) + 1).cast("int")).alias("new"))


def edit_aware_counts(docs: DataFrame, edits: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Builds and keeps the trees, then applies the edits."""
    return edited_counts(docs, materialize(build_trees(docs, ranks, pattern), "segment-trees"), edits, ranks, pattern)
