"""SentencePiece encodings sampled without replacement, and decoding.

A text's segmentations weigh exp(ALPHA * sum of piece scores). The lattice falls apart at the starts of
runs of the space sign and around line ends, which no piece spans; each distinct unit of a batch gets its
lattice once, with the exact chances of each next piece, all as arrays. The k segmentations with the
highest Gumbel-perturbed log probabilities are found from the top down: a best-first search pops the set
of segmentations with the highest perturbed maximum, draws the segmentation that attains it, and splits
the rest of the set by the first piece that differs; the maxima of the parts are Gumbel variables cut off
at the parent's. Parts far down a text are kept together and split only if they come up. Random numbers
are functions of the row's key, so results do not depend on partitions or on reruns.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, mix

SPACE = "▁"
#: Scale of the scores; characters sampled at once; steps looked at singly; random numbers drawn at once.
ALPHA, AT_ONCE, LOOK, NUMBERS = 1 / 2048, 1 << 20, 32, 128
#: In the table of pieces: no piece, but the beginning of some.
BEGUN = -2
_UNIT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_P = np.uint64(0x9E3779B97F4A7C15)
_MODELS: dict[str, Pieces] = {}


class Pieces:
    """A model's pieces with their log weights, looked up by hash, longest piece first known."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        self.bytes: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, dtype=np.int32)
        self.weights = np.full(n, -np.inf)
        usable = []
        for i, t in enumerate(self.texts):
            if model.is_byte(i):
                value = int(t[3:-1], 16)
                self.bytes[i], self.byte_ids[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = t.encode()
                # Scores of hundreds of millions below zero mark pieces that are never merged.
                if model.get_score(i) > -1e8:
                    self.weights[i] = ALPHA * model.get_score(i)
                    usable.append(i)
        self.table = np.empty(n, dtype=object)
        self.table[:] = self.bytes
        if any(SPACE in self.texts[i].lstrip(SPACE) or "\n" in self.texts[i] for i in usable):
            raise ValueError("pieces of this model span words")
        self.unknown = self.weights[usable].min() - 1.0
        # No piece is piece -1, which has no weight.
        self.weights = np.append(self.weights, -np.inf)
        self.longest = max(len(self.texts[i]) for i in usable)
        known = {self.texts[i]: i for i in usable}
        begun = {t[:k]: BEGUN for t in known for k in range(1, len(t))}
        # An open table of 2**18 places by the top bits; a piece lies at its place or up to probes after it, and so does
        # what only begins pieces.
        self.hashes, self.ids, self.probes = np.zeros(2**18 + 64, dtype=np.uint64), np.full(2**18 + 64, -1, dtype=np.int32), 0
        for text, i in (begun | known).items():
            h = self._hash(text)
            at = start = int(h >> np.uint64(46))
            while self.ids[at] != -1:
                at += 1
            self.hashes[at], self.ids[at], self.probes = h, i, max(self.probes, at - start)

    def _hash(self, text: str) -> np.uint64:
        h = np.zeros(1, dtype=np.uint64)
        for c in mix(np.array([ord(c) for c in text], dtype=np.uint64) + np.uint64(1)):
            h = h * _P + c
        return h[0]

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """The pieces of these hashes; BEGUN for what only begins pieces, -1 for anything else."""
        at = (hashes >> np.uint64(46)).astype(np.int64)
        found = np.where(self.hashes[at] == hashes, self.ids[at], -1)
        open_ = np.nonzero((found == -1) & (self.ids[at] != -1))
        at, hashes = at[open_], hashes[open_]
        for _ in range(self.probes):
            if not len(at):
                break
            at = at + 1
            hit = self.hashes[at] == hashes
            found[tuple(x[hit] for x in open_)] = self.ids[at[hit]]
            on = ~hit & (self.ids[at] != -1)
            at, hashes, open_ = at[on], hashes[on], tuple(x[on] for x in open_)
        return found

    def starting(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that start at each character of texts of one length (rows of codes), by their length, -1 for none; and
        where a character is none itself."""
        n = codes.shape[1]
        mixed, h = mix(codes.astype(np.uint64) + np.uint64(1)), np.zeros(codes.shape, dtype=np.uint64)
        found = np.full((*codes.shape, min(self.longest, n)), -1, dtype=np.int32)
        for k in range(found.shape[2]):
            h = h[:, : n - k] * _P + mixed[:, k:]
            found[:, : n - k, k] = np.maximum(self.look_up(h), -1)
        wide = max([1, *(np.flatnonzero((found >= 0).any(axis=(0, 1))) + 1)])
        return found[:, :, :wide], found[:, :, 0] < 0

    def decode(self, ids) -> bytes:
        """The text of piece ids, in UTF-8: space signs become spaces, the one put in front goes."""
        text = b"".join(self.table.take(np.asarray(ids, dtype=np.int64)).tolist()).replace(SPACE.encode(), b" ")
        return text[1:] if text[:1] == b" " else text


def pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def normalised(text: str) -> str:
    """As the model's identity normaliser has it: a space in front, and space signs for spaces."""
    return SPACE + text.replace(" ", SPACE) if text else ""


class Lattices:
    """The lattices of distinct units, one row for each (unit, character): chances of each piece length.

    first, end: rows of a unit. cumulative, logs, ids: (rows, longest piece). Characters without a piece
    have the negative of their code as id.
    """

    def __init__(self, model: Pieces, units: list[str]) -> None:
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        # Units of one length lie side by side.
        order = np.argsort(lengths, kind="stable")
        self.end = np.empty_like(lengths)
        self.end[order] = np.cumsum(lengths[order])
        self.first = self.end - lengths
        rows, wide = int(lengths.sum()), model.longest
        self.cumulative, self.logs, self.ids = np.ones((rows, wide)), np.full((rows, wide), -np.inf), np.zeros((rows, wide), dtype=np.int32)
        self.unit_end = np.repeat(self.end[order], lengths[order])
        codes, at = np.frombuffer("".join([units[i] for i in order.tolist()]).encode("utf-32-le"), dtype="<u4"), 0
        for n, count in zip(*np.unique(lengths, return_counts=True), strict=True):
            step = max(1, 200_000 // int(n * min(n, wide)))
            for begin in range(0, count, step):
                end = at + int(n) * min(step, int(count) - begin)
                self._fill(model, codes[at:end].reshape(-1, n), at, end)
                at = end

    def _fill(self, model: Pieces, codes: np.ndarray, begin: int, end: int) -> None:
        """Rows begin to end: units of one length, which the rows of codes spell. Arrays hold them by length, place and unit."""
        units, n = codes.shape
        own = np.ascontiguousarray(codes.T).reshape(-1)
        mixed = mix(own.astype(np.uint64) + np.uint64(1))
        most = min(model.longest, n)
        found, weights = np.full((most, n * units), -1, dtype=np.int32), np.full((most, n * units), -np.inf)
        # Only what begins a piece is read on.
        at, h, wide = np.arange(n * units), np.zeros(n * units, dtype=np.uint64), 1
        for k in range(most):
            h = h * _P + mixed[at + k * units]
            got = model.look_up(h)
            held = got >= 0
            if held.any():
                places, got_ids, wide = at[held], got[held], k + 1
                found[k, places], weights[k, places] = got_ids, model.weights[got_ids]
            on = np.flatnonzero((got != -1) & (at < (n - k - 1) * units))
            at, h = at[on], h[on]
        found, weights = found[:wide], weights[:wide].reshape(wide, n, units)
        bare = np.flatnonzero(found[0] < 0)
        weights[0].reshape(-1)[bare] = model.unknown
        found[0, bare] = np.where(own[bare] < 128, model.byte_ids[np.minimum(own[bare], 127)], -own[bare].astype(np.int32))
        after = np.zeros((n + 1, units))
        cumulative = np.ones_like(weights)
        for i in range(n - 1, -1, -1):
            fit = min(wide, n - i)
            ways = weights[:fit, i] + after[i + 1 : i + 1 + fit]
            top = ways.max(axis=0)
            sums = np.exp(ways - top)
            for k in range(1, fit):
                sums[k] += sums[k - 1]
            total = sums[-1]
            after[i] = top + np.log(total)
            weights[:fit, i] = ways - after[i]
            cumulative[:fit, i] = np.where(sums >= total, 1.0, sums / total)
        np.minimum(weights, 0, out=weights)
        for into, x in ((self.cumulative, cumulative), (self.logs, weights), (self.ids, found.reshape(wide, n, units))):
            into[begin:end].reshape(units, n, -1)[:, :, :wide] = x.transpose(2, 1, 0)


def uniform(keys: np.ndarray, *more: int) -> np.ndarray:
    """Numbers in (0, 1), functions of keys and further integers."""
    for m in more:
        keys = mix(keys + np.uint64((m * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64))
    return ((keys >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53


class Draws:
    """One segmentation of each unit occurrence: rows, choices (piece length - 1) and occurrences, in order."""

    def __init__(self, lattices: Lattices, units: np.ndarray, keys: np.ndarray) -> None:
        at, end, alive, step = lattices.first[units], lattices.end[units], np.arange(len(units)), 0
        taken: list[tuple] = []
        flat, wide = lattices.cumulative.reshape(-1), lattices.cumulative.shape[1]
        counts = np.zeros(len(units), dtype=np.int64)
        while len(alive):
            rows = at[alive]
            choice, on, u, place, length = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), uniform(keys[alive], step), rows * wide, 0
            while len(on):
                more = np.flatnonzero(flat.take(place) <= u)
                on, u, place, length = on[more], u[more], place[more] + 1, length + 1
                choice[on] = length
            taken.append((alive, rows, choice))
            counts[alive] += 1
            at[alive] += choice + 1
            alive = alive[at[alive] < end[alive]]
            step += 1
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.rows, self.choices = np.zeros(self.first[-1], dtype=np.int64), np.zeros(self.first[-1], dtype=np.int64)
        self.units = np.repeat(np.arange(len(units)), counts)
        for step, (who, rows, choice) in enumerate(taken):
            place = self.first[who] + step
            self.rows[place], self.choices[place] = rows, choice


def _gumbel_below(mu: np.ndarray, top: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of location mu, given that they do not exceed top."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(mu), mu - np.logaddexp(mu - top, np.log(-np.log(u))), -np.inf)


class _Leaf:
    def __init__(self, lattices: Lattices, rows: np.ndarray, choices: np.ndarray, units: np.ndarray, value: float) -> None:
        self.rows, self.choices, self.units, self.value = rows, choices, units, value
        self.logs = lattices.logs[rows, choices]
        self.log_prob = float(self.logs.sum())


def top_k(lattices: Lattices, draws: list[Draws], low: int, high: int, key: np.uint64, numbers: np.ndarray, k: int) -> tuple[list[_Leaf], float]:
    """The k perturbed-best segmentations of unit occurrences low..high-1, best first, and the next value.

    The next value is -inf if there are no more segmentations. numbers are the key's first random
    numbers; more are drawn if they run out.
    """
    heap, leaves, ticket, used, rounds = [], [], 0, 0, 0

    def random(n: int) -> np.ndarray:
        nonlocal numbers, used, rounds
        if used + n > len(numbers):
            rounds += 1
            numbers, used = uniform(mix(np.array([key]) + np.arange(NUMBERS, dtype=np.uint64)), rounds), 0
        used += n
        return numbers[used - n : used]

    def push(values: np.ndarray, leaf: _Leaf, at: int, out: set | None = None) -> None:
        """Keeps sets that may still be taken or bound the next value; values: by the first step that differs."""
        nonlocal ticket
        most = k - len(leaves) + 1
        for i in np.argsort(-values)[:most].tolist() if len(values) > most else range(len(values)):
            if values[i] > -np.inf:
                ticket += 1
                heapq.heappush(heap, (-float(values[i]), ticket, leaf, at + i, out or ({int(leaf.choices[at + i])} if i < LOOK else None)))

    def parts(leaf: _Leaf, at: int) -> np.ndarray:
        """Log masses of what differs from leaf first at each of LOOK steps from at on, and of all beyond."""
        until = at + LOOK
        logs = leaf.logs[at:until]
        before = np.empty(len(logs) + 1)
        before[0] = leaf.logs[:at].sum()
        np.cumsum(logs, out=before[1:])
        before[1:] += before[0]
        with np.errstate(divide="ignore"):
            mu = before[:-1] + np.log(-np.expm1(logs))
            if until < len(leaf.logs):
                mu = np.append(mu, before[-1] + np.log(-np.expm1(leaf.logs[until:].sum())))
        return mu

    def take(leaf: _Leaf, at: int) -> None:
        leaves.append(leaf)
        mu = parts(leaf, at)
        if len(mu):
            push(_gumbel_below(mu, leaf.value, random(len(mu))), leaf, at)

    first, d = float(-np.log(-np.log(random(1)[0]))), draws[0]
    a, b = d.first[low], d.first[high]
    take(_Leaf(lattices, d.rows[a:b], d.choices[a:b], d.units[a:b], first), 0)
    while heap and len(leaves) < k:
        value, _, leaf, at, out = heapq.heappop(heap)
        value = -value
        if out is None:
            mu = parts(leaf, at)
            if not np.isfinite(mu).any():
                continue
            chance = np.exp(mu - mu.max())
            best = min(int(np.searchsorted(np.cumsum(chance), random(1)[0] * chance.sum(), side="right")), len(mu) - 1)
            values = _gumbel_below(mu, value, random(len(mu)))
            values[best] = value
            push(values, leaf, at)
            continue
        row, unit, d = int(leaf.rows[at]), int(leaf.units[at]), draws[len(leaves)]
        rows, choices = [], []
        chance = np.exp(lattices.logs[row])
        chance[list(out)] = 0
        choice = min(int(np.searchsorted(np.cumsum(chance), random(1)[0] * chance.sum(), side="right")), int(np.flatnonzero(chance)[-1]))
        new = choice
        while True:
            rows.append(row)
            choices.append(new)
            row += new + 1
            if row >= lattices.unit_end[rows[0]]:
                break
            new = int((lattices.cumulative[row] <= random(1)[0]).sum())
        a, b = d.first[unit + 1], d.first[high]
        own = np.array([rows, choices, [unit] * len(rows)], dtype=np.int64)
        joined = [np.concatenate((x[:at], o, y[a:b])) for x, o, y in ((leaf.rows, own[0], d.rows), (leaf.choices, own[1], d.choices), (leaf.units, own[2], d.units))]
        took = _Leaf(lattices, *joined, value)
        # What is left of the set at the step itself, and what differs from the new leaf only later.
        left, out = np.exp(lattices.logs[took.rows[at]]), out | {choice}
        left[list(out)] = 0
        if left.sum() > 0:
            mu = np.array([float(took.logs[:at].sum()) + np.log(left.sum())])
            push(_gumbel_below(mu, value, random(1)), leaf, at, out)
        take(took, at + 1)
    return leaves, -heap[0][0] if heap else -np.inf


def _ids(model: Pieces, lattices: Lattices, leaf: _Leaf) -> np.ndarray:
    ids = lattices.ids[leaf.rows, leaf.choices]
    if len(ids) and ids.min() < 0:
        places, parts, at = np.flatnonzero(ids < 0), [], 0
        for p in places.tolist():
            parts += (ids[at:p], model.byte_ids[list(chr(-ids[p]).encode())])
            at = p + 1
        ids = np.concatenate((*parts, ids[at:]))
    return ids.astype(np.int32)


def sample(model: Pieces, texts: list[str], keys: np.ndarray, k: int) -> Iterator[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k distinct encodings: (piece ids, log probability, inclusion score)."""
    split = [_UNIT.findall(normalised(t)) for t in texts]
    flat = list(chain.from_iterable(split))
    places = dict.fromkeys(flat)
    lattices = Lattices(model, list(places))
    places.update(zip(places, range(len(places)), strict=True))
    units = np.fromiter(map(places.__getitem__, flat), dtype=np.int64, count=len(flat))
    counts = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    own = mix(np.repeat(keys, counts) + mix(np.arange(len(units), dtype=np.uint64) - np.repeat(bounds[:-1], counts).astype(np.uint64)))
    draws = [Draws(lattices, units, mix(own + np.uint64(s + 1))) for s in range(k)]
    numbers = uniform(mix(keys[:, None] + np.arange(NUMBERS, dtype=np.uint64)), 0)
    for i in range(len(texts)):
        leaves, bound = top_k(lattices, draws, bounds[i], bounds[i + 1], keys[i], numbers[i], k)
        yield [(_ids(model, lattices, leaf), leaf.log_prob, float(-np.expm1(-np.exp(min(leaf.log_prob - bound, 50.0)))) if bound > -np.inf else 1.0) for leaf in leaves]


def _sampled(batches: Iterator[pa.RecordBatch], path: str, k: int, seed: int, with_pieces: bool) -> Iterator[pa.RecordBatch]:
    model = pieces(path)
    for batch in batches:
        ids, texts = batch.column("doc_id"), [t or "" for t in batch.column("text").to_pylist()]
        keys = mix(batch.column("key").to_numpy().view(np.uint64) + np.uint64(seed))
        for a, b in chunks(list(map(len, texts)), AT_ONCE):
            out: list[tuple] = []
            for i, found in zip(range(a, b), sample(model, texts[a:b], keys[a:b], k), strict=True):
                whole = texts[i].replace(SPACE, " ").encode()
                for rank, (got, log_prob, inclusion) in enumerate(found, 1):
                    out.append((i, rank, got, len(got), zlib.crc32(got.astype("<i4").tobytes()), log_prob, inclusion, model.decode(got) == whole))
            cols = list(zip(*out, strict=True)) if out else [()] * 8
            names, arrays = ["doc_id", "rank"], [ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32())]
            if with_pieces:
                names.append("pieces")
                starts = np.concatenate(([0], np.cumsum(cols[3]))).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(cols[2]) if out else np.zeros(0, np.int32), pa.int32())))
            names += ["n_pieces", "ids_crc32", "log_prob", "inclusion", "decodes"]
            arrays += [pa.array(c, t) for c, t in zip(cols[3:], (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)


def sampled_pieces(docs: DataFrame, model: str, k: int = 2, seed: int = 0, with_pieces: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Up to k distinct segmentations of every whole text: doc_id, rank, pieces (if asked for), n_pieces,
    ids_crc32 (of the ids as little-endian 32-bit integers), log_prob, inclusion, decodes.

    rank 1 is an exact sample, ranks 1 to k one without replacement. inclusion is the chance to be among
    the k given the next value, for weighting; it is 1 where there are no more segmentations. decodes says
    that the pieces decode to the text. Null and empty texts have one segmentation, of no pieces. The
    row's key is its id, or for a null id its text, so rows that repeat both come out the same.
    """
    bounded_batches(docs.sparkSession)
    key = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("long"))).otherwise(F.xxhash64(F.coalesce(text_col, F.lit(""))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), F.col(text_col).alias("text"))
    schema = f"doc_id long, rank int, {'pieces array<int>, ' if with_pieces else ''}n_pieces long, ids_crc32 long, log_prob double, inclusion double, decodes boolean"
    return rows.mapInArrow(partial(_sampled, path=model, k=k, seed=seed, with_pieces=with_pieces), schema)
