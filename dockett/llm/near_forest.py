"""Near duplicates at a share of common shingles, by a forest of vantage-point trees over wide SimHashes.

Two texts that share four fifths of their five-word shingles differ in about 15 % of their fingerprint's
bits. At such a radius a single vantage point prunes nothing, as all distances from it are much alike. So
fingerprints have 256 bits, which keeps unrelated texts (half of the bits, give or take a thirtieth) apart at any
corpus size, a node has many vantage points, and a fingerprint goes to the shard of the nearest, and by the
triangle bound also to those of others that are as near but for MARGIN. A pair that one tree parts meets in
another: their number grows with the shards, about as the fourth root, so that a pair is missed by all with a
chance of about MISS.

Fingerprints only propose pairs; whether two texts are similar is decided by their sets of shingles. First
a shard proposes stars around leaders that lie more than the radius apart, so a large group of copies is
not paired with itself. Then all pairs within the radius are compared that lie in different groups still: one
by one where they are few, and where texts have many of them, as a family of nearly similar texts, by bringing
the texts' sets together in tiles. A tile hands over only links that hold, and of these no more than join its texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_LAST, by_others, chunks, dealt_join, materialize, mix
from .simhash import SEED, components

WORDS, SHINGLE = 4, 5
BITS = 64 * WORDS
#: Own fingerprints in a shard, vantage points of a node, levels that are routed before the shards are formed (more are
#: grown inside the shards that need them), the sample they are taken from (2 MB), and fingerprints compared at once.
SHARD, WIDE, ROUTED, SAMPLE, BLOCK = 512, 256, 2, 65_536, 256
#: Bits that another vantage point may lie further off than the nearest for its shard to be visited too; the chance
#: that two fingerprints NEAR bits apart meet at a node of n points, MEET * n ** -FADE (measured in the tests); the
#: wanted chance that all trees part them.
MARGIN, NEAR, MEET, FADE, MISS = 2, 46, 0.9, 0.165, 0.01

#: Pairs for each text of a part up to which they are handed over one by one; texts of a tile beyond that, shingles of a
#: tile's texts (8 MB), and shingles counted at once.
FEW, TILE, TILE_SHINGLES, AT_ONCE = 4, 512, 1 << 20, 4096

#: A text's own row: its id and the digest of the text; of equal sets of shingles the smallest stands for all.
NODE = "struct<did: long, th: long>"


def radius_of(similarity: float) -> int:
    """Differing bits up to which texts count as similar: what is expected at that Jaccard similarity of
    shingles (its cosine is 2J / (1 + J)), and 3 standard deviations for the noise of the bits."""
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(BITS * apart + 3 * math.sqrt(BITS * apart * (1 - apart)))


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted digests of a text's distinct shingles."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, n = memoryview(b" ".join(words)), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, n)
    digest, first, last = xxhash.xxh64_intdigest, starts[: n - k + 1].tolist(), ends[k - 1 :].tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), dtype=np.uint64, count=len(first)))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """The SimHash of distinct shingles: each counts once, however often it stands in the text."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(own), 16_384):
        h = own[at : at + 16_384]
        wide = np.stack([h, *[mix(h + np.uint64(i)) for i in range(1, WORDS)]], axis=1)
        bits = np.unpackbits(wide.view(np.uint8), axis=1)
        for part in range(0, len(bits), 255):  # sums of up to 255 bits fit a byte
            counts += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(own)).view(np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py() or b"", shingle) for t in batch.column("text").cast(pa.binary())]
        columns = [pa.array([fingerprint(x).tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int32())]
        whole = pa.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) - 2**63 for x in sets], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("did"), batch.column("th"), *columns, whole], names=["did", "th", "fp", "size", "whole"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py() or b"", shingle).tobytes() for t in batch.column("text").cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "own"])


def away(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints (last axis: words)."""
    out = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for i in range(1, WORDS):
        out += np.bitwise_count(a[..., i] ^ b[..., i])
    return out


def widths_of(n: int) -> list[int]:
    """Vantage points of the nodes of each level that cut n fingerprints into shards."""
    parts, widths = -(-n // SHARD), []
    while parts > 1:
        widths.append(min(WIDE, parts))
        parts = -(-parts // WIDE)
    return widths


def trees_for(widths: list[int]) -> int:
    """Trees until a pair NEAR bits apart is missed by all with chance MISS."""
    meet = math.prod(min(0.98, MEET * n**-FADE) for n in widths)
    return math.ceil(math.log(MISS) / math.log(1 - meet)) if widths else 1


def nearest(fps: np.ndarray, points: np.ndarray, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in fps, place in points) of every visit: the nearest point, and those as near but for the margin. points has
    a row of points for all, or one for each fingerprint."""
    at, to = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    for i in range(0, len(fps), BLOCK):
        d = away(fps[i : i + BLOCK, None], points[None] if points.ndim == 2 else points[i : i + BLOCK])
        a, b = np.nonzero(d <= d.min(axis=1, keepdims=True) + margin)
        at.append(a + i)
        to.append(b)
    return np.concatenate(at), np.concatenate(to)


def grow(sample: np.ndarray, widths: list[int], seed: int) -> list[np.ndarray]:
    """The vantage points of a tree's first levels, drawn from a sample: (n, words) and, below, (n, m, words)."""
    rng = np.random.default_rng(seed)
    tree = [sample[rng.choice(len(sample), size=widths[0], replace=len(sample) < widths[0])]]
    if len(widths) > 1:
        own = np.zeros(len(sample), dtype=np.int64)
        for i in range(0, len(sample), BLOCK):
            own[i : i + BLOCK] = away(sample[i : i + BLOCK, None], tree[0][None]).argmin(axis=1)
        parts = [sample[own == c] for c in range(widths[0])]
        parts = [p if len(p) >= widths[1] else sample for p in parts]
        tree.append(np.stack([p[rng.choice(len(p), size=widths[1], replace=len(p) < widths[1])] for p in parts]))
    return tree


def route(fps: np.ndarray, tree: list[np.ndarray], margin: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in fps, shard) of every visit."""
    at, shard = nearest(fps, tree[0], margin)
    if len(tree) > 1:
        step, parts = 1 << 14, []
        for i in range(0, len(at), step):
            a, to = nearest(fps[at[i : i + step]], tree[1][shard[i : i + step]], margin)
            parts.append((at[i + a], shard[i + a] * tree[1].shape[1] + to))
        at, shard = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    return at, shard


_TREES: dict[tuple[bytes, int], list[np.ndarray]] = {}


def _visits(batches: Iterator[pa.RecordBatch], sample: bytes, widths: list[int], trees: int) -> Iterator[pa.RecordBatch]:
    points, name = np.frombuffer(sample, dtype=np.uint64).reshape(-1, WORDS), hashlib.sha256(sample).digest()
    for batch in batches:
        fps = np.frombuffer(b"".join(batch.column("fp").to_pylist()), dtype=np.uint64).reshape(-1, WORDS)
        for tree in range(trees):
            if widths:
                # Trees follow from the sample, so each worker grows its own; those of another table make room.
                if (name, tree) not in _TREES:
                    if _TREES and next(iter(_TREES))[0] != name:
                        _TREES.clear()
                    _TREES[name, tree] = grow(points, widths, tree)
                at, shard = route(fps, _TREES[name, tree], MARGIN)
            else:
                at, shard = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(shard + (tree << 32)), *[c.take(take) for c in batch.columns]], names=["shard", *batch.schema.names])


def near(fps: np.ndarray, sizes: np.ndarray, i: slice | np.ndarray, j: slice | np.ndarray, radius: int, similarity: float) -> np.ndarray:
    """Which of i and j may be similar: within the radius, and of sizes that allow that share."""
    a, b = sizes[i][:, None], sizes[j][None]
    return (away(fps[i][:, None], fps[j][None]) <= radius) & (np.minimum(a, b) / np.maximum(a, b) >= similarity)


def stars(fps: np.ndarray, sizes: np.ndarray, radius: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(leader, member) places of a shard: leaders are not near each other, and each with others near it has a
    link; every place with others near it stands in a link."""
    linked = np.zeros(len(fps), dtype=bool)
    for i in range(0, len(fps), BLOCK):
        for j in range(i, len(fps), 4 * BLOCK):
            found = near(fps, sizes, slice(i, i + BLOCK), slice(j, j + 4 * BLOCK), radius, similarity)
            if j <= i < j + 4 * BLOCK:
                own = np.arange(min(BLOCK, len(fps) - i))
                found[own, own + i - j] = False
            linked[i : i + BLOCK] |= found.any(axis=1)
            linked[j : j + 4 * BLOCK] |= found.any(axis=0)
    rest, leaders, members = np.flatnonzero(linked), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    claimed = np.zeros(len(fps), dtype=bool)
    for leader in rest:
        if not claimed[leader]:
            own = rest[near(fps, sizes, np.array([leader]), rest, radius, similarity)[0]]
            own = own[own != leader]
            claimed[own] = True
            leaders.append(np.full(len(own), leader))
            members.append(own)
    return np.concatenate(leaders), np.concatenate(members)


def across(fps: np.ndarray, sizes: np.ndarray, roots: np.ndarray, radius: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places near each other that have different roots, in pieces."""
    for i in range(0, len(fps), BLOCK):
        for j in range(i, len(fps), 4 * BLOCK):
            found = near(fps, sizes, slice(i, i + BLOCK), slice(j, j + 4 * BLOCK), radius, similarity) & (roots[i : i + BLOCK, None] != roots[None, j : j + 4 * BLOCK])
            a, b = np.nonzero(found)
            yield (a + i)[a + i < b + j], (b + j)[a + i < b + j]


def tiles(sizes: np.ndarray) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(name, places, sides) of tiles in which any two places meet once: those of one range (sides are all 0), or of two."""
    ranges = list(chunks([max(int(n), TILE_SHINGLES // TILE) for n in sizes], TILE_SHINGLES))
    for i, (a, b) in enumerate(ranges):
        yield f"{i}", np.arange(a, b), np.zeros(b - a, dtype=np.int32)
        for j, (c, d) in enumerate(ranges[i + 1 :], i + 1):
            yield f"{i} {j}", np.concatenate((np.arange(a, b), np.arange(c, d))), np.repeat(np.array([0, 1], dtype=np.int32), (b - a, d - c))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Shingles that any two of the sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    shared = np.flatnonzero(held[column] > 1)
    column = (np.cumsum(held > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[shared][order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, AT_ONCE):
        a, b = np.searchsorted(column, (at, at + AT_ONCE))
        part = np.zeros((len(sets), AT_ONCE), dtype=np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        out += part @ part.T
    return out


def forest(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one, other): as few of the links of a symmetric table as join what all of them join."""
    open_, one, other = held.any(axis=1), [], []
    while open_.any():
        edge = np.flatnonzero(open_)[:1]
        open_[edge] = False
        while len(edge):
            met = held[edge] & open_
            new = np.flatnonzero(met.any(axis=0))
            one.append(edge[met[:, new].argmax(axis=0)])
            other.append(new)
            open_[new] = False
            edge = new
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *one]), np.concatenate([none, *other])


def _similar(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = np.zeros(len(batch), dtype=bool)
        for n, (a, b) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
            x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
            both = np.sort(np.concatenate((x, y)))
            common = int((both[1:] == both[:-1]).sum())
            held[n] = common / (len(both) - common) >= similarity
        yield batch.select(["u", "v"]).filter(pa.array(held))


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the distinct pairs (u, v) whose sets (node, own) share enough. Pairs of a text that has many are dealt
    over several copies of its set."""
    own = lambda side, name: sets.select(F.col("node").alias(side), F.col("own").alias(name))
    both = dealt_join(dealt_join(pairs, own("u", "a"), ["u"], by=["v"]), own("v", "b"), ["v"], by=["u"], counted=pairs)
    return both.select("u", "v", "a", "b").mapInArrow(partial(_similar, similarity=similarity), f"u {NODE}, v {NODE}")


def divided(fps: np.ndarray, widths: list[int], seed: int) -> Iterator[np.ndarray]:
    """Places of the parts of a shard that further levels, grown on the shard itself, make."""
    if not widths or len(fps) <= SHARD:
        yield np.arange(len(fps))
        return
    at, part = nearest(fps, grow(fps, widths[:1], seed)[0], MARGIN)
    order = np.argsort(part, kind="stable")
    for own in np.split(at[order], np.flatnonzero(np.diff(part[order])) + 1):
        for inner in divided(fps[own], widths[1:], seed + 1):
            yield own[inner]


class Found(NamedTuple):
    """What near_pairs comes to: rows (did, th, fp, size, whole), classes (the same key, low) and links (u, v) of lows."""

    rows: DataFrame
    classes: DataFrame
    links: DataFrame


def near_pairs(docs: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str) -> Found:
    radius = radius_of(similarity)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_LAST)).alias("did"), F.xxhash64(text_col).alias("th"), F.coalesce(text_col, F.lit("")).alias("text"))
    fps = materialize(rows.mapInArrow(partial(_fingerprints, shingle=shingle), "did long, th long, fp binary, size int, whole long"), "wide-fingerprints")
    # Texts of one set of shingles are one node.
    classes = materialize(fps.groupBy(*KEY).agg(F.min(F.struct("did", "th")).alias("low")), "wide-classes")
    real = classes.filter("size > 0").select(F.col("low").alias("node"), "fp", "size")
    n = real.count()
    widths = widths_of(n)
    share = min(1.0, SAMPLE / max(n, 1))
    digest = F.xxhash64("fp", F.lit(1))
    pick = real.filter(digest <= F.lit(int(share * (2**64 - 1)) - 2**63)) if share < 1 else real
    drawn = pick.select("fp").orderBy(digest, "fp").limit(2 * SAMPLE).collect()
    sample = b"".join(sorted(bytes(r.fp) for r in drawn))

    def columns(shard: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Table]:
        node = shard.column("node").combine_chunks()
        order = pa.array(np.lexsort((node.field("th").to_numpy(), node.field("did").to_numpy())))
        shard = shard.take(order).combine_chunks()
        return np.frombuffer(b"".join(shard.column("fp").to_pylist()), dtype=np.uint64).reshape(-1, WORDS), shard.column("size").to_numpy(), shard.column("node").combine_chunks(), shard

    def table(nodes: pa.Array, one: list, other: list) -> pa.Table:
        u, v = (nodes.take(pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *x]))) for x in (one, other))
        return pa.table([u, v], names=["u", "v"])

    def led(shard: pa.Table) -> pa.Table:
        own, sizes, nodes, _ = columns(shard)
        one, other = [], []
        for at in divided(own, widths[ROUTED:], shard.column("shard")[0].as_py()):
            leaders, members = stars(own[at], sizes[at], radius, similarity)
            one.append(at[leaders])
            other.append(at[members])
        return table(nodes, one, other)

    def numbers(root: pa.Array) -> np.ndarray:
        return np.unique(np.rec.fromarrays([root.field(f).to_numpy() for f in ("did", "th")]), return_inverse=True)[1].reshape(-1)

    def parted(shard: pa.Table) -> pa.Table:
        """Pairs (u, v) where they are few; else texts u of a tile, with their side of it."""
        own, sizes, nodes, whole = columns(shard)
        roots, name = numbers(whole.column("root").combine_chunks()), shard.column("shard")[0].as_py()
        one, other, tile, side = [], [], [], []
        for part, at in enumerate(divided(own, widths[ROUTED:], name)):
            crowd, pairs, n = np.zeros(len(at), dtype=bool), [], 0
            for a, b in across(own[at], sizes[at], roots[at], radius, similarity):
                crowd[a] = crowd[b] = True
                n += len(a)
                if n > FEW * len(at):
                    pairs.clear()
                else:
                    pairs.append((at[a], at[b]))
            at = at[crowd]
            if n <= FEW * len(at):
                for a, b in pairs:
                    one.append(a)
                    other.append(b)
                    tile += [None] * len(a)
                    side.append(np.zeros(len(a), dtype=np.int32))
            else:
                for label, places, sides in tiles(sizes[at]):
                    one.append(at[places])
                    other.append(np.full(len(places), -1))
                    tile += [f"{name} {part} {label}"] * len(places)
                    side.append(sides)
        u, v = (np.concatenate([np.zeros(0, dtype=np.int64), *x]) for x in (one, other))
        return pa.table([nodes.take(pa.array(u)), nodes.take(pa.array(v, mask=v < 0)), pa.array(tile, pa.string()), np.concatenate([np.zeros(0, dtype=np.int32), *side])], names=["u", "v", "tile", "side"])

    def tiled(tile: pa.Table) -> pa.Table:
        """Links of a tile that hold, as many as join its texts."""
        own, sizes, nodes, whole = columns(tile)
        roots, side = numbers(whole.column("root").combine_chunks()), whole.column("side").to_numpy()
        every = slice(None)
        asked = near(own, sizes, every, every, radius, similarity) & (roots[:, None] != roots)
        if side.any():
            asked &= side[:, None] != side
        common = common_counts([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in whole.column("own").combine_chunks()])
        one, other = forest(asked & (common / (sizes[:, None] + sizes - common) >= similarity))
        return table(nodes, [one], [other])

    def visits(nodes: DataFrame, more: str = "") -> DataFrame:
        return nodes.mapInArrow(partial(_visits, sample=sample, widths=widths[:ROUTED], trees=trees_for(widths)), f"shard long, node {NODE}, fp binary, size int{more}").groupBy("shard")

    pair = f"u {NODE}, v {NODE}"
    first = materialize(visits(real).applyInArrow(led, pair).distinct(), "star-pairs")
    near_some = materialize(first.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(real, "node"), "near-some")
    # A row stands once, however often it repeats.
    texts = rows.join(near_some.select("node.did", "node.th", "node"), ["did", "th"]).select("node", "text").dropDuplicates(["node"])
    sets = materialize(texts.mapInArrow(partial(_sets, shingle=shingle), f"node {NODE}, own binary"), "shingles")
    links = materialize(similar(first, sets, similarity), "star-links")
    groups = near_some.join(components(links), "node", "left").select("node", "fp", "size", F.coalesce("root", "node").alias("root"))
    asked = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    groups = materialize(groups, "near-groups")
    parts = materialize(visits(groups, f", root {NODE}").applyInArrow(parted, f"{pair}, tile string, side int"), "parted-pairs")
    second = materialize(parts.filter("tile is null").select("u", "v").distinct().join(asked, ["u", "v"], "left_anti"), "few-pairs")
    met = parts.filter("tile is not null").select(F.col("u").alias("node"), "tile", "side").join(groups, "node").join(sets, "node")
    crowded = met.groupBy("tile").applyInArrow(tiled, pair)
    return Found(fps, classes, materialize(links.union(similar(second, sets, similarity)).union(crowded), "near-links"))


KEY = ["fp", "size", "whole"]


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: did, th, component_id; did is the id (null: a value that sorts last), th a
    digest of the text, component_id the smallest did of what is connected by similar texts: those whose sets
    of shingles share at least the similarity.

    Texts without words (null ones too) are similar to each other only; texts of any length are taken whole.
    Rows that repeat an id are taken by their texts. Ties do not arise: components do not depend on an order.
    An empty table gives no rows; further columns, whatever their names, are ignored.
    """
    found = near_pairs(docs, similarity, shingle, id_col, text_col)
    roots = components(found.links)
    placed = found.classes.join(roots, F.col("low") == F.col("node"), "left").select(*KEY, F.coalesce("root", "low").alias("root"))
    return dealt_join(found.rows, placed, KEY).select("did", "th", F.col("root.did").alias("component_id"))


def near_dedup(docs: DataFrame, similarity: float = 0.8, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near duplicates; all columns as they were.

    The row of the smallest id stays (null ids come last, equal ids by a digest of the text), so unrelated
    rows that repeat an id or have none all stay. Of rows that repeat both id and text one stays, by a digest
    of their other columns. Texts without words, null ones too, form one group. Columns of any name are kept.
    """
    names = docs.columns
    found = near_pairs(docs, similarity, shingle, id_col, text_col)
    # Every class stays by its smallest row unless a component's root is another one.
    others = components(found.links).filter("node <> root").select(F.col("node").alias("low"))
    kept = found.classes.join(others, "low", "left_anti").select("low.did", "low.th")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_LAST)).alias("did"), F.xxhash64(text_col).alias("th"), by_others(names, [id_col, text_col]).alias("by"))
    once = keyed.join(kept, ["did", "th"], "left_semi").groupBy("did", "th").agg(F.min_by("__row", "by").alias("__row"))
    return once.select([F.col(f"__row.`{c}`").alias(c) for c in names])
