"""SimHash near-duplicates found by vantage-point trees over fingerprints.

Fingerprints are collapsed to distinct ones first. A vantage-point tree, grown on a bounded sample, cuts
Hamming space into shards: a fingerprint within the node's radius of its vantage point goes inside, any
other outside; one whose distance lies less than the search radius below the node's radius goes to both.
By the triangle inequality the distances of two linked fingerprints from a vantage point differ by the
search radius at most, so each linked pair meets in at least one shard. A shard reports its own connected
parts as stars, never as pairs, and the stars are joined by alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_LAST, dealt_join, drop, materialize

#: Own fingerprints in a shard, the deepest tree, and the sample it is grown on (2 MB). Beyond 2**16 shards of
#: this size a shard grows with the input and is divided further inside its task.
SHARD, DEPTH, SAMPLE = 1024, 16, 1 << 18
#: Fingerprints compared block by block; above this, a shard is divided by local vantage points.
BLOCK, LOCAL = 512, 16_384
SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    """The 64-bit SimHash of a text's word shingles, A-Z lower-cased; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = memoryview(b" ".join(words)), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, n)
    digest, total, counts = xxhash.xxh64_intdigest, n - k + 1, np.zeros(64, dtype=np.int64)
    first, last = starts[:total].tolist(), ends[k - 1 :].tolist()
    for at in range(0, total, 65_536):
        part = zip(first[at : at + 65_536], last[at : at + 65_536], strict=True)
        values = np.array([digest(joined[a:b], SEED) for a, b in part], dtype=">u8")
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        found = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), dtype=np.uint64, count=len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; null and wordless texts have 0."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, fp long")


def grow(sample: np.ndarray, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete binary tree, node i above 2i+1 and 2i+2.

    Of a few candidates the vantage point is taken that sends the fewest of the sample both ways.
    """
    n = 2**depth - 1
    points, radii = np.zeros(n, dtype=np.uint64), np.full(n, 32, dtype=np.int64)
    parts = {0: sample}
    rng = np.random.default_rng(7)
    for node in range(n):
        own = parts.pop(node)
        if len(own) == 0:
            own = sample
        best = None
        for point in rng.choice(own, size=min(8, len(own)), replace=False):
            away = np.bitwise_count(own ^ point).astype(np.int64)
            middle = int(np.median(away))
            both = ((away > middle - radius) & (away <= middle)).mean() + abs((away <= middle).mean() - 0.5)
            if best is None or both < best[0]:
                best = (both, point, middle, away)
        _, points[node], radii[node], away = best
        parts[2 * node + 1], parts[2 * node + 2] = own[away <= radii[node]], own[away > radii[node]]
    return points, radii


def route(fps: np.ndarray, points: np.ndarray, radii: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in fps, shard) of every visit."""
    at, node = np.arange(len(fps)), np.zeros(len(fps), dtype=np.int64)
    for _ in range(len(points).bit_length()):
        away = np.bitwise_count(fps[at] ^ points[node]).astype(np.int64)
        inside = away <= radii[node]
        outside = away > radii[node] - radius
        at = np.concatenate((at[inside], at[outside]))
        node = np.concatenate((2 * node[inside] + 1, 2 * node[outside] + 2))
    return at, node - len(points)


def _linked(fps: np.ndarray, radius: int) -> np.ndarray:
    """Which fingerprints have another within the radius."""
    found = np.zeros(len(fps), dtype=bool)
    for i in range(0, len(fps), BLOCK):
        for j in range(i, len(fps), 8 * BLOCK):
            near = np.bitwise_count(fps[i : i + BLOCK, None] ^ fps[None, j : j + 8 * BLOCK]) <= radius
            if j <= i < j + 8 * BLOCK:
                own = np.arange(min(BLOCK, len(fps) - i))
                near[own, own + i - j] = False
            found[i : i + BLOCK] |= near.any(axis=1)
            found[j : j + 8 * BLOCK] |= near.any(axis=0)
    return found


def stars(fps: np.ndarray, radius: int, level: int = 0) -> Iterator[tuple[np.ndarray, int]]:
    """(members, centre) of the connected parts of distinct fingerprints, each larger than one.

    Above LOCAL fingerprints, parts of parts: they share members where they belong together.
    """
    if len(fps) > LOCAL and level < 40:
        points, radii = grow(np.random.default_rng(level).choice(fps, size=2048, replace=False), 1, radius)
        at, side = route(fps, points, radii, radius)
        parts = [fps[at[side == s]] for s in (0, 1)]
        if max(map(len, parts)) < 0.95 * len(fps):
            for part in parts:
                yield from stars(part, radius, level + 1)
            return
    rest = np.sort(fps[_linked(fps, radius)])
    while len(rest):
        centre, edge, rest, members = rest[0], rest[:1], rest[1:], [rest[:1]]
        while len(edge) and len(rest):
            near = np.zeros(len(rest), dtype=bool)
            for i in range(0, len(edge), BLOCK):
                left = np.flatnonzero(~near)
                for j in range(0, len(left), 8 * BLOCK):
                    take = left[j : j + 8 * BLOCK]
                    near[take] = (np.bitwise_count(edge[i : i + BLOCK, None] ^ rest[None, take]) <= radius).any(axis=0)
            edge, rest = rest[near], rest[~near]
            members.append(edge)
        yield np.concatenate(members), centre


#: A class of equal fingerprints by its smallest id (none: no row has one) and the fingerprint itself.
NODE = "struct<none: int, id: long, fp: long>"


def _visits(batches: Iterator[pa.RecordBatch], points: np.ndarray, radii: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node = pa.StructArray.from_arrays(batch.columns, names=["none", "id", "fp"])
        at, shard = route(batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64), points, radii, radius)
        yield pa.RecordBatch.from_arrays([pa.array(shard), node.take(pa.array(at))], names=["shard", "node"])


def _shard_stars(shard: pa.Table, radius: int) -> pa.Table:
    nodes = shard.column("node").combine_chunks()
    fps = nodes.field("fp").to_numpy().view(np.uint64)
    order = np.argsort(fps)
    found = [(m, np.full(len(m), c)) for m, c in stars(fps, radius)]
    members, centres = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=np.uint64) for i in (0, 1))
    apart = members != centres
    sides = [nodes.take(pa.array(order[np.searchsorted(fps[order], x[apart])])) for x in (members, centres)]
    return pa.table(sides, names=["u", "v"])


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) between nodes (columns none, id, fp of distinct fingerprints) that join all within radius of each other."""
    n = distinct.count()
    depth = min(DEPTH, max(0, n // SHARD).bit_length())
    # A uniform sample: fingerprints with the smallest digests.
    share = min(1.0, SAMPLE / max(n, 1))
    pick = distinct.filter(F.xxhash64("fp", F.lit(1)) <= F.lit(int(share * (2**64 - 1)) - 2**63)) if share < 1 else distinct
    # Sorted before the bound is put on it, so that every run takes the same.
    sample = np.array([r.fp for r in pick.select("fp").orderBy(F.xxhash64("fp", F.lit(1)), "fp").limit(2 * SAMPLE).collect()], dtype=np.int64)
    sample = np.sort(sample.view(np.uint64))
    points, radii = grow(sample, depth, radius) if len(sample) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    visits = distinct.select("none", "id", "fp").mapInArrow(partial(_visits, points=points, radii=radii, radius=radius), f"shard long, node {NODE}")

    def linked(shard: pa.Table) -> pa.Table:
        return _shard_stars(shard, radius)

    return visits.groupBy("shard").applyInArrow(linked, f"u {NODE}, v {NODE}")


def components(links: DataFrame) -> DataFrame:
    """(node, root): for every node of undirected links (u, v) the smallest node reachable. Nodes are of any type
    that sorts.

    Large-star and small-star steps alternate, each a group and a join, until the links stay as they are. A
    node of very many links is dealt over several tasks; links that a step has replaced are deleted.
    """
    edges = materialize(links.select(F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")).filter("low <> high").distinct(), "links")

    def seen(links: DataFrame):
        return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("low", "high").cast("decimal(20,0)"))).first()

    state = seen(edges)
    while True:
        both = edges.select("low", "high").union(edges.select(F.col("high").alias("low"), F.col("low").alias("high"))).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = materialize(dealt_join(both, least, ["node"]).filter("other > node").select(F.col("other").alias("high"), F.col("m").alias("low")).distinct(), "large-star")
        lows = large.groupBy("high").agg(F.min("low").alias("m"))
        small = dealt_join(large, lows, ["high"]).select(F.explode(F.array(F.struct(F.col("low").alias("high"), F.col("m").alias("low")), F.struct("high", F.col("m").alias("low")))).alias("e")).select("e.low", "e.high")
        before, edges = edges, materialize(small.filter("low <> high").distinct(), "links")
        drop(before)
        drop(large)
        now = seen(edges)
        if now == state:
            return edges.select(F.col("high").alias("node"), F.col("low").alias("root"))
        state = now


def near_groups(docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fp (signed), component_id.

    Texts whose fingerprints differ in at most radius bits are linked; component_id is the smallest
    doc_id reachable. Null texts and texts without words have fingerprint 0 and are linked like any
    other. A null doc_id keeps its row and never becomes a component_id unless no row there has an id
    (then component_id is null). Equal ids share their component only through their fingerprints.
    """
    return grouped(materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints"), radius)


def grouped(fps: DataFrame, radius: int) -> DataFrame:
    """near_groups for ready (doc_id, fp) rows."""
    # A class is known by its smallest id, so the smallest node of a component brings the component's id along.
    low = F.min("doc_id")
    classes = materialize(fps.groupBy("fp").agg(low.isNull().cast("int").alias("none"), F.coalesce(low, F.lit(NULL_LAST)).alias("id")), "fingerprint-classes")
    roots = components(near_links(classes, radius)).select(F.col("node.fp").alias("fp"), "root")
    first = F.coalesce("root", F.struct("none", "id", "fp"))
    placed = classes.join(roots, "fp", "left").select("fp", first.alias("first")).select("fp", F.when(F.col("first.none") == 0, F.col("first.id")).alias("component_id"))
    return dealt_join(fps, placed, ["fp"]).select("doc_id", "fp", "component_id")
