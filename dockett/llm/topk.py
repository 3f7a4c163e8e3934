"""Exact top-k by inner product: tiles of queries times tiles of vectors.

Vectors are packed once into tiles of rows, each a file in the shared folder. Pairs of a query tile and a group
of vector tiles are dealt out as paths, so vectors move only from the shared folder to the task that multiplies
them, and a lost executor costs its pairs alone. A task multiplies blocks of its query tile with each tile of
its group, keeps k candidates a query and tile, and merges them as it goes along; what the groups keep is
merged in a tree, FAN lists of a query at a time.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, shared_path
from .sstable import open_fs

#: Most rows of a query tile and its most bytes (as doubles), rows of a block of it and of a vector tile, most vector tiles
#: of a group, and lists merged at once. A task holds one query tile and one vector tile at a time; each query tile meets
#: all vectors once, so the larger it is, the less is read.
QUERY_ROWS, QUERY_BYTES, BLOCK_ROWS, TILE_ROWS, GROUP, FAN = 1 << 17, 64 << 20, 2048, 4096, 64, 64
#: Partitions that pairs of tiles are dealt over at most.
MOST_TASKS = 100_000
_TILE = "tile long, path string"
_KEPT = "query_id long, group long, vec_id long, score long"
_HEAD = struct.Struct("<QQ3s")
_MOST = 2**63 - 1


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of doubles; shorter vectors end in zeros."""
    lengths = np.asarray(vectors.value_lengths())
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def _pack(rows: pa.Table, folder: str) -> pa.Table:
    """Writes a tile's vectors by rising id, in the smallest type that holds them; tiles are bounded."""
    rows = rows.combine_chunks()
    m, ids = _matrix(rows.column("v").chunk(0)), rows.column("vec_id").to_numpy().astype("<i8")
    order = np.argsort(ids, kind="stable")
    size = np.abs(m).max(initial=0)
    kind = "<i2" if size < 2**15 else "<i4" if size < 2**31 else "<f8"
    tile = rows.column("tile")[0].as_py()
    path = f"{folder}/tile-{tile}-{uuid.uuid4().hex}"
    fs, at = open_fs(path)
    fs.create_dir(at.rpartition("/")[0])
    with fs.open_output_stream(at) as out:
        out.write(_HEAD.pack(len(ids), m.shape[1], kind.encode()) + ids[order].tobytes())
        out.write(m[order].astype(kind).tobytes())
    return pa.table([pa.array([tile], pa.int64()), pa.array([path])], names=["tile", "path"])


def _open(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a tile, the latter in their stored type."""
    fs, at = open_fs(path)
    with fs.open_input_stream(at) as f:
        data = f.read()
    n, wide, kind = _HEAD.unpack_from(data)
    return np.frombuffer(data, dtype="<i8", count=n, offset=_HEAD.size), np.frombuffer(data, dtype=kind.decode(), count=n * wide, offset=_HEAD.size + 8 * n).reshape(n, wide)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole-numbered doubles; beyond +-(2**63 - 1) they stay there."""
    n = min(a.shape[1], b.shape[1])
    a, b = a[:, :n], b[:, :n]
    if n * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, -_MOST, _MOST).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of scores (a row a query, a column an id, ids rising) the k best of each row, ties to smaller ids.

    A row's own id takes no part; places that nothing fills have score -(2**63 - 1) and id 2**63 - 1.
    """
    columns = scores.shape[1]
    if not scores.size:
        return np.full((len(scores), 0), -_MOST), np.full((len(scores), 0), _MOST)
    wide = max(int(scores.max()), -int(scores.min())) >= 2**62 // columns
    rank = scores.astype(object) if wide else scores
    key = rank * columns + (columns - 1 - np.arange(columns))
    mine = ids[None, :] == own[:, None]
    key[mine] = -(2**90) if wide else -(2**63)
    take = np.argsort(-key, axis=1)[:, :k] if wide else np.argpartition(key, max(0, columns - k), axis=1)[:, max(0, columns - k) :]
    gone = np.take_along_axis(mine, take, 1)
    return np.where(gone, -_MOST, np.take_along_axis(scores, take, 1)), np.where(gone, _MOST, ids[take])


def _multiplied(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, q = _open(row["query"])
            kept = [(np.full((len(ids[a : a + BLOCK_ROWS]), 0), -_MOST), np.full((len(ids[a : a + BLOCK_ROWS]), 0), _MOST)) for a in range(0, len(ids), BLOCK_ROWS)]
            for path in row["paths"]:
                vec, v = _open(path)
                v = v.astype(np.float64)
                for i, (scores, found) in enumerate(kept):
                    own = slice(i * BLOCK_ROWS, (i + 1) * BLOCK_ROWS)
                    more, new = select(inner(q[own].astype(np.float64), v), vec, ids[own], k)
                    scores, found = np.concatenate((scores, more), axis=1), np.concatenate((found, new), axis=1)
                    order = np.lexsort((found, -scores), axis=1)[:, :k]
                    kept[i] = np.take_along_axis(scores, order, 1), np.take_along_axis(found, order, 1)
            for i, (scores, found) in enumerate(kept):
                real = found != _MOST
                asked = np.broadcast_to(ids[i * BLOCK_ROWS : (i + 1) * BLOCK_ROWS, None], found.shape)[real]
                yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(np.full(len(asked), row["group"])), pa.array(found[real]), pa.array(scores[real])], names=["query_id", "group", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k vectors of the highest inner product.

    Both inputs have vec_id and v, an array of whole-numbered doubles. Ties go to the smaller vec_id; a
    vector of the query's own vec_id takes no part. Of queries that repeat a vec_id the one of the smallest
    vector is asked. A shorter vector counts as ending in zeros. Rows with a null id or vector, or with a
    component that is null or not finite, take no part; empty tables give no rows. A vec_id that k or more
    equal rows repeat may fill several ranks; more than k equal rows are never needed, so a vector that a
    third of all rows repeat fills no tile. Further columns are ignored.
    """
    sound = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    once = vectors.filter(sound).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    vectors = once.select("vec_id", "v", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))).alias("copy"))
    queries = queries.filter(sound).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("copy", F.lit(1).cast("long"))
    n = vectors.count()
    m, wide = queries.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    q, t = -(-m // max(1, min(QUERY_ROWS, QUERY_BYTES // (8 * max(1, wide))))) or 1, -(-n // TILE_ROWS) or 1
    # Small tables are cut into as many pairs as shuffles have tasks; what is found does not depend on it.
    group = max(1, min(GROUP, q * t // int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    groups = -(-t // group)

    def tiles(rows: DataFrame, number: int, name: str) -> DataFrame:
        """A written list of the tiles; files of attempts that did not end are in none."""
        folder = shared_path(rows.sparkSession, name)
        dealt = rows.select("vec_id", "v", F.pmod(F.xxhash64("vec_id", "v", "copy"), F.lit(number)).alias("tile"))

        def pack(own: pa.Table) -> pa.Table:
            return _pack(own, folder)

        return materialize(dealt.groupBy("tile").applyInArrow(pack, _TILE), name)

    asked = tiles(queries, q, "query-tiles").select(F.col("path").alias("query"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    given = tiles(vectors, t, "vector-tiles").groupBy(F.floor(F.col("tile") / group).alias("group")).agg(F.collect_list("path").alias("paths"))  # at most GROUP paths
    pairs = asked.join(given, "group").repartition(max(1, min(q * groups, MOST_TASKS)))
    kept = pairs.mapInArrow(partial(_multiplied, k=k), _KEPT)
    best = [F.desc("score"), "vec_id"]
    while groups > FAN:
        groups = -(-groups // FAN)
        kept = kept.withColumn("group", F.floor(F.col("group") / FAN)).withColumn("rank", F.row_number().over(W.partitionBy("query_id", "group").orderBy(*best))).filter(F.col("rank") <= k).drop("rank")
    return kept.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*best))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integers(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x), x taken as double."""
    # Not through floor(), whose long result would overflow; x - x % 1 is exact, down for negative rests.
    def down(x):
        y = x.cast("double") * F.lit(float(scale))
        rest = y % F.lit(1.0)
        return F.when(rest < 0, y - rest - 1).otherwise(y - rest)

    return embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vector_col, down).alias("v"))
