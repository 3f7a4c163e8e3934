"""Exact dedup by content sort: sampled splitters range-partition the normalised texts, an external sort
places equal texts next to each other, and comparing whole neighbours finds the groups.

The sort key is (first 64 characters, 64-bit digest, text, doc_id), so a shared opening of many documents
cannot fill one range, what Spark samples for splitters stays small, and as doc_id takes part in the
ranges a large group of copies is cut over several ranges. The cut pieces (runs) are joined again by
their SHA-256 in a table of one row a run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_LAST, by_others, materialize, squeezed

PREFIX_CHARS = 64
_RUNS = "doc_id long, text_sha256 string, run_part int, run_no long, run_place long"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, run, place, last, digest = TaskContext.get().partitionId(), -1, 0, None, ""
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for text in batch.column("norm").cast(pa.binary()):
            text = text.as_buffer()
            if last is None or not text.equals(last):
                run, place, last = run + 1, 0, text
                digest = hashlib.sha256(text).hexdigest()
            out[0].append(digest)
            out[1].append(run)
            out[2].append(place)
            place += 1
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(out[0], pa.string()), pa.array([part] * n, pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())],
            names=["doc_id", "text_sha256", "run_part", "run_no", "run_place"],
        )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Texts are equal if they are after each run of white space became one space.
    keep_id is the smallest non-null id of a group (null if it has none); of rows that repeat that id just
    one is kept. Rows with a null id are kept only where no row of the group has an id. An empty table
    gives an empty result; further columns, whatever their names, are ignored.
    """
    norm = docs.select(F.col(id_col).cast("long").alias("doc_id"), squeezed(F.col(text_col)).alias("norm"))
    keyed = norm.select(F.substring("norm", 1, PREFIX_CHARS).alias("head"), F.xxhash64("norm").alias("digest"), "norm", "doc_id")
    order = ["head", "digest", F.col("doc_id").asc_nulls_last()]
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions("head", "digest", "norm", F.col("doc_id").asc_nulls_last())
    rows = materialize(sorted_.select("doc_id", "norm").mapInArrow(_neighbours, _RUNS), "exact-runs")

    run = ["text_sha256", "run_part", "run_no"]
    runs = rows.groupBy(*run).agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "run_part", "run_no"))
    texts = runs.groupBy("text_sha256").agg(first.alias("first"), F.sum("n").alias("group_size"))
    marked = runs.join(texts, "text_sha256").select(*run, F.col("first.low").alias("keep_id"), "group_size", ((F.col("run_part") == F.col("first.run_part")) & (F.col("run_no") == F.col("first.run_no"))).alias("leads"))
    return rows.join(marked, run).select("doc_id", "keep_id", F.col("group_size").cast("long"), (F.col("leads") & (F.col("run_place") == 0)).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_groups drops, all columns as they were.

    A kept row is found again by its id and the SHA-256 of its text; of rows that repeat both one stays, by a
    digest of their other columns. Null texts count as empty; columns of any name are kept.
    """
    names = docs.columns
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_LAST))
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.coalesce("doc_id", F.lit(NULL_LAST)).alias("__key"), F.col("text_sha256").alias("__digest"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), key.alias("__key"), F.sha2(squeezed(F.col(text_col)), 256).alias("__digest"), by_others(names, [id_col]).alias("__by"))
    once = keyed.join(kept, ["__key", "__digest"], "left_semi").groupBy("__key", "__digest").agg(F.min_by("__row", "__by").alias("__row"))
    return once.select([F.col(f"__row.`{c}`").alias(c) for c in names])
