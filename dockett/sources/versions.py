"""Tables that are replaced by key and read as of one version.

A table is a folder: rows lie in folders below data, cut into buckets by key, and each version is one small file below
versions that says which folder holds which bucket. A writer rewrites the buckets that its rows touch, into new folders,
and then puts the next version's file in place, which fails if another writer was first. So a reader sees one
version whole, and what a writer that died left behind belongs to none.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import numbered, written

BUCKETS = 32


class Conflict(Exception):
    """Another writer made the same version first."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{path}/versions") if n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/versions/{version:012d}.json", wholetext=True).first()[0])


def latest(spark: SparkSession, path: str) -> dict | None:
    """version, schema, key, buckets (folder of each that has rows), rows and marks of the newest version."""
    known = versions(spark, path)
    return _manifest(spark, path, known[-1]) if known else None


def _publish(spark: SparkSession, path: str, manifest: dict) -> None:
    """Puts a version's file in place, whole and only if there is none."""
    target = f"{path}/versions/{manifest['version']:012d}.json"
    fs, at = _fs(spark, target)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps(manifest).encode()))
    finally:
        out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise Conflict(f"version {manifest['version']} of {path} is there already")


def _rows(spark: SparkSession, manifest: dict, path: str, buckets: list[str]) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    folders = [f"{path}/data/{manifest['buckets'][b]}/__bucket={b}" for b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest by default, with ord, their place in the order in which keys came."""
    manifest = latest(spark, path) if version is None else _manifest(spark, path, version)
    if manifest is None:
        raise FileNotFoundError(f"no version of {path}")
    return _rows(spark, manifest, path, sorted(manifest["buckets"]))


def upsert(fresh: DataFrame, path: str, key: str, at: str, mark: tuple[str, int] | None = None, buckets: int = BUCKETS) -> int:
    """Puts fresh rows in the place of those of the same key, which keep their ord; new keys follow in the order of at and
    key. Of several rows of a key the last by at counts. Returns the version that has them.

    mark (a name and a number) makes a repeated call harmless: a table that has the number, or a higher one, under
    that name is left as it is. The first call makes the table.
    """
    spark = fresh.sparkSession
    before = latest(spark, path)
    if before and mark and before["marks"].get(mark[0], -1) >= mark[1]:
        return before["version"]
    buckets = before["n_buckets"] if before else buckets
    bucket = F.lpad(F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("string"), 6, "0")
    names = [c for c in fresh.columns if c != at]
    last = fresh.groupBy(key).agg(F.max_by(F.struct(*names), F.col(at)).alias("r"), F.max(at).alias("__at"))
    last = written(last.select("r.*", "__at").withColumn("__bucket", bucket), "fresh")
    # No more names than there are buckets.
    touched = [r[0] for r in last.select("__bucket").distinct().collect()]
    if before:
        old = _rows(spark, before, path, [b for b in touched if b in before["buckets"]])
        joined = written(last.join(old.select(F.col(key), F.col("ord")), key, "left"), "placed")
        kept = old.join(last.select(key), key, "left_anti").withColumn("__bucket", bucket)
    else:
        joined, kept = last.withColumn("ord", F.lit(None).cast("long")), None
    end = before["end"] if before else 0
    new = numbered(joined.filter("ord is null").drop("ord"), ["__at", key], "__place").withColumn("ord", F.col("__place") + F.lit(end - 1)).drop("__place")
    rows = joined.filter("ord is not null").select(*names, "ord", "__bucket").unionByName(new.select(*names, "ord", "__bucket"))
    rows = rows.unionByName(kept.select(*names, "ord", "__bucket")) if kept is not None else rows
    folder = uuid.uuid4().hex
    rows.repartition(F.col("__bucket")).write.partitionBy("__bucket").parquet(f"{path}/data/{folder}")
    added = new.count()
    manifest = {
        "version": (before["version"] if before else 0) + 1, "schema": rows.drop("__bucket").schema.jsonValue(), "key": key, "n_buckets": buckets, "end": end + added,
        "buckets": {**(before["buckets"] if before else {}), **dict.fromkeys(touched, folder)}, "marks": {**(before["marks"] if before else {}), **(dict([mark]) if mark else {})},
    }
    _publish(spark, path, manifest)
    return manifest["version"]


def forget(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Deletes all versions but the last keep, and the folders that none of these names; returns how many folders. Not to
    be called while a writer is at work, whose folders no version names yet."""
    known = versions(spark, path)
    used = {f for v in known[-keep:] for f in _manifest(spark, path, v)["buckets"].values()}
    for v in known[:-keep]:
        fs, at = _fs(spark, f"{path}/versions/{v:012d}.json")
        fs.delete(at, False)
    gone = [n for n in _names(spark, f"{path}/data") if n not in used]
    for n in gone:
        fs, at = _fs(spark, f"{path}/data/{n}")
        fs.delete(at, True)
    return len(gone)
