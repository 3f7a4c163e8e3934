"""Tables written between stages, so that what several later steps read is made once and lost executors cost one stage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a local session without one gets a temporary folder."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="dockett-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def dealt(df: DataFrame, *key: str) -> DataFrame:
    """df dealt by key over as many partitions as shuffles are set to have.

    What is grouped or joined by the key (and more) later needs no further exchange. Rules on texts take much time for few
    bytes, so small tables, which adaptive execution would put into one task, must keep all cores busy too.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/dockett-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, into: str) -> DataFrame:
    """df with each row's place (from 1) in an order, which should tell all rows apart.

    Rows are dealt over ranges of the order and numbered inside each; a range begins after what those before it hold. The
    driver sees one number a range, and no task sees all rows.
    """
    place = F.monotonically_increasing_id()  # the range above, the place in it in the lower 33 bits
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__spot", place)
    ranged = written(ranged, "ranges")
    number, inside = F.shiftrightunsigned("__spot", 33), F.col("__spot").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.g, r.n) for r in ranged.groupBy(number.alias("g")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for g, n in sizes:
        starts.append((g, total))
        total += n
    before = df.sparkSession.createDataFrame(starts, "__g long, __before long")
    return ranged.withColumn("__g", number).join(F.broadcast(before), "__g").withColumn(into, F.col("__before") + inside + 1).drop("__g", "__before", "__spot")


def running(df: DataFrame, order: list, value: str, into: str) -> DataFrame:
    """df with the sum of value (a whole number) over the rows up to and with each in an order, which should tell all rows
    apart. By ranges, like numbered; the driver sees one sum a range."""
    ranged = written(df.repartitionByRange(*order).withColumn("__g", F.spark_partition_id()), "ranges")
    sums = sorted((r["__g"], r.s) for r in ranged.groupBy("__g").agg(F.coalesce(F.sum(value), F.lit(0)).alias("s")).collect())
    starts, total = [], 0
    for g, s in sums:
        starts.append((g, total))
        total += s
    before = df.sparkSession.createDataFrame(starts, "__g int, __before long")
    inside = F.sum(value).over(W.partitionBy("__g").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return ranged.join(F.broadcast(before), "__g").withColumn(into, F.col("__before") + F.coalesce(inside, F.lit(0))).drop("__g", "__before")
