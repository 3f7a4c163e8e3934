"""Mixing sources to target weights by a low-discrepancy schedule. Only DataFrame functions are used.

The mix is a row of slots of equally many words. Slot i has the golden-ratio point frac(i * phi), which
the sources' cumulative shares map to a source; a slot's rank among its source's slots is the number of
the block that it takes. Blocks are cut from the source's documents in a shuffled order (by digest of the
id), laid end to end and repeated from the start where a source is taken more than once. A source's last
block ends at its target, and blocks that the schedule left out follow its slots, so every source meets
its target at any size of a slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_others, materialize, word_count

#: Slots if documents are small (a slot is one word at least), and the most words of a slot.
SLOTS, MOST_WORDS = 1 << 18, 1 << 20
#: Times that a document may be taken; buckets of the shuffled order in each source; slots ranked together.
REPEATS, BUCKETS, STRIDE = 3, 1024, 4096
PHI = 0.6180339887498949


def _key(source: Column) -> Column:
    """A source as text that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _source(key: Column) -> Column:
    return F.when(key != "1", F.substring(key, F.lit(2), F.length(key)))


def running(rows: DataFrame, value: Column) -> DataFrame:
    """rows (source, part: ranges of sources) with low and upto, the running sum of a value in the order of sources before
    and with each row. Only the sums of the ranges, one row each, meet in one place."""
    order = W.partitionBy("part").orderBy("source")
    inside = rows.withColumn("__in", F.sum(value).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = inside.groupBy("part").agg(F.max("__in").alias("__end"))
    ahead = ends.select("part", F.sum("__end").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("__ahead"))
    zero = F.lit(0)
    out = inside.withColumn("__before", F.coalesce(F.lag("__in").over(order), zero)).join(ahead, "part").withColumn("__ahead", F.coalesce("__ahead", zero))
    return out.withColumns({"low": F.col("__ahead") + F.col("__before"), "upto": F.col("__ahead") + F.col("__in")}).drop("__in", "__before", "__ahead")


def target_table(sizes: DataFrame, weights: Column | None = None) -> DataFrame:
    """(source, source_size, target, upto_low, upto) from rows (source, size): one row a source.

    Sources by code point, null last, weigh 1, 2, 3, repeating. They share all words by weight; a target
    stops at REPEATS times its source's size, and what is beyond is shared again by weight until none is above:
    each turn is one aggregate. upto_low and upto are cumulative shares. Sources may be many: they are numbered and
    summed up in ranges.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = materialize(total.repartitionByRange("source").withColumn("part", F.spark_partition_id()), "source-sizes")
    placed = running(ranged, F.lit(1)).withColumn("place", F.col("upto")).drop("low", "upto")
    weight = (weights if weights is not None else (F.col("place") - 1) % 3 + 1).cast("double")
    weighed = materialize(placed.withColumns({"weight": weight, "cap": F.lit(float(REPEATS)) * F.col("source_size")}), "source-weights")
    words, n = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.count(F.lit(1))).first()
    exact = lambda c: F.coalesce(F.sum(c.cast("decimal(30,6)")), F.lit(0).cast("decimal(30,6)"))
    level, stopped = 0.0, -1
    while True:
        stops = F.col("cap") < F.lit(level) * F.col("weight")
        held, open_, now = weighed.agg(exact(F.when(stops, F.col("cap"))), exact(F.when(~stops, F.col("weight"))), F.count_if(stops)).first()
        if now == stopped or not open_:
            break
        level, stopped = float((words - held) / open_), now
    target = F.least("cap", F.lit(level) * F.col("weight"))
    shared = running(weighed.withColumn("target", target), target / F.lit(float(words or 1)))
    return shared.select("source", "source_size", "target", F.col("low").cast("double").alias("upto_low"), F.when(F.col("place") == n, 1.0).otherwise(F.col("upto")).alias("upto"))


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """(slot, source, rank): every slot with its source and its rank, from 0, among that source's slots.

    Ranks come from counts of stretches of slots, so no source's slots meet in one task.
    """
    spark = sources.sparkSession
    # Sorted grid cells narrow the range join between points and shares to an equi-join.
    cells = 1024
    at = F.col("id") * F.lit(PHI)
    points = spark.range(slots).select(F.col("id").alias("slot"), (at - F.floor(at)).alias("point")).withColumn("cell", F.floor(F.col("point") * cells).cast("int"))
    spans = sources.filter("upto > upto_low").select("source", "upto_low", "upto", F.explode(F.sequence(F.floor(F.col("upto_low") * cells).cast("int"), F.least(F.floor(F.col("upto") * cells), F.lit(cells - 1)).cast("int"))).alias("cell"))
    given = points.join(spans, "cell").filter("point >= upto_low and point < upto").select("slot", "source", F.floor(F.col("slot") / STRIDE).alias("stretch"))
    own = F.row_number().over(W.partitionBy("source", "stretch").orderBy("slot"))
    before = given.groupBy("source", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("source", "stretch", (F.sum("n").over(W.partitionBy("source").orderBy("stretch")) - F.col("n")).alias("ahead"))
    ranked = given.withColumn("own", own).join(before, ["source", "stretch"])
    return ranked.select("slot", "source", (F.col("ahead") + F.col("own") - 1).alias("rank"))


def met(plan: DataFrame, goals: DataFrame, words: int) -> DataFrame:
    """(source, block) of the blocks taken: scheduled ranks up to each source's goal in words, and those up to it
    that the schedule has not given."""
    given = plan.groupBy("source").agg(F.count(F.lit(1)).alias("given"))
    wanted = goals.filter("goal > 0").select("source", F.ceil(F.col("goal") / words).alias("wanted")).join(given, "source", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    scheduled = plan.join(wanted, "source").filter("rank < wanted").select("source", F.col("rank").alias("block"))
    return scheduled.unionByName(wanted.filter("given < wanted").select("source", F.explode(F.sequence("given", F.col("wanted") - 1)).alias("block")))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """sizes (size > 0) with begin, where each document starts in its source's shuffled order, in words,
    and the columns of sources. Running sums inside buckets of the order and sums of whole buckets make it
    up, so a source that holds much of the table is spread over its buckets, and so are rows without an id: equal rows
    are counted and numbered, and their order follows from all that tells rows apart."""
    equal = sizes.groupBy("doc_id", "source", "size", "digest").agg(F.count(F.lit(1)).alias("equals"))
    once = equal.withColumn("equal", F.explode(F.sequence(F.lit(1).cast("long"), "equals"))).drop("equals")
    keyed = once.withColumn("order", F.xxhash64("doc_id", "digest", "equal", F.lit(7))).withColumn("bucket", F.pmod("order", F.lit(BUCKETS)).cast("int"))
    inside = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", "digest", "equal").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size")
    before = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = before.withColumn("ahead", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n").join(sources, "source")
    return keyed.withColumn("inside", inside).join(before, ["source", "bucket"]).withColumn("begin", F.col("ahead") + F.col("inside")).drop("order", "bucket", "inside", "ahead", "equal")


def blocks(docs: DataFrame, words: int) -> DataFrame:
    """Each document of placed() cut at block borders, for each turn of its source (column turns).

    block, part (words of the document in that block, up to the source's goal) and starts (whether the document
    starts in it, before the goal) are added.
    """
    from_ = F.col("begin") + F.col("turn") * F.col("source_size")
    turns = docs.withColumn("turn", F.explode(F.sequence(F.lit(0), (F.col("turns") - 1).cast("int")))).withColumn("from", from_).withColumn("to", from_ + F.col("size"))
    cut = turns.withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / words), F.floor((F.col("to") - 1) / words))))
    part = F.least("to", (F.col("block") + 1) * words, "goal") - F.greatest("from", F.col("block") * words)
    return cut.withColumn("part", F.greatest(part.cast("long"), F.lit(0))).withColumn("starts", (F.col("block") == F.floor(F.col("from") / words)) & (F.col("from") < F.col("goal"))).drop("turn", "turns", "from", "to", "goal")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, copies, digest (xxhash64 of the text).

    size is the number of words, 0 for null and empty texts, which take no part: taken 0, copies 1.
    taken counts words that the mix takes, repeats included, at most REPEATS times size; a source's sum is its
    target within one word. copies is how
    often the document stands in a mix of whole documents: the turns in which its first word is taken.
    Repeated rows and null ids keep their rows. Without any words targets and taken are 0. Further
    columns, whatever their names, are ignored.
    """
    sizes = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(F.col(source_col)).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("digest")), "sizes")
    sources = materialize(target_table(sizes), "sources")
    total = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    words = max(1, min(MOST_WORDS, total // slots))
    plan = materialize(schedule(sources, total // words), "schedule")
    own = sources.select("source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"))
    goals = own.filter("source_size > 0").withColumn("goal", F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round("target"))).otherwise(0).cast("long"))
    used = goals.withColumn("turns", F.greatest(F.lit(1), F.least(F.ceil(F.col("goal") / F.col("source_size")), F.lit(REPEATS))))
    cut = blocks(placed(sizes.filter("size > 0"), used), words)
    taken = cut.join(met(plan, goals, words).withColumn("hit", F.lit(True)), ["source", "block"], "left")
    # (source, begin) tells rows apart, as sizes are positive; ids need not.
    sums = taken.groupBy("source", "begin", "doc_id", "size", "digest", "source_size", "target").agg(
        F.sum(F.when(F.col("hit"), F.col("part")).otherwise(0)).alias("taken"), F.sum((F.col("hit").isNotNull() & F.col("starts")).cast("long")).alias("copies")
    )
    empty = sizes.filter("size = 0").join(own, "source").withColumns({"taken": F.lit(0).cast("long"), "copies": F.lit(1).cast("long")})
    names = ["doc_id", "source", "size", "source_size", "target", "taken", "copies", "digest"]
    return sums.select(names).unionByName(empty.select(names)).withColumn("source", _source(F.col("source")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slots: int = SLOTS) -> DataFrame:
    """docs as a mix of whole documents: every row as often as its copies say, all columns as they were."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    alike = ["__id", "__source", "__size", "__digest"]
    id_ = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    key = [id_.alias("__id"), _key(F.col(source_col)).alias("__source"), word_count(F.col(text_col)).alias("__size"), F.xxhash64(text_col).alias("__digest")]
    plan = mix(docs, id_col, text_col, source_col, slots)
    # Rows of one id, source and text are alike to the mix; they share their copies in a fixed order.
    order = F.row_number().over(W.partitionBy(*alike).orderBy(F.col("copies").desc()))
    plan = plan.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("__id"), _key(F.col("source")).alias("__source"), F.col("size").alias("__size"), F.col("digest").alias("__digest"), "copies").withColumn("__n", order)
    mine = F.row_number().over(W.partitionBy(*alike).orderBy("__by"))
    rows = docs.select(row.alias("__row"), *key, by_others(names, [id_col, text_col]).alias("__by")).withColumn("__n", mine).join(plan, [*alike, "__n"])
    repeated = rows.filter("copies > 0").select("__row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__copy"))
    return repeated.select([F.col(f"__row.`{c}`").alias(c) for c in names])
