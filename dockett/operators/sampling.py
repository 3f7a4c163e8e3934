"""Greedy picks that depend on what was picked before, done on a bounded part that one pass over the data leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written
from .chunks import DOC, chunks, lines, told_lines

#: Examples of a mode.
EXAMPLES = 5
# Lines that label a party.
PARTY_LINE = r"(?i)^\s*(shipper|consignee|notify)\b[^:]{0,60}:"
PARTY_WORDS = ["shipper", "consignee", "notify"]


def examples(candidates: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """mode, place, ord of each mode's worst examples, spread over documents and fields.

    candidates: mode, severity (lower is worse), ord (unique in a mode), document, field. In each turn the worst is taken
    whose document and field were not, else whose document was not, else any. Only the first `most` rows of a mode
    and each (document, field), document and field can be taken, so each turn is one aggregate over what is left.
    """
    order = F.struct("severity", "ord")
    state = candidates.groupBy("mode").agg(F.lit(None).cast("int").alias("none")).select("mode", *[F.array().cast(t).alias(c) for c, t in (("ords", "array<bigint>"), ("documents", "array<string>"), ("fields", "array<string>"))])
    rows = candidates.select("mode", "severity", F.col("ord").cast("bigint").alias("ord"), F.col("document").cast("string").alias("document"), "field")
    near = W.partitionBy("mode", "document", "field").orderBy("severity", "ord")
    rows = rows.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= most).drop("n")
    rows = written(rows, "candidates")
    for _ in range(most):
        # state has a row a mode; it is written each turn, as the next one takes it twice.
        left = rows.join(F.broadcast(state), "mode").filter(~F.array_contains("ords", F.col("ord")))
        other, new = ~F.array_contains("documents", F.col("document")), ~F.array_contains("fields", F.col("field"))
        row = F.struct(order.alias("o"), "document", "field")
        picked = left.groupBy("mode").agg(F.coalesce(F.min(F.when(other & new, row)), F.min(F.when(other, row)), F.min(row)).alias("p"))
        add = lambda c, v: F.when(F.col("p").isNull(), F.col(c)).otherwise(F.concat(c, F.array(v))).alias(c)
        state = state.join(F.broadcast(picked), "mode", "left").select("mode", add("ords", F.col("p.o.ord")), add("documents", F.col("p.document")), add("fields", F.col("p.field")))
        state = written(state, "picks")
    return state.select("mode", F.posexplode("ords").alias("place", "ord")).select("mode", F.col("place") + 1, "ord").toDF("mode", "place", "ord")


def slots(cases: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """slot, place, case_id: for each slot in turn the first case that fits and that no slot before has taken.

    No more than all slots before can have taken cases of a slot, so the first of each slot, as many as there are
    slots, are enough to choose from.
    """
    kinds = F.array(*[F.when(cond, F.struct(F.lit(i).alias("place"), F.lit(name).alias("slot"))) for i, (name, cond) in enumerate(wanted.items(), 1)])
    fits = cases.select("case_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("s")).select("case_id", "s.*")
    first = fits.withColumn("n", F.row_number().over(W.partitionBy("place").orderBy("case_id"))).filter(F.col("n") <= len(wanted))
    ready = first.groupBy("place", "slot").agg(F.array_sort(F.collect_list("case_id")).alias("ids"))
    # At most a row a slot.
    listed = ready.agg(F.array_sort(F.collect_list(F.struct("place", "slot", "ids"))).alias("all"))
    kind = cases.schema["case_id"].dataType.simpleString()
    none = F.struct(F.array().cast(f"array<{kind}>").alias("taken"), F.array().cast(f"array<struct<place:int,slot:string,case_id:{kind}>>").alias("picked"))

    def step(state: Column, x: Column) -> Column:
        own = F.try_element_at(F.filter(x["ids"], lambda i: ~F.array_contains(state["taken"], i)), F.lit(1))
        one = F.struct(x["place"].alias("place"), x["slot"].alias("slot"), own.alias("case_id"))
        return F.when(own.isNull(), state).otherwise(F.struct(F.concat(state["taken"], F.array(own)).alias("taken"), F.concat(state["picked"], F.array(one)).alias("picked")))

    return listed.select(F.inline(F.aggregate("all", none, step, lambda s: s["picked"])))


def continuations(docs: DataFrame) -> DataFrame:
    """word, attached, total: party label lines, and those whose next line continues the value. docs: case_id, side, text."""
    word = lambda x: F.when(x.rlike(PARTY_LINE), F.lower(F.regexp_extract(x, PARTY_LINE, 1)))
    counted = told_lines(docs, word).groupBy(F.col("told").alias("word")).agg(F.count_if("attached").alias("attached"), F.count(F.lit(1)).alias("total"))
    dim = docs.sparkSession.createDataFrame([(w,) for w in PARTY_WORDS], "word string")
    zero = F.lit(0).cast("long")
    return dim.join(counted, "word", "left").select("word", F.coalesce("attached", zero).alias("attached"), F.coalesce("total", zero).alias("total"))


def run_on_pairs(docs: DataFrame) -> DataFrame:
    """One row: pairs, flagged (a party's value runs onto a further line on either side). docs: case_id, side, text."""
    run_on = F.col("field").isin("shipper", "consignee", "notify_party") & F.contains("value", F.lit("\n"))
    by = chunks(docs).groupBy("case_id").agg(F.coalesce(F.bool_or(run_on), F.lit(False)).alias("flagged"))
    whole = docs.groupBy("case_id").agg(F.count_distinct("side").alias("n")).filter("n = 2").select("case_id")
    return whole.join(by, "case_id", "left").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.coalesce("flagged", F.lit(False))).alias("flagged"))


def reader_smoke(docs: DataFrame) -> DataFrame:
    """case_id, side, n_chars, n_lines, n_chunks, n_resolved of each document. docs: case_id, side, text."""
    n_lines = lines(docs).groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_lines"))
    n_chunks = chunks(docs).groupBy(*DOC).agg(F.count(F.lit(1)).alias("n_chunks"), F.count("field").alias("n_resolved"))
    sized = docs.select(*DOC, F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    joined = reduce(lambda a, b: a.join(b, DOC, "left"), (n_lines, n_chunks), sized)
    return joined.select(*DOC, "n_chars", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_lines", "n_chunks", "n_resolved")])
