"""Scores of submitted decisions against gold ones; what is not submitted counts as wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORIES

# Weights of the end-to-end rate, the categories' F1 and the defects' F1.
WEIGHTS = (0.5, 0.3, 0.2)


def _pairs(gold: DataFrame, submitted: DataFrame) -> DataFrame:
    """gold left-joined with submitted, both: case_id, category, status, defect_fields (sorted)."""
    own = submitted.select("case_id", F.col("category").alias("s_category"), F.col("status").alias("s_status"), F.col("defect_fields").alias("s_fields"))
    return gold.join(own, "case_id", "left")


def _f1(tp: Column, predicted: Column, real: Column) -> Column:
    return F.when(predicted + real > 0, 2.0 * tp / (predicted + real)).otherwise(0.0)


def by_category(gold: DataFrame, submitted: DataFrame) -> DataFrame:
    """category, tp, predicted, real, f1 for each of the five."""
    rows = _pairs(gold, submitted)
    sides = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), (F.col("category") == c).alias("real"), F.coalesce(F.col("s_category") == c, F.lit(False)).alias("said")) for c in CATEGORIES])).alias("x")
    counted = rows.select(sides).groupBy(F.col("x.c").alias("category")).agg(F.count_if(F.col("x.real") & F.col("x.said")).alias("tp"), F.count_if("x.said").alias("predicted"), F.count_if("x.real").alias("real"))
    return counted.withColumn("f1", _f1(F.col("tp"), F.col("predicted"), F.col("real")))


def score(gold: DataFrame, submitted: DataFrame) -> DataFrame:
    """One row: end_to_end, macro_f1, defect_f1, escalation_precision, escalation_recall, final_score."""
    rows = _pairs(gold, submitted)
    planted = F.col("defect_fields") != ""
    exact = planted & (F.col("s_category") == "BL_COMPARISON") & (F.col("s_status") == "MISMATCH") & (F.col("s_fields") == F.col("defect_fields"))
    judged = (F.col("category") == "BL_COMPARISON") & (F.col("status") != "NEEDS_REVIEW")
    said = F.coalesce(F.col("s_status") == "MISMATCH", F.lit(False))
    asked, should = F.coalesce(F.col("s_status") == "NEEDS_REVIEW", F.lit(False)), F.col("status") == "NEEDS_REVIEW"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    one = rows.agg(
        share(n(exact), n(planted)).alias("end_to_end"), _f1(n(judged & planted & said), n(judged & said), n(judged & planted)).alias("defect_f1"),
        share(n(asked & should), n(asked)).alias("escalation_precision"), share(n(asked & should), n(should)).alias("escalation_recall"),
    )
    macro = by_category(gold, submitted).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    a, b, c = WEIGHTS
    # Both sides are one row.
    return one.crossJoin(macro).withColumn("final_score", a * F.col("end_to_end") + b * F.col("macro_f1") + c * F.col("defect_f1"))
