"""Reviews laid over system outcomes, corrected values, versions of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import FIELDS, MATCH, MISMATCH, UNCOMPARABLE
from ..functions.text import count_well_formed, weight_well_formed
from .compare import compare

SIDES, DECISIONS = ("si", "bl"), ("cleared", "flagged", "fine")


def effective(cases: DataFrame, reviews: DataFrame, beside: dict[str, Column] | None = None) -> DataFrame:
    """One row a case with the outcome that counts, and further columns of its own beside it. reviews: case_id, decision,
    status, defect_fields.

    Without a review, or with one that confirms, the system's outcome; a correction brings its own. Reviews grow with the
    cases and few of their columns may be asked for, so they are merged: by its estimate Spark would broadcast them all.
    """
    r = reviews.select("case_id", F.col("decision").alias("r_decision"), F.col("status").alias("r_status"), F.col("defect_fields").alias("r_fields"))
    joined = cases.join(r.hint("merge"), "case_id", "left")
    corrects = F.coalesce(F.col("r_decision") == "correct", F.lit(False))
    status = F.when(corrects, F.coalesce("r_status", "status")).otherwise(F.col("status"))
    ordered = F.array_join(F.array_sort(F.split(F.coalesce("r_fields", F.lit("")), ",")), ",")
    fields = F.when(~corrects, F.col("defect_fields")).when(status == "MISMATCH", ordered).otherwise("")
    reason = F.when(~corrects | (status == "NEEDS_REVIEW"), F.col("review_reason"))
    return joined.select(
        "case_id", status.alias("status"), reason.alias("review_reason"), F.when(corrects, status == "MISMATCH").otherwise(F.col("has_defect")).alias("has_defect"), fields.alias("defect_fields"),
        F.when(corrects, "review").otherwise("system").alias("source"), F.col("r_decision").isNotNull().alias("reviewed"), F.col("r_decision").alias("review_decision"),
        *[c.alias(n) for n, c in (beside or {}).items()],
    )


def derive(compared: DataFrame, decisions: DataFrame, corrections: DataFrame, cant_tell: DataFrame) -> DataFrame:
    """One row a case: status and defect_fields of a review.

    corrections (case_id, field, si, bl; null keeps the value) are compared anew, decisions (case_id,
    field, decision) stand over verdicts, and cases of cant_tell (case_id) need review in any case.
    """
    fixed = compared.join(corrections.withColumnsRenamed({"si": "c_si", "bl": "c_bl"}), ["case_id", "field"], "left")
    fixed = fixed.withColumns({"si_raw": F.coalesce("c_si", "si_raw"), "bl_raw": F.coalesce("c_bl", "bl_raw")})
    again = compare(fixed.select("case_id", "field", "field_ord", "si_raw", "bl_raw"))
    ruled = again.join(decisions, ["case_id", "field"], "left")
    stands = F.when(F.col("decision").isin("cleared", "fine"), MATCH).when(F.col("decision") == "flagged", MISMATCH).otherwise(F.col("verdict"))
    by = ruled.withColumn("stands", stands).groupBy("case_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("stands") == MISMATCH, F.col("field")))), ",").alias("defect_fields"), F.bool_or(F.col("stands") == UNCOMPARABLE).alias("open")
    )
    told = by.join(cant_tell.select("case_id", F.lit(True).alias("unsure")).distinct(), "case_id", "left")
    status = F.when(F.col("unsure"), "NEEDS_REVIEW").when(F.col("defect_fields") != "", "MISMATCH").when(F.col("open"), "NEEDS_REVIEW").otherwise("OK")
    return told.select("case_id", status.alias("status"), "defect_fields")


def summary(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: reviewed, confirmed, corrected and unresolved, judged by outcomes."""
    e = effective(cases, reviews).filter("reviewed").select("case_id", F.col("status").alias("e_status"), F.col("defect_fields").alias("e_fields"))
    both = cases.join(e.hint("merge"), "case_id")
    open_ = F.col("e_status") == "NEEDS_REVIEW"
    same = (F.col("e_status") == F.col("status")) & (F.col("e_fields") == F.col("defect_fields"))
    return both.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(~open_ & same).alias("confirmed"), F.count_if(~open_ & ~same).alias("corrected"), F.count_if(open_).alias("unresolved"))


def violations(corrections: DataFrame) -> DataFrame:
    """Corrections that may not be taken: unknown field or side, or a number that is not wholly one."""
    field, value = F.col("field"), F.col("value")
    why = (
        F.when(~field.isin(FIELDS), "unknown field")
        .when(~F.col("side").isin(*SIDES), "unknown side")
        .when((field == "container_count") & ~count_well_formed(value), "malformed count")
        .when((field == "gross_weight_kg") & ~weight_well_formed(value), "malformed weight")
    )
    return corrections.withColumn("violation", why).filter("violation is not null")


def versions(events: DataFrame) -> DataFrame:
    """events (case_id, at, payload columns) numbered from 1 by time, with is_latest."""
    order = W.partitionBy("case_id").orderBy("at")
    return events.withColumns({"version": F.row_number().over(order), "is_latest": F.lead("at").over(order).isNull()})


def file_as_of(versions: DataFrame, version: Column) -> DataFrame:
    return versions.filter(F.col("version") == version)


def recheck_summary(events: DataFrame) -> DataFrame:
    return events.agg(F.count_distinct("case_id").alias("cases"), F.count(F.lit(1)).alias("rechecks"))


def handled(events: DataFrame) -> DataFrame:
    """events (case_id, at, kind, decision, category, resent) with accepted, refused (why not), version and stood.

    kind is review, withdraw, retry or recheck. A withdrawal needs a review that stands, a retry a case that was never
    re-checked, a re-check a comparison and a side that was sent again. An accepted re-check is version 1, 2, ... of
    what it replaces, with the review that stood by then, and ends that review.
    """
    kind, order = F.col("kind"), W.partitionBy("case_id").orderBy("at")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    again = (kind == "recheck") & (F.col("category") == "BL_COMPARISON") & (F.coalesce("resent", F.lit("")) != "")
    out = events.withColumn("again", again).withColumn("rechecks", F.coalesce(F.sum(F.col("again").cast("int")).over(before), F.lit(0)))
    turn = F.when(kind.isin("review", "withdraw") | F.col("again"), F.struct("kind", "decision"))
    out = out.withColumn("last", F.last(turn, ignorenulls=True).over(before)).withColumn("stood", F.when(F.col("last.kind") == "review", F.col("last.decision")))
    refused = (
        F.when((kind == "withdraw") & F.col("stood").isNull(), "no review to withdraw").when((kind == "retry") & (F.col("rechecks") > 0), "re-checked on amended documents")
        .when((kind == "recheck") & (F.col("category") != "BL_COMPARISON"), "no pair to compare").when((kind == "recheck") & ~F.col("again"), "nothing was sent again")
    )
    out = out.withColumn("refused", refused)
    return out.withColumns({"accepted": F.col("refused").isNull(), "version": F.when(F.col("again"), F.col("rechecks") + 1)}).drop("again", "rechecks", "last")


def standing(handled: DataFrame) -> DataFrame:
    """case_id, review (that stands at the end, or null), rechecks, retries."""
    k, ok = F.col("kind"), F.col("accepted")
    turn = F.max(F.when(ok & k.isin("review", "withdraw", "recheck"), F.struct("at", "kind", "decision")))
    by = handled.groupBy("case_id").agg(turn.alias("t"), F.count_if(ok & (k == "recheck")).alias("rechecks"), F.count_if(ok & (k == "retry")).alias("retries"))
    return by.select("case_id", F.when(F.col("t.kind") == "review", F.col("t.decision")).alias("review"), "rechecks", "retries")


def recheck_history(handled: DataFrame) -> DataFrame:
    """case_id, version, at, resent, review: what each accepted re-check replaced."""
    return handled.filter("version is not null").select("case_id", "version", "at", "resent", F.col("stood").alias("review"))
