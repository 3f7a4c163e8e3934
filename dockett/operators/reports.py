"""Reports over cases: run metrics, patterns with Wilson intervals, groups, projections, model usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import FIELDS

Z = 1.959963984540054
MANUAL_SECONDS_EMAIL, MANUAL_SECONDS_PAIR = 20, 240
# Dollars per million tokens (input, cached input, output).
PRICES = (0.25, 0.025, 2.0)


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k in n; 0 and 1 for no trials."""
    p, zz = k / n, z * z
    scale = 1.0 + zz / n
    centre = (p + zz / (2 * n)) / scale
    margin = (F.lit(z) / scale) * F.sqrt(p * (1 - p) / n + zz / (4.0 * n * n))
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - margin)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), centre + margin)).otherwise(1.0)


def defect_rows(cases: DataFrame) -> DataFrame:
    """A row a defect field of cases (defect_fields comma-separated); cases without defects have none."""
    return cases.filter("defect_fields <> ''").withColumn("field", F.explode(F.split("defect_fields", ",")))


def run_metrics(cases: DataFrame) -> DataFrame:
    """One row of counts by status and reason, and the share decided by rules."""
    n = F.count(F.lit(1))
    return cases.agg(
        n.alias("emails"), F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status") == "MISMATCH").alias("mismatch"), F.count_if(F.col("status") == "NEEDS_REVIEW").alias("needs_review"),
        F.count_if(F.col("review_reason") == "missing_value").alias("missing_value"), F.count_if(F.col("review_reason") == "unreadable").alias("unreadable"),
        F.bround(F.count_if(F.col("decided_by") == "rule") / n, 4).alias("rule_share"),
    )


def run_report(cases: DataFrame) -> DataFrame:
    """kind, value, n: all counts of a run. kind is total (emails, decided_by_rule, decided_by_llm, documents_read,
    documents_unreadable), category, status or review_reason; values that no case has are left out."""
    row = lambda kind, value, n=1: F.struct(F.lit(kind).alias("kind"), (F.lit(value) if isinstance(value, str) else value).alias("value"), F.lit(n).cast("long").alias("n") if isinstance(n, int) else n.alias("n"))
    parts = F.array(
        row("total", "emails"), row("total", F.concat(F.lit("decided_by_"), "decided_by")), row("total", "documents_read", F.col("n_docs")), row("total", "documents_unreadable", F.col("n_unreadable")),
        row("category", F.col("category")), row("status", F.col("status")), row("review_reason", F.col("review_reason")),
    )
    return cases.select(F.inline(parts)).filter("value is not null").groupBy("kind", "value").agg(F.sum("n").alias("n"))


def run_times(cases: DataFrame) -> DataFrame:
    """One row: emails, total_ms, mean_ms. cases: duration_ms."""
    n, total = F.count(F.lit(1)), F.coalesce(F.sum("duration_ms"), F.lit(0.0))
    return cases.agg(n.alias("emails"), F.bround(total, 1).alias("total_ms"), F.when(n > 0, F.bround(total / n, 2)).otherwise(0.0).alias("mean_ms"))


def pattern_totals(cases: DataFrame) -> DataFrame:
    """One row: emails, comparisons, with_defect, escalated, and baseline, the rate of defects among comparisons."""
    counted = cases.agg(
        F.count(F.lit(1)).alias("emails"), F.count_if(F.col("category") == "BL_COMPARISON").alias("comparisons"),
        F.count_if(F.col("status") == "MISMATCH").alias("with_defect"), F.count_if(F.col("status") == "NEEDS_REVIEW").alias("escalated"),
    )
    return counted.withColumn("baseline", F.when(F.col("comparisons") > 0, F.col("with_defect") / F.col("comparisons")).otherwise(0.0))


def patterns_senders(cases: DataFrame) -> DataFrame:
    """A row a sender domain: counts, defect rate, its interval, and whether it stands out from the baseline.

    The baseline is one row, joined by a constant, so it is broadcast however large the rest is.
    """
    counts = [F.count(F.lit(1)).alias("emails"), F.count_if(F.col("category") == "BL_COMPARISON").alias("comparisons"), F.count_if(F.col("status") == "MISMATCH").alias("defects"), F.count_if(F.col("status") == "NEEDS_REVIEW").alias("escalated")]
    by = cases.groupBy("domain").agg(*counts)
    base = by.agg((F.sum("defects") / F.nullif(F.sum("comparisons"), F.lit(0))).alias("base"))
    k, n, b = F.col("defects"), F.col("comparisons"), F.coalesce("base", F.lit(0.0))
    low, high = wilson(k, n)
    rated = by.crossJoin(F.broadcast(base)).withColumns({"rate": F.when(n > 0, k / n), "ci_low": F.when(n > 0, low), "ci_high": F.when(n > 0, high)})
    return rated.withColumns({"above_baseline": (n > 0) & F.coalesce(F.col("ci_low") > b, F.lit(False)), "conclusive": (n > 0) & F.coalesce((F.col("ci_low") > b) | (F.col("ci_high") < b), F.lit(False))}).drop("base")


def top_fields(cases: DataFrame, most: int = 3) -> DataFrame:
    """Each domain's most frequent defect fields, ties by the case that shows them first, then by name."""
    counted = defect_rows(cases).groupBy("domain", "field").agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("first"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("domain").orderBy(F.desc("n"), "first", "field")))
    return ranked.filter(F.col("rank") <= most).drop("first")


def patterns_fields(cases: DataFrame) -> DataFrame:
    """All seven fields with their defect count and share, zeros too."""
    spark = cases.sparkSession
    dim = spark.createDataFrame([(f, i) for i, f in enumerate(FIELDS, 1)], "field string, field_ord int")
    counted = defect_rows(cases).groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    filled = dim.join(counted, "field", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    return filled.withColumn("share", F.when(total > 0, F.col("n") / total).otherwise(0.0)).drop("field_ord")


def escalation_reasons(cases: DataFrame) -> DataFrame:
    return cases.filter("status = 'NEEDS_REVIEW' and review_reason is not null").groupBy("review_reason").agg(F.count(F.lit(1)).alias("n"))


def shipper_groups(cases: DataFrame, least: int = 2, most: int = 6) -> DataFrame:
    """The most frequent (shipper, defect field) groups with at least `least` cases."""
    grouped = defect_rows(cases).groupBy("shipper", "field").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("domain").alias("senders"))
    return grouped.filter(F.col("n") >= least).orderBy(F.desc("n"), "shipper", "field").limit(most)


def prior_defects(cases: DataFrame) -> DataFrame:
    """For each case and field, in how many other cases of its shipper that field is a defect."""
    rows = defect_rows(cases)
    counts = rows.groupBy("shipper", "field").agg(F.count(F.lit(1)).alias("n"))
    asked = cases.join(counts, "shipper")
    own = F.array_contains(F.split("defect_fields", ","), F.col("field")).cast("int")
    return asked.select("case_id", "field", (F.col("n") - own).alias("prior")).filter("prior > 0")


def manual_estimate(cases: DataFrame) -> DataFrame:
    pairs = F.count_if(F.col("category") == "BL_COMPARISON")
    n = F.count(F.lit(1))
    return cases.agg(n.alias("emails"), pairs.alias("pairs"), (pairs * len(FIELDS)).alias("fields"), (n * MANUAL_SECONDS_EMAIL + pairs * MANUAL_SECONDS_PAIR).alias("seconds"))


def volume_projection(metrics: DataFrame, volumes: list[int], per_doc: float = 0.0013) -> DataFrame:
    """A row a volume of emails: seconds and dollars at the measured rates of a one-row table (ms, docs)."""
    rows = metrics.select("*", F.explode(F.array(*map(F.lit, volumes))).alias("volume"))
    return rows.select("volume", (F.col("volume") * F.col("ms") / 1000.0).alias("seconds"), F.bround(F.col("volume") * F.col("docs") * per_doc, 2).alias("dollars"))


def usage_cost(calls: DataFrame) -> DataFrame:
    """Model calls by purpose: count, cached, tokens, and cost at pinned prices. calls: purpose, cached,
    input_tokens, cached_tokens, output_tokens."""
    fresh, cached, out = (F.lit(p).cast("decimal(12,6)") for p in PRICES)
    cost = ((F.col("input_tokens") - F.col("cached_tokens")) * fresh + F.col("cached_tokens") * cached + F.col("output_tokens") * out) / 1000000
    return calls.groupBy("purpose").agg(F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("cached"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.bround(F.sum(cost).cast("double"), 6).alias("cost"))


def attention(cases: DataFrame) -> DataFrame:
    """cases with place: mismatches first, then reviews, then the rest; more defect fields first."""
    rank = F.when(F.col("status") == "MISMATCH", 0).when(F.col("status") == "NEEDS_REVIEW", 1).otherwise(2)
    fields = F.when(F.col("defect_fields") == "", 0).otherwise(F.size(F.split("defect_fields", ",")))
    return cases.withColumns({"rank": rank, "n_fields": fields}).orderBy("rank", F.desc("n_fields"), "case_id")
