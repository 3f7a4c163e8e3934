"""A whole run: mails and attachments in, one decision a mail out, with metrics and the three files of a run.

Attachments are typed and given their parts first and then written, as the mails' categories, the pairs and the gate
all read them. Every mail has a row at the end: one for which no decision came about needs review.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assist, classify, doctype
from ..storage import written
from . import cases as plan
from . import guard


def parts(docs: DataFrame) -> DataFrame:
    """docs (case_id, ord, path, text, unreadable) with doc_type, confidence and side: SI, BL, or null for documents that
    play no part."""
    typed = doctype.doc_types(docs).withColumn("hint", doctype.role_hint(F.col("path")))
    cast = doctype.roles(typed.select("case_id", "ord", "doc_type", "hint"))
    side = F.when(F.col("ord") == F.col("si"), "SI").when(F.col("ord") == F.col("bl"), "BL")
    return typed.join(cast, "case_id").withColumn("side", side).drop("hint", "si", "bl")


def classified(mails: DataFrame, docs: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """email_id, category, confidence, decided_by, needs_model, rationale of every mail, the types of its attachments
    heard as well. verdicts: answers of a model to doubtful mails."""
    kinds = docs.groupBy(F.col("case_id").alias("email_id")).agg(F.array_sort(F.collect_set("doc_type")).alias("kinds"))
    ruled = classify.categories(classify.fired_rules(classify.views(mails.join(kinds, "email_id", "left")), "kinds"))
    if verdicts is not None:
        return assist.adopted_categories(ruled, verdicts)
    return ruled.select("email_id", "category", "confidence", F.lit("rule").alias("decided_by"), "needs_model", "rationale")


def run(mails: DataFrame, docs: DataFrame, verdicts: DataFrame | None = None, fuzzy: bool = True) -> DataFrame:
    """One row a mail: case_id, sender, subject, category, category_confidence, decided_by, rationale, the decision's columns,
    error (why no decision came about), n_docs and n_unreadable of its two parts. mails: email_id, sender, subject, body.

    A case whose rows make a step raise needs review, as unreadable, with the error; all others are decided."""
    placed = written(parts(docs), "parts")
    kinds = written(classified(mails, placed, verdicts), "categories")
    asked = kinds.filter("category = 'BL_COMPARISON'").select(F.col("email_id").alias("case_id"))
    sided = placed.filter("side is not null").join(asked, "case_id", "left_semi")
    letters = mails.withColumnRenamed("email_id", "case_id").join(asked, "case_id", "left_semi")
    none = F.lit(None)

    def decide(own: DataFrame | None) -> DataFrame:
        some = [x if own is None else written(x.join(own, "case_id", "left_semi"), "some") for x in (sided, letters)]
        return plan.cases(*some, fuzzy)

    decided, faults = guard.isolated(decide, asked)
    if decided is None:
        decided = asked.select("case_id", *[none.cast(t).alias(c) for c, t in plan.DECIDED_TYPES.items()])
    decided = decided.join(F.broadcast(faults), "case_id", "full_outer")  # no more rows than guard.MOST_FAULTS
    read = sided.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count("unreadable").alias("n_unreadable"))
    every = mails.select(F.col("email_id").alias("case_id"), "sender", "subject").join(kinds.withColumnsRenamed({"email_id": "case_id", "confidence": "category_confidence"}).drop("needs_model"), "case_id", "left")
    return guarded(every.join(decided, "case_id", "left").join(read, "case_id", "left"))


def guarded(rows: DataFrame) -> DataFrame:
    """Rows of a run in which nothing is left open: a comparison or a mail without a decision needs review, as unreadable;
    mails of other categories are done."""
    known, compares = F.col("category").isNotNull(), F.col("category") == "BL_COMPARISON"
    lost = ~known | (compares & F.col("status").isNull())
    zero = F.lit(0).cast("long")
    return rows.withColumns(
        {
            "category": F.coalesce("category", F.lit("GENERAL")), "decided_by": F.coalesce("decided_by", F.lit("rule")), "category_confidence": F.coalesce("category_confidence", F.lit(0.0)),
            "status": F.when(lost, "NEEDS_REVIEW").when(~compares, "OK").otherwise(F.col("status")), "review_reason": F.when(lost, "unreadable").otherwise(F.col("review_reason")),
            "has_defect": F.coalesce("has_defect", F.lit(False)), "defect_fields": F.coalesce("defect_fields", F.lit("")), "n_docs": F.coalesce("n_docs", zero), "n_unreadable": F.coalesce("n_unreadable", zero),
        }
    )


def write(cases: DataFrame, metrics: DataFrame, folder: str) -> None:
    """submission, report and metrics of a run, as JSON lines in folders of these names."""
    from ..sources.inbox import write_submission

    write_submission(cases, f"{folder}/submission")
    cases.write.mode("overwrite").json(f"{folder}/report")
    metrics.write.mode("overwrite").json(f"{folder}/metrics")
