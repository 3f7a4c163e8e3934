"""Registered queries of whole runs, work lists, reviews and greedy picks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import oracle as o
from .operators import compare, metering, reports, review, sampling, worklist
from .plans import cases as plan
from .plans import run
from .queries import _CASES, _EFFECTIVE, _REPORT, _cases, _reviews
from .registry import query
from .sources import derive, versions
from .storage import shared_dir, written
from .streaming import live

#: Cases of a run: what attachments a mail carries by construction, its category with what they say, the decision.
_RUN = f"""{o.MAILS}, {_CASES},
    att AS (SELECT case_id, v, case_id % 7 <> 3 AS bl_there, case_id % 7 = 5 AS bl_bad FROM pair WHERE case_id % 12 IN (0, 11)),
    extra AS (SELECT case_id AS email_id, CASE WHEN bl_there AND NOT bl_bad AND v <> 10 THEN 3.0 ELSE 1.5 END AS gain FROM att),
    total AS (SELECT s.email_id, s.category, s.i, s.s + CASE WHEN s.category = 'BL_COMPARISON' THEN coalesce(e.gain, 0) ELSE 0 END AS s FROM scored s LEFT JOIN extra e USING (email_id)),
    kind AS (SELECT email_id AS case_id, CASE WHEN s <= 0 THEN 'GENERAL' ELSE category END AS category FROM total QUALIFY row_number() OVER (PARTITION BY email_id ORDER BY s DESC, i) = 1),
    {o.intent()},
    joined AS (SELECT k.case_id, category, a.case_id IS NOT NULL AS si_there, coalesce(bl_there, false) AS bl_there, coalesce(bl_bad, false) AS bl_bad, i.a >= 1.5 AND i.a > i.d AS expects, i.d >= 1.5 AND i.d >= i.a AS drafts, d.status AS d_status, d.review_reason AS d_reason, d.defect_fields AS d_fields
               FROM kind k JOIN intent i ON i.email_id = k.case_id LEFT JOIN att a USING (case_id) LEFT JOIN decided d USING (case_id)),
    outcome_ AS (SELECT *, CASE WHEN category <> 'BL_COMPARISON' THEN 'done' WHEN NOT si_there AND drafts AND NOT expects THEN 'done' WHEN NOT si_there AND expects OR si_there AND NOT bl_there THEN 'missing' WHEN NOT si_there THEN 'done' WHEN bl_bad THEN 'bad' ELSE 'pair' END AS how FROM joined),
    run_ AS (SELECT case_id, category, 'rule' AS decided_by, CASE how WHEN 'done' THEN 'OK' WHEN 'pair' THEN d_status ELSE 'NEEDS_REVIEW' END AS status, CASE how WHEN 'missing' THEN 'missing_attachment' WHEN 'bad' THEN 'unreadable' WHEN 'pair' THEN d_reason END AS review_reason,
        how = 'pair' AND d_fields <> '' AS has_defect, CASE how WHEN 'pair' THEN d_fields ELSE '' END AS defect_fields, CASE WHEN category <> 'BL_COMPARISON' OR NOT si_there THEN 0 WHEN bl_there THEN 2 ELSE 1 END AS n_docs, CASE WHEN category = 'BL_COMPARISON' AND bl_there AND bl_bad THEN 1 ELSE 0 END AS n_unreadable FROM outcome_)"""


def _run(spark, sf_dir):
    return run.run(derive.emails(spark, sf_dir), derive.run_docs(derive.pairs(spark, sf_dir)))


@query(f"WITH {_RUN} SELECT case_id, category, decided_by, status, review_reason, has_defect, defect_fields FROM run_")
def run_submission(spark, sf_dir):
    """Mails and attachments in, a decision a mail out."""
    return _run(spark, sf_dir).select("case_id", "category", "decided_by", "status", "review_reason", "has_defect", "defect_fields")


@query(f"WITH {_RUN} SELECT case_id, category, decided_by, status, review_reason, has_defect, defect_fields, row_number() OVER (ORDER BY case_id) - 1 AS ord FROM run_")
def stream_submission(spark, sf_dir):
    """The same as a stream: the mails of the orders' files, decided in batches, from the table that the run keeps."""
    at = f"{shared_dir(spark)}/dockett-stream-{uuid.uuid4().hex}"
    orders = spark.readStream.schema(derive.read(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders*.parquet")
    given = written(derive.run_docs(derive.pairs(spark, sf_dir)), "stream-docs")
    docs = lambda mails: given.join(mails.select(F.col("email_id").alias("case_id")), "case_id", "left_semi")
    live.start(derive.mails_of(orders).withColumn("at", F.lit(0)), docs, f"{at}/cases", f"{at}/checkpoint", once=True).awaitTermination()
    return versions.read(spark, f"{at}/cases").select("case_id", "category", "decided_by", "status", "review_reason", "has_defect", "defect_fields", "ord")


@query(
    f"""WITH {_RUN}, f AS (SELECT 'total' AS kind, 'emails' AS value, 1 AS n FROM run_ UNION ALL SELECT 'total', 'decided_by_rule', 1 FROM run_ UNION ALL SELECT 'total', 'documents_read', n_docs FROM run_ UNION ALL SELECT 'total', 'documents_unreadable', n_unreadable FROM run_
        UNION ALL SELECT 'category', category, 1 FROM run_ UNION ALL SELECT 'status', status, 1 FROM run_ UNION ALL SELECT 'review_reason', review_reason, 1 FROM run_ WHERE review_reason IS NOT NULL) SELECT kind, value, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY ALL"""
)
def run_report(spark, sf_dir):
    return reports.run_report(_run(spark, sf_dir))


@query("SELECT count(*) AS emails, CAST(round_even(sum((o_orderkey % 1000) * 0.5), 1) AS DOUBLE) AS total_ms, CAST(round_even(CAST(sum((o_orderkey % 1000) * 0.5) AS DOUBLE) / count(*), 2) AS DOUBLE) AS mean_ms FROM orders")
def run_times(spark, sf_dir):
    return reports.run_times(derive.read(spark, sf_dir, "orders").select(((F.col("o_orderkey") % 1000) * F.lit(0.5)).alias("duration_ms")))


@query(
    f"""WITH {_CASES} SELECT case_id, 'BL_COMPARISON' AS category, 'rule' AS decided_by, CASE WHEN case_id % 6 = 0 THEN 'unreadable' ELSE gate_status END AS gate_status, CASE WHEN case_id % 6 = 0 THEN 'NEEDS_REVIEW' ELSE status END AS status,
        CASE WHEN case_id % 6 = 0 THEN 'unreadable' ELSE review_reason END AS review_reason, CASE WHEN case_id % 6 = 0 THEN '' ELSE defect_fields END AS defect_fields FROM decided"""
)
def direct_compare(spark, sf_dir):
    bad = (F.col("case_id") % 6 == 0) & (F.col("side") == "BL")
    docs = derive.texts(derive.pairs(spark, sf_dir)).select("case_id", "side", F.when(~bad, F.col("text")).alias("text"), F.when(bad, "corrupt").alias("unreadable"))
    return plan.direct(written(docs, "handed-over")).select("case_id", "category", "decided_by", "gate_status", "status", "review_reason", "defect_fields")


@query(f"WITH {_REPORT} SELECT count(*) AS emails, count_if(category = 'BL_COMPARISON') AS comparisons, count_if(status = 'MISMATCH') AS with_defect, count_if(status = 'NEEDS_REVIEW') AS escalated, count_if(status = 'MISMATCH') / count_if(category = 'BL_COMPARISON') AS baseline FROM cases")
def pattern_totals(spark, sf_dir):
    return reports.pattern_totals(_cases(spark, sf_dir))


#: Rows of a case list with attachments, re-checks and scans by number.
_ROWS = f"""{_EFFECTIVE}, rows_ AS (SELECT c.case_id, c.category, c.shipper, c.decided_by, c.status AS system_status, c.defect_fields AS system_fields, e.status, e.defect_fields, e.review_reason, e.reviewed, e.source, c.case_id % 4 AS n_attachments,
    CASE WHEN c.case_id % 10 = 0 THEN 1 ELSE 0 END AS recheck_count, c.case_id % 9 = 0 AS scanned, c.case_id % 18 = 9 AS scan_transcribed FROM cases c JOIN effective e USING (case_id)),
    judged AS (SELECT *, category = 'BL_COMPARISON' AND (n_attachments >= 2 OR system_status = 'NEEDS_REVIEW' OR recheck_count > 0 OR reviewed) AS reviewable,
        CASE WHEN NOT reviewed THEN 'pending' WHEN status = 'NEEDS_REVIEW' THEN 'cant_tell' WHEN source <> 'review' OR status = system_status AND (status <> 'MISMATCH' OR list_sort(string_split(defect_fields, ',')) = list_sort(string_split(system_fields, ','))) THEN 'agreed' ELSE 'corrected' END AS state FROM rows_)"""


def _rows(spark, sf_dir):
    cases, k = _cases(spark, sf_dir), F.col("case_id")
    senders = cases.filter(k % 3 != 0).select("case_id", F.concat(F.lit("desk"), (k % 5).cast("string")).alias("sender"))
    rows = worklist.case_rows(cases, _reviews(cases), senders)
    return rows.withColumns({"n_attachments": k % 4, "recheck_count": F.when(k % 10 == 0, 1).otherwise(0), "scanned": k % 9 == 0, "scan_transcribed": k % 18 == 9, "ord": k})


@query(f"WITH {_ROWS} SELECT case_id, CASE WHEN case_id % 3 = 0 THEN 'unknown' ELSE 'desk' || CAST(case_id % 5 AS VARCHAR) END AS sender, status, system_status, review_reason, source AS outcome_source FROM rows_ WHERE category = 'BL_COMPARISON' AND status = 'NEEDS_REVIEW' AND decided_by = 'rule'")
def case_list(spark, sf_dir):
    return worklist.filtered(_rows(spark, sf_dir), "BL_COMPARISON", "NEEDS_REVIEW", "rule").select("case_id", "sender", "status", "system_status", "review_reason", "outcome_source")


@query(f"WITH {_ROWS} SELECT case_id, state, reviewable, category = 'BL_COMPARISON' AND n_attachments >= 2 AS has_pair FROM judged")
def review_states(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return rows.select("case_id", worklist.review_state(rows).alias("state"), worklist.reviewable(rows).alias("reviewable"), worklist.has_pair(F.col("category"), F.col("n_attachments")).alias("has_pair"))


@query(f"WITH {_ROWS} SELECT 'corrected' AS shown, case_id FROM judged WHERE reviewable AND state = 'corrected' AND status = 'MISMATCH' UNION ALL SELECT 'general', case_id FROM judged WHERE category = 'GENERAL'")
def visible_cases(spark, sf_dir):
    """The page under two sets of filters; the review filter does not apply to a category without comparisons."""
    rows = _rows(spark, sf_dir)
    one = worklist.visible(rows, None, "MISMATCH", "corrected").select(F.lit("corrected").alias("shown"), "case_id")
    return one.unionByName(worklist.visible(rows, "GENERAL", None, "pending").select(F.lit("general").alias("shown"), "case_id"))


@query(
    f"""WITH {_ROWS}, dim AS (SELECT 'status' AS kind, unnest(['OK', 'MISMATCH', 'NEEDS_REVIEW']) AS value UNION ALL SELECT 'category', unnest(['SPAM', 'GENERAL', 'INVOICE_QUERY', 'SI_REQUEST', 'BL_COMPARISON']))
        SELECT kind, value, count(r.case_id) AS n FROM dim LEFT JOIN rows_ r ON kind = 'status' AND value = r.status OR kind = 'category' AND value = r.category GROUP BY ALL"""
)
def effective_counts(spark, sf_dir):
    return worklist.counts(_rows(spark, sf_dir))


@query(
    f"""WITH {_ROWS}, first_ AS (SELECT *, CASE WHEN case_id % 2 = 0 THEN category ELSE 'SPAM' END AS guess FROM rows_ ORDER BY case_id LIMIT 5)
        SELECT count(guess) AS answered, count_if(guess = category) AS agreed, CAST(60.0 / count(*) AS DOUBLE) AS per_email_seconds, CAST(60.0 / count(*) AS DOUBLE) * (SELECT count(*) FROM rows_) AS classify_all_seconds FROM first_"""
)
def exercise_pace(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    guesses = rows.select("case_id", F.when(F.col("case_id") % 2 == 0, F.col("category")).otherwise("SPAM").alias("guess"))
    return worklist.exercise(rows, guesses, 60.0)


@query(
    f"""WITH {_ROWS}, c AS (SELECT *, CASE WHEN defect_fields = '' THEN 0 ELSE len(string_split(defect_fields, ',')) END AS n FROM rows_ WHERE category = 'BL_COMPARISON'),
        f AS (SELECT case_id, shipper, unnest(string_split(defect_fields, ',')) AS field, unnest(range(1, len(string_split(defect_fields, ',')) + 1)) AS pos FROM c WHERE status = 'MISMATCH' AND defect_fields <> ''),
        g AS (SELECT count(*) AS n, min(case_id * 10 + pos) AS head FROM f GROUP BY shipper, field HAVING count(*) >= 2)
        SELECT coalesce((SELECT min(case_id) FROM c WHERE status = 'NEEDS_REVIEW' AND review_reason = 'missing_attachment'), (SELECT min(case_id) FROM c WHERE status = 'NEEDS_REVIEW')) AS recheck, coalesce((SELECT min(case_id) FROM c WHERE scan_transcribed), (SELECT min(case_id) FROM c WHERE scanned)) AS scan,
            (SELECT bool_or(scan_transcribed) FROM c) AS scan_read_out, (SELECT CAST(head // 10 AS BIGINT) FROM g ORDER BY n DESC, head LIMIT 1) AS history, (SELECT case_id FROM c WHERE status = 'MISMATCH' ORDER BY n DESC, case_id LIMIT 1) AS mismatch"""
)
def showcases(spark, sf_dir):
    return worklist.showcases(_rows(spark, sf_dir))


@query(
    """WITH d AS (SELECT user_id AS case_id, event_type = 'error' AS scan, event_type = 'error' AND event_id % 3 = 0 AS read FROM events)
        SELECT case_id, bool_or(scan) AS scanned, bool_or(read) AS scan_transcribed FROM d GROUP BY case_id"""
)
def scan_states(spark, sf_dir):
    e = derive.read(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").cast("string").alias("path"), F.when(F.col("event_type") == "error", "no_text_layer").when(F.col("event_type") == "click", "corrupt").alias("unreadable"), "event_id")
    return worklist.scan_states(e.drop("event_id"), e.filter("event_id % 3 = 0").select("case_id", "path"))


_RUN_EVENTS = "re AS (SELECT user_id AS run_id, ts AS moment, CASE event_type WHEN 'signup' THEN 'created' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'other' END AS kind, event_id FROM events)"
_RUNS = f"""{_RUN_EVENTS}, one AS (SELECT run_id, min(moment) FILTER (WHERE kind = 'created') AS created, max(moment) FILTER (WHERE kind IN ('done', 'failed')) AS ended, arg_max(kind, moment) FILTER (WHERE kind IN ('done', 'failed')) AS last, arg_max(event_id, moment) FILTER (WHERE kind IN ('done', 'failed')) AS e FROM re GROUP BY run_id),
    runs_ AS (SELECT run_id, coalesce(last, 'running') AS status, CASE WHEN last = 'failed' THEN 'error ' || CAST(e AS VARCHAR) END AS error, CAST(row_number() OVER (ORDER BY created DESC, run_id DESC) AS INTEGER) AS place,
        coalesce(run_id = first_value(run_id) OVER (ORDER BY CASE WHEN last = 'done' THEN ended END DESC NULLS LAST) AND last = 'done', false) AS latest_done FROM one WHERE created IS NOT NULL)"""


def _runs(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t == "signup", "created").when(t == "purchase", "done").when(t == "error", "failed").otherwise("other")
    return worklist.runs(derive.read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("ts").alias("at"), kind.alias("kind"), F.concat(F.lit("error "), F.col("event_id").cast("string")).alias("error")))


@query(f"WITH {_RUNS} SELECT * FROM runs_")
def run_list(spark, sf_dir):
    return _runs(spark, sf_dir).select("run_id", "status", "error", "place", "latest_done")


@query(f"WITH {_RUNS} SELECT o_orderkey AS case_id, run_id FROM orders JOIN runs_ ON o_orderkey % 40 = run_id WHERE status = 'done'")
def submittable_cases(spark, sf_dir):
    cases = derive.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") % 40).alias("run_id"))
    return worklist.submittable(cases, _runs(spark, sf_dir))


@query(
    """WITH c AS (SELECT o_orderkey AS case_id, o_orderkey * 2 AS ord, o_orderstatus AS status FROM orders), f AS (SELECT user_id * 150 AS case_id, max(event_id) AS moment, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id),
        j AS (SELECT f.case_id, c.ord, f.status, moment FROM f LEFT JOIN c USING (case_id))
        SELECT * FROM c WHERE case_id NOT IN (SELECT case_id FROM f) UNION ALL SELECT case_id, ord, status FROM j WHERE ord IS NOT NULL UNION ALL SELECT case_id, (SELECT max(ord) FROM c) + row_number() OVER (ORDER BY moment, case_id), status FROM j WHERE ord IS NULL"""
)
def replaced_cases(spark, sf_dir):
    cases = derive.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), (F.col("o_orderkey") * 2).alias("ord"), F.col("o_orderstatus").alias("status"))
    fresh = derive.read(spark, sf_dir, "events").select((F.col("user_id") * 150).alias("case_id"), F.col("event_id").alias("at"), F.col("event_type").alias("status"))
    return worklist.replaced(cases, fresh)


@query("SELECT event_id AS case_id, event_id AS ord FROM events ORDER BY event_id DESC LIMIT 5")
def recent_cases(spark, sf_dir):
    return worklist.recent(derive.read(spark, sf_dir, "events").select(F.col("event_id").alias("case_id"), F.col("event_id").alias("ord")))


#: Cases for replies: some lost their documents, some are scans or broken files, the rest as compared.
_REPLIED = f"""{o.PAIRS}, {o.COMPARED}, {o.OUTCOME},
    rc AS (SELECT case_id, CASE WHEN case_id % 9 < 5 THEN 'NEEDS_REVIEW' ELSE status END AS status, CASE case_id % 9 WHEN 0 THEN 'missing_attachment' WHEN 1 THEN 'missing_attachment' WHEN 2 THEN 'unreadable' WHEN 3 THEN 'unreadable' WHEN 4 THEN 'wrong_doc_type' ELSE review_reason END AS why FROM outcome),
    asked AS (SELECT case_id, string_agg(replace(replace(field, '_kg', ''), '_', ' '), '|' ORDER BY field_ord) FILTER (WHERE verdict = 'UNCOMPARABLE' AND reason IN ('si_blank', 'bl_blank', 'si_unparseable', 'bl_unparseable', 'unit_differs', 'ocr_confusable')) AS a,
        string_agg(replace(replace(field, '_kg', ''), '_', ' '), '|' ORDER BY field_ord) FILTER (WHERE verdict = 'MISMATCH') AS d FROM cmp GROUP BY case_id)"""


@query(
    f"""WITH {_REPLIED}, s AS (SELECT case_id, status, a, d, CASE WHEN status = 'OK' THEN 'no_discrepancy' WHEN status = 'MISMATCH' THEN 'discrepancy' WHEN case_id % 9 = 0 THEN 'attachments_missing' WHEN case_id % 9 = 1 THEN 'document_missing' WHEN case_id % 9 = 2 THEN 'scanned_copies' WHEN case_id % 9 = 3 THEN 'file_unopenable'
            WHEN case_id % 9 = 4 THEN 'wrong_document' WHEN a IS NOT NULL OR d IS NOT NULL THEN 'values_to_confirm' ELSE 'review_generic' END AS situation FROM rc JOIN asked USING (case_id))
        SELECT case_id, situation, CASE WHEN case_id % 2 = 0 THEN 'Re: BL ' || CAST(case_id AS VARCHAR) ELSE 'Re: ' || CAST(case_id AS VARCHAR) || ' — ' || CASE WHEN situation = 'no_discrepancy' THEN 'SI/BL checked, no discrepancy' WHEN situation = 'discrepancy' THEN 'discrepancy found between SI and draft BL'
            WHEN situation IN ('scanned_copies', 'review_generic') THEN 'SI/BL check: manual review in progress' ELSE 'SI/BL check: action required' END END AS subject,
            CASE situation WHEN 'no_discrepancy' THEN 'No discrepancy was found.' WHEN 'discrepancy' THEN 'Could you please confirm which value is correct so we can finalise the Bill of Lading?'
                WHEN 'attachments_missing' THEN 'Could you please re-send it with both the Shipping Instruction and the draft Bill of Lading attached?' WHEN 'document_missing' THEN 'Could you please send the draft Bill of Lading so we can compare the two?'
                WHEN 'scanned_copies' THEN 'There is no need to re-send it. We will check manually and come back to you with the result.' WHEN 'file_unopenable' THEN 'Could you please send a fresh copy of the draft Bill of Lading? Exporting it again from the original usually fixes this; forwarding the same file will not.'
                WHEN 'wrong_document' THEN 'Could you please send the draft Bill of Lading so we can compare the two?' WHEN 'review_generic' THEN 'We will come back to you shortly.'
                ELSE 'Could you please check with the customer and ' || concat_ws(' and ', 'confirm the ' || regexp_replace(replace(a, '|', ', '), ', ([^,]*)$', ' and \\1'), 'tell us which value is correct for the ' || regexp_replace(replace(d, '|', ', '), ', ([^,]*)$', ' and \\1'))
                    || ' before we release the Bill of Lading? We have not assumed the draft Bill of Lading is right.' END AS action FROM s"""
)
def reply_drafts(spark, sf_dir):
    return _replies(spark, sf_dir).select("case_id", "situation", "subject", "action")


def _replies(spark, sf_dir):
    values = derive.values(derive.pairs(spark, sf_dir))
    seen = (F.col("field") == "port_of_discharge") & (F.col("v") == 1) & (F.col("case_id") % 3 == 0)
    compared = compare.compare(values).withColumn("bl_reviewed", F.when(seen, F.lit(" AS SEEN ON THE SCAN ")))
    k = F.col("case_id") % 9
    cases = _cases(spark, sf_dir).select(
        "case_id", F.when(F.col("case_id") % 2 == 0, F.concat(F.lit("RE: Fw_ BL "), F.col("case_id").cast("string"))).alias("subject"), F.lit("BL_COMPARISON").alias("category"),
        F.when(k < 5, "NEEDS_REVIEW").otherwise(F.col("status")).alias("status"), F.when(k < 2, "missing_attachment").when(k < 4, "unreadable").when(k == 4, "wrong_doc_type").otherwise(F.col("review_reason")).alias("review_reason"),
        (k > 0).alias("si_there"), (k > 1).alias("bl_there"), F.lit(None).cast("string").alias("si_unreadable"), F.when(k == 2, "no_text_layer").when(k == 3, "corrupt").alias("bl_unreadable"),
        F.lit("SHIPPING_INSTRUCTION").alias("si_type"), F.when(k == 4, "COMMERCIAL_INVOICE").otherwise("BILL_OF_LADING").alias("bl_type"), "defect_fields",
        F.format_string("in/%d/SI.txt", "case_id").alias("si_path"), F.format_string("C:\\in\\%d_BL.pdf", "case_id").alias("bl_path"),
    )
    return worklist.replies(cases, worklist.questions(compared))


def _reply_lines() -> str:
    """CTEs lines and told: what a reply says of each field, and its situation with the lines that belong to it."""
    given = lambda s, name: f"CASE WHEN {s}_state = 'usable' THEN 'the {name} shows \"' || {s}_s || '\"' ELSE 'it is not given on the {name} either' END"
    si, bl = "Shipping Instruction", "draft Bill of Lading"
    reads = lambda s: f"CASE WHEN {s}_s <> '' THEN ' (it reads \"' || {s}_s || '\")' ELSE '' END"
    shows = f"nm || ': the {si} shows \"' || coalesce(si_raw, '{{0}}') || '\"{{1}}the {bl} shows \"' || coalesce(bl_raw, '{{0}}') || '\"'"
    says = lambda s, name, x: f"CASE WHEN {x} <> '' THEN '{name} says \"' || {x} || '\"' ELSE '{name} has no value we could read' END"
    headings = " ".join(f"WHEN {o.q(f)} THEN {o.q(n)}" for f, n in worklist.FIELD_HEADINGS.items())
    return f"""nm AS (SELECT *, CASE field {headings} END AS nm, {o.strip("coalesce(si_raw, '')")} AS si_s, {o.strip("coalesce(bl_raw, '')")} AS bl_s FROM cmp),
    qs AS (SELECT *, '  - ' || CASE reason WHEN 'si_blank' THEN nm || ': left blank on the {si}' || {reads('si')} || '; ' || {given('bl', bl)} || '.' WHEN 'bl_blank' THEN nm || ': left blank on the {bl}' || {reads('bl')} || '; ' || {given('si', si)} || '.'
            WHEN 'si_unparseable' THEN nm || ': the {si} shows "' || si_raw || '", which we could not read as a value; ' || {given('bl', bl)} || '.' WHEN 'bl_unparseable' THEN nm || ': the {bl} shows "' || bl_raw || '", which we could not read as a value; ' || {given('si', si)} || '.'
            WHEN 'unit_differs' THEN replace({shows.format('', ' and ')}, ' (kg)', '') || '; the figures are the same but the units differ, so one of the two documents needs amending.'
            WHEN 'ocr_confusable' THEN {shows.format('', ' and ')} || '; they differ only in characters that are easy to misread on a scan.' END AS question,
            '  - ' || {shows.format('?', '; ')} || '.' AS differs, '  - ' || nm || ': ' || {says('si', 'SI', 'si_s')} || ', ' || {says('bl', 'draft BL', "CASE WHEN field = 'port_of_discharge' AND v = 1 AND case_id % 3 = 0 THEN 'AS SEEN ON THE SCAN' ELSE bl_s END")} AS quoted FROM nm),
    told AS (SELECT case_id, string_agg(question, chr(10) ORDER BY field_ord) FILTER (WHERE verdict = 'UNCOMPARABLE') AS ql, string_agg(differs, chr(10) ORDER BY field_ord) FILTER (WHERE verdict = 'MISMATCH') AS dl, string_agg(quoted, chr(10) ORDER BY field_ord) FILTER (WHERE verdict = 'MISMATCH') AS tl,
            count_if(verdict = 'MATCH') AS agreed, count_if(verdict = 'UNCOMPARABLE' AND question IS NULL) AS unread FROM qs GROUP BY case_id)"""


@query(
    f"""WITH {_REPLIED}, {_reply_lines()}, s AS (SELECT *, CAST(case_id AS VARCHAR) AS c, CASE WHEN status = 'OK' THEN 'no_discrepancy' WHEN status = 'MISMATCH' THEN 'discrepancy' ELSE ['attachments_missing', 'document_missing', 'scanned_copies', 'file_unopenable', 'wrong_document', NULL][case_id % 9 + 1] END AS t FROM rc JOIN asked USING (case_id) JOIN told USING (case_id)),
        r AS (SELECT *, coalesce(t, CASE WHEN a IS NOT NULL OR d IS NOT NULL THEN 'values_to_confirm' ELSE 'review_generic' END) AS situation FROM s),
        l AS (SELECT *, CASE situation WHEN 'no_discrepancy' THEN 'We compared the draft Bill of Lading against the Shipping Instruction across all seven fields we check.' WHEN 'discrepancy' THEN 'We compared the draft Bill of Lading against the Shipping Instruction and found discrepancies in the following fields.'
                WHEN 'attachments_missing' THEN 'Unfortunately, no attachments reached us with it.' WHEN 'document_missing' THEN 'We need both the Shipping Instruction and the draft Bill of Lading for the check, and only one came through.' WHEN 'file_unopenable' THEN 'We could not open one of the attachments, so we could not complete the check.'
                WHEN 'scanned_copies' THEN 'One of the documents came through as a scanned image, which we check manually rather than automatically.' WHEN 'wrong_document' THEN 'One of the attachments is not the document we need for this check.'
                WHEN 'values_to_confirm' THEN 'We compared the draft Bill of Lading against the Shipping Instruction, and some fields need your confirmation.' ELSE 'We were not able to complete the check automatically, and a member of our team is looking at it.' END AS context,
            coalesce(CASE situation WHEN 'discrepancy' THEN tl WHEN 'attachments_missing' THEN '  - Attachments received: none.' WHEN 'document_missing' THEN '  - Received: Shipping Instruction (SI.txt).' || chr(10) || '  - Still needed: draft Bill of Lading.'
                WHEN 'wrong_document' THEN '  - Received: Shipping Instruction (SI.txt).' || chr(10) || '  - Received: Commercial Invoice (' || c || '_BL.pdf).' || chr(10) || '  - Still needed: draft Bill of Lading.'
                WHEN 'file_unopenable' THEN '  - Draft Bill of Lading (' || c || '_BL.pdf): the file will not open.' WHEN 'scanned_copies' THEN '  - Draft Bill of Lading (' || c || '_BL.pdf): a scanned image, which we check manually.'
                WHEN 'values_to_confirm' THEN concat_ws(chr(10), ql, dl, CASE WHEN agreed > 0 AND unread > 0 THEN '  - ' || agreed || ' of the other fields are consistent between the two documents; our team is checking the rest manually.'
                    WHEN agreed = 1 THEN '  - The other field is consistent between the two documents.' WHEN agreed > 1 THEN '  - The other ' || agreed || ' fields are consistent between the two documents.' END) END, '') AS facts,
            CASE WHEN situation IN ('scanned_copies', 'review_generic') THEN 'Thank you for your patience.' ELSE 'Thank you.' END AS closing FROM r)
        SELECT case_id, facts, context, closing, 'Hello,' || chr(10) || chr(10) || 'Thank you for your email. ' || context || CASE WHEN facts <> '' THEN chr(10) || chr(10) || facts ELSE '' END AS opening FROM l"""
)
def reply_bodies(spark, sf_dir):
    """What replies quote and how they read up to what they ask for, which reply_drafts gives."""
    r = _replies(spark, sf_dir)
    opening = F.replace("body", F.concat(F.lit("\n\n"), "action", F.lit("\n\n"), "closing", F.lit("\n\nRegards,")), F.lit(""))
    return r.select("case_id", F.array_join("facts", "\n").alias("facts"), "context", "closing", opening.alias("opening"))


#: Events of reviews, withdrawals, retries and re-checks.
_HANDLED = """ev AS (SELECT user_id AS case_id, event_id AS moment, CASE event_type WHEN 'signup' THEN 'withdraw' WHEN 'click' THEN 'recheck' WHEN 'error' THEN 'retry' ELSE 'review' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'confirm' ELSE 'correct' END AS decision,
        user_id % 5 <> 0 AS compares, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'bl' ELSE 'bl,si' END AS resent FROM events),
    ag AS (SELECT *, kind = 'recheck' AND compares AND resent <> '' AS again FROM ev),
    tn AS (SELECT *, CAST(coalesce(sum(CASE WHEN again THEN 1 ELSE 0 END) OVER b, 0) AS INTEGER) AS done_, max(CASE WHEN kind IN ('review', 'withdraw') OR again THEN moment END) OVER b AS turn FROM ag WINDOW b AS (PARTITION BY case_id ORDER BY moment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    st AS (SELECT tn.*, CASE WHEN p.kind = 'review' THEN p.decision END AS stood FROM tn LEFT JOIN ev p ON p.case_id = tn.case_id AND p.moment = tn.turn),
    handled AS (SELECT *, CASE WHEN kind = 'withdraw' AND stood IS NULL THEN 'no review to withdraw' WHEN kind = 'retry' AND done_ > 0 THEN 're-checked on amended documents' WHEN kind = 'recheck' AND NOT compares THEN 'no pair to compare' WHEN kind = 'recheck' AND NOT again THEN 'nothing was sent again' END AS refused FROM st)"""


def _handled(spark, sf_dir):
    t, n = F.col("event_type"), F.col("event_id")
    kind = F.when(t == "signup", "withdraw").when(t == "click", "recheck").when(t == "error", "retry").otherwise("review")
    return review.handled(
        derive.read(spark, sf_dir, "events").select(
            F.col("user_id").alias("case_id"), n.alias("at"), kind.alias("kind"), F.when(n % 2 == 0, "confirm").otherwise("correct").alias("decision"),
            F.when(F.col("user_id") % 5 == 0, "GENERAL").otherwise("BL_COMPARISON").alias("category"), F.when(n % 3 == 0, "").when(n % 3 == 1, "bl").otherwise("bl,si").alias("resent"),
        )
    )


@query(f"WITH {_HANDLED} SELECT case_id, moment AS event_id, kind, refused IS NULL AS accepted, refused, CASE WHEN again THEN done_ + 1 END AS version, stood FROM handled")
def review_events(spark, sf_dir):
    return _handled(spark, sf_dir).select("case_id", F.col("at").alias("event_id"), "kind", "accepted", "refused", F.col("version").cast("int").alias("version"), "stood")


@query(
    f"""WITH {_HANDLED}, l AS (SELECT case_id, max(moment) FILTER (WHERE refused IS NULL AND kind IN ('review', 'withdraw', 'recheck')) AS m, count_if(refused IS NULL AND kind = 'recheck') AS rechecks, count_if(refused IS NULL AND kind = 'retry') AS retries FROM handled GROUP BY case_id)
        SELECT l.case_id, CASE WHEN e.kind = 'review' THEN e.decision END AS review, rechecks, retries FROM l LEFT JOIN ev e ON e.case_id = l.case_id AND e.moment = m"""
)
def standing_reviews(spark, sf_dir):
    return review.standing(_handled(spark, sf_dir))


@query(f"WITH {_HANDLED} SELECT case_id, done_ + 1 AS version, moment AS event_id, resent, stood AS review FROM handled WHERE again")
def recheck_history(spark, sf_dir):
    return review.recheck_history(_handled(spark, sf_dir)).select("case_id", F.col("version").cast("int").alias("version"), F.col("at").alias("event_id"), "resent", "review")


def _picks(most: int) -> str:
    """Turn by turn: the worst candidate of a document and field not seen, else of a document not seen, else any."""
    out = "cand AS (SELECT event_type AS mode, event_id % 6 - 1 AS sev, event_id AS ord, user_id AS doc, CAST(value AS INTEGER) % 7 AS field FROM events), p0 AS (SELECT NULL::VARCHAR AS mode, NULL::BIGINT AS ord, NULL::BIGINT AS doc, NULL::INTEGER AS field, 0 AS place WHERE false)"
    for i in range(1, most + 1):
        out += f""", p{i} AS (SELECT * FROM p{i - 1} UNION ALL SELECT mode, ord, doc, field, {i} FROM (SELECT c.*, CASE WHEN EXISTS (SELECT 1 FROM p{i - 1} p WHERE p.mode = c.mode AND p.doc = c.doc) THEN 2 WHEN EXISTS (SELECT 1 FROM p{i - 1} p WHERE p.mode = c.mode AND p.field = c.field) THEN 1 ELSE 0 END AS relax
            FROM cand c WHERE NOT EXISTS (SELECT 1 FROM p{i - 1} p WHERE p.mode = c.mode AND p.ord = c.ord)) QUALIFY row_number() OVER (PARTITION BY mode ORDER BY relax, sev, ord) = 1)"""
    return out


@query(f"WITH {_picks(5)} SELECT mode, place, ord FROM p5")
def example_picks(spark, sf_dir):
    e = derive.read(spark, sf_dir, "events")
    return sampling.examples(e.select(F.col("event_type").alias("mode"), (F.col("event_id") % 6 - 1).alias("severity"), F.col("event_id").alias("ord"), F.col("user_id").alias("document"), (F.bround("value", 0).cast("int") % 7).cast("string").alias("field")))


# Slots in order: what each wants, as an expression that both engines read.
_SLOTS = {
    "urgent_done": "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'", "urgent": "o_orderpriority = '1-URGENT'", "urgent_again": "o_orderpriority = '1-URGENT'", "large": "o_totalprice > 400000",
    "done": "o_orderstatus = 'F'", "nobody": "o_custkey < 0", "open": "o_orderstatus = 'O' AND o_custkey % 7 = 0", "any": "o_orderkey >= 0", "any_again": "o_orderkey >= 0",
}


def _slot_sql() -> str:
    out = "s0 AS (SELECT NULL::INTEGER AS place, NULL::VARCHAR AS slot, NULL::BIGINT AS case_id WHERE false)"
    for i, (name, want) in enumerate(_SLOTS.items(), 1):
        out += f", s{i} AS (SELECT * FROM s{i - 1} UNION ALL (SELECT {i}, {o.q(name)}, o_orderkey FROM orders WHERE {want} AND o_orderkey NOT IN (SELECT case_id FROM s{i - 1}) ORDER BY o_orderkey LIMIT 1))"
    return out


@query(f"WITH {_slot_sql()} SELECT place, slot, case_id FROM s{len(_SLOTS)}")
def stratified_picks(spark, sf_dir):
    orders = derive.read(spark, sf_dir, "orders").withColumn("case_id", F.col("o_orderkey"))
    return sampling.slots(orders, {name: F.expr(want) for name, want in _SLOTS.items()})


#: Questions of the events, asked in order of time: errors fail, some clicks are refused, others of a key are remembered.
_PRICED = " ".join(f"WHEN {o.q(m)} THEN {{}} * {fresh} + {{}} * {known} + {{}} * {out}" for m, (fresh, known, out) in ((m, [int(float(x) * 1000) for x in p]) for m, p in metering.PRICES.items()))
_BUDGET = f"""e AS (SELECT event_id, event_type AS purpose, row_number() OVER (ORDER BY ts, event_id) AS turn, ts, value, user_id || '/' || event_type || '/' || (event_id % 5) AS key, {[*metering.PRICES]}[user_id % {len(metering.PRICES)} + 1] AS model,
        CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' AND value < 20 THEN 'refused' ELSE 'answered' END AS said, 1000 + event_id % 1000 AS i, event_id % 300 AS c, CAST(floor(value * 10) AS BIGINT) AS u FROM events),
    h AS (SELECT key, arg_max(i, (ts, event_id)) AS hi, arg_max(u, (ts, event_id)) AS hu FROM e WHERE value > 150 GROUP BY key),
    a AS (SELECT e.*, hi, hu, CASE model {_PRICED.format(*['(i - c)', 'c', 'u'] * len(metering.PRICES))} END AS price FROM e LEFT JOIN h USING (key)),
    p AS (SELECT key, min(turn) AS p_at, arg_min(price, turn) AS p_price, arg_min(i, turn) AS p_i, arg_min(u, turn) AS p_u FROM a WHERE hi IS NULL AND said = 'answered' GROUP BY key),
    l AS (SELECT min(p_at) AS stop FROM (SELECT p_at, sum(p_price) OVER (ORDER BY p_at) AS total FROM p) WHERE total >= 500000000),
    s AS (SELECT a.*, p_i, p_u, CASE WHEN hi IS NOT NULL OR (p_at < turn AND (stop IS NULL OR p_at <= stop)) THEN 'hit' WHEN stop IS NOT NULL AND turn > stop THEN 'unavailable' ELSE said END AS state FROM a LEFT JOIN p USING (key), l),
    spent AS (SELECT event_id, purpose, state, CAST(CASE state WHEN 'hit' THEN coalesce(hi, p_i) WHEN 'answered' THEN i ELSE 0 END AS BIGINT) AS tokens_in, CAST(CASE state WHEN 'hit' THEN coalesce(hu, p_u) WHEN 'answered' THEN u ELSE 0 END AS BIGINT) AS tokens_out, CAST(CASE state WHEN 'answered' THEN price ELSE 0 END AS BIGINT) AS cost FROM s)"""


def _spent(spark, sf_dir):
    e = derive.read(spark, sf_dir, "events")
    models = F.array(*map(F.lit, metering.PRICES))
    t, n = F.col("event_type"), F.col("event_id")
    asked = e.select(
        "event_id", t.alias("purpose"), F.struct("ts", "event_id").alias("at"), F.concat_ws("/", F.col("user_id").cast("string"), t, (n % 5).cast("string")).alias("key"), F.get(models, (F.col("user_id") % len(metering.PRICES)).cast("int")).alias("model"), "value",
        F.when(t == "error", "failed").when((t == "click") & (F.col("value") < 20), "refused").otherwise("answered").alias("said"), (n % 1000 + 1000).alias("input_tokens"), (n % 300).alias("cached_tokens"), F.floor(F.col("value") * 10).alias("output_tokens"),
    )
    return metering.metered(asked, asked.filter("value > 150"), "0.50")


@query(f"WITH {_BUDGET} SELECT event_id, state, tokens_in, tokens_out, cost FROM spent")
def budget_states(spark, sf_dir):
    """What becomes of each question under a budget: remembered, paid for, refused, failed, or not asked any more."""
    return _spent(spark, sf_dir).select("event_id", "state", "tokens_in", "tokens_out", "cost")


_USED = "count_if(state IN ('hit', 'answered')) AS calls, count_if(state = 'hit') AS cached_calls, count_if(state = 'answered') AS live_calls, CAST(sum(tokens_in) AS BIGINT) AS input_tokens, CAST(sum(tokens_out) AS BIGINT) AS output_tokens, CAST(round_even(CAST(sum(cost) AS DECIMAL(28, 9)) / 1e9, 6) AS DOUBLE) AS cost_usd, count_if(state = 'refused') AS refusals, count_if(state = 'failed') AS errors, count_if(state = 'unavailable') AS unavailable FROM spent"


@query(f"WITH {_BUDGET} SELECT purpose, {_USED} GROUP BY purpose UNION ALL SELECT NULL, {_USED}")
def budget_usage(spark, sf_dir):
    return metering.usage(_spent(spark, sf_dir))
