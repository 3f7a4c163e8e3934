"""The registered queries of the document operators. Every one runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as o
from .functions import labels, text
from .constants import FIELDS
from .operators import chunks, classify, compare, doctype, perturb, reports, review, scoring
from .plans import cases as plan
from .plans import harness
from .registry import ORACLE, QUERIES, query
from .sources import derive
from .storage import dealt, written

__all__ = ["ORACLE", "QUERIES"]

def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.values(derive.pairs(spark, sf_dir))


@query(f"WITH {o.PAIRS}, {o.COMPARED} SELECT case_id, field, verdict, reason, si_key, bl_key FROM cmp")
def field_verdicts(spark, sf_dir):
    return compare.compare(_values(spark, sf_dir)).select("case_id", "field", "verdict", "reason", "si_key", "bl_key")


@query(f"WITH {o.PAIRS}, {o.COMPARED}, {o.OUTCOME} SELECT case_id, defect_fields, uncomparable_fields, n_matched FROM outcome")
def case_outcomes(spark, sf_dir):
    return compare.by_case(compare.compare(_values(spark, sf_dir))).drop("summary")


@query(f"SELECT doc_id, {o.basic('text')} AS basic FROM documents")
def norm_basic(spark, sf_dir):
    return derive.read(spark, sf_dir, "documents").select("doc_id", text.basic(F.col("text")).alias("basic"))


@query(f"WITH {o.PAIRS} SELECT case_id, field, {o.is_blank('bl_raw')} AS blank, {o.first_segment('bl_raw')} AS head FROM val")
def norm_blank(spark, sf_dir):
    return _values(spark, sf_dir).select("case_id", "field", text.is_blank(F.col("bl_raw")).alias("blank"), text.first_segment(F.col("bl_raw")).alias("head"))


@query(f"WITH {o.PAIRS} SELECT case_id, {o.org('bl_shipper')} AS shipper, {o.org('bl_consignee')} AS consignee FROM pair")
def norm_org(spark, sf_dir):
    return derive.pairs(spark, sf_dir).select("case_id", text.org(F.col("bl_shipper")).alias("shipper"), text.org(F.col("bl_consignee")).alias("consignee"))


@query(rf"WITH {o.PAIRS} SELECT case_id, {o.port('bl_port_of_discharge')} AS port, nullif(regexp_extract(upper(bl_port_of_discharge), '\(\s*([A-Z]{{2}}[A-Z0-9]{{3}})\s*\)', 1), '') AS code FROM pair")
def norm_port(spark, sf_dir):
    p = F.col("bl_port_of_discharge")
    return derive.pairs(spark, sf_dir).select("case_id", text.port(p).alias("port"), text.locode(p).alias("code"))


@query(f"WITH {o.PAIRS} SELECT case_id, {o.count('bl_container_count')} AS n_containers FROM pair")
def norm_count(spark, sf_dir):
    return derive.pairs(spark, sf_dir).select("case_id", text.container_count(F.col("bl_container_count")).alias("n_containers"))


@query(f"WITH {o.PAIRS} SELECT case_id, {o.weight('bl_gross_weight_kg')} AS kg FROM pair")
def norm_weight(spark, sf_dir):
    return derive.pairs(spark, sf_dir).select("case_id", text.gross_weight(F.col("bl_gross_weight_kg")).alias("kg"))


@query(f"SELECT doc_id, {o.contaminated('text')} AS contaminated FROM documents")
def digits_contaminated(spark, sf_dir):
    return derive.read(spark, sf_dir, "documents").select("doc_id", text.digits_contaminated(F.col("text")).alias("contaminated"))


def _lines(spark, sf_dir):
    docs = derive.read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("case_id"), F.lit("SI").alias("side"), "text")


_DOC_LINES = """
    raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM documents)
"""


@query(rf"WITH {_DOC_LINES} SELECT doc_id, count(*) AS n_lines, sum(line) AS sum_lines FROM raw WHERE trim(raw, ' ' || chr(9)) <> '' AND NOT regexp_matches(trim(raw), '^[\s=_\-*~#]+$') GROUP BY doc_id")
def content_lines(spark, sf_dir):
    return chunks.lines(_lines(spark, sf_dir)).groupBy(F.col("case_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("line").cast("decimal(38,0)").alias("sum_lines"))


def _label_sample(spark, sf_dir):
    rows = derive.read(spark, sf_dir, "conversations").select(F.col("text").alias("label"))
    known = F.array(*[F.lit(w) for w in [x for v in labels.SYNONYMS.values() for x in v] + labels.IGNORED + ["Gross Wt. total", "Total No. of Boxes", "Notify (copy)", "Marks & Nos"]])
    made = derive.read(spark, sf_dir, "orders").select(F.concat_ws(" ", F.element_at(known, (F.col("o_orderkey") % F.size(known) + 1).cast("int")), F.when(F.col("o_orderkey") % 3 == 1, F.col("o_orderpriority"))).alias("label"))
    return rows.filter("label is not null").union(made).distinct()


_KNOWN = "[" + ", ".join(o.q(w) for w in [x for v in labels.SYNONYMS.values() for x in v] + labels.IGNORED + ["Gross Wt. total", "Total No. of Boxes", "Notify (copy)", "Marks & Nos"]) + "]"


@query(
    f"""WITH k AS (SELECT {_KNOWN} AS known), made AS (SELECT DISTINCT label FROM (SELECT text AS label FROM conversations WHERE text IS NOT NULL UNION ALL
        SELECT known[CAST(o_orderkey % len(known) + 1 AS INTEGER)] || CASE WHEN o_orderkey % 3 = 1 THEN ' ' || o_orderpriority ELSE '' END FROM orders, k)),
        keyed AS (SELECT label, {o.basic('label')} AS k FROM made) SELECT label, {o.resolve('k')} AS field FROM keyed"""
)
def label_resolve(spark, sf_dir):
    return _label_sample(spark, sf_dir).select("label", labels.resolve(F.col("label"))["field"].alias("field"))


@query(f"WITH {o.PAIRS}, {o.COMPARED} SELECT reason, field, count(*) AS n FROM cmp WHERE verdict = 'UNCOMPARABLE' GROUP BY ALL")
def uncomparable_reasons(spark, sf_dir):
    return compare.compare(_values(spark, sf_dir)).filter("verdict = 'UNCOMPARABLE'").groupBy("reason", "field").agg(F.count(F.lit(1)).alias("n"))


def _compared(spark, sf_dir):
    return compare.compare(_values(spark, sf_dir))


#: Raw values as they can be read back from the texts: the wrapped consignee ends at its first line.
_READ_BACK = f"""read_back AS (SELECT case_id, side, field, raw FROM (
    SELECT case_id, 'SI' AS side, field, si_raw AS raw FROM val UNION ALL
    SELECT case_id, 'BL', field, CASE WHEN v = 7 AND field = 'consignee' THEN replace(bl_raw, ' TRADING CO', '') ELSE bl_raw END FROM val) WHERE raw IS NOT NULL)"""


def _docs(spark, sf_dir):
    # Dealt by both, as dealing by case_id alone is taken for that of the joins below, which adaptive execution puts into few tasks.
    return dealt(derive.texts(derive.pairs(spark, sf_dir)), "case_id", "side")


@query(f"WITH {o.PAIRS}, {_READ_BACK} SELECT case_id, side, field, raw FROM read_back")
def text_fields(spark, sf_dir):
    return chunks.field_values(chunks.candidates(chunks.chunks(_docs(spark, sf_dir)))).select("case_id", "side", "field", "raw")


@query(f"WITH {o.PAIRS}, {_READ_BACK} SELECT field, side, CAST(CASE WHEN {o.is_blank('raw')} THEN -80.0 ELSE 0.0 END + CASE WHEN {o.key('field', 'raw')} IS NOT NULL THEN 50.0 ELSE 0.0 END + CASE WHEN field = 'gross_weight_kg' AND side = 'BL' AND case_id % 3 = 1 THEN 15.0 ELSE 0.0 END AS DOUBLE) AS score, count(*) AS n FROM read_back GROUP BY ALL")
def candidate_scores(spark, sf_dir):
    return chunks.candidates(chunks.chunks(_docs(spark, sf_dir))).filter("rank = 1").groupBy("field", "side", "score").agg(F.count(F.lit(1)).alias("n"))


#: Lines of a made document: real values beside headings of tables, values that say nothing, totals, and two as good as each other.
_RIVALS = {
    "Shipper": [f"'{chunks.HEADER_WORDS[0]} OF GOODS ' || upper(si_shipper) || ' {chunks.HEADER_WORDS[1]}'", "'TBA'", "si_shipper", "bl_consignee"], "Gross Weight": ["'N/A'", "'QTY GROSS WEIGHT ' || length(si_shipper)", "si_gross_weight_kg", "bl_gross_weight_kg"],
    "Total Gross Weight": ["si_gross_weight_kg", "'???'"], "Consignee": ["bl_consignee", "'PACKAGES MARKS'"],
}
_RIVAL_ROWS = [(label, value) for label, values in _RIVALS.items() for value in values]


@query(
    f"""WITH {o.PAIRS}, l AS ({' UNION ALL '.join(f"SELECT case_id, CASE WHEN case_id % 2 = 0 THEN {i} ELSE {len(_RIVAL_ROWS) - 1 - i} END AS chunk_ord, {o.q(label)} AS label, {value} AS raw FROM pair" for i, (label, value) in enumerate(_RIVAL_ROWS))}),
        f AS (SELECT *, CASE label WHEN 'Shipper' THEN 'shipper' WHEN 'Consignee' THEN 'consignee' ELSE 'gross_weight_kg' END AS field FROM l), k AS (SELECT *, {o.key('field', 'raw')} AS key FROM f),
        p AS (SELECT *, CASE WHEN key IS NOT NULL AND (field = 'gross_weight_kg' OR regexp_matches(key, '[A-Z]')) THEN 50.0 ELSE 0 END + CASE WHEN starts_with(label, 'Total') THEN 15.0 ELSE 0 END + CASE WHEN {' + '.join(f"CAST(contains({o.basic('raw')}, {o.q(w)}) AS INTEGER)" for w in chunks.HEADER_WORDS)} >= 2 THEN -100.0 ELSE 0 END + CASE WHEN {o.is_blank('raw')} THEN -80.0 ELSE 0 END AS score FROM k)
        SELECT case_id, field, CAST(chunk_ord AS INTEGER) AS chunk_ord, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER w AS INTEGER) AS rank, first_value(label) OVER w AS won_label, CAST(first_value(chunk_ord) OVER w + 1 AS INTEGER) AS won_line, CAST(first_value(score) OVER w AS DOUBLE) AS won_score
        FROM p WINDOW w AS (PARTITION BY case_id, field ORDER BY score DESC, chunk_ord)"""
)
def candidate_ranks(spark, sf_dir):
    """Every candidate of a field, losers too, with what won over it."""
    lines = F.array(*[F.concat(F.lit(f"{label}: "), F.expr(value)) for label, value in _RIVAL_ROWS])
    texts = derive.pairs(spark, sf_dir).select("case_id", F.lit("SI").alias("side"), F.array_join(F.when(F.col("case_id") % 2 == 0, lines).otherwise(F.reverse(lines)), "\n").alias("text"))
    return chunks.candidates(chunks.chunks(dealt(texts, "case_id", "side"))).select("case_id", "field", "chunk_ord", "score", "rank", "won_label", F.col("won_line").cast("int").alias("won_line"), "won_score")


@query(f"WITH {o.PAIRS} SELECT case_id, 'BL' AS side, bl_consignee AS raw FROM pair WHERE v = 7")
def wrap_repair(spark, sf_dir):
    values = chunks.field_values(chunks.candidates(chunks.chunks(_docs(spark, sf_dir))))
    # Pairs lie by case already, so their texts meet in one row without an exchange, and the values join that row.
    fixed = chunks.repaired(chunks.paired(values, chunks.both_texts(derive.texts(derive.pairs(spark, sf_dir)))))
    sides = F.explode(F.array(*[F.struct(F.lit(s.upper()).alias("side"), F.col(f"{s}_raw").alias("raw"), F.col(f"{s}_wrapped").alias("wrapped")) for s in ("si", "bl")])).alias("s")
    return fixed.select("case_id", sides).filter("s.wrapped").select("case_id", "s.side", "s.raw")


@query(
    f"""WITH {o.PAIRS} SELECT case_id, side, CASE WHEN side = 'SI' THEN 'SHIPPING_INSTRUCTION' WHEN v = 10 THEN 'COMMERCIAL_INVOICE' ELSE 'BILL_OF_LADING' END AS doc_type,
        CASE WHEN side = 'SI' THEN round_even((5.8 - 0.5) / 5.8, 3) WHEN v = 10 AND case_id % 3 = 2 THEN round_even((7.2 - 0.5) / 7.2, 3) WHEN v = 10 THEN 0.99 WHEN case_id % 3 = 2 THEN round_even((5.9 - 0.5) / 5.9, 3) ELSE 0.99 END AS confidence
        FROM pair, (VALUES ('SI'), ('BL')) s(side)"""
)
def doc_type_score(spark, sf_dir):
    return doctype.doc_types(_docs(spark, sf_dir)).select("case_id", "side", "doc_type", "confidence")


@query(f"WITH {o.PAIRS} SELECT case_id, 1 AS si, 2 AS bl, CASE WHEN v = 10 THEN 'wrong_doc_type' END AS problem FROM pair")
def role_assignment(spark, sf_dir):
    typed = doctype.doc_types(_docs(spark, sf_dir)).select("case_id", F.when(F.col("side") == "SI", 1).otherwise(2).alias("ord"), "doc_type", "confidence", doctype.role_hint(F.col("path")).alias("hint"))
    cast = doctype.roles(typed)
    of = lambda s: typed.select("case_id", F.col("ord").alias(s), F.col("doc_type").alias(f"{s}_type"), F.col("confidence").alias(f"{s}_conf"))
    both = cast.join(of("si"), ["case_id", "si"], "left").join(of("bl"), ["case_id", "bl"], "left")
    return both.select("case_id", "si", "bl", doctype.pair_problem(F.col("si_type"), F.col("si_conf"), F.col("bl_type"), F.col("bl_conf")).alias("problem"))


def _views(spark, sf_dir):
    return classify.views(derive.emails(spark, sf_dir))


@query(f"WITH {o._mails()}, {o._views()} SELECT email_id, v_subject, v_body, v_body_head FROM view")
def email_clean(spark, sf_dir):
    return _views(spark, sf_dir).select("email_id", "v_subject", "v_body", "v_body_head")


@query(f"WITH {o.MAILS} SELECT email_id, name, category, gain FROM hit")
def email_rule_scores(spark, sf_dir):
    fired = classify.fired_rules(_views(spark, sf_dir))
    return fired.select("email_id", F.explode("fired").alias("r")).select("email_id", "r.name", "r.category", "r.gain")


@query(
    f"""WITH {o.MAILS} SELECT email_id, CASE WHEN s <= 0 THEN 'GENERAL' ELSE category END AS category, CASE WHEN s <= 0 THEN 0.0 ELSE round_even(0.5 * least(1, s / 8) + 0.5 * least(1, lead_ / 4), 4) END AS confidence,
        CASE WHEN s <= 0 THEN 0.0 ELSE lead_ END AS margin, s <= 0 OR s < 3 OR lead_ < 1.5 AS needs_model, coalesce((SELECT string_agg(name, ',' ORDER BY gain DESC, ord) FROM hit h WHERE h.email_id = r.email_id), 'fallback.no-rule-fired') AS rationale
        FROM ranked r WHERE rank = 1"""
)
def email_category(spark, sf_dir):
    return classify.categories(classify.fired_rules(_views(spark, sf_dir))).select("email_id", "category", "confidence", "margin", "needs_model", "rationale")


@query(
    f"""WITH {o._mails()}, {o._views()}, {o.intent()} SELECT email_id, a AS attach_score, d AS draft_score, a >= 1.5 AND a > d AS expects_documents, d >= 1.5 AND d >= a AS requests_draft,
        CASE WHEN greatest(a, d) <= 0 THEN 0.0 ELSE round_even(0.5 * least(1, greatest(a, d) / 5) + 0.5 * (greatest(a, d) - least(a, d)) / greatest(a, d), 4) END AS intent_confidence FROM intent"""
)
def email_intent(spark, sf_dir):
    return classify.intents(_views(spark, sf_dir)).select("email_id", "attach_score", "draft_score", "expects_documents", "requests_draft", "intent_confidence")


#: Outcomes of the gate by construction: what each planted variation must come to.
_GATED = f"""gated AS (SELECT case_id, v, o.status, o.defect_fields, o.review_reason,
    CASE WHEN v = 10 THEN 'wrong_document' WHEN o.review_reason = 'missing_value' OR uncomparable_fields <> '' AND NOT coalesce(soft, false) THEN 'blank_value' WHEN v = 3 THEN 'ocr_confusable' WHEN v = 5 THEN 'unit_differs' ELSE 'grounded' END AS gate_status
    FROM outcome o JOIN (SELECT case_id, v FROM pair) USING (case_id) LEFT JOIN (SELECT case_id, bool_and(reason IN ('ocr_confusable', 'unit_differs')) AS soft FROM cmp WHERE verdict = 'UNCOMPARABLE' GROUP BY case_id) USING (case_id))"""
_CASES = f"""{o.PAIRS}, {o.COMPARED}, {o.OUTCOME}, {_GATED},
    decided AS (SELECT case_id, gate_status, CASE gate_status WHEN 'grounded' THEN status ELSE 'NEEDS_REVIEW' END AS status,
        CASE gate_status WHEN 'wrong_document' THEN 'wrong_doc_type' WHEN 'blank_value' THEN 'missing_value' WHEN 'grounded' THEN NULL ELSE 'unreadable' END AS review_reason,
        gate_status = 'grounded' AND defect_fields <> '' AS has_defect, CASE gate_status WHEN 'grounded' THEN defect_fields ELSE '' END AS defect_fields FROM gated)"""


def _inputs(spark, sf_dir):
    docs = written(_docs(spark, sf_dir).withColumn("unreadable", F.lit(None).cast("string")), "texts")
    mails = derive.pairs(spark, sf_dir).select("case_id", F.lit("TO CONFIRM DOCS").alias("subject"), F.lit("Attached are the SI and draft BL. Please compare.").alias("body"), F.lit("a@b.c").alias("sender"))
    return docs, mails


@query(f"WITH {_CASES} SELECT * FROM decided")
def case_status(spark, sf_dir):
    return plan.cases(*_inputs(spark, sf_dir)).select("case_id", "gate_status", "status", "review_reason", "has_defect", "defect_fields")


@query(
    """SELECT o_orderkey AS case_id, CASE o_orderkey % 5 WHEN 0 THEN 'missing_attachment' WHEN 1 THEN CASE WHEN o_orderkey % 12 = 1 THEN 'no_comparison_needed' WHEN o_orderkey % 12 IN (0, 2) THEN 'missing_attachment' ELSE 'no_comparison_needed' END WHEN 2 THEN 'unreadable' ELSE 'blank_value' END AS gate_status,
        CASE WHEN o_orderkey % 5 = 0 THEN 'attachments:1,missing_document:BL' WHEN o_orderkey % 5 = 1 THEN CASE WHEN o_orderkey % 12 IN (1, 3) THEN 'attachments:0,intent:requests_draft' WHEN o_orderkey % 12 IN (0, 2) THEN 'attachments:0,intent:expects_attached_documents' ELSE 'attachments:0,intent:unclear' END
             WHEN o_orderkey % 5 = 2 THEN 'bl:empty_file' END AS signals FROM orders"""
)
def gate_attachments(spark, sf_dir):
    """The gate's first steps: one side only, none (by the mail's intent), an empty file, blank texts."""
    key = F.col("case_id")
    orders = derive.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"))
    side = lambda s, when, text_, bad: orders.filter(when).select("case_id", F.lit(s).alias("side"), F.lit(text_).alias("text"), F.lit(bad).cast("string").alias("unreadable"))
    docs = side("SI", key % 5 != 1, "nothing", None).union(side("BL", key % 5 > 2, "nothing", None)).union(side("BL", key % 5 == 2, None, "empty_file"))
    mails = derive.emails(spark, sf_dir).withColumnRenamed("email_id", "case_id")
    out = plan.cases(docs, mails)
    return out.select("case_id", "gate_status", F.when(key % 5 < 3, F.col("signals")).alias("signals"))

#: Cases for the reports: the pairs' outcomes with a sender domain and a shipper.
_REPORT = f"""{o.PAIRS}, {o.COMPARED}, {o.OUTCOME}, shipped AS (SELECT case_id, si_shipper AS shipper, v FROM pair),
    cases AS (SELECT o.case_id, shipper, 'agent' || CAST(o.case_id % 37 AS VARCHAR) || '.com' AS domain, CASE WHEN v = 19 THEN 'GENERAL' ELSE 'BL_COMPARISON' END AS category, 'rule' AS decided_by, status, review_reason, status = 'MISMATCH' AS has_defect,
              CASE WHEN status = 'MISMATCH' THEN defect_fields ELSE '' END AS defect_fields FROM outcome o JOIN shipped USING (case_id)),
    defects AS (SELECT *, unnest(string_split(defect_fields, ',')) AS field FROM cases WHERE defect_fields <> '')"""


def _cases(spark, sf_dir):
    """The reports' cases, written: most reports read them more than once, and each reading would compare all fields again."""
    seen = compare.compare(_values(spark, sf_dir)).groupBy("case_id").agg(
        F.max("v").alias("v"), F.max(F.when(F.col("field") == "shipper", F.col("si_raw"))).alias("shipper"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("verdict") == "MISMATCH", F.col("field")))), ",").alias("fields"),
        F.count_if(F.col("verdict") == "UNCOMPARABLE").alias("open"), F.min(F.when(F.col("verdict") == "UNCOMPARABLE", F.when(F.col("reason").isin("ocr_confusable", "unit_differs"), "unreadable").otherwise("missing_value"))).alias("review_reason"),
    )
    status = F.when(F.col("open") > 0, "NEEDS_REVIEW").when(F.col("fields") != "", "MISMATCH").otherwise("OK")
    sender = F.concat(F.lit("<desk@AGENT"), (F.col("case_id") % 37).cast("string"), F.lit(".com>"))
    cases = seen.select(
        "case_id", "shipper", text.domain(sender).alias("domain"), F.when(F.col("v") == 19, "GENERAL").otherwise("BL_COMPARISON").alias("category"), F.lit("rule").alias("decided_by"), status.alias("status"), "review_reason", (status == "MISMATCH").alias("has_defect"),
        F.when(status == "MISMATCH", F.col("fields")).otherwise("").alias("defect_fields"),
    )
    return written(cases, "report-cases")


@query(f"WITH {_REPORT} SELECT count(*) AS emails, count_if(status = 'OK') AS ok, count_if(status = 'MISMATCH') AS mismatch, count_if(status = 'NEEDS_REVIEW') AS needs_review, count_if(review_reason = 'missing_value') AS missing_value, count_if(review_reason = 'unreadable') AS unreadable, CAST(1.0 AS DOUBLE) AS rule_share FROM cases")
def run_metrics(spark, sf_dir):
    return reports.run_metrics(_cases(spark, sf_dir))


_W = "(1.959963984540054 / (1 + 3.8414588206941227 / n)) * sqrt((k / n) * (1 - k / n) / n + 3.8414588206941227 / (4.0 * n * n))"
_C = "((k / n + 3.8414588206941227 / (2 * n)) / (1 + 3.8414588206941227 / n))"


@query(
    f"""WITH {_REPORT}, per AS (SELECT domain, count(*) AS emails, count_if(category = 'BL_COMPARISON') AS comparisons, count_if(status = 'MISMATCH') AS defects, count_if(status = 'NEEDS_REVIEW') AS escalated FROM cases GROUP BY domain),
        overall AS (SELECT sum(defects) / sum(comparisons) AS b FROM per), r AS (SELECT *, CAST(defects AS DOUBLE) AS k, CAST(comparisons AS DOUBLE) AS n FROM per, overall)
        SELECT domain, emails, comparisons, defects, escalated, k / n AS rate, greatest(0, {_C} - {_W}) AS ci_low, least(1, {_C} + {_W}) AS ci_high, {_C} - {_W} > b AS above_baseline, {_C} - {_W} > b OR {_C} + {_W} < b AS conclusive FROM r"""
)
def patterns_senders_wilson(spark, sf_dir):
    return reports.patterns_senders(_cases(spark, sf_dir))


@query(f"WITH {_REPORT}, g AS (SELECT domain, field, count(*) AS n, min(case_id) AS f FROM defects GROUP BY ALL), r AS (SELECT domain, field, n, CAST(row_number() OVER (PARTITION BY domain ORDER BY n DESC, f, field) AS INTEGER) AS rank FROM g) SELECT * FROM r WHERE rank <= 3")
def patterns_top_fields(spark, sf_dir):
    return reports.top_fields(_cases(spark, sf_dir))


@query(f"WITH {_REPORT}, dim(field) AS (VALUES {', '.join(f'({o.q(f)})' for f in FIELDS)}), g AS (SELECT dim.field, count(defects.field) AS n FROM dim LEFT JOIN defects USING (field) GROUP BY ALL) SELECT field, n, n / sum(n) OVER () AS share FROM g")
def patterns_fields(spark, sf_dir):
    return reports.patterns_fields(_cases(spark, sf_dir))


@query(f"WITH {_REPORT} SELECT review_reason, count(*) AS n FROM cases WHERE status = 'NEEDS_REVIEW' AND review_reason IS NOT NULL GROUP BY ALL")
def escalation_reasons(spark, sf_dir):
    return reports.escalation_reasons(_cases(spark, sf_dir))


@query(f"WITH {_REPORT} SELECT shipper, field, count(*) AS n, count(DISTINCT domain) AS senders FROM defects GROUP BY ALL HAVING count(*) >= 2 ORDER BY n DESC, shipper, field LIMIT 6")
def pattern_groups_top6(spark, sf_dir):
    return reports.shipper_groups(_cases(spark, sf_dir))


@query(f"WITH {_REPORT}, g AS (SELECT shipper, field, count(*) AS n FROM defects GROUP BY ALL) SELECT * FROM (SELECT c.case_id, g.field, g.n - CASE WHEN list_contains(string_split(c.defect_fields, ','), g.field) THEN 1 ELSE 0 END AS prior FROM cases c JOIN g USING (shipper)) WHERE prior > 0")
def prior_defects(spark, sf_dir):
    return reports.prior_defects(_cases(spark, sf_dir))


@query(f"WITH {_REPORT} SELECT count(*) AS emails, count_if(category = 'BL_COMPARISON') AS pairs, 7 * count_if(category = 'BL_COMPARISON') AS fields, 20 * count(*) + 240 * count_if(category = 'BL_COMPARISON') AS seconds FROM cases")
def manual_estimate(spark, sf_dir):
    return reports.manual_estimate(_cases(spark, sf_dir))


@query("SELECT volume, CAST(volume * 2.5 / 1000 AS DOUBLE) AS seconds, CAST(round_even(volume * 2 * 0.0013, 2) AS DOUBLE) AS dollars FROM (VALUES (1000), (5000), (10000), (50000)) t(volume)")
def volume_projection(spark, sf_dir):
    return reports.volume_projection(spark.range(1).select(F.lit(2.5).alias("ms"), F.lit(2).alias("docs")), [1000, 5000, 10_000, 50_000])


@query("WITH c AS (SELECT event_type AS purpose, event_id % 3 = 0 AS cached, CAST(value * 10 AS BIGINT) AS i, CASE WHEN event_id % 3 = 0 THEN CAST(value * 10 AS BIGINT) // 2 ELSE 0 END AS h, event_id % 100 AS u FROM events) SELECT purpose, count(*) AS calls, count_if(cached) AS cached, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(u) AS BIGINT) AS output_tokens, round_even(CAST(sum((i - h) * 0.25 + h * 0.025 + u * 2.0) / 1000000 AS DOUBLE), 6) AS cost FROM c GROUP BY ALL")
def usage_cost(spark, sf_dir):
    i = F.bround(F.col("value") * 10, 0).cast("bigint")
    e = derive.read(spark, sf_dir, "events").select(F.col("event_type").alias("purpose"), (F.col("event_id") % 3 == 0).alias("cached"), i.alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"))
    return reports.usage_cost(e.withColumn("cached_tokens", F.when(F.col("cached"), F.expr("input_tokens div 2")).otherwise(F.lit(0).cast("bigint"))))


_REVIEWS = "reviews AS (SELECT case_id, CASE case_id % 3 WHEN 0 THEN 'confirm' ELSE 'correct' END AS decision, CASE case_id % 6 WHEN 1 THEN 'MISMATCH' WHEN 2 THEN 'OK' WHEN 4 THEN 'NEEDS_REVIEW' END AS r_status, 'shipper,consignee' AS r_fields FROM cases WHERE case_id % 4 = 0 OR case_id % 7 = 0)"
_EFFECTIVE = f"""{_REPORT}, {_REVIEWS}, eff AS (SELECT c.*, r.decision, r.decision = 'correct' AS fix, coalesce(r_status, status) AS n_status FROM cases c LEFT JOIN reviews r USING (case_id)),
    effective AS (SELECT case_id, CASE WHEN fix THEN n_status ELSE status END AS status, CASE WHEN fix AND n_status <> 'NEEDS_REVIEW' THEN NULL ELSE review_reason END AS review_reason, CASE WHEN fix THEN n_status = 'MISMATCH' ELSE has_defect END AS has_defect,
        CASE WHEN NOT coalesce(fix, false) THEN defect_fields WHEN n_status = 'MISMATCH' THEN 'consignee,shipper' ELSE '' END AS defect_fields, CASE WHEN fix THEN 'review' ELSE 'system' END AS source, decision IS NOT NULL AS reviewed, decision AS review_decision FROM eff)"""


def _reviews(cases):
    k = F.col("case_id")
    return cases.filter((k % 4 == 0) | (k % 7 == 0)).select("case_id", F.when(k % 3 == 0, "confirm").otherwise("correct").alias("decision"), F.when(k % 6 == 1, "MISMATCH").when(k % 6 == 2, "OK").when(k % 6 == 4, "NEEDS_REVIEW").alias("status"), F.lit("shipper,consignee").alias("defect_fields"))


@query(f"WITH {_EFFECTIVE} SELECT * FROM effective")
def effective_outcome(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    return review.effective(cases, _reviews(cases))


@query(f"WITH {_EFFECTIVE} SELECT count(*) AS reviewed, count_if(e.status <> 'NEEDS_REVIEW' AND e.status = c.status AND e.defect_fields = c.defect_fields) AS confirmed, count_if(e.status <> 'NEEDS_REVIEW' AND NOT (e.status = c.status AND e.defect_fields = c.defect_fields)) AS corrected, count_if(e.status = 'NEEDS_REVIEW') AS unresolved FROM effective e JOIN cases c USING (case_id) WHERE e.reviewed")
def review_summary(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    return review.summary(cases, _reviews(cases))


@query(
    f"""WITH {o.PAIRS}, corrected AS (SELECT case_id, v, field, field_ord, CASE WHEN field = 'gross_weight_kg' AND v = 2 THEN si_raw WHEN field = 'shipper' AND v = 15 THEN 'Someone Else' ELSE bl_raw END AS bl_new, si_raw, bl_raw FROM val),
        fixed AS (SELECT case_id, v, field, field_ord, si_raw, bl_new AS bl_raw FROM corrected), {o.COMPARED.replace('FROM val)', 'FROM fixed)')},
        stand AS (SELECT case_id, v, field, CASE WHEN field = 'consignee' AND v = 3 THEN 'MATCH' WHEN field = 'notify_party' AND v = 16 THEN 'MISMATCH' ELSE verdict END AS s FROM cmp),
        g AS (SELECT case_id, v, coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE s = 'MISMATCH'), '') AS defect_fields, bool_or(s = 'UNCOMPARABLE') AS open FROM stand GROUP BY ALL)
        SELECT case_id, CASE WHEN v = 17 THEN 'NEEDS_REVIEW' WHEN defect_fields <> '' THEN 'MISMATCH' WHEN open THEN 'NEEDS_REVIEW' ELSE 'OK' END AS status, defect_fields FROM g"""
)
def review_derived(spark, sf_dir):
    values = _values(spark, sf_dir)
    corrections = values.filter(((F.col("field") == "gross_weight_kg") & (F.col("v") == 2)) | ((F.col("field") == "shipper") & (F.col("v") == 15))).select("case_id", "field", F.lit(None).cast("string").alias("si"), F.when(F.col("v") == 2, F.col("si_raw")).otherwise("Someone Else").alias("bl"))
    decisions = values.filter(((F.col("field") == "consignee") & (F.col("v") == 3)) | ((F.col("field") == "notify_party") & (F.col("v") == 16))).select("case_id", "field", F.when(F.col("v") == 3, "cleared").otherwise("flagged").alias("decision"))
    return review.derive(values, decisions, corrections, values.filter("v = 17").select("case_id"))


@query("WITH e AS (SELECT user_id AS case_id, ts AS moment, event_id FROM events) SELECT case_id, event_id, CAST(row_number() OVER w AS INTEGER) AS version, lead(moment) OVER w IS NULL AS is_latest FROM e WINDOW w AS (PARTITION BY case_id ORDER BY moment, event_id)")
def case_versions_latest(spark, sf_dir):
    events = derive.read(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.struct("ts", "event_id").alias("at"), "event_id")
    return review.versions(events).select("case_id", "event_id", "version", "is_latest")


@query(f"WITH {_REPORT} SELECT case_id, CAST(CASE status WHEN 'MISMATCH' THEN 0 WHEN 'NEEDS_REVIEW' THEN 1 ELSE 2 END AS INTEGER) AS rank, CAST(CASE WHEN defect_fields = '' THEN 0 ELSE len(string_split(defect_fields, ',')) END AS INTEGER) AS n_fields FROM cases")
def attention_order(spark, sf_dir):
    return reports.attention(_cases(spark, sf_dir)).select("case_id", "rank", "n_fields")


_SHOWN = lambda s: f"CASE WHEN field_ord > 5 THEN coalesce({s}_key, '?') ELSE coalesce(nullif({o.first_segment(s + '_raw')}, ''), {s}_key, '?') END"


@query(f"WITH {o.PAIRS}, {o.COMPARED} SELECT case_id, coalesce(string_agg(replace(field, '_', ' ') || ' - SI: ' || {_SHOWN('si')} || ' / BL: ' || {_SHOWN('bl')}, '; ' ORDER BY field_ord) FILTER (WHERE verdict = 'MISMATCH'), 'No mismatch detected.') AS summary FROM cmp GROUP BY case_id")
def case_summary(spark, sf_dir):
    return compare.by_case(_compared(spark, sf_dir)).select("case_id", "summary")


def _rewritten() -> str:
    """Lines of the pairs' texts under every mode, put together again."""
    lab = lambda i: rf"regexp_extract(raw, '^([^:]{{1,60}}?)(\s*:\s*)(.*)$', {i})"
    unseen = " ".join(f"WHEN {o.q(f)} THEN {o.q(w)}" for f, w in perturb.UNSEEN.items())
    party = o.among(FIELDS[:3])
    glyph = rf"'^([^{perturb.GLYPHS}]*)([{perturb.GLYPHS}])(.*)$'"
    wide = rf"'^(.{{1,{perturb.WRAP}}}) (.*)$'"
    forms = {
        "unseen_labels": f"CASE field {unseen} END || sep || value", "reflow_indented": "label || ':' || chr(10) || '    ' || value", "reflow_next_line": "label || ':' || chr(10) || value",
        "wrapped_value": f"CASE WHEN field IN {party} AND length(value) > {perturb.WRAP} AND regexp_matches(value, {wide}) THEN label || sep || regexp_extract(value, {wide}, 1) || chr(10) || '    ' || regexp_extract(value, {wide}, 2) ELSE raw END",
        "punct_no_colon": "label || '  ' || value", "punct_em_dash": "label || ' — ' || value", "punct_nbsp": "replace(label, ' ', chr(160)) || ':' || chr(160) || value", "punct_double_space": "label || ':  ' || value", "punct_tab": "label || ':' || chr(9) || value",
        "case_upper_labels": "upper(label) || sep || value", "case_lower_labels": "lower(label) || sep || value", "label_inner_spaces": "replace(label, ' ', '  ') || ' :  ' || value", "label_indented": "'   ' || label || sep || value",
        "ocr_confusions": f"label || sep || CASE WHEN regexp_matches(value, {glyph}) THEN regexp_extract(value, {glyph}, 1) || translate(regexp_extract(value, {glyph}, 2), '{perturb.GLYPHS}', '{perturb.SWAPPED}') || regexp_extract(value, {glyph}, 3) ELSE value END",
    }
    cases = " ".join(f"WHEN {o.q(m)} THEN {x}" for m, x in forms.items())
    return f"""WITH {o.PAIRS}, {o.texts()}, raw AS (SELECT case_id, side, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM doc_text),
        cut AS (SELECT *, {lab(1)} AS label, {lab(2)} AS sep, {lab(3)} AS value, contains(raw, ':') AND NOT starts_with(raw, ' ') AS starts FROM raw),
        own AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY case_id, side ORDER BY line) AS block, CASE WHEN starts THEN {o.resolve(o.basic('label'))} END AS field FROM cut),
        slot AS (SELECT case_id, side, block, row_number() OVER (PARTITION BY case_id, side ORDER BY block) AS up, row_number() OVER (PARTITION BY case_id, side ORDER BY block DESC) AS down FROM own WHERE field IS NOT NULL),
        turn AS (SELECT a.case_id, a.side, a.block, b.block AS turned FROM slot a JOIN slot b ON a.case_id = b.case_id AND a.side = b.side AND a.down = b.up),
        made AS (SELECT case_id, side, mode, line, CASE WHEN mode = 'reordered_fields' THEN coalesce(turned, block) ELSE block END AS place, CASE WHEN field IS NULL THEN raw ELSE CASE mode {cases} ELSE raw END END AS t
                 FROM own LEFT JOIN turn USING (case_id, side, block) CROSS JOIN (SELECT unnest([{', '.join(map(o.q, perturb.FAMILIES))}]) AS mode))
        SELECT case_id, side, mode, md5(string_agg(t, chr(10) ORDER BY place, line)) AS text_md5 FROM made GROUP BY ALL"""


@query(_rewritten())
def perturb_texts(spark, sf_dir):
    """Every document under every mode, as a digest of its text."""
    return perturb.texts(_docs(spark, sf_dir)).select("case_id", "side", "mode", F.md5("text").alias("text_md5"))


@query(
    f"""WITH {o.PAIRS}, {o.COMPARED}, {o.OUTCOME}, {_GATED}, arms(arm, off) AS (VALUES ('full', []), ('no-untraceable', ['untraceable_value']), ('no-blank', ['blank_value']), ('neither', ['untraceable_value', 'blank_value'])),
        freed AS (SELECT arm, defect_fields AS d, gate_status = 'grounded' OR list_contains(off, gate_status) AS free FROM gated CROSS JOIN arms)
        SELECT arm, count_if(free AND d <> '') AS reported_defects, CAST(sum(CASE WHEN free AND d <> '' THEN len(string_split(d, ',')) ELSE 0 END) AS BIGINT) AS defect_fields, count_if(NOT free) AS escalations, count_if(free AND d = '') AS clean FROM freed GROUP BY arm"""
)
def gate_ablation(spark, sf_dir):
    return harness.ablation(plan.gated(*_inputs(spark, sf_dir)))


#: What a made-up system submits for the reports' cases: some are left out, misfiled, or flagged in part.
_SUBMITTED = f"""{_REPORT}, said AS (SELECT case_id, CASE WHEN case_id % 11 = 0 THEN 'SPAM' ELSE category END AS category, CASE WHEN case_id % 7 = 0 THEN 'MISMATCH' ELSE status END AS status,
    CASE WHEN case_id % 13 = 0 THEN 'shipper' ELSE defect_fields END AS defect_fields FROM cases WHERE case_id % 17 <> 0),
    both_ AS (SELECT c.*, s.category AS sc, s.status AS ss, s.defect_fields AS sd FROM cases c LEFT JOIN said s USING (case_id)),
    cat(category) AS (VALUES ('SPAM'), ('GENERAL'), ('INVOICE_QUERY'), ('SI_REQUEST'), ('BL_COMPARISON')),
    f AS (SELECT cat.category, count(*) FILTER (WHERE b.category = cat.category AND sc = cat.category) AS tp, count(*) FILTER (WHERE sc = cat.category) AS predicted, count(*) FILTER (WHERE b.category = cat.category) AS real FROM cat CROSS JOIN both_ b GROUP BY cat.category)"""


def _submitted(cases):
    k = F.col("case_id")
    return cases.filter(k % 17 != 0).select("case_id", F.when(k % 11 == 0, "SPAM").otherwise(F.col("category")).alias("category"), F.when(k % 7 == 0, "MISMATCH").otherwise(F.col("status")).alias("status"), F.when(k % 13 == 0, "shipper").otherwise(F.col("defect_fields")).alias("defect_fields"))


@query(f"WITH {_SUBMITTED} SELECT category, tp, predicted, real, CASE WHEN predicted + real > 0 THEN 2.0 * tp / (predicted + real) ELSE 0 END::DOUBLE AS f1 FROM f")
def score_by_category(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    return scoring.by_category(cases, _submitted(cases))


@query(
    f"""WITH {_SUBMITTED}, n AS (SELECT count_if(defect_fields <> '') AS planted, count_if(defect_fields <> '' AND sc = 'BL_COMPARISON' AND ss = 'MISMATCH' AND sd = defect_fields) AS exact_, count_if(j AND defect_fields <> '' AND ss = 'MISMATCH') AS tp, count_if(j AND ss = 'MISMATCH') AS said, count_if(j AND defect_fields <> '') AS real,
        count_if(ss = 'NEEDS_REVIEW') AS asked, count_if(status = 'NEEDS_REVIEW') AS should, count_if(ss = 'NEEDS_REVIEW' AND status = 'NEEDS_REVIEW') AS right_ FROM (SELECT *, category = 'BL_COMPARISON' AND status <> 'NEEDS_REVIEW' AS j FROM both_)),
        r AS (SELECT exact_::DOUBLE / planted AS end_to_end, 2.0::DOUBLE * tp / (said + real) AS defect_f1, right_::DOUBLE / asked AS escalation_precision, right_::DOUBLE / should AS escalation_recall, (SELECT avg(CASE WHEN predicted + real > 0 THEN 2.0::DOUBLE * tp / (predicted + real) ELSE 0 END) FROM f) AS macro_f1 FROM n)
        SELECT *, 0.5::DOUBLE * end_to_end + 0.3::DOUBLE * macro_f1 + 0.2::DOUBLE * defect_f1 AS final_score FROM r"""
)
def score_final(spark, sf_dir):
    cases = _cases(spark, sf_dir)
    return scoring.score(cases, _submitted(cases))


from . import check_queries, desk_queries, reader_queries  # noqa: E402, F401  they register their queries
