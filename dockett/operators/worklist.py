"""Lists that people work from: cases under filters, states of reviews and scans, runs, picks worth opening, replies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CATEGORIES, STATUSES
from ..functions.text import strip
from ..storage import numbered, written
from .review import effective

# States of a review; places of a list of recent cases; rows of the exercise; situations of a reply.
REVIEW_STATES = ["pending", "cant_tell", "agreed", "corrected"]
RECENT, EXERCISE = 5, 5
SITUATIONS = ["no_discrepancy", "discrepancy", "attachments_missing", "document_missing", "file_unopenable", "scanned_copies", "wrong_document", "values_to_confirm", "review_generic"]
SCAN = "no_text_layer"


def listed(df: DataFrame) -> Column:
    return F.when(F.col("defect_fields") == "", 0).otherwise(F.size(F.split("defect_fields", ",")))


def case_rows(cases: DataFrame, reviews: DataFrame, senders: DataFrame | None = None) -> DataFrame:
    """One row a case with the outcome that counts and, beside it, the system's own (system_status,
    system_defect_fields). senders (case_id, sender) fills sender; a case without one has 'unknown'."""
    own = {c: F.col(c) for c in cases.columns if c not in ("case_id", "status", "review_reason", "has_defect", "defect_fields")}
    rows = effective(cases, reviews, {**own, "system_status": F.col("status"), "system_defect_fields": F.col("defect_fields")}).withColumnRenamed("source", "outcome_source")
    if senders is None:
        return rows
    return rows.join(senders.select("case_id", "sender").hint("merge"), "case_id", "left").withColumn("sender", F.coalesce(F.nullif("sender", F.lit("")), F.lit("unknown")))


def filtered(rows: DataFrame, category: str | None = None, status: str | None = None, decided_by: str | None = None) -> DataFrame:
    """Rows of a case list; status is that which counts, after reviews."""
    for name, wanted in (("category", category), ("status", status), ("decided_by", decided_by)):
        if wanted:
            rows = rows.filter(F.col(name) == wanted)
    return rows


def has_pair(category: Column, n_attachments: Column) -> Column:
    """A comparison request that came with two documents or more."""
    return (category == "BL_COMPARISON") & (F.coalesce(n_attachments, F.lit(0)) >= 2)


def reviewable(rows: DataFrame) -> Column:
    """A comparison with something to decide: a pair, an escalation, a re-check, or a review already. rows also has
    n_attachments and recheck_count."""
    more = has_pair(F.col("category"), F.col("n_attachments")) | (F.col("system_status") == "NEEDS_REVIEW") | (F.col("recheck_count") > 0) | F.col("reviewed")
    return (F.col("category") == "BL_COMPARISON") & more


def review_state(rows: DataFrame) -> Column:
    """pending, cant_tell, agreed or corrected, by the outcome that a review left and not by what was pressed."""
    ordered = lambda c: F.array_sort(F.split(c, ","))
    same = (F.col("status") == F.col("system_status")) & ((F.col("status") != "MISMATCH") | (ordered("defect_fields") == ordered("system_defect_fields")))
    return F.when(~F.col("reviewed"), "pending").when(F.col("status") == "NEEDS_REVIEW", "cant_tell").when((F.col("outcome_source") != "review") | same, "agreed").otherwise("corrected")


def visible(rows: DataFrame, category: str | None = None, status: str | None = None, state: str | None = None) -> DataFrame:
    """Rows under the filters of the page. A review filter matches comparisons with something to decide, and is left out
    where another category is asked for."""
    rows = filtered(rows, category, status)
    if state and category in (None, "BL_COMPARISON"):
        rows = rows.filter(reviewable(rows) & (review_state(rows) == state))
    return rows


def counts(rows: DataFrame) -> DataFrame:
    """kind (status or category), value, n over all rows, whatever filter is on; values without a case too."""
    spark = rows.sparkSession
    dim = spark.createDataFrame([("status", s) for s in STATUSES] + [("category", c) for c in CATEGORIES], "kind string, value string")
    seen = rows.select(F.explode(F.array(F.struct(F.lit("status").alias("kind"), F.col("status").alias("value")), F.struct(F.lit("category").alias("kind"), F.col("category").alias("value")))).alias("x"))
    n = seen.groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))
    return dim.join(n, ["kind", "value"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def scan_states(docs: DataFrame, read_out: DataFrame) -> DataFrame:
    """case_id, scanned, scan_transcribed: any document is an image alone, and any such was read out. docs: case_id, path,
    unreadable; read_out: case_id, path."""
    marked = docs.join(read_out.select("case_id", "path", F.lit(True).alias("read")).distinct(), ["case_id", "path"], "left")
    scan = F.coalesce(F.col("unreadable") == SCAN, F.lit(False))
    return marked.groupBy("case_id").agg(F.bool_or(scan).alias("scanned"), F.bool_or(scan & F.coalesce("read", F.lit(False))).alias("scan_transcribed"))


def exercise(rows: DataFrame, guesses: DataFrame, seconds: float) -> DataFrame:
    """One row: answered, agreed and per_email_seconds over the first five cases, and classify_all_seconds, that pace over
    all. rows: case_id, ord, category; guesses: case_id, guess. Rows are written, as they are read twice; of the guesses
    only those of the first cases are joined."""
    rows = written(rows.select("case_id", "ord", "category"), "exercise-rows")
    first = written(rows.orderBy("ord").limit(EXERCISE), "exercise-first")
    few = guesses.join(F.broadcast(first.select("case_id")), "case_id", "left_semi")
    seen = first.join(few.hint("merge"), "case_id", "left").agg(F.count(F.lit(1)).alias("shown"), F.count("guess").alias("answered"), F.count_if(F.col("guess") == F.col("category")).alias("agreed"))
    n = rows.agg(F.count(F.lit(1)).alias("emails"))
    pace = F.when((F.col("shown") > 0) & (F.col("answered") >= F.col("shown")), F.lit(float(seconds)) / F.col("shown")).otherwise(0.0)
    # Both sides are one row.
    return seen.crossJoin(n).select("answered", "agreed", pace.alias("per_email_seconds"), (pace * F.col("emails")).alias("classify_all_seconds"))


def showcases(rows: DataFrame) -> DataFrame:
    """One row: recheck, scan, scan_read_out, history, mismatch, cases worth opening (null: none).

    rows: case_id, ord, category, status, review_reason, defect_fields, shipper, n_attachments, scanned,
    scan_transcribed. recheck: escalated without attachments, else with one missing, else any; scan: one read
    out, else any; history: the first case of the largest group of a shipper and field; mismatch: most fields.
    """
    r = rows.filter("category = 'BL_COMPARISON'").withColumn("n_fields", listed(rows))
    escalated, wrong = F.col("status") == "NEEDS_REVIEW", F.col("status") == "MISMATCH"
    missing = escalated & (F.col("review_reason") == "missing_attachment")
    first = lambda cond: F.min_by(F.when(cond, F.col("case_id")), F.when(cond, F.col("ord")))
    picks = r.agg(
        F.coalesce(first(missing & (F.col("n_attachments") == 0)), first(missing), first(escalated)).alias("recheck"),
        F.coalesce(first(F.col("scan_transcribed")), first(F.col("scanned"))).alias("scan"), F.coalesce(F.bool_or("scan_transcribed"), F.lit(False)).alias("scan_read_out"),
        F.max_by(F.when(wrong, F.col("case_id")), F.when(wrong, F.struct("n_fields", -F.col("ord")))).alias("mismatch"),
    )
    shown = r.filter(wrong & F.col("shipper").isNotNull() & (F.col("shipper") != "") & (F.col("defect_fields") != ""))
    fields = shown.select("case_id", "shipper", F.col("ord"), F.posexplode(F.split("defect_fields", ",")).alias("pos", "field"))
    groups = fields.groupBy("shipper", "field").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "pos", "case_id")).alias("head")).filter("n >= 2")
    history = groups.agg(F.min_by("head.case_id", F.struct(-F.col("n"), "head")).alias("history"))
    return picks.crossJoin(history).select("recheck", "scan", "scan_read_out", "history", "mismatch")


def recent(rows: DataFrame, n: int = RECENT) -> DataFrame:
    """The last rows that were completed (by ord), newest first."""
    return rows.orderBy(F.desc("ord")).limit(n)


def runs(events: DataFrame) -> DataFrame:
    """run_id, created_at, status (running, done, failed), finished_at, error, place (1: newest) and latest_done, from
    events run_id, at, kind (created, done, failed), error. The last of done and failed counts."""
    ended = F.col("kind").isin("done", "failed")
    last = F.max(F.when(ended, F.struct("at", "kind", "error")))
    one = events.groupBy("run_id").agg(F.min(F.when(F.col("kind") == "created", F.col("at"))).alias("created_at"), last.alias("last")).filter("created_at is not null")
    listed_ = one.select("run_id", "created_at", F.coalesce("last.kind", F.lit("running")).alias("status"), F.col("last.at").alias("finished_at"), F.when(F.col("last.kind") == "failed", F.col("last.error")).alias("error"))
    placed = numbered(listed_, [F.desc("created_at"), F.desc("run_id")], "place").withColumn("place", F.col("place").cast("int"))
    done = placed.agg(F.max(F.when(F.col("status") == "done", F.struct("finished_at", "run_id"))).alias("done"))
    return placed.crossJoin(F.broadcast(done)).withColumn("latest_done", F.coalesce(F.col("done.run_id") == F.col("run_id"), F.lit(False))).drop("done")


def submittable(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """Cases (with run_id) of finished runs only; those of running or failed ones are not handed out."""
    return cases.join(runs.filter("status = 'done'").select("run_id"), "run_id", "left_semi")


def replaced(cases: DataFrame, fresh: DataFrame) -> DataFrame:
    """cases (case_id, ord, more) with the rows of fresh (case_id, at, more) in the place of those they replace; new cases
    follow in their order. Of several fresh rows of a case the last (by at) counts."""
    last = fresh.withColumn("n", F.row_number().over(W.partitionBy("case_id").orderBy(F.desc("at")))).filter("n = 1").drop("n")
    more = [c for c in last.columns if c not in ("case_id", "at")]
    end = cases.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("end"))
    own = cases.select("case_id", "ord", *more)
    new = last.join(own.select("case_id", "ord"), "case_id", "left")
    added = numbered(new.filter("ord is null"), ["at", "case_id"], "place").crossJoin(F.broadcast(end)).withColumn("ord", F.col("end") + F.col("place"))
    return own.join(last.select("case_id"), "case_id", "left_anti").unionByName(new.filter("ord is not null").select(own.columns)).unionByName(added.select(own.columns))


# What a reply says happened, what it asks for, and how it closes, by situation.
REPLIES = {
    "no_discrepancy": ("We compared the draft Bill of Lading against the Shipping Instruction across all seven fields we check.", "No discrepancy was found.", "Thank you."),
    "discrepancy": ("We compared the draft Bill of Lading against the Shipping Instruction and found discrepancies in the following fields.", "Could you please confirm which value is correct so we can finalise the Bill of Lading?", "Thank you."),
    "attachments_missing": ("Unfortunately, no attachments reached us with it.", "Could you please re-send it with both the Shipping Instruction and the draft Bill of Lading attached?", "Thank you."),
    "document_missing": ("We need both the Shipping Instruction and the draft Bill of Lading for the check, and only one came through.", "Could you please send the {needed} so we can compare the two?", "Thank you."),
    "file_unopenable": ("We could not open {some} of the attachments, so we could not complete the check.", "Could you please send a fresh copy of the {broken}?{hint}", "Thank you."),
    "scanned_copies": ("{scans}, which we check manually rather than automatically.", "There is no need to re-send {them}. We will check manually and come back to you with the result.", "Thank you for your patience."),
    "wrong_document": ("One of the attachments is not the document we need for this check.", "Could you please send the {needed} so we can compare the two?", "Thank you."),
    "values_to_confirm": ("We compared the draft Bill of Lading against the Shipping Instruction, and some fields need your confirmation.", "Could you please check with the customer and {asks} before we release the Bill of Lading? We have not assumed the draft Bill of Lading is right.", "Thank you."),
    "review_generic": ("We were not able to complete the check automatically, and a member of our team is looking at it.", "We will come back to you shortly.", "Thank you for your patience."),
}
RE_EXPORT = " Exporting it again from the original usually fixes this; forwarding the same file will not."
SIDE_NAMES = {"si": "Shipping Instruction", "bl": "draft Bill of Lading"}
ASK_REASONS = ["si_blank", "bl_blank", "si_unparseable", "bl_unparseable", "unit_differs", "ocr_confusable"]
FIELD_PHRASES = {
    "shipper": "shipper", "consignee": "consignee", "notify_party": "notify party", "port_of_loading": "port of loading", "port_of_discharge": "port of discharge",
    "container_count": "container count", "gross_weight_kg": "gross weight",
}


def _listed_and(items: Column) -> Column:
    n = F.size(items)
    return F.when(n <= 1, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


# What the lines of a reply call a field, a type of document, and why a file could not be opened; its greeting and frame.
FIELD_HEADINGS = {
    "shipper": "Shipper", "consignee": "Consignee", "notify_party": "Notify Party", "port_of_loading": "Port of Loading", "port_of_discharge": "Port of Discharge",
    "container_count": "Container Count", "gross_weight_kg": "Gross Weight (kg)",
}
DOC_NAMES = {
    "SHIPPING_INSTRUCTION": "Shipping Instruction", "BILL_OF_LADING": "draft Bill of Lading", "COMMERCIAL_INVOICE": "Commercial Invoice",
    "PACKING_LIST": "Packing List", "CERTIFICATE_OF_ORIGIN": "Certificate of Origin",
}
UNOPENED = {
    "corrupt": "the file will not open", "empty_file": "the file arrived empty", "missing_file": "the file did not come through",
    "unsupported": "the file is in a format or size we cannot open",
}
HELLO, GREETING, REGARDS = "Hello,", "Thank you for your email.", "Regards,"


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def _said(text: str, **parts: Column) -> Column:
    """text with its {marks} replaced by columns, as one concatenation: values are never looked through for marks."""
    pieces = re.split(r"\{(\w+)\}", text)
    return F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def value_lines(compared: DataFrame) -> DataFrame:
    """compared with what a reply says of each field: question (a field that it asks about), differs and quoted.

    Columns of compare.compare(); with {si,bl}_present these count as given, and with {si,bl}_reviewed, values that a
    review settled on, quoted takes these.
    """
    name = F.coalesce(_looked_up(FIELD_HEADINGS, F.col("field")), F.col("field"))
    raw = {s: F.coalesce(f"{s}_raw", F.lit("")) for s in SIDE_NAMES}
    has = lambda c: c in compared.columns
    given = {s: (F.coalesce(F.col(f"{s}_present"), F.lit(False)) if has(f"{s}_present") else F.col(f"{s}_state") == "usable") & (strip(raw[s]) != "") for s in SIDE_NAMES}
    other = {s: F.when(given[s], F.concat(F.lit(f'the {SIDE_NAMES[s]} shows "'), strip(raw[s]), F.lit('"'))).otherwise(f"it is not given on the {SIDE_NAMES[s]} either") for s in SIDE_NAMES}
    reads = {s: F.when(strip(raw[s]) != "", F.concat(F.lit(' (it reads "'), strip(raw[s]), F.lit('")'))).otherwise("") for s in SIDE_NAMES}
    question = F.lit(None).cast("string")
    for s, o in (("si", "bl"), ("bl", "si")):
        blank = _said("  - {name}: left blank on the " + SIDE_NAMES[s] + "{reads}; {other}.", name=name, reads=reads[s], other=other[o])
        unread = _said("  - {name}: the " + SIDE_NAMES[s] + ' shows "{raw}", which we could not read as a value; {other}.', name=name, raw=raw[s], other=other[o])
        question = F.when(F.col("reason") == f"{s}_blank", blank).when(F.col("reason") == f"{s}_unparseable", unread).otherwise(question)
    both = '{name}: the Shipping Instruction shows "{si}" and the draft Bill of Lading shows "{bl}"; '
    units = _said("  - " + both + "the figures are the same but the units differ, so one of the two documents needs amending.", name=F.regexp_replace(name, r"\s*\(kg\)$", ""), **raw)
    glyphs = _said("  - " + both + "they differ only in characters that are easy to misread on a scan.", name=name, **raw)
    question = F.when(F.col("reason") == "unit_differs", units).when(F.col("reason") == "ocr_confusable", glyphs).otherwise(question)
    shown = {s: F.coalesce(f"{s}_raw", F.lit("?")) for s in SIDE_NAMES}
    differs = _said('  - {name}: the Shipping Instruction shows "{si}"; the draft Bill of Lading shows "{bl}".', name=name, **shown)
    settled_on = {s: strip(F.coalesce(*([f"{s}_reviewed"] if has(f"{s}_reviewed") else []), f"{s}_raw", F.lit(""))) for s in SIDE_NAMES}
    says = lambda s, called: F.when(settled_on[s] != "", F.concat(F.lit(f'{called} says "'), settled_on[s], F.lit('"'))).otherwise(f"{called} has no value we could read")
    quoted = _said("  - {name}: {si}, {bl}", name=name, si=says("si", "SI"), bl=says("bl", "draft BL"))
    return compared.withColumns({"question": question, "differs": differs, "quoted": quoted})


def questions(compared: DataFrame) -> DataFrame:
    """What replies say of fields, in canonical order: case_id, asked and differing (phrases of fields), asked_lines and
    differing_lines, quoted (field and line of every field), agreed and unread (numbers of fields)."""
    ordered = lambda cond, c: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("field_ord", F.col(c).alias("p"))))), lambda x: x["p"])
    open_, asks = F.col("verdict") == "UNCOMPARABLE", F.coalesce(F.col("reason").isin(ASK_REASONS), F.lit(False))
    lines = value_lines(compared).withColumns({"phrase": _looked_up(FIELD_PHRASES, F.col("field")), "both": F.struct("field", F.col("quoted").alias("line"))})
    return lines.groupBy("case_id").agg(
        ordered(open_ & asks, "phrase").alias("asked"), ordered(F.col("verdict") == "MISMATCH", "phrase").alias("differing"), ordered(open_ & asks, "question").alias("asked_lines"),
        ordered(F.col("verdict") == "MISMATCH", "differs").alias("differing_lines"), ordered(F.lit(True), "both").alias("quoted"), F.array_join(F.collect_list(F.when(F.col("verdict") == "MISMATCH", F.col("field"))), ",").alias("mismatched"), F.count_if(F.col("verdict") == "MATCH").alias("agreed"), F.count_if(open_ & ~asks).alias("unread"),
    )


def facts(rows: DataFrame) -> Column:
    """The lines of a reply that quote the case. rows: situation, columns of questions, defect_fields, needed, and of each
    side si_ and bl_: there, unreadable, type, path."""
    there = {s: F.coalesce(f"{s}_there", F.lit(False)) for s in SIDE_NAMES}
    opened = {s: F.col(f"{s}_unreadable").isNull() for s in SIDE_NAMES}
    file = {s: F.coalesce(F.nullif(F.regexp_extract(f"{s}_path", r"([^\\/]*)$", 1), F.lit("")), f"{s}_path", F.lit("")) for s in SIDE_NAMES}
    lines = lambda *xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    large = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))
    kind = {}
    for s in SIDE_NAMES:
        type_ = F.coalesce(f"{s}_type", F.lit(""))
        named = F.coalesce(_looked_up(DOC_NAMES, type_), F.when(type_.isin("", "UNKNOWN"), "a document we could not identify").otherwise(F.replace(F.lower(type_), F.lit("_"), F.lit(" "))))
        kind[s] = F.when(opened[s], named).when(F.col(f"{s}_unreadable") == SCAN, "a scanned document").otherwise("a file we could not open")
    received = [F.when(there[s], _said("  - Received: {kind} ({file}).", kind=large(kind[s]), file=file[s])) for s in SIDE_NAMES]
    needed = F.transform("needed", lambda x: F.concat(F.lit("  - Still needed: "), x, F.lit(".")))
    heading = {s: F.lit(name[0].upper() + name[1:]) for s, name in SIDE_NAMES.items()}
    scanned = {s: there[s] & (F.col(f"{s}_unreadable") == SCAN) for s in SIDE_NAMES}
    scans = [F.when(scanned[s], _said("  - {side} ({file}): a scanned image, which we check manually.", side=heading[s], file=file[s])) for s in SIDE_NAMES]
    why = {s: F.coalesce(_looked_up(UNOPENED, F.col(f"{s}_unreadable")), F.lit("we could not read the file")) for s in SIDE_NAMES}
    broken = [F.when(there[s] & ~opened[s] & ~scanned[s], _said("  - {side} ({file}): {why}.", side=heading[s], file=file[s], why=why[s])) for s in SIDE_NAMES]
    n = F.col("agreed").cast("string")
    agreed = (
        F.when((F.col("agreed") > 0) & (F.col("unread") > 0), _said("  - {n} of the other fields are consistent between the two documents; our team is checking the rest manually.", n=n))
        .when(F.col("agreed") == 1, "  - The other field is consistent between the two documents.")
        .when(F.col("agreed") > 1, _said("  - The other {n} fields are consistent between the two documents.", n=n))
    )
    wrong = F.split(F.coalesce("defect_fields", F.lit("")), ",")
    by = {
        "discrepancy": F.transform(F.filter("quoted", lambda x: F.array_contains(wrong, x["field"])), lambda x: x["line"]), "attachments_missing": F.array(F.lit("  - Attachments received: none.")),
        "document_missing": F.concat(lines(*received), needed), "wrong_document": F.concat(lines(*received), needed), "file_unopenable": lines(*broken, *scans), "scanned_copies": lines(*scans),
        "values_to_confirm": F.concat("asked_lines", "differing_lines", lines(agreed)),
    }
    out = F.array().cast("array<string>")
    for situation, own in by.items():
        out = F.when(F.col("situation") == situation, own).otherwise(out)
    return out


def body(rows: DataFrame) -> Column:
    """A reply's parts (greeting, context, facts, action, closing) as one text."""
    para = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit("\n\n"), c)).otherwise("")
    head = F.concat(F.lit(HELLO + "\n\n"), F.trim(F.concat("greeting", F.lit(" "), "context")))
    return F.concat(head, para(F.array_join("facts", "\n")), para(F.col("action")), para(F.col("closing")), F.lit("\n\n" + REGARDS))


def replies(cases: DataFrame, asked: DataFrame) -> DataFrame:
    """case_id, situation, subject, greeting, context, facts (lines), action, closing and body for comparisons that a reply
    can be drafted for.

    cases: case_id, subject, category, status, review_reason, and of each side si_ and bl_: there, unreadable, type,
    path (may be left out); defect_fields as they count after a review (left out: those that differ). A clean case
    needs both documents. asked: questions().
    """
    for c in ("defect_fields", "si_path", "bl_path"):
        if c not in cases.columns:
            cases = cases.withColumn(c, F.lit(None).cast("string"))
    there = {s: F.coalesce(f"{s}_there", F.lit(False)) for s in SIDE_NAMES}
    rows = cases.filter(F.col("category") == "BL_COMPARISON").filter((F.col("status") != "OK") | (there["si"] & there["bl"])).join(asked, "case_id", "left")
    none = F.array().cast("array<string>")
    some = lambda cond, s: F.when(cond, F.lit(SIDE_NAMES[s]))
    names = lambda cond: F.filter(F.array(*[some(cond(s), s) for s in SIDE_NAMES]), lambda x: x.isNotNull())
    bad = lambda s: there[s] & F.col(f"{s}_unreadable").isNotNull()
    readable = F.array(*[F.when(there[s] & F.col(f"{s}_unreadable").isNull(), F.col(f"{s}_type")) for s in SIDE_NAMES])
    wanted = {"si": "SHIPPING_INSTRUCTION", "bl": "BILL_OF_LADING"}
    rows = rows.withColumns(
        {
            "asked": F.coalesce("asked", none), "differing": F.coalesce("differing", none), "asked_lines": F.coalesce("asked_lines", none), "differing_lines": F.coalesce("differing_lines", none),
            "defect_fields": F.coalesce("defect_fields", "mismatched", F.lit("")), "scans": names(lambda s: bad(s) & (F.col(f"{s}_unreadable") == SCAN)),
            "broken": names(lambda s: bad(s) & (F.col(f"{s}_unreadable") != SCAN)), "needed": names(lambda s: ~F.exists(readable, lambda x: F.coalesce(x == wanted[s], F.lit(False)))),
            "damaged": ~F.coalesce(F.exists(F.array(*[F.when(bad(s) & (F.col(f"{s}_unreadable") != SCAN), F.col(f"{s}_unreadable")) for s in SIDE_NAMES]), lambda x: x.isNotNull() & ~x.isin("corrupt", "empty_file")), F.lit(False)),
        }
    )
    open_, why = F.col("status") == "NEEDS_REVIEW", F.col("review_reason")
    to_confirm = (F.size("asked") + F.size("differing")) > 0
    situation = (
        F.when(F.col("status") == "OK", "no_discrepancy").when(~open_, "discrepancy")
        .when((why == "missing_attachment") & ~there["si"] & ~there["bl"], "attachments_missing").when(why == "missing_attachment", "document_missing")
        .when((why == "unreadable") & (F.size("broken") > 0), "file_unopenable").when((why == "unreadable") & (F.size("scans") > 0), "scanned_copies")
        .when((why == "unreadable") & to_confirm, "values_to_confirm").when(why == "wrong_doc_type", "wrong_document").when((why == "missing_value") & to_confirm, "values_to_confirm").otherwise("review_generic")
    )
    both = F.array(*map(F.lit, SIDE_NAMES.values()))
    confirm = F.when(F.size("asked") > 0, F.concat(F.lit("confirm the "), _listed_and(F.col("asked"))))
    correct = F.when(F.size("differing") > 0, F.concat(F.lit("tell us which value is correct for the "), _listed_and(F.col("differing"))))
    one_scan, one_broken = F.size("scans") == 1, F.size("broken") == 1
    fill = {
        "{needed}": _listed_and(F.when(F.size("needed") > 0, F.col("needed")).otherwise(both)), "{broken}": _listed_and(F.col("broken")), "{some}": F.when(one_broken, "one").otherwise("some"),
        "{hint}": F.when(F.col("damaged"), RE_EXPORT).otherwise(""), "{them}": F.when(one_scan, "it").otherwise("them"), "{asks}": _listed_and(F.filter(F.array(confirm, correct), lambda x: x.isNotNull())),
        "{scans}": F.when(one_scan, "One of the documents came through as a scanned image").otherwise("The documents came through as scanned images"),
    }
    out = rows.withColumn("situation", situation).withColumn("greeting", F.lit(GREETING))
    out = out.withColumn("facts", F.coalesce(facts(out), none))
    for i, name in enumerate(("context", "action", "closing")):
        text = F.lit(None).cast("string")
        for s, parts in REPLIES.items():
            text = F.when(F.col("situation") == s, parts[i]).otherwise(text)
        for mark, value in fill.items():
            if any(mark in parts[i] for parts in REPLIES.values()):
                text = F.replace(text, F.lit(mark), value)
        out = out.withColumn(name, text)
    quiet = F.col("situation").isin("scanned_copies", "review_generic")
    fallback = F.when(F.col("status") == "OK", "SI/BL checked, no discrepancy").when(open_ & quiet, "SI/BL check: manual review in progress").when(open_, "SI/BL check: action required").otherwise("discrepancy found between SI and draft BL")
    original = F.trim(F.coalesce("subject", F.lit("")))
    subject = F.when(original != "", F.concat(F.lit("Re: "), F.regexp_replace(original, r"(?i)^((re|fw|fwd)\s*[:_]\s*)+", ""))).otherwise(F.concat(F.lit("Re: "), F.col("case_id").cast("string"), F.lit(" — "), fallback))
    return out.select("case_id", "situation", subject.alias("subject"), "greeting", "context", "facts", "action", "closing", body(out).alias("body"))
