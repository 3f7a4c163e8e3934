import json

from pyspark.sql import functions as F

from dockett import queries
from dockett.functions import labels
from dockett.operators import classify, compare, layout, perturb, reports, scoring, worklist
from dockett.plans import harness, run
from dockett.sources import inbox

SI = "SHIPPING INSTRUCTION\n====\nShipper: ACME PTE. LTD.\nConsignee: A VERY LONG COMPANY NAME TRADING CO\nNotify Party: GAMMA\nPort of Loading: PENANG\nPort of Discharge: OSLO\nNo. of Containers: 2 x 40'HC\nGross Weight (KG): 21,577 KG\n"
BL = SI.replace("SHIPPING INSTRUCTION", "DRAFT BILL OF LADING").replace("====", "====\nB/L No.: 88")
CLEAN = [(1, "SI", SI), (1, "BL", BL)]


def docs(spark, rows=CLEAN):
    return spark.createDataFrame(rows, "case_id long, side string, text string")


def test_rewritings(spark):
    made = {(r.side, r.mode): r.text for r in perturb.texts(docs(spark)).collect()}
    assert len(made) == 2 * len(perturb.FAMILIES) and made["SI", "control_rewrite"] == SI and made["BL", "control_rewrite"] == BL
    assert "Shipped By: ACME" in made["SI", "unseen_labels"] and "Boxes: 2 x" in made["SI", "unseen_labels"]
    assert "Consignee: A VERY LONG COMPANY NAME\n    TRADING CO\n" in made["SI", "wrapped_value"]
    assert "Shipper:\n    ACME" in made["SI", "reflow_indented"] and "Shipper:\nACME" in made["SI", "reflow_next_line"]
    assert "Port of Loading: ".replace(" ", "\u00a0") in made["SI", "punct_nbsp"] and "Shipper \u2014 ACME" in made["SI", "punct_em_dash"]
    assert "Port of Loading: PENANG" in SI and "Port of Discharge: 0SLO" in made["SI", "ocr_confusions"]
    fields = [x.split(":")[0] for x in made["SI", "reordered_fields"].split("\n") if ":" in x]
    assert fields == [x.split(":")[0] for x in SI.split("\n") if ":" in x][::-1] and made["SI", "reordered_fields"].startswith("SHIPPING INSTRUCTION\n====\n")


def test_harness_tripwire(spark):
    """The control changes nothing; a swapped glyph escalates or changes values, and nothing is lost by layout."""
    mails = spark.createDataFrame([(1, "TO CONFIRM DOCS", "Attached are the SI and draft BL. Please compare.", "a@b.c")], "case_id long, subject string, body string, sender string")
    got = {r.mode: r for r in harness.report(docs(spark), mails, ["control_rewrite", "case_upper_labels", "ocr_confusions"]).collect()}
    for mode in ("control_rewrite", "case_upper_labels"):
        r = got[mode]
        assert (r.documents, r.unchanged, r.changed, r.lost, r.decisions_changed) == (2, 14, 0, 0, 0)
    assert got["ocr_confusions"].changed + got["ocr_confusions"].lost > 0 and got["ocr_confusions"].decisions_changed == 2


def test_empty_and_null_texts(spark):
    made = perturb.texts(docs(spark, [(1, "SI", None), (2, "SI", ""), (3, "BL", "no label at all")]), ["control_rewrite", "reordered_fields"]).collect()
    assert {(r.case_id, r.text) for r in made} == {(1, ""), (2, ""), (3, "no label at all")}


def test_scores(spark):
    schema = "case_id long, category string, status string, defect_fields string"
    gold = spark.createDataFrame([(1, "BL_COMPARISON", "MISMATCH", "consignee,shipper"), (2, "BL_COMPARISON", "MISMATCH", "shipper"), (3, "BL_COMPARISON", "OK", ""), (4, "BL_COMPARISON", "NEEDS_REVIEW", ""), (5, "SPAM", "OK", "")], schema)
    same = scoring.score(gold, gold).first()
    assert (same.end_to_end, same.defect_f1, same.escalation_recall) == (1.0, 1.0, 1.0) and abs(same.macro_f1 - 0.4) < 1e-9
    worse = spark.createDataFrame([(1, "BL_COMPARISON", "MISMATCH", "shipper"), (3, "BL_COMPARISON", "MISMATCH", "shipper"), (4, "GENERAL", "OK", "")], schema)
    r = scoring.score(gold, worse).first()
    assert (r.end_to_end, r.escalation_recall) == (0.0, 0.0) and r.defect_f1 == 0.5
    assert scoring.score(gold.limit(0), worse).first().final_score == 0.0


def test_inbox(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    (tmp_path / "attachments").mkdir()
    for i, names in enumerate((["a_SI.txt", "a_BL.txt", "gone.txt"], None, ["empty.txt", "scan.png", "nothing.txt"])):
        (tmp_path / f"inbox/email_{i:03d}.json").write_text(json.dumps({"email_id": f"email_{i:03d}", "from": None if i else "x@y.z", "subject": "s", "body": None, "attachments": names and [f"attachments/{n}" for n in names]}))
    (tmp_path / "attachments/a_SI.txt").write_bytes(SI.encode())
    (tmp_path / "attachments/a_BL.txt").write_bytes(b"caf\xe9: 1")
    (tmp_path / "attachments/empty.txt").write_bytes(b" \n")
    (tmp_path / "attachments/scan.png").write_bytes(b"\x89PNG")
    (tmp_path / "attachments/nothing.txt").write_bytes(b"")
    mails = inbox.emails(spark, str(tmp_path))
    assert [(r.email_id, r.sender, r.body, len(r.attachments)) for r in mails.orderBy("email_id").collect()] == [("email_000", "x@y.z", "", 3), ("email_001", "", "", 0), ("email_002", "", "", 3)]
    got = {r.path.split("/")[-1]: r for r in inbox.attachments(spark, str(tmp_path), mails).collect()}
    assert {k: r.unreadable for k, r in got.items()} == {"a_SI.txt": None, "a_BL.txt": None, "gone.txt": "missing_file", "empty.txt": "empty_file", "scan.png": "unsupported", "nothing.txt": "empty_file"}
    assert got["a_SI.txt"].text == SI and got["a_BL.txt"].text == "caf�: 1" and inbox.emails(spark, str(tmp_path), 1).count() == 1


def test_unseen_wordings_are_read(spark):
    """The plan's reads take the third pass: a wording close to a known one keeps its field."""
    text = SI.replace("Port of Discharge", "Final Destination Port").replace("Consignee:", "Consigneee Name:")
    got = {r.field: r.raw for r in perturb.reads(docs(spark, [(1, "SI", text)])).filter("present").collect()}
    assert got["port_of_discharge"] == "OSLO" and got["consignee"] == "A VERY LONG COMPANY NAME TRADING CO"


def test_run_from_files(spark, tmp_path):
    """Mails and attachments on disk, decided, reported and written."""
    (tmp_path / "inbox").mkdir()
    (tmp_path / "attachments").mkdir()
    ask = "Attached are the SI and draft BL. Please compare the SI and draft BL."
    mails = [("TO CONFIRM DOCS", ask, ["a_SI.txt", "a_BL.txt"]), ("TO CONFIRM DOCS", ask, ["b_SI.txt", "b_BL.txt"]), ("TO CONFIRM DOCS", ask, ["a_SI.txt", "nothing_BL.txt"]), ("You have won", "Congratulations!!! Claim now, click here.", []), ("", "", None)]
    for i, (subject, body, names) in enumerate(mails):
        (tmp_path / f"inbox/email_{i:03d}.json").write_text(json.dumps({"email_id": f"email_{i:03d}", "from": "a@b.c", "subject": subject, "body": body, "attachments": names and [f"attachments/{n}" for n in names]}))
    for name, text in (("a_SI", SI), ("a_BL", BL), ("b_SI", SI), ("b_BL", BL.replace("OSLO", "BERGEN")), ("nothing_BL", "")):
        (tmp_path / f"attachments/{name}.txt").write_text(text)
    read = inbox.emails(spark, str(tmp_path))
    cases = run.run(read, inbox.attachments(spark, str(tmp_path), read))
    got = {r.case_id: (r.category, r.status, r.review_reason, r.defect_fields) for r in cases.collect()}
    assert got == {
        "email_000": ("BL_COMPARISON", "OK", None, ""), "email_001": ("BL_COMPARISON", "MISMATCH", None, "port_of_discharge"), "email_002": ("BL_COMPARISON", "NEEDS_REVIEW", "unreadable", ""),
        "email_003": ("SPAM", "OK", None, ""), "email_004": ("GENERAL", "OK", None, ""),
    }
    run.write(cases, reports.run_report(cases), str(tmp_path / "out"))
    sent = {r.case_id: r for r in spark.read.json(str(tmp_path / "out/submission")).collect()}
    assert sent["email_001"].defect_fields == ["port_of_discharge"] and sent["email_001"].has_defect and len(sent) == 5
    counts = {(r.kind, r.value): r.n for r in spark.read.json(str(tmp_path / "out/metrics")).collect()}
    assert counts["total", "emails"] == 5 and counts["total", "documents_read"] == 6 and counts["total", "documents_unreadable"] == 1 and counts["status", "OK"] == 3


def test_nothing_is_lost_without_a_decision(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "BL_COMPARISON", None), (3, "SPAM", None)], "case_id long, category string, status string")
    empty = F.lit(None)
    full = rows.withColumns({c: empty.cast("string") for c in ("review_reason", "defect_fields", "decided_by")} | {"category_confidence": empty.cast("double"), "has_defect": empty.cast("boolean"), "n_docs": empty.cast("long"), "n_unreadable": empty.cast("long")})
    assert {(r.case_id, r.status, r.review_reason) for r in run.guarded(full).collect()} == {(1, "NEEDS_REVIEW", "unreadable"), (2, "NEEDS_REVIEW", "unreadable"), (3, "OK", None)}


def test_rows_hang_on_their_first_word(spark):
    """A slope of words a point apart breaks where the first word of the row is left behind, not the word before."""
    words = [(1, 1, f"w{i}", 10.0 * i, 10.0 * i + 5, 100.0 + i, 8.0, "Helvetica") for i in range(9)]
    frame = spark.createDataFrame(words, "doc int, page int, text string, x0 double, x1 double, top double, size double, fontname string")
    assert [r.row for r in layout.numbered_rows(frame).orderBy("x0").collect()] == [1, 1, 1, 1, 2, 2, 2, 2, 3]
    assert layout.value_columns(frame).first().value_x == layout.NO_COLUMN
    assert {(r.row, r.label, r.value) for r in layout.split_rows(frame).collect()} == {(1, "w0 w1 w2 w3", ""), (2, "w4 w5 w6 w7", ""), (3, "w8", "")}


def test_literals_are_needed():
    assert classify.literals(r"\bSI\b\s+AND\s+(?:THE\s+)?DRAFT\s+B/?L\b") == ["DRAFT"] and classify.literals(r"^[A-Z]{2}") is None
    assert classify.literals(r"\bBILLING\b|\bGR\b") == ["BILLING", "GR"] and classify.literals("AB|[0-9]") is None


def test_similar_wordings_by_brute_force(spark):
    """The third pass over a table agrees with comparing every wording with every known one."""
    wordings = ["Final Destination Port", "Shipper Nam", "Consignee Nme", "Gros Weight", "Port of Loadng", "Nothing alike at all", "Notify Prty", "x"]
    got = {r.label: r.field for r in labels.with_fields(spark.createDataFrame([(w,) for w in wordings], "label string"), "label").collect()}
    step = {r.label: r.s for r in spark.createDataFrame([(w,) for w in wordings], "label string").select("label", labels.resolve(F.col("label"))["step"].alias("s")).collect()}
    for w in wordings:
        if step[w] == 0:
            k = labels.key(w)
            scored = [(labels.weighted_ratio(k, known), -i, f) for i, (known, f) in enumerate(labels.FUZZY_POOL)] if len(k) >= 8 or len(k.split()) > 1 else []
            best = max(scored, default=(0, 0, None))
            assert got[w] == (best[2] if best[0] >= labels.FUZZY_CUTOFF else None)


def test_lines_of_replies(spark):
    """Blank and unread values of either side, values given nowhere, marks inside values, files of all kinds."""
    rows = [
        (1, "shipper", 1, "TBA", "ACME {si}"), (1, "notify_party", 3, "N/A", "-"), (1, "container_count", 6, "B8 x", "  "), (1, "gross_weight_kg", 7, "5000 LBS", "5000 KG"), (1, "consignee", 2, "A", "B"), (1, "port_of_loading", 4, "OSLO", "OSLO"),
        (2, "consignee", 2, " A\n", "B"), (2, "shipper", 1, "X", "Y"),
    ]
    asked = worklist.questions(compare.compare(spark.createDataFrame(rows, "case_id long, field string, field_ord int, si_raw string, bl_raw string")))
    schema = "case_id long, subject string, category string, status string, review_reason string, defect_fields string, si_there boolean, si_unreadable string, si_type string, si_path string, bl_there boolean, bl_unreadable string, bl_type string, bl_path string"
    both = (True, None, "SHIPPING_INSTRUCTION", "a/si.txt", True, None, "BILL_OF_LADING", "bl.txt")
    cases = [
        (1, None, "BL_COMPARISON", "NEEDS_REVIEW", "missing_value", None, *both), (2, "re: FW_ x", "BL_COMPARISON", "MISMATCH", None, "consignee", *both), (3, None, "BL_COMPARISON", "OK", None, "", *both), (4, None, "SPAM", "OK", None, "", *both),
        (5, None, "BL_COMPARISON", "NEEDS_REVIEW", "unreadable", None, True, "no_text_layer", None, r"c:\x\s.png", True, "strange", None, None),
        (6, None, "BL_COMPARISON", "NEEDS_REVIEW", "wrong_doc_type", None, True, None, "ARRIVAL_NOTICE", "n.txt", True, None, "UNKNOWN", "/"),
    ]
    got = {r.case_id: r for r in worklist.replies(spark.createDataFrame(cases, schema), asked).collect()}
    assert set(got) == {1, 2, 3, 5, 6}
    assert got[1].facts == [
        '  - Shipper: left blank on the Shipping Instruction (it reads "TBA"); the draft Bill of Lading shows "ACME {si}".',
        '  - Notify Party: left blank on the Shipping Instruction (it reads "N/A"); it is not given on the draft Bill of Lading either.',
        '  - Container Count: the Shipping Instruction shows "B8 x", which we could not read as a value; it is not given on the draft Bill of Lading either.',
        '  - Gross Weight: the Shipping Instruction shows "5000 LBS" and the draft Bill of Lading shows "5000 KG"; the figures are the same but the units differ, so one of the two documents needs amending.',
        '  - Consignee: the Shipping Instruction shows "A"; the draft Bill of Lading shows "B".', "  - The other field is consistent between the two documents.",
    ]
    # Only what counts as a defect is quoted, though the shipper differs too.
    assert got[2].facts == ['  - Consignee: SI says "A", draft BL says "B"'] and got[2].subject == "Re: x"
    assert got[3].facts == [] and got[3].body == f"Hello,\n\n{got[3].greeting} {got[3].context}\n\n{got[3].action}\n\nThank you.\n\nRegards,"
    assert got[5].facts == ["  - Draft Bill of Lading (): we could not read the file.", "  - Shipping Instruction (s.png): a scanned image, which we check manually."]
    assert got[6].facts == ["  - Received: Arrival notice (n.txt).", "  - Received: A document we could not identify (/).", "  - Still needed: Shipping Instruction.", "  - Still needed: draft Bill of Lading."]


def test_mail_rules_stand_once_in_the_plan(spark):
    """Exploding what fired repeats neither rules nor views (F9)."""
    mails = spark.createDataFrame([(1, "TO CONFIRM DOCS", "Dear all,\n\nShipper: A\nPOL: B\nConsignee : C\nPOL: D", "a@b.c")], "email_id long, subject string, body string, sender string")
    fired = classify.fired_rules(classify.views(mails)).select("email_id", F.explode("fired").alias("r")).select("email_id", "r.name", "r.gain")
    plan = fired._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^TO CONFIRM DOCS") == 1 and plan.count("(?i)\\A\\s*(?:WARNING") == 1
    assert {(r.name, r.gain) for r in fired.collect()} >= {("bl.subject.to-confirm-docs", 4.0), ("si.body.structured-block", 3.0)}


def test_first_segments_are_cut_once_a_side(spark):
    """A comparison cuts each value for its key and once more for its unit, not for each question about units (F1)."""
    rows = [(1, "gross_weight_kg", 7, "100 LBS", "100 KG"), (2, "shipper", 1, "AC0ME", "ACOME"), (3, "shipper", 1, "A\x85B | C", " "), (4, "gross_weight_kg", 7, None, "5 KG")]
    values = spark.createDataFrame(rows, "case_id long, field string, field_ord int, si_raw string, bl_raw string")
    got = compare.compare(values).select("case_id", "verdict", "reason", "si_key")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("\t;,") <= 4
    assert {tuple(r) for r in got.collect()} == {(1, "UNCOMPARABLE", "unit_differs", "100"), (2, "UNCOMPARABLE", "ocr_confusable", "AC0ME"), (3, "UNCOMPARABLE", "bl_blank", "A"), (4, "UNCOMPARABLE", "si_missing", None)}


def test_report_cases_are_compared_once(spark):
    """Reports that read their cases several times read them from one written table (F16, F20, F24, F27, F33)."""
    for name in ("review_summary", "score_final", "prior_defects", "effective_outcome", "score_by_category"):
        assert "l_orderkey" not in queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
