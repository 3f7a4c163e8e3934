"""Cells of office files, kinds of unreadable files, and rows that make a step raise."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from dockett.plans import guard, run
from dockett.plans import cases as plan
from dockett.sources import inbox, office
from dockett.storage import written

LABELS = [("Shipper", "ACME PTE. LTD."), ("Consignee", "BETA TRADING CO"), ("Notify Party", "GAMMA"), ("Port of Loading", "PENANG"), ("Port of Discharge", "OSLO"), ("No. of Containers", "2 x 40'HC"), ("Gross Weight (KG)", "21577")]
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def xlsx(*sheets, strings=()):
    names = [f"S{i}" for i in range(1, len(sheets) + 1)]
    return zipped({
        "xl/workbook.xml": f'<workbook {M} xmlns:r="r"><sheets>' + "".join(f'<sheet name="{n}" r:id="r{n}"/>' for n in names) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{n}" Target="worksheets/{n}.xml"/>' for n in names) + "</Relationships>",
        **({"xl/sharedStrings.xml": f"<sst {M}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>"} if strings else {}),
        **{f"xl/worksheets/{n}.xml": f"<worksheet {M}><sheetData>{s}</sheetData></worksheet>" for n, s in zip(names, sheets, strict=True)},
    })


def docx(body):
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def inline(rows):
    return "".join(f'<row r="{r}">' + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))


def test_cells_of_a_workbook():
    sheet = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>12</v></c></row><row><c t="b"><v>1</v></c><c><v>1.5</v></c><c t="str"><v> x </v></c><c/></row>'
    found = list(office.workbook(io.BytesIO(xlsx(sheet, inline([["a"]]), strings=["<r><t>Gross </t></r><r><t>Weight</t></r><rPh><t>no</t></rPh>"]))))
    assert found == [(1, 2, 0, "Gross Weight", "S1"), (1, 2, 2, "12", "S1"), (1, 3, 0, "True", "S1"), (1, 3, 1, "1.5", "S1"), (1, 3, 2, "x", "S1"), (2, 1, 0, "a", "S2")]


def test_cells_of_a_document():
    merged = f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("A")}{p("B")}</w:tc><w:tc>{table(["in", "ner"])}{p("C")}</w:tc></w:tr></w:tbl>'
    found = list(office.document(io.BytesIO(docx(p("Title") + p(" ") + merged + p("after") + table(["x", "y"])))))
    assert found == [(0, 1, 0, "Title", ""), (1, 1, 0, "A\nB", ""), (1, 1, 1, "A\nB", ""), (1, 1, 2, "in\nner\nC", ""), (0, 3, 0, "after", ""), (2, 1, 0, "x", ""), (2, 1, 1, "y", "")]


def test_files_are_planned_by_size(monkeypatch):
    monkeypatch.setattr(office, "TASK_BYTES", 10)
    assert office.planned([("a", 4), ("b", 50), ("c", 4), ("d", 4)]) == [["b"], ["a", "c"], ["d"]] and office.planned([]) == []


def test_a_large_sheet_is_streamed(spark, tmp_path):
    """Batches of a bounded number of cells, whatever the size of the sheet; a cut file keeps what came before, and its error."""
    (tmp_path / "big.xlsx").write_bytes(xlsx(inline([[f"v{r}", "w"] for r in range(20_000)])))
    broken = xlsx(inline([["a", "b"]]) + "<row><c t=\"s\"><v>9</v></c></row>")
    (tmp_path / "cut.xlsx").write_bytes(broken)
    (tmp_path / "text.xlsx").write_bytes(b"PK no zip")
    files = [(str(tmp_path / n), (tmp_path / n).stat().st_size) for n in ("big.xlsx", "cut.xlsx", "text.xlsx")] + [(str(tmp_path / "gone.xlsx"), 5)]
    got = office.cells(spark, files)
    by = {r.path.rpartition("/")[2]: (r.n, r.e) for r in got.groupBy("path").agg(F.count("text").alias("n"), F.max("error").alias("e")).collect()}
    assert by["big.xlsx"] == (40_000, None) and by["cut.xlsx"][0] == 2 and "IndexError" in by["cut.xlsx"][1] and by["text.xlsx"][0] == 0 and by["text.xlsx"][1] and by["gone.xlsx"][1]
    reader = office._Reader({"files": json.dumps(files[:1])})
    batches = list(reader.read(reader.partitions()[0]))
    assert max(b.num_rows for b in batches) <= office.BATCH and sum(b.num_rows for b in batches) == 40_000


def test_a_run_over_office_files(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    (tmp_path / "attachments").mkdir()
    ask = "Attached are the SI and draft BL. Please compare the SI and draft BL."
    named = [["a_SI.xlsx", "a_BL.docx"], ["b_SI.xlsx", "b_BL.docx"], ["a_SI.xlsx", "c_BL.docx"], ["a_SI.xlsx", "../secret.txt"], ["d_SI.XLSX", "d_BL.pdf"]]
    for i, names in enumerate(named):
        (tmp_path / f"inbox/email_{i:03d}.json").write_text(json.dumps({"email_id": f"email_{i:03d}", "from": "a@b.c", "subject": "TO CONFIRM DOCS", "body": ask, "attachments": [f"attachments/{n}" for n in names]}))
    (tmp_path / "secret.txt").write_text("secret")
    sheet = xlsx(inline([["SHIPPING INSTRUCTION"], *LABELS]))
    manifest = [x for x in LABELS if x[0] != "No. of Containers"]
    for name, data in (
        ("a_SI.xlsx", sheet), ("b_SI.xlsx", sheet), ("d_SI.XLSX", xlsx("")), ("d_BL.pdf", b"%PDF"), ("c_BL.docx", b"not zipped"),
        ("a_BL.docx", docx(p("DRAFT BILL OF LADING") + p("B/L No.: 88") + table(*LABELS))),
        ("b_BL.docx", docx(p("DRAFT BILL OF LADING") + p("B/L No.: 88") + table(*manifest) + table(["Container Nr.", "Seal", "Packages"], ["C1", "S1", "4"], ["C2", "S2", "4"], ["C3", "S3", "4"]))),
    ):
        (tmp_path / f"attachments/{name}").write_bytes(data)
    mails = inbox.emails(spark, str(tmp_path))
    read = inbox.attachments(spark, str(tmp_path), mails)
    assert {(r.path.rpartition("/")[2], r.unreadable) for r in read.collect()} == {("a_SI.xlsx", None), ("a_BL.docx", None), ("b_SI.xlsx", None), ("b_BL.docx", None), ("c_BL.docx", "corrupt"), ("secret.txt", "missing_file"), ("d_SI.XLSX", "empty_file"), ("d_BL.pdf", "unsupported")}
    got = {r.case_id: (r.status, r.review_reason, r.defect_fields) for r in run.run(mails, read).collect()}
    assert got["email_000"] == ("OK", None, "") and got["email_001"] == ("MISMATCH", None, "container_count") and got["email_002"][:2] == ("NEEDS_REVIEW", "unreadable")


def test_rows_that_raise_are_set_apart(spark, monkeypatch):
    """Of twelve keys one raises in Python and one overflows in an expression; the others are kept."""
    keys = spark.range(12).withColumnRenamed("id", "case_id")

    @F.udf("long")
    def fussy(i):
        if i == 3:
            raise ValueError("planted")
        return i

    def decide(own):
        rows = keys if own is None else written(own, "own")
        return rows.withColumn("x", fussy("case_id")).withColumn("y", F.when(F.col("case_id") == 7, F.col("case_id")).otherwise(0) * F.lit(2**62))

    kept, faults = guard.isolated(decide, keys)
    assert sorted(r.case_id for r in kept.collect()) == [i for i in range(12) if i not in (3, 7)]
    said = {r.case_id: r.error for r in faults.collect()}
    assert set(said) == {3, 7} and "OVERFLOW" in said[7] and all(said.values())
    monkeypatch.setattr(guard, "MOST_FAULTS", 1)
    with pytest.raises(Exception, match=r"planted|OVERFLOW|MULTIPLE_FAILURES"):
        guard.isolated(decide, keys)


def test_a_run_outlives_a_row_that_raises(spark, monkeypatch):
    ask = "Attached are the SI and draft BL. Please compare the SI and draft BL."
    si = "SHIPPING INSTRUCTION\n====\n" + "\n".join(": ".join(x) for x in LABELS)
    bl = si.replace("SHIPPING INSTRUCTION\n====", "DRAFT BILL OF LADING\n====\nB/L No.: 88")
    docs = spark.createDataFrame([(m, o, f"{m}_{s}.txt", t, None) for m in ("a", "b") for o, (s, t) in enumerate((("SI", si), ("BL", bl)))], "case_id string, ord int, path string, text string, unreadable string")
    mails = spark.createDataFrame([(m, "x@y.z", "TO CONFIRM DOCS", ask) for m in ("a", "b")], "email_id string, sender string, subject string, body string")
    real = plan.cases

    @F.udf("string")
    def fussy(m):
        if m == "b":
            raise ValueError("planted")
        return m

    monkeypatch.setattr(plan, "cases", lambda *given: real(*given).withColumn("reason", F.concat("reason", F.substring(fussy("case_id"), 1, 0))))
    got = {r.case_id: (r.status, r.review_reason, bool(r.error)) for r in run.run(mails, docs).collect()}
    assert got == {"a": ("OK", None, False), "b": ("NEEDS_REVIEW", "unreadable", True)}
