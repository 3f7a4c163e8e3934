"""Lines are cut and folded inside their document's row."""

import re

from dockett import queries, reader_queries  # noqa: F401
from dockett.functions.text import split_lines
from dockett.operators import chunks
from dockett.registry import QUERIES
from pyspark.sql import functions as F

ODD = [
    "Shipper: ACME\r\n  more\nPOL : Oslo\x1eGross Weight:\t5 KG", ": nothing\nConsignee:: B:C", "x" * 60 + ": a", "x" * 61 + ": a", "x" * 60 + "   : a", "", "\n\n====\n", "no label\nShipper\tACME\nNotify Party — BETA\n POD: X\n other: y",
    "Port of Lodaing: fuzzy\nShippers Nam: z", " Shipper : ACME tail", "a: b\r\rc\x85d", None,
]


def test_labels_are_what_the_pattern_takes(spark):
    docs = spark.createDataFrame([(i, "SI", t) for i, t in enumerate(ODD)], "case_id long, side string, text string")
    seen = {(r.case_id, r.line): r for r in chunks.marked(docs).collect()}
    assert len(seen) > 20
    for r in seen.values():
        m = re.match(chunks.LABEL.replace(r"\s", "[ \t\n\x0b\x0c\r]"), r.text)
        if m and m.group(1).strip():
            assert r.label == m.group(1).strip(), r
        else:
            assert r.label is None or ":" not in r.text[: len(r.label) + 1]


def test_folding_needs_no_exchange_and_no_sorting(spark):
    docs = spark.createDataFrame([(i, "SI", t) for i, t in enumerate(ODD)], "case_id long, side string, text string")
    folded = chunks.chunks(docs)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in ("Exchange", "Sort", "Window", "Aggregate") if x in plan]
    rows = sorted((r.case_id, r.chunk_ord, r.label, r.value, r.field) for r in folded.collect())
    assert rows[:3] == [(0, 0, "Shipper", "ACME\nmore", "shipper"), (0, 1, "POL", "Oslo", "port_of_loading"), (0, 2, "Gross Weight", "5 KG", "gross_weight_kg")]
    assert (7, 0, "Shipper", "ACME", "shipper") in rows and (7, 1, "Notify Party", "BETA", "notify_party") in rows and (7, 2, "POD", "X\nother: y", "port_of_discharge") in rows
    assert (8, 0, "Port of Lodaing", "fuzzy", "port_of_loading") in rows


def test_lines_end_as_by_the_pattern(spark):
    texts = ["a\r\nb\rc\nd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l", "\r\r\n\n", "", "x\r\n"]
    got = [r.l for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(split_lines(F.col("t")).alias("l")).collect()]
    assert got == [re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", t) for t in texts]


def test_pairing_makes_one_list_a_case_and_keeps_cases_without_values(spark):
    names = "case_id long, side string, field string, raw string, key string, number double, blank boolean, present boolean, line int, snippet string"
    values = spark.createDataFrame([(1, "BL", "consignee", "ACME LTD", "ACME", None, False, True, 2, "s"), (1, "SI", "gross_weight_kg", "5 KG", "5", 5.0, False, True, 3, "t")], names)
    paired = chunks.paired(values, spark.createDataFrame([(1,), (2,)], "case_id long"))
    plan = paired._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1 and "max(" not in plan.replace("array_max(", "")
    rows = {(r.case_id, r.field): r for r in paired.collect()}
    assert len(rows) == 14 and rows[1, "consignee"].bl_key == "ACME" and rows[1, "consignee"].si_raw is None
    assert rows[1, "gross_weight_kg"].si_number == 5.0 and rows[1, "gross_weight_kg"].bl_raw is None
    assert [rows[2, f].field_ord for f in ("shipper", "gross_weight_kg")] == [1, 7] and all(r.si_raw is None and r.bl_raw is None for k, r in rows.items() if k[0] == 2)


def test_texts_are_dealt_by_document_before_they_are_read(spark):
    for name in ("candidate_scores", "candidate_ranks", "missing_fields"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"hashpartitioning\(case_id#\d+L?, (?:side#\d+|SI), \d+\), REPARTITION", plan), name
