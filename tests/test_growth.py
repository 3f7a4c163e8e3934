"""What grows with the input is not sent through the driver, and documents are not exchanged more often than needed."""

from dockett import queries
from dockett.operators import compare, layout, perturb, sampling, worklist
from dockett.storage import written


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _cases(spark):
    rows = [(i, f"s{i % 2}", "BL_COMPARISON", ("OK", "MISMATCH", "NEEDS_REVIEW")[i % 3], None, i % 3 == 1, "consignee" if i % 3 == 1 else "") for i in range(8)]
    return spark.createDataFrame(rows, "case_id long, shipper string, category string, status string, review_reason string, has_defect boolean, defect_fields string")


def test_reviews_and_senders_are_not_broadcast(spark):
    cases = written(_cases(spark), "cases")
    reviews = cases.filter("case_id % 4 = 0").selectExpr("case_id", "'correct' AS decision", "'MISMATCH' AS status", "'shipper,consignee' AS defect_fields")
    rows = worklist.case_rows(cases, reviews, cases.filter("case_id > 2").selectExpr("case_id", "'desk' AS sender")).withColumn("ord", cases["case_id"])
    assert "Broadcast" not in physical(rows)
    got = {r.case_id: r for r in rows.collect()}
    assert len(got) == 8 and [(got[4].status, got[4].system_status, got[4].defect_fields, got[4].outcome_source, got[4].sender), (got[1].status, got[1].system_defect_fields, got[1].outcome_source, got[1].sender)] == [
        ("MISMATCH", "MISMATCH", "consignee,shipper", "review", "desk"), ("MISMATCH", "consignee", "system", "unknown")
    ]
    guesses = rows.selectExpr("case_id", "CASE WHEN case_id < 3 THEN category ELSE 'SPAM' END AS guess")
    r = worklist.exercise(rows, guesses, 60.0)
    assert tuple(r.first()) == (5, 3, 12.0, 96.0)


def test_a_page_is_dealt_once(spark):
    """Also with nulls, fonts drawn through each other, and an edge that no labelled row shows."""
    word = "doc int, page int, text string, x0 double, x1 double, top double, size double, fontname string"
    rows = [(1, 1, t, x, x + 20, top, 10.0, font) for top in (10.0, 30.0, 50.0) for t, x, font in (("L", 40.0, "B,Bold"), ("v", 200.0, "A"), ("w", 300.0, None))]
    rows += [(2, 1, "Bold", 40.0, 90.0, 10.0, 10.0, "Bold"), (2, 1, "thin", 60.0, 99.0, 10.0, None, "A"), (2, 1, "lost", None, None, 30.0, 0.0, None), (2, 1, None, 70.0, 80.0, None, 10.0, "A")]
    words = written(spark.createDataFrame(rows, word), "words")
    out = layout.split_rows(words)
    assert physical(out).count("Exchange") == 1 and "Join" not in physical(out)
    assert {(r.doc, r.value_x) for r in layout.value_columns(words).collect()} == {(1, 200.0), (2, layout.NO_COLUMN)}
    got = {(r.doc, r.row): (r.label, r.value) for r in out.collect()}
    assert [got[1, i] for i in (1, 2, 3)] == [("L", "v w")] * 3 and ("Bold", "thin") in got.values() and len(got) == 6


def test_continued_lines_are_read_once(spark):
    """A blank line, a rule or a label that resolves ends a value; a no-break space in front is no beginning of a line."""
    texts = ["Shipper: A\n  B\nConsignee: C\n\nD", " shipper: A\nB\r\nNotify Party: E\n====\nF", "\u00a0Shipper: A\nB\nnotify x: y\nPOL: Z", None, ""]
    docs = written(spark.createDataFrame([(i, "SI", t) for i, t in enumerate(texts)], "case_id long, side string, text string"), "docs")
    out = sampling.continuations(docs)
    assert physical(out).count("ArrowEvalPython") == 1
    assert sorted(map(tuple, out.collect())) == [("consignee", 0, 1), ("notify", 0, 2), ("shipper", 2, 2)]


def test_sorting_calls_no_comparison_of_its_own(spark):
    """array_sort compares through an expression that is interpreted for every two elements."""
    docs = spark.createDataFrame([(1, "SI", "Shipper: A")], "case_id long, side string, text string")
    values = spark.createDataFrame([(1, "shipper", 1, "A", "B")], "case_id long, field string, field_ord int, si_raw string, bl_raw string")
    for made in (perturb.texts(docs), compare.by_case(compare.compare(values))):
        assert "array_sort(" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_pairs_meet_without_a_further_exchange(spark):
    plan = physical(queries.wrap_repair(spark, "/root/testdata/sf0.001"))
    assert plan.count("orders.parquet") == 2 and plan.count("Exchange hashpartitioning(case_id#") <= 5
