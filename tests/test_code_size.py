"""Steps on values and texts stay below 8,000 bytes a method, the most that the JVM compiles."""

import re

import pytest

from dockett.operators import chunks, compare, perturb
from dockett.sources import derive

SF = "/root/testdata/sf0.001"
STEPS = {
    "compare": lambda pairs: compare.compare(derive.values(pairs)),
    "candidates": lambda pairs: chunks.candidates(chunks.chunks(derive.texts(pairs))),
    "perturb": lambda pairs: perturb.texts(derive.texts(pairs)),
}


@pytest.mark.parametrize("step", STEPS)
def test_methods_are_compiled(spark, step):
    made = STEPS[step](derive.pairs(spark, SF))
    given = {"spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        shown = spark._jvm.PythonSQLUtils.explainString(made.select("*")._jdf.queryExecution(), "codegen")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = list(map(int, re.findall(r"maxMethodCodeSize:(\d+)", shown)))
    assert sizes and max(sizes) < 8000


def test_equal_and_blank_values_on_either_side(spark):
    rows = [("shipper", "A LTD", "A LTD"), ("shipper", None, None), ("shipper", "A LTD", None), ("shipper", None, "A LTD"), ("gross_weight_kg", "5 KG", "5 KG"), ("gross_weight_kg", "???", "???"), ("port_of_loading", "X\x85Y", "X|Z")]
    out = compare.compare(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, field string, si_raw string, bl_raw string")).orderBy("i").collect()
    assert [(r.si_key, r.bl_key, r.bl_number, r.bl_state, r.verdict) for r in out] == [
        ("A", "A", None, "usable", "MATCH"), (None, None, None, "missing", "UNCOMPARABLE"), ("A", None, None, "missing", "UNCOMPARABLE"), (None, "A", None, "usable", "UNCOMPARABLE"),
        ("5", "5", 5.0, "usable", "MATCH"), (None, None, None, "blank", "UNCOMPARABLE"), ("X", "X", None, "usable", "MATCH"),
    ]
