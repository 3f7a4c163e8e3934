"""Comparison of two readings of a field: MATCH, MISMATCH or UNCOMPARABLE, never by similarity of values."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MATCH, MISMATCH, NO_MISMATCH, NUMERIC_FIELDS, PARTY_FIELDS, PORT_FIELDS, UNCOMPARABLE
from ..functions.text import first_segment, settled, squash, with_key

WEIGHT_TOLERANCE_KG = 0.5
# Unit tokens of pounds and of metric weights.
_LB = r"(?:LBS?|LBR|POUNDS?|L\.B\.S?\.?)"
_METRIC = r"(?i)(?<![A-Z])(KGS?|KGM|KGRS?|KILOS?|KILOGRAMS?|KILOGRAMMES?|KILOGRAMOS?|K\.G\.S?\.?|MTS?|TONS?|TONNES?)(?![A-Z])|㎏"
_POUNDS = rf"(?i)(?<![A-Z]){_LB}(?![A-Z])"
_FIGURE = r"\d[\d,]*(?:\.\d+)?"


def ocr_confusable(a: Column, b: Column) -> Column:
    """Different texts that are equal once O/0, I/1, S/5 and B/8 are not told apart."""
    same = F.translate(a, "0158", "OISB") == F.translate(b, "0158", "OISB")
    return F.coalesce((a != b) & same, F.lit(False))


def _pounds_only(s: Column) -> Column:
    one = F.regexp_count(s, F.lit(_FIGURE)) == 1
    beside = s.rlike(rf"(?i){_FIGURE}\s*\(?\s*{_LB}(?![A-Z])") | s.rlike(rf"(?i)(?<![A-Z]){_LB}\s*[:.]?\s*\d")
    # What every unit of _LB holds settles most weights without a pattern.
    some = reduce(or_, (F.contains(F.upper(s), F.lit(x)) for x in ("LB", "L.B", "POUND")))
    return some & s.rlike(_POUNDS) & ~s.rlike(_METRIC) & one & beside


def _metric_only(s: Column) -> Column:
    return s.rlike(_METRIC) & ~s.rlike(_POUNDS)


def units_differ(a: Column, b: Column) -> Column:
    """One weight in pounds only, the other in kilograms or tonnes only; by their first segments, columns of their own."""
    return F.coalesce((_pounds_only(a) & _metric_only(b)) | (_pounds_only(b) & _metric_only(a)), F.lit(False))


def state_of(side: str, flagged: bool) -> Column:
    """usable, missing (no label), blank or unparseable; flagged: an extractor's blank flag counts first."""
    missing = F.when(F.coalesce(f"{side}_blank", F.lit(False)), "blank").when(F.col(f"{side}_raw").isNull(), "missing") if flagged else F.when(F.col(f"{side}_raw").isNull(), "missing")
    return missing.when(F.col(f"{side}_empty"), "blank").when(F.col(f"{side}_key").isNull(), "unparseable").otherwise("usable")


def compare(values: DataFrame, blanks: bool = False) -> DataFrame:
    """Adds si_key, bl_key, si_number, bl_number, si_state, bl_state, verdict and reason to rows with field,
    si_raw and bl_raw (with blanks, also si_blank and bl_blank). The instruction is named first. Keys and numbers that
    are there already are taken as they are, with the blank flags."""
    field, si, bl = F.col("field"), F.col("si_raw"), F.col("bl_raw")
    if blanks and "si_key" in values.columns:
        keyed = values.withColumns({f"{s}_empty": F.coalesce(f"{s}_blank", F.lit(False)) for s in ("si", "bl")})
    else:
        # Equal values, which most are, are read once.
        other = with_key(values, "field", "si_raw", "si").withColumns({"__as_si": si.eqNullSafe(bl), "__bl": F.when(~si.eqNullSafe(bl), bl)})
        keyed = with_key(other, "field", "__bl", "__bl")
        keyed = keyed.withColumns({f"bl_{c}": F.when(F.col("__as_si"), F.col(f"si_{c}")).otherwise(F.col(f"__bl_{c}")) for c in ("key", "number", "empty")})
        keyed = settled(keyed, "bl_key", "bl_number", "bl_empty").drop("__as_si", "__bl", "__bl_key", "__bl_number", "__bl_empty")
    stated = keyed.withColumns({"si_state": state_of("si", blanks), "bl_state": state_of("bl", blanks)}).drop("si_empty", "bl_empty")
    # Forms that few rows need are made for those alone, each once.
    weight = field == "gross_weight_kg"
    stated = stated.withColumns({f"__{s}_segment": F.when(weight & raw.isNotNull(), first_segment(raw)) for s, raw in (("si", si), ("bl", bl))})
    close = F.abs(F.col("si_number") - F.col("bl_number")) < WEIGHT_TOLERANCE_KG
    equal = F.when(weight, close).otherwise(F.col("si_key") == F.col("bl_key"))
    stated = settled(stated.withColumns({"__units": F.when(weight, units_differ(F.col("__si_segment"), F.col("__bl_segment"))).otherwise(False), "__same": equal}), "__units", "__same")
    same, unlike = F.col("__same"), field.isin(PARTY_FIELDS + PORT_FIELDS) & ~F.col("__same")
    stated = stated.withColumns({f"__{s}_squashed": F.when(unlike, squash(raw)) for s, raw in (("si", si), ("bl", bl))})
    glyphs = unlike & (ocr_confusable(F.col("si_key"), F.col("bl_key")) | ocr_confusable(F.col("__si_squashed"), F.col("__bl_squashed")))
    reason = (
        F.when(F.col("si_state") != "usable", F.concat(F.lit("si_"), "si_state"))
        .when(F.col("bl_state") != "usable", F.concat(F.lit("bl_"), "bl_state"))
        .when(glyphs, "ocr_confusable")
        .when(same & F.col("__units"), "unit_differs")
    )
    judged = stated.withColumn("reason", reason).withColumn("verdict", F.when(F.col("reason").isNotNull(), UNCOMPARABLE).when(same, MATCH).otherwise(MISMATCH)).drop("__units", "__same", "__si_segment", "__bl_segment", "__si_squashed", "__bl_squashed")
    return settled(judged, "si_state", "bl_state", "reason", "verdict")


def shown(field: Column, raw: Column, key: Column) -> Column:
    text = F.coalesce(F.nullif(first_segment(raw), F.lit("")), key, F.lit("?"))
    return F.when(field.isin(NUMERIC_FIELDS), F.coalesce(key, F.lit("?"))).otherwise(text)


def by_case(compared: DataFrame) -> DataFrame:
    """One row a case: defect_fields and uncomparable_fields (sorted, comma-separated), summary, n_matched."""
    line = F.concat(F.replace("field", F.lit("_"), F.lit(" ")), F.lit(" - SI: "), shown(F.col("field"), F.col("si_raw"), F.col("si_key")), F.lit(" / BL: "), shown(F.col("field"), F.col("bl_raw"), F.col("bl_key")))
    hit = lambda verdict, x: F.when(F.col("verdict") == verdict, x)
    lines = F.sort_array(F.collect_list(hit(MISMATCH, F.struct("field_ord", line.alias("line")))))
    grouped = compared.groupBy("case_id").agg(
        F.array_join(F.sort_array(F.collect_list(hit(MISMATCH, F.col("field")))), ",").alias("defect_fields"),
        F.array_join(F.sort_array(F.collect_list(hit(UNCOMPARABLE, F.col("field")))), ",").alias("uncomparable_fields"),
        F.array_join(F.transform(lines, lambda x: x["line"]), "; ").alias("lines"),
        F.count_if(F.col("verdict") == MATCH).alias("n_matched"),
    )
    return grouped.select("case_id", "defect_fields", "uncomparable_fields", F.when(F.col("lines") == "", NO_MISMATCH).otherwise(F.col("lines")).alias("summary"), "n_matched")
