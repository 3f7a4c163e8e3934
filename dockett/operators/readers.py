"""Readers over tables of lines and cells: container manifests, Markdown, tidy lines, transcripts of scans, uploads.

No bytes are read here: cells come from sources.office, and what a converter makes of PDFs and scans (Markdown lines, words
with places, answers about a scan) comes in as a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import FIELDS
from ..functions.labels import resolve
from ..functions.text import basic, is_blank, split_lines, strip
from .chunks import DOC, RULE, chunks

#: Columns of a table that may be a manifest, at least.
MANIFEST_COLUMNS = 3
# The label of a manifest's count, the word that makes a header, kinds of text files, the largest file.
MANIFEST_LABEL, MANIFEST_WORD = "Container Count", "CONTAINER"
TEXT_KINDS, MAX_BYTES = [".txt", ".text", ".csv"], 25 * 1024 * 1024
# Patterns of a tidy field, of column spacing, and of a rule.
_FIELD, _COLUMNS, _TIDY_RULE = r"^([^:]{1,60}?):\s*(.*)$", r"(?U)\s{2,}", r"^[=\-_]{3,}\s*$"


def table_rows(cells: DataFrame) -> DataFrame:
    """doc, tbl, row, cells (array): rows that hold any text, with consecutive equal cells (merged ones) taken once.

    cells: doc, tbl, row, col, text; a row is bounded by its columns.
    """
    listed = F.array_sort(F.collect_list(F.struct("col", strip(F.coalesce("text", F.lit(""))).alias("text"))))
    rows = cells.groupBy("doc", "tbl", "row").agg(F.transform(listed, lambda x: x["text"]).alias("c"))
    once = F.filter("c", lambda x, i: (i == 0) | (x != F.get(F.col("c"), i - 1)))
    return rows.withColumn("cells", once).filter(F.exists("cells", lambda x: x != "")).select("doc", "tbl", "row", "cells")


def table_chunks(cells: DataFrame) -> DataFrame:
    """doc, tbl, row, label, value of the chunks of tables; row is null for the count of a container manifest.

    A table whose first row has at least three cells, one of which names containers, has a container a row: it
    gives one chunk with their number. Other rows give their first cell as label and the rest as value.
    """
    rows = table_rows(cells)
    names = F.exists("cells", lambda x: F.contains(basic(x), F.lit(MANIFEST_WORD)))
    header = (F.col("row") == 1) & (F.size("cells") >= MANIFEST_COLUMNS) & names
    marked = rows.withColumn("manifest", F.max(header).over(W.partitionBy("doc", "tbl")))
    counted = marked.filter("manifest and row > 1").groupBy("doc", "tbl").agg(F.count(F.lit(1)).alias("n"))
    manifests = counted.select("doc", "tbl", F.lit(None).cast("int").alias("row"), F.lit(MANIFEST_LABEL).alias("label"), F.col("n").cast("string").alias("value"))
    rest = F.filter(F.slice("cells", F.lit(2), F.size("cells")), lambda x: x != "")
    pairs = marked.filter(~F.col("manifest") & (F.size("cells") >= 2) & (F.col("cells")[0] != ""))
    return pairs.select("doc", "tbl", F.col("row").cast("int").alias("row"), F.col("cells")[0].alias("label"), F.array_join(rest, " ").alias("value")).unionByName(manifests)


def split_pair(text: Column) -> Column:
    """A struct (label, value) of one string: by colon, else by another separator behind a wording that resolves; null if
    neither."""
    from .chunks import LABEL, OTHER

    t = strip(text)
    pair = lambda p: F.struct(strip(F.regexp_extract(t, p, 1)).alias("label"), strip(F.regexp_extract(t, p, 2)).alias("value"))
    colon, other = pair(LABEL), pair(OTHER)
    return F.when(colon["label"] != "", colon).when((other["label"] != "") & resolve(other["label"])["field"].isNotNull(), other)


def markdown_chunks(docs: DataFrame) -> DataFrame:
    """case_id, side, chunk_ord (from 0), line, label, value of Markdown texts: rows of pipe tables first, then labelled
    lines outside of tables, both in their order. docs: case_id, side, text."""
    lines = docs.select(*DOC, F.posexplode(split_lines(F.col("text"))).alias("line", "raw")).withColumns({"line": F.col("line") + 1, "text": strip(F.col("raw"))})
    piped = F.startswith("text", F.lit("|"))
    cells = F.transform(F.split(F.btrim("text", F.lit("|")), r"\|"), strip)
    full = F.filter("cells", lambda x: x != "")
    ruled = F.forall("cells", lambda x: x.rlike(r"^[-: ]*$"))
    rows = lines.filter(piped).withColumn("cells", cells).filter(~ruled)
    value = F.array_join(F.filter(F.slice("cells", F.lit(2), F.size("cells")), lambda x: x != ""), " ")
    label = F.col("cells")[0]
    alone = split_pair(label)
    found = rows.withColumn("pair", F.when((label != "") & (value != ""), F.struct(label.alias("label"), value.alias("value"))).when((label != "") & (F.size(full) == 1), alone)).filter("pair is not null")
    tables = found.select(*DOC, F.lit(0).alias("part"), "line", "pair.label", "pair.value")
    plain = lines.withColumn("text", F.when(piped, "").otherwise(strip(F.ltrim(F.col("text"), F.lit("#")))))
    again = plain.groupBy(*DOC).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    outside = chunks(again).select(*DOC, F.lit(1).alias("part"), "line", "label", "value")
    order = F.row_number().over(W.partitionBy(*DOC).orderBy("part", "line"))
    return tables.unionByName(outside).withColumn("chunk_ord", order - 1).drop("part")


def tidy_lines(docs: DataFrame) -> DataFrame:
    """case_id, side, line, kind (field, heading, text), label, value: each line once, continued values folded in.

    An indented line continues the field above it; blank lines and rules are left out. docs: case_id, side, text.
    """
    rows = docs.select(*DOC, F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line", "raw"))
    kept = rows.withColumns({"line": F.col("line") + 1, "text": strip(F.col("raw"))}).filter((F.col("text") != "") & ~F.col("raw").rlike(_TIDY_RULE))
    label = strip(F.regexp_extract("raw", _FIELD, 1))
    field = F.col("raw").rlike(_FIELD) & ~label.rlike(_COLUMNS)
    heading = ~F.col("text").rlike("[a-z]") & (F.length("text") <= 60) & ~F.col("text").rlike(_COLUMNS)
    typed = kept.withColumns({"field": field, "indented": F.col("raw").rlike(r"(?U)^\s"), "kind": F.when(field, "field").when(heading, "heading").otherwise("text")})
    # A run is a line that is not indented and what follows it; in it all after the first field continue a field.
    order = W.partitionBy(*DOC).orderBy("line")
    runs = typed.withColumn("run", F.sum((~F.col("indented")).cast("int")).over(order))
    before = W.partitionBy(*DOC, "run").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    more = runs.withColumn("more", F.col("indented") & F.coalesce(F.max("field").over(before), F.lit(False)))
    own = more.withColumn("own", F.sum((~F.col("more")).cast("int")).over(order))
    value = F.when(F.col("more"), F.col("text")).when(F.col("kind") == "field", strip(F.regexp_extract("raw", _FIELD, 2))).when(F.col("kind") == "heading", F.col("text")).otherwise(F.rtrim("raw"))
    parts = F.array_sort(F.collect_list(F.struct("line", value.alias("v"))))
    head = lambda c: F.max(F.when(~F.col("more"), c))
    folded = own.groupBy(*DOC, "own").agg(F.min("line").alias("line"), head(F.col("kind")).alias("kind"), head(F.when(F.col("kind") == "field", label)).alias("label"), parts.alias("p"))
    joined = F.array_join(F.filter(F.transform("p", lambda x: x["v"]), lambda x: x != ""), "\n")
    return folded.select(*DOC, "line", "kind", "label", joined.alias("value"))


def without_caption(field: Column, value: Column) -> Column:
    """A value without a printed caption in front of it, if that resolves to the value's own field."""
    head, rest = F.substring_index(value, ":", 1), strip(F.substring(value, F.instr(value, ":") + 1, F.length(value)))
    captioned = F.contains(value, F.lit(":")) & (rest != "") & F.coalesce(resolve(head)["field"] == field, F.lit(False))
    return F.when(captioned, rest).otherwise(value)


def transcripts(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """Seven rows a doc: doc, field, field_ord, value, legible. docs: doc; answers: doc, ord, field, value, legible.

    The first answer of a field counts. A value that says nothing, or is not legible, is empty and not legible.
    """
    first = answers.withColumn("n", F.row_number().over(W.partitionBy("doc", "field").orderBy("ord"))).filter("n = 1").select("doc", "field", "value", "legible")
    dim = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_ord")) for i, f in enumerate(FIELDS, 1)])).alias("d")
    rows = docs.select("doc", dim).select("doc", "d.*").join(first, ["doc", "field"], "left")
    value = without_caption(F.col("field"), strip(F.coalesce("value", F.lit(""))))
    legible = F.coalesce("legible", F.lit(False)) & ~is_blank(value)
    return rows.select("doc", "field", "field_ord", F.when(legible, value).otherwise("").alias("value"), legible.alias("legible"))


def transcript_summary(read: DataFrame, said: DataFrame) -> DataFrame:
    """doc, legible_fields, overall_legible, confidence: a claim of legibility needs a legible field, confidence is kept
    within 0 and 1. said: doc, overall_legible, confidence."""
    counted = read.groupBy("doc").agg(F.count_if("legible").alias("legible_fields"))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0))))
    return counted.join(said, "doc").select("doc", "legible_fields", (F.coalesce("overall_legible", F.lit(False)) & (F.col("legible_fields") > 0)).alias("overall_legible"), sure.alias("confidence"))


def unreadable(path: Column, n_bytes: Column, text: Column, error: Column | None = None, kinds: list[str] = TEXT_KINDS) -> Column:
    """Why a file cannot be read, or null: missing (no length), no bytes, too large, none of the kinds, corrupt (an error came
    up), or blank text."""
    kind = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    error = F.lit(None).cast("string") if error is None else error
    return (
        F.when(n_bytes.isNull() & error.isNull(), "missing_file").when(n_bytes == 0, "empty_file").when(n_bytes > MAX_BYTES, "unsupported")
        .when(~kind.isin(kinds), "unsupported").when(error.isNotNull(), "corrupt").when(strip(F.coalesce(text, F.lit(""))) == "", "empty_file")
    )


def uploads(files: DataFrame) -> DataFrame:
    """files (name, content as bytes) with n_bytes, text and unreadable, as for attachments. Bytes that are no UTF-8
    become replacement characters."""
    sized = files.withColumn("n_bytes", F.octet_length(F.coalesce("content", F.lit(b""))))
    kind = F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1))
    text = F.when(kind.isin(TEXT_KINDS) & (F.col("n_bytes") <= MAX_BYTES), F.expr("make_valid_utf8(cast(content as string))"))
    return sized.withColumn("text", text).withColumn("unreadable", unreadable(F.col("name"), F.col("n_bytes"), F.col("text"))).drop("content")


def decoration(text: Column) -> Column:
    return text.rlike(RULE)
