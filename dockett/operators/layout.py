"""Words with places on a page put together to rows of label and value.

words: doc, page, text, x0, x1, top, size, fontname. A page's words are gathered into one row, in which rows of words and
columns are found, so a page is dealt once and joined with nothing; it bounds what a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import settled

PAGE = ["doc", "page"]
# Points that words of a row, and edges of a column, may lie apart; the place of no column.
ROW_TOLERANCE, COLUMN_TOLERANCE, NO_COLUMN = 3.0, 3.0, 1e9
# How far from the margin a label may begin, a column must begin, and how often an edge must recur.
LABEL_MARGIN, COLUMN_MARGIN, RECURRING, LEAST_WORDS, WORD_SHARE, FONT_SIZE = 5.0, 20.0, 0.6, 3, 0.04, 8.0


def is_bold(fontname: Column) -> Column:
    return F.coalesce(F.lower(fontname).rlike("bold|black|heavy|,b"), F.lit(False))


def _pages(words: DataFrame) -> DataFrame:
    """doc, page, w (the words down the page) and starts (the places in w, from 1, at which rows begin).

    A word is in the row whose first word lies within the tolerance. That first word, not the last, is the anchor, so a
    page is folded word by word, keeping the places of anchors only.
    """
    word = F.struct(F.bround("top", 1).alias("by"), "x0", "text", "x1", "top", "size", "fontname")
    pages = settled(words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(word)).alias("w")), "w")
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(1).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(state: Column, x: Column) -> Column:
        same = F.coalesce(F.abs(x["top"] - state["anchor"]) <= ROW_TOLERANCE, F.lit(False))
        anchor, starts = F.when(same, state["anchor"]).otherwise(x["top"].cast("double")), F.when(same, state["starts"]).otherwise(F.concat(state["starts"], F.array(state["i"])))
        return F.struct(anchor.alias("anchor"), (state["i"] + 1).alias("i"), starts.alias("starts"))

    return settled(pages.withColumn("starts", F.aggregate("w", start, step, lambda s: s["starts"])), "starts")


def _rows(pages: DataFrame) -> DataFrame:
    """pages with rows, an array of the words of each row."""
    row = F.transform("starts", lambda s, i: F.slice("w", s, F.coalesce(F.get("starts", i + 1), F.size("w") + 1) - s))
    return settled(pages.select(*[c for c in pages.columns if c not in ("w", "starts")], row.alias("rows")), "rows")


def numbered_rows(words: DataFrame) -> DataFrame:
    """words with row, from 1 down the page."""
    row = _rows(_pages(words)).select(*PAGE, F.posexplode("rows").alias("row", "words"))
    return row.select(*PAGE, F.col("row") + 1, F.inline("words")).toDF(*PAGE, "row", "by", "x0", "text", "x1", "top", "size", "fontname").drop("by")


def _bin(x: Column) -> Column:
    return F.bround(x / COLUMN_TOLERANCE, 0).cast("int")


def _binned(df: DataFrame, edges: Column, into: str) -> DataFrame:
    """df with the bins of an array of edges, from the left: bin, n (how many edges), x (the leftmost of them)."""
    df = settled(df.withColumn("__e", F.sort_array(F.transform(edges, lambda x: F.struct(_bin(x).alias("bin"), x.alias("x"))))), "__e")
    new = F.transform("__e", lambda e, i: F.when((i == 0) | ~F.get("__e", i - 1)["bin"].eqNullSafe(e["bin"]), i))
    df = settled(df.withColumn("__i", F.filter(new, lambda i: i.isNotNull())), "__i")
    bins = F.transform("__i", lambda s, k: F.struct(F.get("__e", s)["bin"].alias("bin"), (F.coalesce(F.get("__i", k + 1), F.size("__e")) - s).alias("n"), F.get("__e", s)["x"].alias("x")))
    return settled(df.withColumn(into, bins), into).drop("__e", "__i")


def _labelled(pages: DataFrame) -> DataFrame:
    """pages with a: the edge that recurs at which values begin behind bold labels at the margin.

    Of edges that at least two rows and 60 % as many rows as the strongest share, the leftmost counts.
    """
    least = lambda words, kept: F.array_min(F.transform(F.filter(words, kept), lambda x: x["x0"]))
    bold = lambda x: is_bold(x["fontname"])
    heads = F.transform("rows", lambda r: F.struct(least(r, bold).alias("label"), least(r, lambda x: ~bold(x)).alias("value")))
    df = settled(pages.withColumns({"__heads": heads, "__margin": F.array_min(F.transform("w", lambda x: x["x0"]))}), "__heads", "__margin")
    starts = F.filter("__heads", lambda h: (h["label"] <= F.col("__margin") + LABEL_MARGIN) & h["value"].isNotNull())
    df = _binned(df, F.transform(starts, lambda h: h["value"]), "__bins")
    df = settled(df.withColumn("__most", F.array_max(F.transform("__bins", lambda b: b["n"]))), "__most")
    strong = F.filter("__bins", lambda b: b["n"] >= F.greatest(F.lit(2.0), F.col("__most") * RECURRING))
    return df.withColumn("a", F.get(strong, F.lit(0))["x"]).drop("__heads", "__margin", "__bins", "__most")


def _edged(pages: DataFrame) -> DataFrame:
    """pages with b: the most populated left edge well right of the margin, ties to the left."""
    df = _binned(pages, F.transform("w", lambda x: x["x0"]), "__bins")
    df = settled(df.withColumns({"__margin": F.array_min(F.transform("__bins", lambda b: b["x"])), "__least": F.greatest(F.lit(LEAST_WORDS), F.floor(F.size("w") * WORD_SHARE))}), "__margin", "__least")
    able = F.filter("__bins", lambda b: (b["x"] > F.col("__margin") + COLUMN_MARGIN) & (b["n"] >= F.col("__least")))
    best = F.array_max(F.transform(able, lambda b: F.struct(b["n"].alias("n"), (-b["bin"]).alias("bin"), b["x"].alias("x"))))
    return df.withColumn("b", best["x"]).drop("__bins", "__margin", "__least")


def _with_rows(pages: DataFrame) -> DataFrame:
    """pages with rows, and w still beside them."""
    return _rows(pages.withColumn("__w", F.col("w"))).withColumnRenamed("__w", "w")


def column_of_edges(words: DataFrame) -> DataFrame:
    """doc, page, value_x by edges, of pages that have such a one."""
    return _edged(_pages(words)).select(*PAGE, F.col("b").alias("value_x")).filter("value_x is not null")


def _columned(words: DataFrame) -> DataFrame:
    """doc, page, rows, value_x: by labelled rows, else by edges, else NO_COLUMN."""
    pages = _edged(_labelled(_with_rows(_pages(words))))
    return settled(pages.select(*PAGE, "rows", F.coalesce("a", "b", F.lit(NO_COLUMN)).alias("value_x")), "value_x")


def value_columns(words: DataFrame) -> DataFrame:
    """doc, page, value_x of every page."""
    return _columned(words).select(*PAGE, "value_x")


def joined(words: Column) -> Column:
    """Text of an array of (x0, text, x1, size) sorted by x0; a gap of over a quarter of the size was a space."""
    gap = lambda x, before: x["x0"] - before["x1"] > F.greatest(F.lit(1.0), 0.25 * F.coalesce(F.nullif(before["size"], F.lit(0.0)), F.lit(FONT_SIZE)))
    spaced = F.transform(words, lambda x, i: F.concat(F.when((i > 0) & gap(x, F.get(words, i - 1)), " ").otherwise(""), x["text"]))
    return F.trim(F.array_join(spaced, ""))


def split_rows(words: DataFrame) -> DataFrame:
    """doc, page, row, label, value of each row.

    Words left of the value column are the label. Where fonts overlap on the page, the label was drawn
    through the value, and bold words are the label.
    """
    bold = lambda x: is_bold(x["fontname"])
    rows = _columned(words).select(*PAGE, "value_x", F.posexplode("rows").alias("row", "__r"))
    word = F.transform("__r", lambda x: F.struct(x["x0"].alias("x0"), x["text"].alias("text"), x["x1"].alias("x1"), x["size"].alias("size"), bold(x).alias("bold"), x["fontname"].alias("fontname")))
    rows = settled(rows.select(*PAGE, (F.col("row") + 1).alias("row"), "value_x", F.sort_array(word).alias("w")), "w")
    rows = settled(rows.withColumn("fonts", F.array_distinct(F.transform("w", lambda x: x["fontname"]))), "fonts")
    # From which place to which each font goes.
    of = lambda f, c, most: most(F.transform(F.filter("w", lambda x: x["fontname"].eqNullSafe(f)), lambda x: x[c]))
    spans = F.sort_array(F.transform("fonts", lambda f: F.struct(of(f, "x0", F.array_min).alias("a"), of(f, "x1", F.array_max).alias("b"))))
    crossed = (F.size("fonts") > 1) & F.exists("w", lambda x: x["bold"]) & F.exists("w", lambda x: ~x["bold"])
    rows = settled(rows.withColumn("s", F.when(crossed, spans)), "s")
    overlap = F.exists(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.get(F.col("s"), i)["a"] < F.get(F.col("s"), i - 1)["b"] - 0.5)
    rows = settled(rows.withColumn("by_font", F.when(F.col("s").isNotNull(), overlap).otherwise(F.lit(False))), "by_font")
    is_label = lambda x: F.when(F.col("by_font"), x["bold"]).otherwise(x["x0"] < F.col("value_x") - COLUMN_TOLERANCE)
    # Settled, as else each word would look for all words of its side again.
    parts = settled(rows.withColumns({"l": F.filter("w", is_label), "r": F.filter("w", lambda x: ~is_label(x))}), "l", "r")
    return parts.select(*PAGE, "row", joined(F.col("l")).alias("label"), joined(F.col("r")).alias("value"))


def left_edges(words: DataFrame) -> DataFrame:
    """doc, x, n: how many words begin at each whole point."""
    return words.groupBy("doc", F.bround("x0", 0).alias("x")).agg(F.count(F.lit(1)).alias("n"))
