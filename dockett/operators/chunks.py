"""Lines of a document folded into label and value chunks; candidates and the best one of each field.

A document's lines stay in its row until they are folded, so cutting and folding need no exchange and no sorting; the
candidates group by document, and one exchange by (case_id, side) serves them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import FIELDS, NUMERIC_FIELDS, PARTY_FIELDS
from ..functions.labels import resolve_key, similar_fields
from ..functions.text import basic, first_segment, is_blank, org, port, settled, snippet, split_lines, strip, with_key

DOC = ["case_id", "side"]
# Scores of candidates, and words of which two make a table header.
PARSES, TOTAL_LABEL, TABLE_HEADER, BLANK = 50.0, 15.0, -100.0, -80.0
HEADER_WORDS = ["DESCRIPTION", "GROSS WEIGHT", "NET WEIGHT", "CONTAINER NO", "MEASUREMENT", "MARKS", "SEAL NO", "PACKAGES", "UNIT PRICE", "QTY"]
LABEL = r"^([^:]{1,60}?)\s*:\s*(.*)$"
OTHER = r"(?U)^(.{1,60}?)\s*(?:[–—―|]|\t|\s{2,})\s*(\S.*)$"
RULE = r"(?U)^[\s=_\-*~#]+$"
# What OTHER cuts at, the blanks of LABEL, one of LINE_ENDS.
SEPARATOR, _BLANKS, END = r"(?U)[–—―|\t]|\s{2}", " \t\n\x0b\x0c\r", "\x1e"


def lines(docs: DataFrame) -> DataFrame:
    """case_id, side, line (from 1), raw: non-blank lines that are no decoration. docs: case_id, side, text."""
    rows = docs.select(*DOC, F.posexplode(split_lines(F.col("text"))).alias("line", "raw"))
    text = strip(F.col("raw"))
    return rows.withColumn("line", F.col("line") + 1).filter((text != "") & ~text.rlike(RULE))


def _label(text: Column) -> Column:
    """What LABEL takes for the label of a text that begins with no blank, without blanks around it; null without one."""
    before = F.substring_index(text, ":", 1)
    return F.when((F.instr(text, ":") > 1) & (F.length(F.rtrim(before, F.lit(_BLANKS))) <= 60), F.nullif(strip(before), F.lit("")))


def _marked(docs: DataFrame, fuzzy: bool, told: Callable[[Column], Column] | None = None) -> DataFrame:
    """case_id, side, rows (the lines() of each document with text, indented, colon and label) and fields, one a line.

    told is asked about each line as it stands, for rows' column of that name. Few lines have no colon, so only those are searched for other separators, if they hold one at all.
    """
    more = lambda x: [] if told is None else [x.alias("told")]
    rows = F.transform(split_lines(F.col("text")), lambda x, i: F.struct((i + 1).alias("line"), F.substring(x, 1, 1).isin(" ", "\t").alias("indented"), strip(x).alias("text"), *more(told and told(x))))
    rows = F.filter(rows, lambda r: (r["text"] != "") & ~r["text"].rlike(RULE))
    other = lambda x: F.when(x.rlike(SEPARATOR), F.nullif(strip(F.regexp_extract(x, OTHER, 1)), F.lit("")))
    rows = F.transform(rows, lambda r: F.struct(r["line"].alias("line"), r["indented"].alias("indented"), r["text"].alias("text"), _label(r["text"]).isNotNull().alias("colon"), F.coalesce(_label(r["text"]), other(r["text"])).alias("label"), *more(told and r["told"])))
    found = settled(docs.select(*DOC, rows.alias("rows")), "rows")
    keys = F.transform("rows", lambda r: basic(r["label"]))
    found = settled(found.withColumn("__a", F.transform(keys, lambda k: F.struct(k.alias("k"), resolve_key(k).alias("r")))), "__a")
    fields = F.transform("__a", lambda a: a["r"]["field"])
    if fuzzy:
        # Undecided labels go to Python, a list a document; documents without one send nothing.
        undecided = lambda a: a["r"]["step"] == 0
        found = found.withColumn("__s", similar_fields(F.when(F.exists("__a", undecided), F.transform("__a", lambda a: F.when(undecided(a), a["k"])))))
        fields = F.transform("__a", lambda a, i: F.coalesce(a["r"]["field"], F.get("__s", i)))
    return settled(found.select(*DOC, "rows", fields.alias("fields")), "fields")


def _starts(row: Column, field: Column) -> Column:
    """A line with a colon, or with another separator behind a wording that resolves, starts a chunk; an indented one only
    if its label resolves."""
    return F.when(row["colon"], ~row["indented"] | field.isNotNull()).otherwise(row["label"].isNotNull() & field.isNotNull())


def marked(docs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """The lines of docs with text, label (by a colon or another separator), field and starts."""
    field = lambda i: F.get("fields", i)
    rows = F.transform("rows", lambda r, i: F.struct(r["line"].alias("line"), r["text"].alias("text"), r["label"].alias("label"), field(i).alias("field"), _starts(r, field(i)).alias("starts")))
    return settled(_marked(docs, fuzzy).select(*DOC, rows.alias("rows")), "rows").select(*DOC, F.inline("rows"))


def told_lines(docs: DataFrame, told: Callable[[Column], Column], fuzzy: bool = True) -> DataFrame:
    """told (not null), attached: of the lines that told says something of, whether they start a chunk that the very next
    line continues. Blank lines and decorations continue nothing."""
    field = lambda i: F.get("fields", i)
    rows = F.transform("rows", lambda r, i: F.struct(r["line"].alias("line"), r["told"].alias("told"), _starts(r, field(i)).alias("starts")))
    marked = settled(_marked(docs, fuzzy, told).select(*DOC, rows.alias("rows")), "rows")
    # A last line has none after it, and one with a gap after it is not attached either.
    after = lambda r, i: F.coalesce((F.get("rows", i + 1)["line"] == r["line"] + 1) & ~F.get("rows", i + 1)["starts"], F.lit(False))
    own = F.transform("rows", lambda r, i: F.when(r["told"].isNotNull(), F.struct(r["told"].alias("told"), (r["starts"] & after(r, i)).alias("attached"))))
    return marked.select(F.inline(F.filter(own, lambda x: x.isNotNull())))


def chunks(docs: DataFrame, fuzzy: bool = True) -> DataFrame:
    """case_id, side, line, label, value, field, chunk_ord (from 0).

    Lines that start no chunk continue the one above; those before any are dropped.
    """
    starts = lambda r, i: _starts(r, F.get("fields", i))
    own = lambda r: F.when(r["colon"], F.substring(r["text"], F.instr(r["text"], ":") + 1, F.length(r["text"]))).otherwise(F.regexp_extract(r["text"], OTHER, 2))
    # Values are joined and cut at their starts: END ends lines, so no value holds one.
    part = lambda r, i: F.when(starts(r, i), F.concat(F.lit(END), strip(own(r)))).otherwise(F.concat(F.lit("\n"), r["text"]))
    first = F.filter(F.transform("rows", lambda r, i: F.when(starts(r, i), F.struct(r["line"].alias("line"), r["label"].alias("label"), F.get("fields", i).alias("field")))), lambda r: r.isNotNull())
    cut = _marked(docs, fuzzy).select(*DOC, first.alias("__first"), F.split(F.array_join(F.transform("rows", part), ""), END).alias("__values"))
    # Settled, as else each chunk would cut the values again.
    cut = settled(cut, "__first", "__values")
    folded = F.transform("__first", lambda r, i: F.struct(r["line"].alias("line"), r["label"].alias("label"), strip(F.get("__values", i + 1)).alias("value"), r["field"].alias("field"), i.alias("chunk_ord")))
    return settled(cut.select(*DOC, folded.alias("__chunks")), "__chunks").select(*DOC, F.inline("__chunks"))


def parses(field: Column, key: Column, number: Column) -> Column:
    return F.when(field.isin(NUMERIC_FIELDS), number.isNotNull()).otherwise(F.coalesce(key.rlike("[A-Z]"), F.lit(False)))


def table_header(raw: Column) -> Column:
    k = basic(raw)
    total = F.lit(0)
    for word in HEADER_WORDS:
        total = total + F.contains(k, F.lit(word)).cast("int")
    return total >= 2


def candidates(chunks: DataFrame) -> DataFrame:
    """Chunks that resolve to a field, with raw, key, number, blank, parsed, score and rank (1 wins).

    The winner's label, line and score stand beside every candidate.
    """
    field, raw = F.col("field"), F.col("raw")
    read = chunks.filter(field.isin(FIELDS)).withColumn("raw", first_segment(F.col("value")))
    read = with_key(read, "field", "raw", "raw").withColumnsRenamed({"raw_key": "key", "raw_number": "number", "raw_empty": "blank"})
    read = read.withColumn("parsed", parses(field, F.col("key"), F.col("number")))
    total = (field == "gross_weight_kg") & basic(F.col("label")).rlike(r"\bTOTAL\b")
    add = lambda cond, points: F.when(cond, points).otherwise(0.0)
    score = add(F.col("parsed"), PARSES) + add(total, TOTAL_LABEL) + add(table_header(raw), TABLE_HEADER) + add(F.col("blank"), BLANK)
    best = W.partitionBy(*DOC, "field").orderBy(F.desc("score"), "chunk_ord")
    return read.withColumn("score", score).withColumns({"rank": F.row_number().over(best), "won_label": F.first("label").over(best), "won_line": F.first("line").over(best), "won_score": F.first("score").over(best)})


def field_values(candidates: DataFrame) -> DataFrame:
    """case_id, side, field, raw, key, number, present, blank, label, line, snippet of each winner."""
    text = F.when(strip(F.col("value")) != "", F.concat("label", F.lit(": "), "value")).otherwise(F.concat("label", F.lit(":")))
    return candidates.filter("rank = 1").select(*DOC, "field", "raw", "key", "number", (F.col("parsed") & ~F.col("blank")).alias("present"), "blank", "label", "line", snippet(text).alias("snippet"))


def _types(df: DataFrame, names: tuple[str, ...]) -> str:
    return ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in names)


def paired(values: DataFrame, cases: DataFrame) -> DataFrame:
    """Seven rows a case: the columns of cases, field, field_ord and both sides' raw, key, number, blank, present, line and
    snippet.

    A case's values are gathered into one row, so they meet the case in one join by case_id.
    """
    names = ("raw", "key", "number", "blank", "present", "line", "snippet")
    # One list a case: an aggregate for each field and side would copy all of them with every value.
    wide = values.groupBy("case_id").agg(F.collect_list(F.struct("field", "side", F.struct(*names).alias("d"))).alias("__all"))
    of = lambda f, s: F.array_max(F.filter("__all", lambda x: (x["field"] == f) & (x["side"] == s)))["d"]
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_ord"), of(f, "SI").alias("si"), of(f, "BL").alias("bl")) for i, f in enumerate(FIELDS, 1)])
    out = [F.col(f"d.{s}.{c}").alias(f"{s}_{c}") for s in ("si", "bl") for c in names]
    joined = cases.join(wide.select("case_id", rows.alias("__rows")), "case_id", "left")
    # A case without any value has its seven rows too.
    none = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_ord"), *[F.lit(None).cast(f"struct<{_types(values, names)}>").alias(s) for s in ("si", "bl")]) for i, f in enumerate(FIELDS, 1)])
    joined = settled(joined.withColumn("__rows", F.coalesce("__rows", none)), "__rows")
    return joined.select(*cases.columns, F.explode("__rows").alias("d")).select(*cases.columns, "d.field", "d.field_ord", *out)


def both_texts(docs: DataFrame) -> DataFrame:
    """case_id, si_text, bl_text: the texts of a case's two sides in one row. docs: case_id, side, text."""
    return docs.groupBy("case_id").agg(F.max(F.when(F.col("side") == "SI", F.col("text"))).alias("si_text"), F.max(F.when(F.col("side") == "BL", F.col("text"))).alias("bl_text"))


def repaired(pairs: DataFrame) -> DataFrame:
    """pairs (with si_text and bl_text) with wrapped party and port values completed from the next line of their own document.

    Only where one side's key is a token-prefix of the other's, the line after the value (within 200
    characters of text) completes it to exactly the other's key. Adds si_wrapped and bl_wrapped.
    """
    field = F.col("field")
    out = pairs
    for own, other in (("si", "bl"), ("bl", "si")):
        raw, text, line = F.col(f"{own}_raw"), F.col(f"{own}_text"), F.col(f"{own}_line")
        able = field.isin(FIELDS[:5]) & (raw != "") & F.startswith(F.col(f"{other}_key"), F.concat(F.col(f"{own}_key"), F.lit(" ")))
        # From the value's own line on, else from the start. Only few values can be completed; only theirs is looked for.
        rows = F.split(text, "\n")
        rest = F.when(line.isNull(), text).otherwise(F.array_join(F.slice(rows, F.least(line, F.size(rows)), F.size(rows)), "\n"))
        out = out.withColumn("__rest", F.when(able, rest)).withColumn("__at", F.call_function("locate", raw, F.col("__rest")))
        tail = F.substring("__rest", F.col("__at") + F.length(raw), F.lit(200))
        following = F.try_element_at(F.filter(F.transform(F.split(tail, r"[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), strip), lambda x: x != ""), F.lit(1))
        whole = F.when((F.col("__at") > 0) & F.substring(tail, 1, 1).rlike(r"(?U)^\s"), F.concat(raw, F.lit(" "), following))
        out = settled(out.withColumn(f"__{own}_whole", whole).drop("__rest", "__at"), f"__{own}_whole")
        text = F.col(f"__{own}_whole")
        key = F.when(text.isNotNull() & ~is_blank(text), F.when(field.isin(PARTY_FIELDS), org(text)).otherwise(port(text)))
        out = settled(out.withColumn(f"{own}_wrapped", F.coalesce(key == F.col(f"{other}_key"), F.lit(False))), f"{own}_wrapped")
    then = lambda s, new, old: F.when(F.col(f"{s}_wrapped"), F.col(new)).otherwise(F.col(old))
    # Both at once: neither key starts the other's and is started by it.
    out = out.withColumns({f"{s}_{c}": then(s, new, f"{s}_{c}") for s, o in (("si", "bl"), ("bl", "si")) for c, new in (("raw", f"__{s}_whole"), ("key", f"{o}_key"))})
    return out.drop("__si_whole", "__bl_whole")
