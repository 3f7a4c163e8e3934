"""Text normalisation as Column expressions: values are compared by equality of these forms only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import NUMERIC_FIELDS, PARTY_FIELDS, PORT_FIELDS

# Words that stand for no value, legal forms of companies, words that decorate a port.
BLANK_WORDS = ["", "-", "--", "N/A", "NA", "NIL", "NONE", "NULL", "TBA", "TBC", "TBD", "TO BE ADVISED", "TO BE CONFIRMED", "PENDING", "???", "?", "XXX", "XXXX"]
LEGAL_FORMS = [
    "PTE", "PTY", "LTD", "LTDA", "LIMITED", "LLC", "LLP", "PLC", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "GMBH", "AG", "SA", "SAS", "SARL", "SRL", "SPA", "NV",
    "BV", "AB", "AS", "OY", "SDN", "BHD", "FZE", "FZC", "FZ", "DMCC", "JLT", "WLL", "UAB", "OOO", "ZAO", "PT", "TBK", "JSC", "JOINT", "STOCK", "PVT", "PRIVATE", "GROUP", "HOLDINGS", "HOLDING",
]
PORT_NOISE = ["PORT", "OF", "SEAPORT", "TERMINAL"]
# Units and characters that stand for no value, ends of lines, patterns of port codes, figures, container sizes and weight units.
BLANK_UNITS = ["MT", "MTS", "KG", "KGS", "TON", "TONS"]
_PLACEHOLDERS = " \t\n\x0b\x0c\r_?-.*"
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
LOCODE = r"\(\s*([A-Z]{2}[A-Z0-9]{3})\s*\)"
NUMBER = r"[-+]?\d[\d,\s]*(?:\.\d+)?"
SIZE = r"(?:(?:20|40|45)\s*(?:'|’|FT)?\s*(?:GP|HC|HQ|DV|DC|RF|RH|OT|FR|TK|SD|SH|ST|STD|FCL|NOR)\b|(?:20|40|45)\s*(?:'|’)|[24L][0-9A-Z][A-Z]\d\b)"
NUMBER_WORDS = ["ONE", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "NINE", "TEN", "ELEVEN", "TWELVE"]
WEIGHT_UNIT = r"(?i)\b(KGS?|KILOS?|KILOGRAMS?|MTS?|TONS?|TONNES?)\b"
UNIT_TAIL = r"\s*(?:CONTAINERS?|CNTRS?|CTRS?)?\s*$"


# What basic() keeps, one by one: Java looks such characters up in a table, but tries ranges one after another.
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
# Every character that counts as white space.
_WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(s: Column) -> Column:
    return F.btrim(s, F.lit(_WHITE))


def split_lines(s: Column, ends: str = LINE_ENDS) -> Column:
    """The lines of a text, of which null has one, empty. Any of ends, or a line feed behind a carriage return, ends a line.

    Other ends become line feeds first: few texts hold one, and Java splits at a single character without a pattern.
    """
    one = F.replace(F.coalesce(s, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    for end in ends:
        one = one if end == "\n" else F.replace(one, F.lit(end), F.lit("\n"))
    return F.split(one, "\n")


def basic(s: Column) -> Column:
    """Upper case, & as AND, all but A-Z and 0-9 as single spaces; empty for null."""
    return F.coalesce(F.trim(F.regexp_replace(F.replace(F.upper(s), F.lit("&"), F.lit(" AND ")), f"[^{PLAIN}]+", " ")), F.lit(""))


def is_blank(s: Column) -> Column:
    """Null, a word that stands for no value, or nothing but placeholder characters around a unit of weight.

    A text consists of some characters alone if nothing is left when they are trimmed off, which costs no more than a
    look at its ends. No text with a digit is blank, which settles most of them at once.
    """
    t = strip(s)
    unit = F.ltrim(F.rtrim(t, F.lit(_PLACEHOLDERS)), F.lit(_PLACEHOLDERS + "xX"))
    blank = F.upper(t).isin(BLANK_WORDS) | F.upper(unit).isin(["", *BLANK_UNITS]) | (F.btrim(t, F.lit(_WHITE + "_?-.*/")) == "")
    return F.when(s.isNull(), True).when(s.rlike("[0-9]"), False).otherwise(blank)


def first_segment(s: Column) -> Column:
    """The first line, up to a bar, without surrounding blanks, commas and semicolons; empty for null."""
    head = strip(F.coalesce(s, F.lit("")))
    for end in "|" + LINE_ENDS:
        head = F.substring_index(head, end, 1)
    return F.btrim(head, F.lit(" \t;,"))


def without(tokens: Column, words: list[str]) -> Column:
    """Space-separated A-Z0-9 tokens without those words."""
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), tokens), " (?:" + "|".join(words) + ")(?![A-Z0-9])", ""))


def org(s: Column) -> Column:
    """A company's name without legal forms, or with them if nothing else is left."""
    name = basic(first_segment(s))
    kept = without(name, LEGAL_FORMS)
    return F.when(kept == "", name).otherwise(kept)


def locode(s: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(s), LOCODE, 1), F.lit(""))


def port(s: Column) -> Column:
    """A port's name without codes and decorating words; may be empty."""
    return without(basic(F.regexp_replace(F.upper(first_segment(s)), LOCODE, " ")), PORT_NOISE)


def ports_equal(a: Column, b: Column) -> Column:
    same = port(a) == port(b)
    return (same & (port(a) != "")) | (same & F.coalesce(locode(a) == locode(b), F.lit(False)))


def first_number(s: Column) -> Column:
    return F.regexp_substr(s, F.lit(NUMBER)).try_cast("string")


def to_double(token: Column) -> Column:
    return F.translate(token, ", ", "").try_cast("double")


def digits_contaminated(s: Column) -> Column:
    """The first number touches a letter that is taken for a digit, on either side."""
    return F.coalesce(s.rlike(r"^\D*[OIlSB][-+]?\d") | s.rlike(r"^\D*+\d[\d,\s]*+(?:\.\d+)?+[OIlSB]"), F.lit(False))


def _readable(s: Column) -> Column:
    return ~is_blank(s) & ~digits_contaminated(s)


def _count(s: Column, readable: Column, number: Column) -> Column:
    """Containers from a first segment: size first or a number word as the whole value, else the number."""
    size_first = F.regexp_extract(s, rf"(?i)^\s*{SIZE}\s*[X×*]\s*(\d{{1,3}})\s*$", 1)
    word = F.upper(F.regexp_extract(s, rf"(?i)^\s*({'|'.join(NUMBER_WORDS)})\s*[X×*]\s*{SIZE}{UNIT_TAIL}", 1))
    words = F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), word)
    n = F.bround(number, 0)
    plain = F.when((n > 0) & (n < 100000), n.cast("bigint"))
    read = F.when(size_first != "", F.nullif(size_first.try_cast("bigint"), F.lit(0).cast("bigint"))).when(word != "", words).otherwise(plain)
    return F.when(readable, read)


def _weight(s: Column, readable: Column, number: Column) -> Column:
    """Kilograms from a first segment; tonnes are converted, pounds are not."""
    unit = F.upper(F.regexp_extract(s, WEIGHT_UNIT, 1))
    kg = F.when(unit.startswith("MT") | unit.startswith("TON"), number * 1000.0).otherwise(number)
    return F.when(readable & (kg > 0), kg)


def container_count(value: Column) -> Column:
    """Containers as bigint, or null."""
    s = first_segment(value)
    return F.when(value.isNotNull(), _count(s, _readable(s), to_double(first_number(s))))


def gross_weight(value: Column) -> Column:
    """Kilograms as double, or null."""
    s = first_segment(value)
    return F.when(value.isNotNull(), _weight(s, _readable(s), to_double(first_number(s))))


def count_well_formed(value: Column) -> Column:
    """A typed count that is wholly one of the readable shapes; blank is well-formed."""
    s = strip(first_segment(value))
    shapes = [
        rf"(?i)^\s*(?:TOTAL\s+)?\d{{1,3}}(?:\.\d+)?{UNIT_TAIL}",
        rf"(?i)^\s*\d{{1,3}}(?:\.\d+)?\s*[X×*]\s*{SIZE}{UNIT_TAIL}",
        rf"(?i)^\s*{SIZE}\s*[X×*]\s*(\d{{1,3}})\s*$",
        rf"(?i)^\s*({'|'.join(NUMBER_WORDS)})\s*[X×*]\s*{SIZE}{UNIT_TAIL}",
    ]
    found = is_blank(s)
    for shape in shapes:
        found = found | s.rlike(shape)
    return found


def weight_well_formed(value: Column) -> Column:
    s = strip(first_segment(value))
    return is_blank(s) | s.rlike(r"(?i)^\s*[\d,\s]*\d(?:\.\d+)?\s*(?:KGS?|KILOS?|KILOGRAMS?|MTS?|TONS?|TONNES?|LBS?)?\s*$")


def number_of(field: Column, value: Column) -> Column:
    return F.when(field == "container_count", container_count(value).cast("double")).when(field == "gross_weight_kg", gross_weight(value))


def key_of(field: Column, value: Column) -> Column:
    """The canonical text that decides equality, or null if the value cannot be read."""
    text = (
        F.when(field.isin(PARTY_FIELDS), org(value))
        .when(field.isin(PORT_FIELDS), port(value))
        .when(field == "container_count", container_count(value).cast("string"))
        .when(field == "gross_weight_kg", F.bround(gross_weight(value), 0).cast("bigint").cast("string"))
        .otherwise(basic(value))
    )
    return F.when(~is_blank(value), F.nullif(text, F.lit("")))


def settled(df: DataFrame, *made: str) -> DataFrame:
    """df with those columns computed once, where they stand.

    They pass through a generator of one row, which the optimizer neither merges with later projections nor
    moves filters through; without it, each use of a long expression would repeat all of it.
    """
    rest = [c for c in df.columns if c not in made]
    return df.select(*[F.col(f"`{c}`") for c in rest], F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in made]))))


def with_key(df: DataFrame, field: str, raw: str, into: str) -> DataFrame:
    """df with <into>_key, <into>_number and <into>_empty: key_of, number_of and is_blank of a raw column.

    Made step by step, each form once: in one expression the shared parts would be repeated in every branch. Each step
    is settled, as the JVM compiles no method of more than 8,000 bytes, and what it does not compile runs many times slower.
    """
    f, r, s = F.col(field), F.col(raw), F.col("__s")
    number = f.isin(NUMERIC_FIELDS)
    step = lambda out, made: settled(out.withColumns(made), *made)
    out = step(df, {"__s": first_segment(r), "__blank": is_blank(r)})
    out = step(out, {"__b": basic(F.when(f.isin(PORT_FIELDS), F.regexp_replace(F.upper(s), LOCODE, " ")).when(~number, s)), "__n": F.when(number, to_double(first_number(s)))})
    out = step(out, {"__ok": number & ~F.col("__blank") & _readable(s), "__kept": F.when(f.isin(PARTY_FIELDS), without(F.col("__b"), LEGAL_FORMS)).when(f.isin(PORT_FIELDS), without(F.col("__b"), PORT_NOISE))})
    out = step(out, {"__count": F.when(f == "container_count", _count(s, F.col("__ok"), F.col("__n"))), "__kg": F.when(f == "gross_weight_kg", _weight(s, F.col("__ok"), F.col("__n")))})
    text = (
        F.when(f.isin(PARTY_FIELDS), F.when(F.col("__kept") == "", F.col("__b")).otherwise(F.col("__kept")))
        .when(f.isin(PORT_FIELDS), F.col("__kept"))
        .when(f == "container_count", F.col("__count").cast("string"))
        .when(f == "gross_weight_kg", F.bround("__kg", 0).cast("bigint").cast("string"))
        .otherwise(F.col("__b"))
    )
    out = step(out, {f"{into}_key": F.when(~F.col("__blank"), F.nullif(text, F.lit(""))), f"{into}_number": F.coalesce("__kg", F.col("__count").cast("double")), f"{into}_empty": F.col("__blank")})
    return out.drop("__s", "__blank", "__b", "__ok", "__n", "__kept", "__count", "__kg")


def squash(s: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " ")))


def snippet(s: Column, most: int = 120) -> Column:
    flat = F.trim(F.regexp_replace(s, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 3)), F.lit("..."))).otherwise(flat)


def numbers_in(text: Column) -> Column:
    """All figures of a text as doubles, digit groups closed up; those before a tonne unit also times 1000."""
    joined = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?<=\d)[ \t]+(?=\d)", "")
    plain = F.transform(F.regexp_extract_all(joined, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), 1), to_double)
    tonnes = F.transform(F.regexp_extract_all(joined, F.lit(r"(?i)(\d[\d,]*+(?:\.\d+)?+)(?=\W{0,3}(?:MT|MTS|TON|TONS|TONNE|TONNES)\b)"), 1), lambda x: to_double(x) * 1000.0)
    return F.filter(F.array_union(plain, tonnes), lambda x: x.isNotNull())


def domain(sender: Column) -> Column:
    """A sender's domain in lower case, the whole address without @, or 'unknown'."""
    s = F.btrim(strip(F.coalesce(sender, F.lit(""))), F.lit("<>"))
    return F.when(F.contains(s, F.lit("@")), F.lower(F.substring_index(s, "@", -1))).otherwise(F.coalesce(F.nullif(F.lower(s), F.lit("")), F.lit("unknown")))


def looks_like_label(s: Column) -> Column:
    t = strip(s)
    return (t != "") & (F.length(t) <= 70) & t.rlike("[A-Za-z]")
