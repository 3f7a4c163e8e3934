"""Around a model that is asked from outside: what it is shown, which answers are taken, and what is remembered.

No call is made here. Answers come as a table, whether just given or remembered by the key of their question; a case
without one keeps what the rules say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import CATEGORIES, FIELDS, NUMERIC_FIELDS
from ..functions.text import basic, first_segment, is_blank, settled, snippet, split_lines, strip, with_key
from .chunks import DOC, parses
from .classify import BANNER, QUOTE, SIGNOFF, should_escalate

# Characters of a mail and of a reason that count, the most confidence that an answer gets, the version of keys.
MAX_BODY, MAX_REASON, MAX_CONFIDENCE, KEY_VERSION = 1200, 300, 0.9, "1"
TRUNCATED = "\n[...truncated]"
# Where a forwarded or quoted tail starts, besides the marks of the scorer.
FORWARDED = (
    r"^[ \t]*-{2,}[ \t]*(?:Original Message|Forwarded message)\b"
    r"|^[ \t]*From[ \t]*:[ \t]*\S[^\n]*\n(?:[^\n]*\n){0,2}?[ \t]*(?:Sent|Date|To|Cc|Subject)[ \t]*:[ \t]*\S"
    r"|^[ \t]*>[^\n]*\n[ \t]*>"
)


def visible_body(body: Column) -> Column:
    """The sender's own words as they were written: without banner, quoted or forwarded tail and signature, runs of empty
    lines closed up, and cut at a line's end if long."""
    text = F.regexp_replace(F.coalesce(body, F.lit("")), BANNER, "")
    text = F.split(text, f"{QUOTE}|(?im:{FORWARDED})", 2)[0]
    text = strip(F.regexp_replace(F.split(text, SIGNOFF, 2)[0], r"\n{3,}", "\n\n"))
    head = F.substring(text, 1, MAX_BODY)
    whole = F.regexp_extract(head, r"(?s)^(.*)\n", 1)
    kept = F.when(F.length(whole) > MAX_BODY // 2, whole).otherwise(head)
    return F.when(F.length(text) > MAX_BODY, F.concat(F.regexp_replace(kept, r"(?U)\s+\z", ""), F.lit(TRUNCATED))).otherwise(text)


def clamped(confidence: Column) -> Column:
    """A claimed confidence as a number from 0 to MAX_CONFIDENCE; what is none counts as 0."""
    n = F.nanvl(confidence.try_cast("double"), F.lit(0.0))
    return F.coalesce(F.least(F.lit(MAX_CONFIDENCE), F.greatest(F.lit(0.0), n)), F.lit(0.0))


def cache_key(model: Column, purpose: Column, payload: Column) -> Column:
    """SHA-256 of a question as JSON with sorted keys. payload: a map of strings, in any order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(payload)))
    return F.sha2(F.to_json(F.struct(model.alias("model"), ordered.alias("payload"), purpose.alias("purpose"), F.lit(KEY_VERSION).alias("v"))), 256)


def remembered(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """questions (with key) with answer and hit; of answers that share a key the last one (by at) counts. cache: key, at,
    answer."""
    last = cache.groupBy("key").agg(F.max_by("answer", "at").alias("answer"))
    return questions.join(last, "key", "left").withColumn("hit", F.col("answer").isNotNull())


def adopted_categories(ruled: DataFrame, verdicts: DataFrame) -> DataFrame:
    """ruled (email_id, subject, body, category, confidence, needs_model, rationale) with decided_by, where an answer to
    a doubtful mail replaces category and confidence, and rationale says what was done. verdicts: email_id,
    said_category, said_confidence, said_reason."""
    doubtful = should_escalate(F.col("needs_model"), F.col("confidence"), F.lit("rule"))
    empty = is_blank(F.coalesce("subject", F.lit(""))) & is_blank(F.coalesce("body", F.lit("")))
    said = F.col("said_category")
    both = ruled.join(verdicts, "email_id", "left").withColumn("__adopt", doubtful & ~empty & F.coalesce(said.isin(CATEGORIES), F.lit(False)))
    adopt = F.col("__adopt")
    reason = F.substring(F.trim(F.regexp_replace(strip(F.coalesce("said_reason", F.lit(""))), r"(?U)\s+", " ")), 1, MAX_REASON)
    agreed = F.when(said == F.col("category"), "llm.agreed").otherwise(F.concat(F.lit("llm.overrode:"), "category"))
    why = F.concat_ws(",", F.concat(F.lit("llm.rule_said:"), "category"), F.concat(F.lit("llm.category:"), said), agreed, F.concat(F.lit("llm.reason:"), F.when(reason == "", "(none given)").otherwise(reason)))
    note = (
        F.when(~doubtful, F.lit(None)).when(empty, "llm.skipped:empty-email").when(said.isNull(), "llm.unavailable:no-client")
        .when(adopt, why).otherwise(F.concat(F.lit("llm.rejected:unknown-category:"), said))
    )
    return both.select(
        "email_id", F.when(adopt, said).otherwise(F.col("category")).alias("category"), F.when(adopt, clamped(F.col("said_confidence"))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(adopt, "llm").otherwise("rule").alias("decided_by"), (F.col("needs_model") & ~adopt).alias("needs_model"), F.concat_ws(",", "rationale", note).alias("rationale"),
    )


def missing_fields(values: DataFrame, docs: DataFrame) -> DataFrame:
    """case_id, side, field, field_ord of fields for which a document prints nothing that was read: no raw value at all,
    which is less than blank. docs: case_id, side; values: case_id, side, field, raw."""
    dim = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_ord")) for i, f in enumerate(FIELDS, 1)])).alias("d")
    return docs.select(*DOC, dim).select(*DOC, "d.*").join(values.filter("raw is not null").select(*DOC, "field"), [*DOC, "field"], "left_anti")


def _quoted(needle: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(needle, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def span_pattern(field: Column, needle: Column) -> Column:
    """A pattern that finds a needle as the value of a line or cell; group 1 is what stands before it.

    A party or port must run to the end or to a bar; a figure must be the first one behind the label and no part
    of a longer one.
    """
    words = F.concat(F.lit(r"(?isu)^(.*?)(?<![\p{L}\p{N}])"), _quoted(needle), F.lit(r"(?![\p{L}\p{N}])[^\p{L}\p{N}|]*(?:\||\z)"))
    figure = F.concat(F.lit(r"(?isu)^((?:.*?:)??[^:\p{Nd}]*?)(?<![\p{Nd},.])"), _quoted(needle), F.lit(r"(?![\p{Nd},.])"))
    return F.when(field.isin(NUMERIC_FIELDS), figure).otherwise(words)


def located(asked: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """asked (case_id, side, ord, field, raw, claim) with locator, label and snippet of the place that holds raw.

    Chunks come before lines of the text, but a place whose printed label is the claimed one before any
    other; answers that stand nowhere are left out. chunks: case_id, side, line, label, value, chunk_ord.
    """
    claimed = basic(F.col("claim"))
    needle = span_pattern(F.col("field"), F.col("raw"))
    at = lambda hay: F.regexp_like(hay, needle)
    segment = first_segment(F.col("value"))
    shown = F.when(strip(F.col("value")) != "", F.concat("c_label", F.lit(": "), "value")).otherwise(F.concat("c_label", F.lit(":")))
    by_chunk = asked.join(chunks.select(*DOC, "line", F.col("label").alias("c_label"), "value", "chunk_ord"), DOC).filter(at(segment))
    by_chunk = by_chunk.select(*asked.columns, F.lit(1).alias("pass"), F.col("chunk_ord").alias("place"), F.concat(F.lit("line "), F.col("line").cast("string")).alias("locator"), F.col("c_label").alias("label"), snippet(shown).alias("snippet"))
    lines = docs.select(*DOC, F.posexplode(split_lines(F.col("text"))).alias("place", "hay"))
    printed = strip(F.rtrim(strip(F.regexp_replace("hay", F.concat(needle, F.lit("(?s:.*)")), "$1")), F.lit(":")))
    by_line = asked.join(lines, DOC).filter(at(F.col("hay"))).select(*asked.columns, F.lit(2).alias("pass"), "place", F.concat(F.lit("line "), (F.col("place") + 1).cast("string")).alias("locator"), printed.alias("label"), snippet(F.col("hay")).alias("snippet"))
    best = W.partitionBy(*DOC, "ord").orderBy(F.desc("hit"), "pass", "place")
    every = by_chunk.unionByName(by_line).withColumn("hit", (claimed != "") & (basic(F.col("label")) == claimed))
    return every.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n", "hit", "pass", "place")


def adopted_values(answers: DataFrame, missing: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """case_id, side, field, raw, key, number, locator, label, snippet, extractor of the answers that are taken.

    Only fields that the rules left without a value are filled, and only by a value that can be used and stands in
    the document; of several such answers for a field the first counts. answers: case_id, side, ord, field, value,
    label.
    """
    raw = strip(first_segment(F.col("value")))
    wanted = answers.join(missing.select(*DOC, "field"), [*DOC, "field"], "left_semi")
    read = with_key(wanted.select(*DOC, "ord", "field", raw.alias("raw"), F.coalesce("label", F.lit("")).alias("claim")), "field", "raw", "raw")
    usable = read.filter((F.col("raw") != "") & ~F.col("raw_empty") & parses(F.col("field"), F.col("raw_key"), F.col("raw_number")))
    found = located(usable.select(*DOC, "ord", "field", "raw", "claim", "raw_key", "raw_number"), chunks, docs)
    first = found.withColumn("n", F.row_number().over(W.partitionBy(*DOC, "field").orderBy("ord"))).filter("n = 1")
    return first.select(*DOC, "field", "raw", F.col("raw_key").alias("key"), F.col("raw_number").alias("number"), "locator", "label", "snippet", F.lit("llm").alias("extractor"))


def filled(values: DataFrame, adopted: DataFrame) -> DataFrame:
    """values (case_id, side, field, raw) with extractor, and adopted ones beside them; what the rules read always wins."""
    ruled = values.filter("raw is not null").select(*DOC, "field", "raw", F.lit("rule").alias("extractor"))
    return ruled.unionByName(adopted.select(*DOC, "field", "raw", "extractor").join(ruled, [*DOC, "field"], "left_anti"))


# Words that claim an outcome, that deny, that greet, and that ask for something; phrases that claim.
CLAIM_WORDS = [
    "verified", "verify", "confirmed", "approved", "approve", "released", "cleared", "accepted", "matched", "matches", "correct", "accurate", "resolved", "fixed", "finalised",
    "finalized", "guarantee", "guaranteed", "agree", "agrees", "agreed", "fine", "discrepancy", "discrepancies", "mismatch", "mismatches", "wrong", "issued", "shipped", "sail", "sails",
]
NEGATIONS = ["not", "no", "nothing", "none", "never", "unable", "cannot", "can't", "couldn't", "wasn't", "weren't", "isn't", "aren't", "haven't", "hasn't", "without"]
SALUTATIONS = ["hello", "hi", "dear", "regards", "sincerely", "cheers"]
REQUEST_WORDS = ["send", "resend", "re-send", "provide", "confirm", "attach", "pay", "payment", "invoice", "sign", "submit", "password", "upload", "forward"]
CLAIM_PHRASES = [
    r"\bin order\b(?!\s+to\b)", r"\ball good\b", r"\bno (issues?|problems?)\b", r"\ball (the )?fields\b", r"\ball set\b", r"\bchecks? out\b", r"\bsigned off\b",
    r"\bgood to go\b", r"\bnothing wrong\b", r"\bno (discrepanc(y|ies)|mismatch(es)?)\b", r"\bon (schedule|time)\b",
]
# How much longer than its template a wording may be, and the length that is always allowed.
GROWTH, FLOOR = 2.0, 160
WORD = r"([A-Za-z][A-Za-z'’-]*)([^A-Za-z]*)"


def with_refusal(df: DataFrame, text: str, template: str, into: str) -> DataFrame:
    """df with why a courtesy line that was worded anew (a column) may not stand for its template, or null if it may.

    Word lists are made once a row, in steps, as later ones look at them word by word.
    """
    listed = lambda s, i: F.regexp_extract_all(s, F.lit(WORD), F.lit(i))
    kept = lambda a: F.filter(a, lambda w: w.isNotNull())
    first = lambda a: F.try_element_at(a, F.lit(1))
    t, own, gaps, words, known = (F.col(f"__{c}") for c in ("t", "own", "gaps", "words", "known"))
    steps = df.withColumn("__t", F.trim(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")))
    low, template_low = F.replace(F.lower(t), F.lit("’"), F.lit("'")), F.lower(template)
    made = {"__own": listed(t, 1), "__gaps": listed(t, 2), "__words": listed(low, 1), "__known": F.transform(listed(F.col(template), 1), F.lower), "__printed": listed(F.col(template), 1)}
    steps = settled(steps.withColumns(made), "__t", *made)
    inside = kept(F.transform(own, lambda w, i: F.when((i > 0) & ~F.coalesce(F.substring(F.get(gaps, i - 1), 1, 3), F.lit("")).rlike(r"(?U)^\s*[.!?…]"), w)))
    among = lambda w, table: w.isin(table) & ~F.array_contains(known, w)
    denied = lambda i: F.arrays_overlap(F.slice(words, F.greatest(F.lit(1), i - 2), F.least(i, F.lit(3))), F.array(*map(F.lit, NEGATIONS)))
    made = {
        "__names": F.array_except(F.filter(inside, lambda w: w.rlike("^[A-Z]") & ~w.rlike("^I(['’](m|ll|d|ve))?$")), F.col("__printed")),
        "__claims": kept(F.transform(words, lambda w, i: F.when(among(w, CLAIM_WORDS) & ~F.when(i > 0, denied(i)).otherwise(F.lit(False)), w))),
        "__greeted": F.filter(words, lambda w: among(w, SALUTATIONS)), "__asked": F.filter(words, lambda w: among(w, REQUEST_WORDS)),
    }
    steps = settled(steps.withColumns(made), *made)
    names, claims, greeted, asked = (F.col(c) for c in made)
    why = (
        F.when(t == "", "the rewrite was empty")
        .when(F.length(t) > F.greatest(F.lit(FLOOR), F.floor(F.length(template) * GROWTH)), "the rewrite was much longer than the template")
        .when(t.rlike(r"\p{Nd}"), "the rewrite contained a number")
        .when(t.rlike(r"\b[A-Z]{3,}\b"), "the rewrite contained an all-capitals word, which reads as a name or a code")
        .when(t.rlike("[\"“”«»]"), "the rewrite quoted something")
        .when(t.rlike(r"(?i)@|https?://|www\."), "the rewrite contained an address or a link")
        .when(F.size(names) > 0, F.concat(F.lit("the rewrite introduced a name the template did not have ("), F.array_min(names), F.lit(")")))
        .when(F.size(claims) > 0, F.concat(F.lit("the rewrite claimed an outcome ("), first(claims), F.lit(")")))
    )
    for p in CLAIM_PHRASES:
        why = why.when(low.rlike(p) & ~template_low.rlike(p), F.concat(F.lit("the rewrite claimed an outcome ("), F.regexp_extract(low, p, 0), F.lit(")")))
    why = (
        why.when(F.size(greeted) > 0, F.concat(F.lit("the rewrite repeated the salutation or sign-off ("), first(greeted), F.lit(")")))
        .when(F.contains(t, F.lit("?")), "the rewrite asked a question, which is the locked request's job")
        .when(F.size(asked) > 0, F.concat(F.lit("the rewrite asked the customer for something ("), first(asked), F.lit("), which is the locked request's job")))
    )
    out = steps.withColumn(into, why)
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def polished(drafts: DataFrame) -> DataFrame:
    """drafts (greeting, closing, said_greeting, said_closing and more) with greeting and closing replaced if both new
    lines may stand, adopted, and rejected_reason."""
    flat = lambda c: F.trim(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?U)\s+", " "))
    judged = with_refusal(with_refusal(drafts, "said_greeting", "greeting", "why_greeting"), "said_closing", "closing", "why_closing")
    why = lambda part: F.concat(F.lit(f"{part}: "), F.col(f"why_{part}"))
    judged = judged.withColumn("rejected_reason", F.coalesce(why("greeting"), why("closing"))).withColumn("adopted", F.col("rejected_reason").isNull())
    return judged.withColumns({p: F.when(F.col("adopted"), flat(f"said_{p}")).otherwise(F.col(p)) for p in ("greeting", "closing")}).drop("said_greeting", "said_closing", "why_greeting", "why_closing")
