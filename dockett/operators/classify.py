"""Emails: text views, category by scored rules, and intent."""

from __future__ import annotations

from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CATEGORIES
from ..functions.labels import resolve_key
from ..functions.rules import ATTACHED, BLOCK_CAP, DRAFT, EMAIL_RULES
from ..functions.text import basic, is_blank, settled, strip

MIN_SCORE, MIN_MARGIN, FULL_SCORE, FULL_MARGIN = 3.0, 1.5, 8.0, 4.0
PAIR_WEIGHT, SINGLE_WEIGHT = 3.0, 1.5
ATTACH_MIN, DRAFT_MIN, FULL_SIGNAL = 1.5, 1.5, 5.0
# Reply prefixes, the banner, where quotes and signatures start, salutations.
_REPLY = r"(?i)^(?:\s*(?:RE|FW|FWD|AW|TR)\s*[:_\-]+\s*){1,4}"
BANNER = r"(?i)\A\s*(?:WARNING|CAUTION|\[?EXTERNAL\]?)\b[^\n]*\n?"
QUOTE = r"(?im)^(?:\s*[_\-=]{5,}\s*|\s*From\s*:\s*\S|\s*Sent\s*:\s*\S|\s*-{2,}\s*Original Message|\s*On\b.{0,80}\bwrote\s*:\s*)$"
SIGNOFF = r"(?im)^\s*(?:BEST\s+REGARDS|KIND\s+REGARDS|WARM\s+REGARDS|BEST\s+WISHES|REGARDS|BEST|THANKS|THANK\s+YOU|SINCERELY|CHEERS|YOURS\s+\w+)\s*[,.!]?\s*$"
SALUTATION = r"^(?:HI|HELLO|HEY|DEAR|GOOD\s+(?:MORNING|AFTERNOON|DAY))\b"
_LABELLED = r"(?m)^[ \t]*([A-Z][A-Z0-9 ./&()'\-]{1,40}?)[ \t]*:"


def clean_subject(s: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(s, F.lit("")), _REPLY, ""), r"(?U)\s+", " ")))


def clean_body(s: Column) -> Column:
    text = F.regexp_replace(F.coalesce(s, F.lit("")), BANNER, "")
    text = F.split(text, QUOTE, 2)[0]
    return F.upper(strip(F.split(text, SIGNOFF, 2)[0]))


def body_head(body: Column) -> Column:
    """The first paragraph that is no short salutation."""
    parts = F.filter(F.transform(F.split(body, r"\n\s*\n"), strip), lambda p: (p != "") & ~(p.rlike(SALUTATION) & (F.length(p) <= 40)))
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))


def literals(pattern: str) -> list[str] | None:
    """Texts one of which a match of a pattern must hold (the longest run of each alternative), or null if there is none
    that narrows anything down."""
    def best(items) -> list[str] | None:
        runs, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is _parser.LITERAL:
                run += chr(arg)
                continue
            if len(run) > 1:
                runs.append([run])
            run = ""
            if op is _parser.BRANCH:
                found = [best(x) for x in arg[1]]
                if all(found):
                    runs.append([t for f in found for t in f])
            elif op is _parser.SUBPATTERN and (inner := best(arg[3])):
                runs.append(inner)
        return max(runs, key=lambda r: min(map(len, r))) if runs else None

    return best(_parser.parse(pattern))


def matches(text: Column, pattern: str) -> Column:
    """text.rlike in lines, asked only of texts that hold one of the pattern's literals: finding those is much cheaper."""
    found = text.rlike("(?m)" + pattern)
    needed = literals(pattern)
    if not needed:
        return found
    held = F.contains(text, F.lit(needed[0]))
    for t in needed[1:]:
        held = held | F.contains(text, F.lit(t))
    return held & found


def views(emails: DataFrame) -> DataFrame:
    """emails with v_subject, v_body, v_body_head, v_sender and v_any, made once for all rules."""
    out = emails.withColumns({"v_subject": clean_subject(F.col("subject")), "v_body": clean_body(F.col("body")), "v_sender": F.upper(strip(F.coalesce("sender", F.lit(""))))})
    out = settled(out, "v_subject", "v_body", "v_sender")
    return settled(out.withColumns({"v_body_head": body_head(F.col("v_body")), "v_any": F.concat("v_subject", F.lit("\n"), "v_body")}), "v_body_head", "v_any")


def block_markers(text: Column) -> Column:
    """How many of the seven fields are labelled in a text."""
    fields = F.transform(F.transform(F.regexp_extract_all(text, F.lit(_LABELLED), 1), basic), lambda k: resolve_key(k)["field"])
    return F.size(F.array_distinct(F.filter(fields, lambda f: f.isNotNull())))


def fired_rules(viewed: DataFrame, doc_types: str | None = None) -> DataFrame:
    """viewed with fired: array of (ord, name, category, gain), in table order. It is settled, as what reads it would
    else repeat all rules for each thing that it asks.

    doc_types names an array column of the attachments' types, which speak for a comparison.
    """
    counted = {v: f"__blocks_{v}" for _, _, v, _, p in EMAIL_RULES if p is None}
    viewed, given = settled(viewed.withColumns({c: block_markers(F.col(f"v_{v}")) for v, c in counted.items()}), *counted.values()), viewed.columns
    hits = []
    for i, (name, category, view, weight, pattern) in enumerate(EMAIL_RULES):
        text = F.col(f"v_{view}")
        gain = F.least(F.col(counted[view]), F.lit(BLOCK_CAP)) * F.lit(weight) if pattern is None else F.lit(weight)
        cond = gain > 0 if pattern is None else matches(text, pattern)
        hits.append(F.when(cond, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("name"), F.lit(category).alias("category"), gain.alias("gain"))))
    if doc_types:
        kinds = F.coalesce(F.col(doc_types), F.array().cast("array<string>"))
        si, bl = F.array_contains(kinds, "SHIPPING_INSTRUCTION"), F.array_contains(kinds, "BILL_OF_LADING")
        of = lambda name, w: F.struct(F.lit(len(EMAIL_RULES)).alias("ord"), F.lit(name).alias("name"), F.lit("BL_COMPARISON").alias("category"), F.lit(w).alias("gain"))
        hits.append(F.when(si & bl, of("attachments.si-bl-pair", PAIR_WEIGHT)).when(si | bl, of("attachments.shipping-document", SINGLE_WEIGHT)))
    return settled(viewed.withColumn("fired", F.filter(F.array(*hits), lambda x: x.isNotNull())), "fired").select(*given, "fired")


def categories(fired: DataFrame) -> DataFrame:
    """fired with category, confidence, margin, score, needs_model, rationale (by falling gain)."""
    score = lambda c: F.aggregate(F.filter("fired", lambda x: x["category"] == c), F.lit(0.0), lambda s, x: s + x["gain"])
    ranked = F.sort_array(F.array(*[F.struct((-score(c)).alias("s"), F.lit(i).alias("i"), F.lit(c).alias("category")) for i, c in enumerate(CATEGORIES)]))
    out = fired.withColumn("__r", ranked).withColumns({"__top": -F.col("__r")[0]["s"], "__margin": F.col("__r")[1]["s"] - F.col("__r")[0]["s"]})
    none = F.col("__top") <= 0
    order = F.sort_array(F.transform("fired", lambda x: F.struct((-x["gain"]).alias("g"), x["ord"].alias("o"), x["name"].alias("name"))))
    return out.withColumns(
        {
            "category": F.when(none, "GENERAL").otherwise(F.col("__r")[0]["category"]),
            "score": F.bround("__top", 4),
            "margin": F.when(none, 0.0).otherwise(F.bround("__margin", 4)),
            "confidence": F.when(none, 0.0).otherwise(F.bround(0.5 * F.least(F.lit(1.0), F.col("__top") / FULL_SCORE) + 0.5 * F.least(F.lit(1.0), F.col("__margin") / FULL_MARGIN), 4)),
            "needs_model": none | (F.col("__top") < MIN_SCORE) | (F.col("__margin") < MIN_MARGIN),
            "rationale": F.when(none, "fallback.no-rule-fired").otherwise(F.array_join(F.transform(order, lambda x: x["name"]), ",")),
        }
    ).drop("__r", "__top", "__margin")


def intents(viewed: DataFrame) -> DataFrame:
    """viewed with expects_documents, requests_draft, attach_score, draft_score, intent_confidence.

    Signs in the head count whole, those only further down by half.
    """
    head = F.when(F.col("v_body_head") == "", F.col("v_body")).otherwise(F.col("v_body_head"))

    def total(signals: list) -> Column:
        out = F.lit(0.0)
        for _, weight, pattern, view in signals:
            if view == "subject":
                out = out + F.when(matches(F.col("v_subject"), pattern), weight).otherwise(0.0)
            else:
                out = out + F.when(matches(F.col("__head"), pattern), weight).when(matches(F.col("v_body"), pattern), 0.5 * weight).otherwise(0.0)
        return out

    out = viewed.withColumn("__head", head).withColumns({"attach_score": total(ATTACHED), "draft_score": total(DRAFT)})
    lead, second = F.greatest("attach_score", "draft_score"), F.least("attach_score", "draft_score")
    return out.withColumns(
        {
            "expects_documents": (F.col("attach_score") >= ATTACH_MIN) & (F.col("attach_score") > F.col("draft_score")),
            "requests_draft": (F.col("draft_score") >= DRAFT_MIN) & (F.col("draft_score") >= F.col("attach_score")),
            "intent_confidence": F.when(lead <= 0, 0.0).otherwise(F.bround(0.5 * F.least(F.lit(1.0), lead / FULL_SIGNAL) + 0.5 * (lead - second) / lead, 4)),
        }
    ).drop("__head")


def empty_mail(emails: DataFrame) -> DataFrame:
    return emails.filter(is_blank(F.coalesce("subject", F.lit(""))) & is_blank(F.coalesce("body", F.lit(""))))


def should_escalate(needs_model: Column, confidence: Column, decided_by: Column) -> Column:
    return (decided_by != "llm") & (needs_model | (confidence < 0.45))


def intent_signs(viewed: DataFrame) -> DataFrame:
    """email_id, kind (expects_attached, requests_draft), name, gain, place (1: the strongest) of each sign that a mail shows."""
    head = F.when(F.col("v_body_head") == "", F.col("v_body")).otherwise(F.col("v_body_head"))
    signs = []
    for kind, table in (("expects_attached", ATTACHED), ("requests_draft", DRAFT)):
        for name, weight, pattern, view in table:
            p = "(?m)" + pattern
            gain = F.when(F.col("v_subject").rlike(p), weight) if view == "subject" else F.when(F.col("__head").rlike(p), weight).when(F.col("v_body").rlike(p), 0.5 * weight)
            signs.append(F.when(gain.isNotNull(), F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), gain.alias("gain"), F.lit(len(signs)).alias("ord"))))
    rows = viewed.withColumn("__head", head).withColumn("s", F.filter(F.array(*signs), lambda x: x.isNotNull()))
    ranked = F.sort_array(F.transform("s", lambda x: F.struct((-x["gain"]).alias("g"), x["ord"].alias("ord"), x["kind"].alias("kind"), x["name"].alias("name"))))
    return rows.select("email_id", F.posexplode(ranked).alias("place", "r")).select("email_id", "r.kind", "r.name", (-F.col("r.g")).alias("gain"), (F.col("place") + 1).alias("place"))
