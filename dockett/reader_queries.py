"""Registered queries of readers, page layout and what stands around a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import oracle as o
from .constants import CATEGORIES, FIELDS
from .functions import labels
from .operators import assist, chunks, classify, layout, readers, sampling
from .registry import query
from .sources import derive
from .storage import dealt

_QTY = "CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR)"


@query(
    f"""WITH i AS (SELECT l_orderkey AS doc, l_linenumber AS n, min(l_partkey) AS p, {_QTY} AS q FROM lineitem GROUP BY ALL)
        SELECT doc, n AS row, 'Item ' || CAST(n AS VARCHAR) AS label, q AS value FROM i WHERE doc % 2 = 1 AND p % 5 <> 0
        UNION ALL SELECT doc, NULL, 'Container Count', CAST(count(*) AS VARCHAR) FROM i WHERE doc % 2 = 0 GROUP BY doc"""
)
def table_chunks(spark, sf_dir):
    return readers.table_chunks(derive.cells(spark, sf_dir)).select("doc", "row", "label", "value")


def _markdown(spark, sf_dir):
    p = derive.pairs(spark, sf_dir)
    text = F.concat(F.lit("| Shipper | "), "si_shipper", F.lit(" |\n| --- | :-- |\n| Consignee | "), "si_consignee", F.lit(" | Oslo |\n## Remarks\nPort of Loading: "), "si_port_of_loading", F.lit("\n| Gross Weight: 5 KG | |\n# Notify Party: "), "si_notify_party", F.lit("\n  second line"))
    return p.select("case_id", F.lit("SI").alias("side"), text.alias("text"))


@query(
    f"""WITH {o.PAIRS} SELECT case_id, CAST(k AS INTEGER) AS chunk_ord, CAST(n AS INTEGER) AS line, label, value FROM (
        SELECT case_id, 0 AS k, 1 AS n, 'Shipper' AS label, si_shipper AS value FROM pair UNION ALL SELECT case_id, 1, 3, 'Consignee', si_consignee || ' Oslo' FROM pair
        UNION ALL SELECT case_id, 2, 6, 'Gross Weight', '5 KG' FROM pair UNION ALL SELECT case_id, 3, 5, 'Port of Loading', si_port_of_loading FROM pair
        UNION ALL SELECT case_id, 4, 7, 'Notify Party', si_notify_party || chr(10) || 'second line' FROM pair)"""
)
def markdown_chunks(spark, sf_dir):
    return readers.markdown_chunks(_markdown(spark, sf_dir)).select("case_id", F.col("chunk_ord").cast("int").alias("chunk_ord"), F.col("line").cast("int").alias("line"), "label", "value")


#: Lines of the pairs' texts with their places.
_RAW = f"""{o.PAIRS}, {o.texts()}, raw AS (SELECT case_id, v, side, unnest(string_split(text, chr(10))) AS raw, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS INTEGER) AS line FROM doc_text)"""


@query(
    rf"""WITH {_RAW}, kept AS (SELECT *, regexp_matches(raw, '^([^:]{{1,60}}?):\s*(.*)$') AND NOT regexp_matches(trim(regexp_extract(raw, '^([^:]{{1,60}}?):', 1)), '\s{{2,}}') AS field, starts_with(raw, ' ') AS indented
            FROM raw WHERE trim(raw) <> '' AND NOT regexp_matches(raw, '^[=\-_]{{3,}}\s*$')),
        own AS (SELECT *, sum(CASE WHEN indented THEN 0 ELSE 1 END) OVER (PARTITION BY case_id, side ORDER BY line) AS island FROM kept)
        SELECT case_id, side, min(line) AS line, CASE WHEN bool_or(field) THEN 'field' WHEN bool_or(NOT regexp_matches(raw, '[a-z]') AND length(trim(raw)) <= 60) THEN 'heading' ELSE 'text' END AS kind,
            max(CASE WHEN field THEN trim(regexp_extract(raw, '^([^:]{{1,60}}?):', 1)) END) AS label, string_agg(CASE WHEN field THEN trim(regexp_extract(raw, '^[^:]{{1,60}}?:\s*(.*)$', 1)) ELSE trim(raw) END, chr(10) ORDER BY line) AS value FROM own GROUP BY case_id, side, island"""
)
def tidy_lines(spark, sf_dir):
    return readers.tidy_lines(derive.texts(derive.pairs(spark, sf_dir))).withColumn("line", F.col("line").cast("int"))


_FIELD_LIST = "[" + ", ".join(o.q(f) for f in FIELDS) + "]"


def _answers(spark, sf_dir):
    e = derive.read(spark, sf_dir, "events")
    field = F.element_at(F.array(*map(F.lit, FIELDS)), (F.col("event_id") % 7 + 1).cast("int"))
    t = F.col("event_type")
    value = F.when(t == "view", "Shipper: ACME").when(t == "signup", " OSLO ").when(t == "click", "???").when(t == "purchase", F.concat(F.replace(field, F.lit("_"), F.lit(" ")), F.lit(": x"), F.col("event_id").cast("string")))
    return e.select(F.col("user_id").alias("doc"), F.col("event_id").alias("ord"), field.alias("field"), value.alias("value"), (F.col("event_id") % 4 != 0).alias("legible"))


@query(
    f"""WITH a AS (SELECT user_id AS doc, event_id, {_FIELD_LIST}[event_id % 7 + 1] AS field, event_type AS t, event_id % 4 <> 0 AS ok FROM events),
        said AS (SELECT *, trim(coalesce(CASE t WHEN 'view' THEN 'Shipper: ACME' WHEN 'signup' THEN ' OSLO ' WHEN 'click' THEN '???' WHEN 'purchase' THEN replace(field, '_', ' ') || ': x' || CAST(event_id AS VARCHAR) END, '')) AS said FROM a),
        f AS (SELECT * FROM said QUALIFY row_number() OVER (PARTITION BY doc, field ORDER BY event_id) = 1),
        cut AS (SELECT *, CASE WHEN contains(said, ':') AND {o.resolve(o.basic("split_part(said, ':', 1)"))} = field THEN trim(split_part(said, ':', 2)) ELSE said END AS v FROM f),
        dim AS (SELECT DISTINCT user_id AS doc, unnest({_FIELD_LIST}) AS field, CAST(unnest(range(1, 8)) AS INTEGER) AS field_ord FROM events)
        SELECT dim.doc, dim.field, field_ord, CASE WHEN ok AND NOT {o.is_blank('v')} THEN v ELSE '' END AS value, coalesce(ok AND NOT {o.is_blank('v')}, false) AS legible FROM dim LEFT JOIN cut USING (doc, field)"""
)
def scan_transcripts(spark, sf_dir):
    a = _answers(spark, sf_dir)
    return readers.transcripts(a, a.select("doc").distinct())


@query(
    r"""WITH f AS (SELECT doc_id, ['a.txt', 'b.TXT', 'c.pdf', 'noext', 'd.csv', 'e.text'][doc_id % 6 + 1] AS name, CASE doc_id % 12 WHEN 0 THEN '' WHEN 1 THEN chr(10) || ' ' ELSE text END AS t FROM documents)
        SELECT doc_id, name, CAST(strlen(coalesce(t, '')) AS INTEGER) AS n_bytes, CASE WHEN coalesce(t, '') = '' THEN 'empty_file' WHEN strlen(t) > 26214400 OR NOT regexp_matches(name, '(?i)\.(txt|text|csv)$') THEN 'unsupported' WHEN trim(t, ' ' || chr(10)) = '' THEN 'empty_file' END AS unreadable FROM f"""
)
def upload_reasons(spark, sf_dir):
    n = F.col("doc_id")
    name = F.element_at(F.array(*map(F.lit, ("a.txt", "b.TXT", "c.pdf", "noext", "d.csv", "e.text"))), (n % 6 + 1).cast("int"))
    content = F.when(n % 12 == 0, "").when(n % 12 == 1, "\n ").otherwise(F.col("text")).cast("binary")
    return readers.uploads(derive.read(spark, sf_dir, "documents").select("doc_id", name.alias("name"), content.alias("content"))).select("doc_id", "name", "n_bytes", "unreadable")


def _words(spark, sf_dir):
    return derive.words(derive.pairs(spark, sf_dir))


_LABELS = "[" + ", ".join(o.q(w) for w in derive.WORDINGS[0]) + "]"


@query(f"WITH {o.PAIRS} SELECT case_id AS doc, CAST(field_ord AS INTEGER) AS row, {_LABELS}[field_ord] AS label, coalesce(bl_raw, '') AS value FROM val")
def layout_rows(spark, sf_dir):
    return layout.split_rows(_words(spark, sf_dir)).select("doc", "row", "label", "value")


@query(f"WITH {o.PAIRS} SELECT case_id AS doc, CASE v WHEN 15 THEN 60.0 ELSE 220.0 END::DOUBLE AS value_x FROM pair")
def value_columns(spark, sf_dir):
    return layout.value_columns(_words(spark, sf_dir)).select("doc", "value_x")


#: Left edges of all words: a label's or value's words, five points a character from where it begins.
_EDGES = f"""part AS (SELECT case_id AS doc, string_split({_LABELS}[field_ord], ' ') AS w, 40.0 AS x FROM val UNION ALL SELECT case_id, string_split(bl_raw, ' '), CASE v WHEN 15 THEN 60.0 ELSE 220.0 END FROM val WHERE bl_raw IS NOT NULL),
    edge AS (SELECT doc, CAST(x + 5 * unnest(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i = 1 THEN 0 ELSE length(array_to_string(w[1:i - 1], ' ')) + 1 END)) AS DOUBLE) AS x0 FROM part)"""


@query(f"WITH {o.PAIRS}, {_EDGES} SELECT doc, round_even(x0, 0) AS x, count(*) AS n FROM edge GROUP BY ALL")
def left_edges(spark, sf_dir):
    return layout.left_edges(_words(spark, sf_dir))


@query(
    f"""WITH {o.PAIRS}, {_EDGES}, bins AS (SELECT doc, round_even(x0 / 3, 0) AS b, count(*) AS n, min(x0) AS x FROM edge GROUP BY ALL), seen AS (SELECT *, min(x) OVER (PARTITION BY doc) AS m, sum(n) OVER (PARTITION BY doc) AS total FROM bins)
        SELECT doc, x AS value_x FROM seen WHERE x > m + 20 AND n >= greatest(3, floor(total * 0.04)) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, b) = 1"""
)
def edge_columns(spark, sf_dir):
    return layout.column_of_edges(_words(spark, sf_dir)).select("doc", "value_x")


_TAILS = ["", "\n-----Original Message-----\nold", "\nFrom: a@b.c\nSent: today\nold", "\n> one\n> two", "\nBest regards,\nAnn"]


@query(
    rf"""WITH {o._mails()}, tails AS (SELECT [{', '.join(o.q(t).replace(chr(10), "' || chr(10) || '") for t in _TAILS)}] AS t),
        b AS (SELECT 'mail' AS kind, email_id AS id, body FROM mail UNION ALL SELECT 'doc', doc_id, 'Hello' || chr(10) || chr(10) || chr(10) || chr(10) || text || t[doc_id % 5 + 1] FROM documents, tails WHERE text IS NOT NULL),
        s AS (SELECT kind, id, {o.visible('body')} AS text FROM b)
        SELECT kind, id, CASE WHEN length(text) > 1200 THEN regexp_replace(CASE WHEN length(regexp_extract(substr(text, 1, 1200), '^((?s:.*))\n', 1)) > 600 THEN regexp_extract(substr(text, 1, 1200), '^((?s:.*))\n', 1) ELSE substr(text, 1, 1200) END, '[\s\x0B\x{{85}}\x{{A0}}]+$', '') || chr(10) || '[...truncated]' ELSE text END AS visible FROM s"""
)
def visible_body(spark, sf_dir):
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("doc_id") % 5 + 1).cast("int"))
    docs = derive.read(spark, sf_dir, "documents").filter("text is not null").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.concat(F.lit("Hello\n\n\n\n"), "text", tail).alias("body"))
    mails = derive.emails(spark, sf_dir).select(F.lit("mail").alias("kind"), F.col("email_id").alias("id"), "body")
    return mails.unionByName(docs).select("kind", "id", assist.visible_body(F.col("body")).alias("visible"))


_CLAIMS = ["0.5", "1.5", "-1", "nan", "abc", "", None, "0.1234"]


@query("SELECT event_id, [0.5, 0.9, 0.0, 0.0, 0.0, 0.0, 0.0, 0.1234][event_id % 8 + 1]::DOUBLE AS confidence FROM events")
def confidence_clamped(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(c).cast("string") for c in _CLAIMS]), (F.col("event_id") % 8 + 1).cast("int"))
    return derive.read(spark, sf_dir, "events").select("event_id", assist.clamped(said).alias("confidence"))


@query(
    """WITH k AS (SELECT event_id, ts, value, sha256('{"model":"m1","payload":{"kind":"x","user":"' || CAST(user_id AS VARCHAR) || '"},"purpose":"' || event_type || '","v":"1"}') AS key FROM events),
        c AS (SELECT key, arg_max(event_id, ts) AS answer FROM k WHERE value > 100 GROUP BY key) SELECT event_id, key, answer, answer IS NOT NULL AS hit FROM k LEFT JOIN c USING (key)"""
)
def cache_lookups(spark, sf_dir):
    e = derive.read(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    key = lambda *entries: assist.cache_key(F.lit("m1"), F.col("event_type"), F.create_map(*entries))
    asked = e.select("event_id", key(F.lit("user"), user, F.lit("kind"), F.lit("x")).alias("key"))
    known = e.filter("value > 100").select(key(F.lit("kind"), F.lit("x"), F.lit("user"), user).alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("answer"))
    return assist.remembered(asked, known).select("event_id", "key", "answer", "hit")


_CATS = o.among(CATEGORIES)
#: Answers to mails by number modulo 5: none, the fallback category, another, an unknown one, and one with no number.
_SAID = """said AS (SELECT o_orderkey AS email_id, CASE o_orderkey % 5 WHEN 1 THEN 'GENERAL' WHEN 2 THEN 'SPAM' WHEN 3 THEN 'WHATEVER' ELSE 'INVOICE_QUERY' END AS sc, CASE o_orderkey % 5 WHEN 1 THEN 0.75 WHEN 2 THEN 0.9 ELSE 0 END AS sf,
    CASE o_orderkey % 5 WHEN 2 THEN 'why so' WHEN 1 THEN 'general words' ELSE '(none given)' END AS sr FROM orders WHERE o_orderkey % 5 <> 0)"""


@query(
    f"""WITH {o.MAILS}, {_SAID}, r AS (SELECT email_id, CASE WHEN s <= 0 THEN 'GENERAL' ELSE category END AS category, CASE WHEN s <= 0 THEN 0.0 ELSE round_even(0.5 * least(1, s / 8) + 0.5 * least(1, lead_ / 4), 4) END AS confidence, s <= 0 OR s < 3 OR lead_ < 1.5 AS unsure FROM ranked WHERE rank = 1),
        j AS (SELECT r.*, sc, sf, sr, unsure OR confidence < 0.45 AS doubtful, (unsure OR confidence < 0.45) AND coalesce(sc IN {_CATS}, false) AS take FROM r LEFT JOIN said USING (email_id))
        SELECT email_id, CASE WHEN take THEN sc ELSE category END AS category, CAST(CASE WHEN take THEN sf ELSE confidence END AS DOUBLE) AS confidence, CASE WHEN take THEN 'llm' ELSE 'rule' END AS decided_by, unsure AND NOT take AS needs_model,
            CASE WHEN NOT doubtful THEN NULL WHEN sc IS NULL THEN 'llm.unavailable:no-client' WHEN NOT take THEN 'llm.rejected:unknown-category:' || sc ELSE 'llm.rule_said:' || category || ',llm.category:' || sc || ',' || CASE WHEN sc = category THEN 'llm.agreed' ELSE 'llm.overrode:' || category END || ',llm.reason:' || sr END AS note FROM j"""
)
def adopted_categories(spark, sf_dir):
    ruled = classify.categories(classify.fired_rules(classify.views(derive.emails(spark, sf_dir))))
    k = F.col("o_orderkey") % 5
    said = derive.read(spark, sf_dir, "orders").filter(k != 0).select(
        F.col("o_orderkey").alias("email_id"), F.when(k == 1, "GENERAL").when(k == 2, "SPAM").when(k == 3, "WHATEVER").otherwise("INVOICE_QUERY").alias("said_category"),
        F.when(k == 1, "0.75").when(k == 2, "1.7").otherwise("x").alias("said_confidence"), F.when(k == 1, "general words").when(k == 2, "  why \n so ").otherwise(" ").alias("said_reason"),
    )
    out = assist.adopted_categories(ruled, said)
    return out.select("email_id", "category", "confidence", "decided_by", "needs_model", F.nullif(F.regexp_extract("rationale", r"(llm\..*)$", 1), F.lit("")).alias("note"))


@query(
    f"""WITH {o.PAIRS}, rb AS (SELECT case_id, 'SI' AS side, field FROM val WHERE si_raw IS NOT NULL UNION ALL SELECT case_id, 'BL', field FROM val WHERE bl_raw IS NOT NULL), every AS (SELECT case_id, side, field, CAST(field_ord AS INTEGER) AS field_ord FROM val, (VALUES ('SI'), ('BL')) s(side))
        SELECT every.* FROM every LEFT JOIN rb USING (case_id, side, field) WHERE rb.case_id IS NULL"""
)
def missing_fields(spark, sf_dir):
    docs = derive.texts(derive.pairs(spark, sf_dir))
    return assist.missing_fields(chunks.field_values(chunks.candidates(chunks.chunks(dealt(docs, "case_id", "side")))), docs.select("case_id", "side"))


def _unseen(spark, sf_dir):
    """Drafts whose labels no table knows, but for the port."""
    p = derive.pairs(spark, sf_dir)
    text = F.concat(F.lit("DRAFT BILL OF LADING\nCarried for: "), "si_shipper", F.lit("\nHand over to: "), "si_consignee", F.lit("\nBoxes: "), "si_container_count", F.lit("\nMass in all: "), "si_gross_weight_kg", F.lit("\nPOL: "), "si_port_of_loading")
    return p, p.select("case_id", F.lit("BL").alias("side"), text.alias("text"))


def _told(p):
    """Answers: true ones, one that was made up, one cut short, one figure that is the box's size, one that says nothing,
    one nobody asked for, and a second one for a field."""
    k = F.col("case_id") % 3
    n, w = F.substring_index("si_container_count", " ", 1), F.col("si_gross_weight_kg")
    rows = [
        ("shipper", F.col("si_shipper"), "Carried for"), ("consignee", F.when(k == 0, "NOBODY LTD").when(k == 1, F.substring_index("si_consignee", " ", 1)).otherwise(F.col("si_consignee")), "Hand over to"),
        ("container_count", F.lit("40"), "Boxes"), ("container_count", n, "Boxes"), ("gross_weight_kg", F.lit("???"), "Mass in all"), ("gross_weight_kg", w, "Mass in all"),
        ("port_of_loading", F.col("si_port_of_loading"), "POL"), ("notify_party", F.col("si_consignee"), "Hand over to"), ("shipper", F.col("si_consignee"), "Carried for"),
    ]
    given = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), v.alias("value"), F.lit(x).alias("label")) for i, (f, v, x) in enumerate(rows)])
    return p.select("case_id", F.lit("BL").alias("side"), F.explode(given).alias("a")).select("case_id", "side", "a.*")


@query(
    f"""WITH {o.PAIRS} SELECT case_id, 'shipper' AS field, si_shipper AS raw, 'line 2' AS locator, 'Carried for' AS label FROM pair UNION ALL SELECT case_id, 'consignee', si_consignee, 'line 3', 'Hand over to' FROM pair WHERE case_id % 3 = 2
        UNION ALL SELECT case_id, 'container_count', CAST(n AS VARCHAR), 'line 4', 'Boxes' FROM pair UNION ALL SELECT case_id, 'gross_weight_kg', si_gross_weight_kg, 'line 5', 'Mass in all' FROM pair
        UNION ALL SELECT case_id, 'notify_party', si_consignee, 'line 3', 'Hand over to' FROM pair"""
)
def adopted_values(spark, sf_dir):
    p, docs = _unseen(spark, sf_dir)
    cut = chunks.chunks(docs)
    missing = assist.missing_fields(chunks.field_values(chunks.candidates(cut)), docs)
    return assist.adopted_values(_told(p), missing, cut, docs).select("case_id", "field", "raw", "locator", "label")


# A courtesy line, what was made of it, and why that may not stand (null: it may).
_TEMPLATE = "Thank you for your email."
WORDINGS = [
    ("Thank you very much for your message.", None), ("", "the rewrite was empty"), ("Thank you so much, truly, " + "and again and again, " * 8 + "for your message.", "the rewrite was much longer than the template"),
    ("Thank you for your 2 messages.", "the rewrite contained a number"), ("Thank you for the MSC message.", "the rewrite contained an all-capitals word, which reads as a name or a code"),
    ('Thank you for your "message".', "the rewrite quoted something"), ("Thank you, see www.example.org.", "the rewrite contained an address or a link"), ("Thank you, dear Maria, for your message.", "the rewrite introduced a name the template did not have (Maria)"),
    ("Thank you. We are grateful, and I'm glad.", None), ("Thank you, we have verified it.", "the rewrite claimed an outcome (verified)"), ("Thank you; we could not yet have verified it.", None),
    ("Thank you, all is in order here.", "the rewrite claimed an outcome (in order)"), ("Thank you for writing in order to reach us.", None), ("Thank you, there is no problem at all.", "the rewrite claimed an outcome (no problem)"),
    ("Dear friend, thank you.", "the rewrite repeated the salutation or sign-off (dear)"), ("Thank you, how are you?", "the rewrite asked a question, which is the locked request's job"),
    ("Thank you, and please forward it.", "the rewrite asked the customer for something (forward), which is the locked request's job"), ("Thank you.  We   appreciate it.", None),
]


def _worded(spark, sf_dir):
    text = F.element_at(F.array(*[F.lit(t) for t, _ in WORDINGS]), (F.col("event_id") % len(WORDINGS) + 1).cast("int"))
    return derive.read(spark, sf_dir, "events").select("event_id", text.alias("text"), F.lit(_TEMPLATE).alias("template"))


_WHY = "[" + ", ".join(o.q(w) if w else "NULL" for _, w in WORDINGS) + "]"


@query(f"SELECT event_id, {_WHY}[event_id % {len(WORDINGS)} + 1] AS refused FROM events")
def wording_checks(spark, sf_dir):
    return assist.with_refusal(_worded(spark, sf_dir), "text", "template", "refused").select("event_id", "refused")


@query(
    rf"""WITH w AS (SELECT [{', '.join(o.q(t) for t, _ in WORDINGS)}] AS t, {_WHY} AS y), e AS (SELECT event_id, y[event_id % {len(WORDINGS)} + 1] AS a, y[event_id % 7 + 1] AS b, t[event_id % {len(WORDINGS)} + 1] AS g, t[event_id % 7 + 1] AS c FROM events, w)
        SELECT event_id, CASE WHEN a IS NULL AND b IS NULL THEN trim(regexp_replace(g, '\s+', ' ', 'g')) ELSE 'Thank you for your email.' END AS greeting, CASE WHEN a IS NULL AND b IS NULL THEN c ELSE 'Thank you for your email.' END AS closing,
            a IS NULL AND b IS NULL AS adopted, coalesce('greeting: ' || a, 'closing: ' || b) AS rejected_reason FROM e"""
)
def polished_lines(spark, sf_dir):
    pick = lambda n: F.element_at(F.array(*[F.lit(t) for t, _ in WORDINGS]), (F.col("event_id") % n + 1).cast("int"))
    same = F.lit(_TEMPLATE)
    return assist.polished(derive.read(spark, sf_dir, "events").select("event_id", same.alias("greeting"), same.alias("closing"), pick(len(WORDINGS)).alias("said_greeting"), pick(7).alias("said_closing")))


def _signs() -> str:
    from .functions.rules import ATTACHED, DRAFT

    out, head = [], "CASE WHEN v_body_head = '' THEN v_body ELSE v_body_head END"
    for kind, table in (("expects_attached", ATTACHED), ("requests_draft", DRAFT)):
        for name, w, pattern, view in table:
            p = o.q("(?m)" + o._re2(pattern))
            gain = f"CASE WHEN regexp_matches(v_subject, {p}) THEN {w} END" if view == "subject" else f"CASE WHEN regexp_matches({head}, {p}) THEN {w} WHEN regexp_matches(v_body, {p}) THEN {w / 2} END"
            out.append(f"SELECT email_id, '{kind}' AS kind, {o.q(name)} AS name, CAST({gain} AS DOUBLE) AS gain, {len(out)} AS i FROM view")
    return " UNION ALL ".join(out)


@query(f"WITH {o._mails()}, {o._views()}, s AS ({_signs()}) SELECT email_id, kind, name, gain, CAST(row_number() OVER (PARTITION BY email_id ORDER BY gain DESC, i) AS INTEGER) AS place FROM s WHERE gain IS NOT NULL")
def intent_signs(spark, sf_dir):
    return classify.intent_signs(classify.views(derive.emails(spark, sf_dir)))


_PARTY = r"'(?i)^\s*(shipper|consignee|notify)\b[^:]{0,60}:'"


@query(
    rf"""WITH {_RAW}, m AS (SELECT case_id, side, line, lower(regexp_extract(raw, {_PARTY}, 1)) AS word FROM raw WHERE regexp_matches(raw, {_PARTY})), n AS (SELECT case_id, side, line - 1 AS line, raw AS next FROM raw)
        SELECT word, count(*) FILTER (WHERE starts_with(next, ' ')) AS attached, count(*) AS total FROM m LEFT JOIN n USING (case_id, side, line) GROUP BY word"""
)
def continuation_counts(spark, sf_dir):
    return sampling.continuations(derive.texts(derive.pairs(spark, sf_dir)))


@query(f"WITH {o.PAIRS} SELECT count(*) AS pairs, count_if(v = 7) AS flagged FROM pair")
def run_on_pairs(spark, sf_dir):
    return sampling.run_on_pairs(derive.texts(derive.pairs(spark, sf_dir)))


@query(
    rf"""WITH {_RAW}, l AS (SELECT case_id, side, count(*) AS n_lines, count(*) FILTER (WHERE contains(raw, ':')) AS n_chunks, count(*) FILTER (WHERE contains(raw, ':') AND {o.resolve(o.basic("split_part(raw, ':', 1)"))} IS NOT NULL) AS n_resolved FROM raw WHERE NOT regexp_matches(raw, '^[\s=_\-*~#]+$') GROUP BY ALL)
        SELECT case_id, side, CAST(length(text) AS INTEGER) AS n_chars, n_lines, n_chunks, n_resolved FROM doc_text JOIN l USING (case_id, side)"""
)
def reader_smoke(spark, sf_dir):
    return sampling.reader_smoke(derive.texts(derive.pairs(spark, sf_dir)))


@query()
def label_fuzzy(spark, sf_dir):
    """Every distinct wording that stands before a colon in documents and conversations, with the field that it is most like."""
    texts = derive.read(spark, sf_dir, "documents").select("text").union(derive.read(spark, sf_dir, "conversations").select("text"))
    found = texts.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?m)^\s*([^:\n]{1,60}?)\s*:"), 1)).alias("label")).distinct()
    made = derive.read(spark, sf_dir, "orders").select(F.concat_ws(" ", F.element_at(F.array(*[F.lit(w) for v in labels.SYNONYMS.values() for w in v]), (F.col("o_orderkey") % 40 + 1).cast("int")), F.when(F.col("o_orderkey") % 2 == 1, "nr")).alias("label")).distinct()
    return labels.with_fields(found.union(made).distinct(), "label", "field")
