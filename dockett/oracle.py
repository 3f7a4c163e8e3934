"""DuckDB SQL of the registered queries, written on its own: RE2 patterns, no look-around, lists for arrays."""

from __future__ import annotations

from .constants import FIELDS, PARTY_FIELDS, PORT_FIELDS
from .functions import labels, text


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def among(words: list[str]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0B\x{{85}}\x{{A0}}]+|[\s\x0B\x{{85}}\x{{A0}}]+$', '', 'g')"


def basic(x: str) -> str:
    return rf"coalesce(trim(regexp_replace(replace(upper(replace({x}, 'ß', 'SS')), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g')), '')"


def is_blank(x: str) -> str:
    s = strip(x)
    return rf"({x} IS NULL OR upper({s}) IN {among(text.BLANK_WORDS)} OR regexp_matches({s}, '(?i)^[\s_?\-.*x]*(?:MT|MTS|KG|KGS|TON|TONS)?[\s_?\-.*]*$') OR regexp_replace({s}, '[\s_?\-.*/]', '', 'g') = '')"


def first_segment(x: str) -> str:
    return rf"trim(regexp_extract(split_part({strip(f'coalesce({x}, {q(chr(0))[:1]}{q(chr(0))[-1:]})')}, '|', 1), '^[^\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]*'), ' ' || chr(9) || ';,')"


def without(x: str, words: list[str]) -> str:
    return f"list_aggregate(list_filter(string_split({x}, ' '), lambda t: t NOT IN {among(words)}), 'string_agg', ' ')"


def org(x: str) -> str:
    name = basic(first_segment(x))
    return f"coalesce(nullif(coalesce({without(name, text.LEGAL_FORMS)}, ''), ''), {name})"


def port(x: str) -> str:
    bare = rf"regexp_replace(upper({first_segment(x)}), '\(\s*([A-Z]{{2}}[A-Z0-9]{{3}})\s*\)', ' ', 'g')"
    return f"coalesce({without(basic(bare), text.PORT_NOISE)}, '')"


def number_text(x: str) -> str:
    return rf"regexp_extract({x}, '[-+]?\d[\d,\s]*(?:\.\d+)?')"


def to_double(x: str) -> str:
    return f"TRY_CAST(replace(replace({x}, ',', ''), ' ', '') AS DOUBLE)"


def contaminated(x: str) -> str:
    n = number_text(x)
    at = f"instr({x}, {n})"
    near = lambda i: f"coalesce(substr({x}, {i}, 1) IN ('O', 'I', 'l', 'S', 'B'), false)"
    return f"({n} <> '' AND (({at} > 1 AND {near(at + ' - 1')}) OR {near(f'{at} + length({n})')}))"


def readable(s: str) -> str:
    return f"NOT {is_blank(s)} AND NOT {contaminated(s)}"


_SIZE = r"(?:(?:20|40|45)\s*(?:''|’|FT)?\s*(?:GP|HC|HQ|DV|DC|RF|RH|OT|FR|TK|SD|SH|ST|STD|FCL|NOR)\b|(?:20|40|45)\s*(?:''|’)|[24L][0-9A-Z][A-Z]\d\b)"


def count(x: str) -> str:
    s = first_segment(x)
    first = rf"regexp_extract({s}, '(?i)^\s*{_SIZE}\s*[X×*]\s*(\d{{1,3}})\s*$', 1)"
    word = rf"upper(regexp_extract({s}, '(?i)^\s*({'|'.join(text.NUMBER_WORDS)})\s*[X×*]\s*{_SIZE}\s*(?:CONTAINERS?|CNTRS?|CTRS?)?\s*$', 1))"
    n = f"round_even({to_double(number_text(s))}, 0)"
    words = "[" + ", ".join(map(q, text.NUMBER_WORDS)) + "]"
    return f"CASE WHEN {x} IS NULL OR NOT ({readable(s)}) THEN NULL WHEN {first} <> '' THEN nullif(CAST({first} AS BIGINT), 0) WHEN {word} <> '' THEN CAST(list_position({words}, {word}) AS BIGINT) WHEN {n} > 0 AND {n} < 100000 THEN CAST({n} AS BIGINT) END"


def weight(x: str) -> str:
    s = first_segment(x)
    n = to_double(number_text(s))
    unit = rf"upper(regexp_extract({s}, '(?i)\b(KGS?|KILOS?|KILOGRAMS?|MTS?|TONS?|TONNES?)\b', 1))"
    kg = f"CASE WHEN starts_with({unit}, 'MT') OR starts_with({unit}, 'TON') THEN {n} * 1000.0 ELSE {n} END"
    return f"CASE WHEN {x} IS NOT NULL AND {readable(s)} AND {kg} > 0 THEN {kg} END"


def key(field: str, x: str) -> str:
    return (
        f"CASE WHEN {is_blank(x)} THEN NULL WHEN {field} IN {among(PARTY_FIELDS)} THEN nullif({org(x)}, '') WHEN {field} IN {among(PORT_FIELDS)} THEN nullif({port(x)}, '') "
        f"WHEN {field} = 'container_count' THEN CAST({count(x)} AS VARCHAR) ELSE CAST(CAST(round_even({weight(x)}, 0) AS BIGINT) AS VARCHAR) END"
    )


def resolve(x: str) -> str:
    """The field of a label by known wordings and rules, as a CASE expression."""
    keys = lambda wordings: among([labels.key(w) for w in wordings])
    k = f"({x})"
    out = f"CASE WHEN {k} = '' THEN NULL WHEN {k} IN {keys(labels.IGNORED)} THEN NULL"
    for field, wordings in [*labels.SYNONYMS.items(), *labels.EXACT_ONLY.items()]:
        out += f" WHEN {k} IN {keys(wordings)} THEN {q(field)}"
    for field, pattern in labels.RULES:
        out += f" WHEN regexp_matches({k}, {q(pattern)}) THEN {q(field) if field else 'NULL'}"
    return out + " END"


_PORT = lambda name, k, code: f"{name} || ', PORT (' || upper(substr({code}, 1, 2)) || 'P' || lpad(CAST({k} AS VARCHAR), 2, '0') || ')'"

#: CTEs pair (wide) and val (seven rows a case).
PAIRS = f"""
    item AS (SELECT l_orderkey, count(*) AS n, min(l_suppkey) AS s1, max(l_suppkey) AS s2, CAST(sum(l_quantity) AS BIGINT) * 100 AS w FROM lineitem GROUP BY l_orderkey),
    base AS (SELECT o_orderkey AS case_id, CAST(o_orderkey % 20 AS INTEGER) AS v, n, w, c_name, a.s_name AS s1_name, b.s_name AS s2_name, na.n_name AS pol, na.n_nationkey AS pol_key, nc.n_name AS pod, nc.n_nationkey AS pod_key
             FROM orders JOIN item ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation nc ON c_nationkey = nc.n_nationkey
             JOIN supplier a ON s1 = a.s_suppkey JOIN nation na ON a.s_nationkey = na.n_nationkey JOIN supplier b ON s2 = b.s_suppkey),
    side AS (SELECT *, s1_name || ' PTE. LTD.' AS si_shipper, c_name || ' TRADING CO' AS si_consignee, s2_name AS si_notify_party, {_PORT('pol', 'pol_key', 'pol')} AS si_port_of_loading,
             {_PORT('pod', 'pod_key', 'pod')} AS si_port_of_discharge, CAST(n AS VARCHAR) || ' x 40''HC' AS si_container_count, CAST(w AS VARCHAR) || ' KG' AS si_gross_weight_kg FROM base),
    pair AS (SELECT *, CASE v WHEN 4 THEN s1_name || ' Limited' WHEN 12 THEN 'TBA' ELSE si_shipper END AS bl_shipper,
             CASE v WHEN 3 THEN replace(upper(si_consignee), 'O', '0') ELSE si_consignee END AS bl_consignee, CASE WHEN v <> 6 THEN si_notify_party END AS bl_notify_party,
             si_port_of_loading AS bl_port_of_loading, CASE v WHEN 1 THEN {_PORT('pol', 'pod_key', 'pod')} ELSE si_port_of_discharge END AS bl_port_of_discharge,
             CASE v WHEN 8 THEN CAST(n - 1 AS VARCHAR) || ' x 40''HC' WHEN 11 THEN '40HC x ' || CAST(n AS VARCHAR) WHEN 14 THEN 'ONE x 20''GP' ELSE si_container_count END AS bl_container_count,
             CASE v WHEN 0 THEN CAST(w + 500 AS VARCHAR) || ' KG' WHEN 2 THEN '???' WHEN 5 THEN CAST(w AS VARCHAR) || ' LBS'
                    WHEN 9 THEN CAST(w // 1000 AS VARCHAR) || '.' || lpad(CAST(w % 1000 AS VARCHAR), 3, '0') || ' MT' WHEN 13 THEN CAST(w AS VARCHAR) || 'B KG' ELSE si_gross_weight_kg END AS bl_gross_weight_kg FROM side),
    val AS ({' UNION ALL '.join(f"SELECT case_id, v, {q(f)} AS field, {i} AS field_ord, si_{f} AS si_raw, bl_{f} AS bl_raw FROM pair" for i, f in enumerate(FIELDS, 1))})
"""

_METRIC = r"(?i)(?:^|[^A-Z])(KGS?|KGM|KGRS?|KILOS?|KILOGRAMS?|KILOGRAMMES?|KILOGRAMOS?|K\.G\.S?\.?|MTS?|TONS?|TONNES?)(?:[^A-Z]|$)"
_POUND = r"(?i)(?:^|[^A-Z])(?:LBS?|LBR|POUNDS?|L\.B\.S?\.?)(?:[^A-Z]|$)"
_SQUASH = lambda x: rf"upper(trim(regexp_replace({x}, '\s+', ' ', 'g')))"
_STATE = lambda s: f"CASE WHEN {s}_raw IS NULL THEN 'missing' WHEN {is_blank(s + '_raw')} THEN 'blank' WHEN {s}_key IS NULL THEN 'unparseable' ELSE 'usable' END"
_LOOKS = lambda a, b: f"({a} <> {b} AND translate({a}, '0158', 'OISB') = translate({b}, '0158', 'OISB'))"

#: CTE cmp: val with keys, states, verdict and reason.
COMPARED = f"""
    keyed AS (SELECT *, {key('field', 'si_raw')} AS si_key, {key('field', 'bl_raw')} AS bl_key FROM val),
    stated AS (SELECT *, {_STATE('si')} AS si_state, {_STATE('bl')} AS bl_state,
               CASE WHEN field = 'gross_weight_kg' THEN abs({weight('si_raw')} - {weight('bl_raw')}) < 0.5 ELSE si_key = bl_key END AS same FROM keyed),
    reasoned AS (SELECT *, CASE WHEN si_state <> 'usable' THEN 'si_' || si_state WHEN bl_state <> 'usable' THEN 'bl_' || bl_state
                 WHEN NOT same AND field_ord <= 5 AND ({_LOOKS('si_key', 'bl_key')} OR {_LOOKS(_SQUASH('si_raw'), _SQUASH('bl_raw'))}) THEN 'ocr_confusable'
                 WHEN same AND field = 'gross_weight_kg' AND regexp_matches(si_raw, '{_METRIC}') <> regexp_matches(bl_raw, '{_METRIC}') AND regexp_matches(si_raw, '{_POUND}') <> regexp_matches(bl_raw, '{_POUND}') THEN 'unit_differs' END AS reason FROM stated),
    cmp AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'UNCOMPARABLE' WHEN same THEN 'MATCH' ELSE 'MISMATCH' END AS verdict FROM reasoned)
"""

_LISTED = lambda v: f"coalesce(string_agg(field, ',' ORDER BY field) FILTER (WHERE verdict = '{v}'), '')"
#: CTE outcome: one row a case by the verdicts alone (no gate).
OUTCOME = f"""
    outcome AS (SELECT case_id, {_LISTED('MISMATCH')} AS defect_fields, {_LISTED('UNCOMPARABLE')} AS uncomparable_fields, count(*) FILTER (WHERE verdict = 'MATCH') AS n_matched,
                CASE WHEN count(*) FILTER (WHERE verdict = 'UNCOMPARABLE') > 0 THEN 'NEEDS_REVIEW' WHEN count(*) FILTER (WHERE verdict = 'MISMATCH') > 0 THEN 'MISMATCH' ELSE 'OK' END AS status,
                min(CASE WHEN verdict = 'UNCOMPARABLE' THEN CASE WHEN reason IN ('ocr_confusable', 'unit_differs') THEN 'unreadable' ELSE 'missing_value' END END) AS review_reason
                FROM cmp GROUP BY case_id)
"""


def _re2(pattern: str) -> str:
    """A rule's pattern without look-ahead, for tests of existence only."""
    return pattern.replace(r"(?![A-Z])", "(?:[^A-Z]|$)").replace(r"(?!SI\b)", "")


def _mails() -> str:
    from .sources.derive import MAILS

    rows = ", ".join(f"({i}, {q(s)}, replace({q(b)}, '\\n', chr(10)), {q(w)})".replace("\n", "' || chr(10) || '") for i, (s, b, w) in enumerate(MAILS))
    return f"""mail_t(k, subject, body, sender) AS (VALUES {rows}),
    mail AS (SELECT o_orderkey AS email_id, replace(subject, '{{n}}', CAST(o_orderkey AS VARCHAR)) AS subject, replace(body, '{{n}}', CAST(o_orderkey AS VARCHAR)) AS body, sender FROM orders JOIN mail_t ON o_orderkey % 12 = k)"""


def _views() -> str:
    from .operators import classify as c

    return rf"""
    cut AS (SELECT *, upper(trim(regexp_replace(regexp_replace(subject, {q(c._REPLY)}, ''), '\s+', ' ', 'g'))) AS v_subject, upper(trim(sender)) AS v_sender,
            string_split_regex(regexp_replace(body, '(?i)\A\s*(?:WARNING|CAUTION|\[?EXTERNAL\]?)\b[^\n]*\n?', ''), {q(c.QUOTE)})[1] AS unquoted FROM mail),
    bodies AS (SELECT *, upper({strip(f"string_split_regex(unquoted, {q(c.SIGNOFF)})[1]")}) AS v_body FROM cut),
    view AS (SELECT *, coalesce(list_filter(list_transform(string_split_regex(v_body, '\n\s*\n'), lambda p: {strip('p')}), lambda p: p <> '' AND NOT (regexp_matches(p, '{c.SALUTATION}') AND length(p) <= 40))[1], '') AS v_body_head,
             v_subject || chr(10) || v_body AS v_any FROM bodies)"""


def _rule_terms() -> str:
    from .functions.rules import EMAIL_RULES

    out = []
    for i, (name, category, view, weight_, pattern) in enumerate(EMAIL_RULES):
        if pattern is None:
            gain = rf"least(6, len(list_distinct(list_filter(list_transform(regexp_extract_all(v_body, '(?m)^[ \t]*([A-Z][A-Z0-9 ./&()''\-]{{1,40}}?)[ \t]*:', 1), lambda x: {resolve(basic('x'))}), lambda f: f IS NOT NULL)))) * 1.0"
        else:
            more = r" AND NOT regexp_matches(v_subject, '^SI\b')" if r"(?!SI\b)" in pattern else ""
            gain = f"CASE WHEN regexp_matches(v_{view}, {q('(?m)' + _re2(pattern))}){more} THEN {weight_} ELSE 0 END"
        out.append(f"SELECT email_id, {i} AS ord, {q(name)} AS name, {q(category)} AS category, CAST({gain} AS DOUBLE) AS gain FROM view")
    return " UNION ALL ".join(out)


#: CTEs mail, view, hit (a row a rule that fires) and ranked (a row a mail and category).
MAILS = f"""{_mails()}, {_views()},
    hit AS (SELECT * FROM ({_rule_terms()}) WHERE gain > 0),
    cats(category, i) AS (VALUES ('SPAM', 0), ('GENERAL', 1), ('INVOICE_QUERY', 2), ('SI_REQUEST', 3), ('BL_COMPARISON', 4)),
    scored AS (SELECT m.email_id, c.category, c.i, coalesce(sum(h.gain), 0) AS s FROM mail m CROSS JOIN cats c LEFT JOIN hit h ON h.email_id = m.email_id AND h.category = c.category GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER w AS rank, s - lead(s) OVER w AS lead_ FROM scored WINDOW w AS (PARTITION BY email_id ORDER BY s DESC, i))"""


def _signals(table: list, head: str) -> str:
    terms = []
    for _, w, pattern, view in table:
        p = q("(?m)" + _re2(pattern))
        terms.append(f"CASE WHEN regexp_matches(v_subject, {p}) THEN {w} ELSE 0 END" if view == "subject" else f"CASE WHEN regexp_matches({head}, {p}) THEN {w} WHEN regexp_matches(v_body, {p}) THEN {w / 2} ELSE 0 END")
    return "CAST(" + " + ".join(terms) + " AS DOUBLE)"


def intent() -> str:
    from .functions.rules import ATTACHED, DRAFT

    head = "CASE WHEN v_body_head = '' THEN v_body ELSE v_body_head END"
    return f"intent AS (SELECT email_id, {_signals(ATTACHED, head)} AS a, {_signals(DRAFT, head)} AS d FROM view)"


def _lines_of(side: str, wording: list[str]) -> str:
    """Labelled lines of a side's seven values; lines of null values are left out, as concat_ws does."""
    value = lambda f: "CASE WHEN v = 7 THEN replace(bl_consignee, ' TRADING', chr(10) || '  TRADING') ELSE bl_consignee END" if (side, f) == ("bl", "consignee") else f"{side}_{f}"
    return ", ".join(f"{q(label + ': ')} || {value(f)}" for f, label in zip(FIELDS, wording, strict=True))


def texts() -> str:
    """CTE doc_text: case_id, v, side, text of both attachments of each pair."""
    from .sources.derive import WORDINGS

    title = "CASE WHEN v = 10 THEN 'COMMERCIAL INVOICE' || chr(10) || '====' || chr(10) || 'Invoice No.: 77' || chr(10) || 'Total Amount: 5' ELSE 'DRAFT BILL OF LADING' || chr(10) || '====' || chr(10) || 'B/L No.: 88' END"
    drafts = " ".join(f"WHEN {i} THEN concat_ws(chr(10), {title}, {_lines_of('bl', w)})" for i, w in enumerate(WORDINGS))
    return f"""doc_text AS (
        SELECT case_id, v, 'SI' AS side, concat_ws(chr(10), 'SHIPPING INSTRUCTION', '====', 'Booking Reference: BK' || CAST(case_id AS VARCHAR), {_lines_of('si', WORDINGS[0])}, 'Net Weight: 1 KG') AS text FROM pair
        UNION ALL SELECT case_id, v, 'BL', CASE case_id % 3 {drafts} END FROM pair)"""


def visible(x: str) -> str:
    """The sender's own words of a body."""
    from .operators import assist as a
    from .operators import classify as c

    cut = rf"string_split_regex(regexp_replace({x}, '(?i)\A\s*(?:WARNING|CAUTION|\[?EXTERNAL\]?)\b[^\n]*\n?', ''), {q(c.QUOTE + '|(?im:' + a.FORWARDED + ')')})[1]"
    return strip(rf"regexp_replace(string_split_regex({cut}, {q(c.SIGNOFF)})[1], '\n{{3,}}', chr(10) || chr(10), 'g')")
