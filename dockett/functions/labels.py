"""Resolving a document's label wording to one of the seven fields: known wordings, ordered rules, similarity."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import basic

# Known wordings of each field.
SYNONYMS = {
    "shipper": ["Shipper", "Shipper/Exporter", "Shipper (Principal or Seller)", "Exporter", "Consignor", "Shipper or Exporter", "Shipper Name", "Shipper/Consignor"],
    "consignee": ["Consignee", "Consignee (Non-Negotiable)", "To the Order of", "To Order of", "Consignee Name", "Consigned to", "Receiver", "Consignee (Complete Name and Address)"],
    "notify_party": ["Notify Party", "Notify", "Notify Party/Intermediate Consignee", "Notify Address", "Also Notify", "Notify Party (Complete Name and Address)", "Intermediate Consignee"],
    "port_of_loading": ["Port of Loading", "Port of Loading (POL)", "Load Port", "POL", "Loading Port", "Port of Receipt", "Port of Lading"],
    "port_of_discharge": ["Port of Discharge", "Port of Discharge (POD)", "Discharge Port", "POD", "Discharging Port", "Port of Delivery", "Destination Port"],
    "container_count": ["No. of Containers", "Total Containers", "No. of Containers or Packages", "Container Count", "Number of Containers", "Container Qty", "Quantity of Containers", "Total No. of Containers", "Containers", "No of Ctnrs", "Ctr Count"],
    "gross_weight_kg": ["Gross Weight (KG)", "Gross Wt (kgs)", "Gross Weight", "GROSS WEIGHT", "Total Gross Weight", "Gross Weight (KGS)", "Gross Wt", "G.W.", "Gross Weight in KG", "Total Gross Wt"],
}
# Wordings that are none of the fields.
IGNORED = [
    "Container No.", "Container Number", "Container Numbers", "Container No", "Net Weight", "Net Wt", "N.W.", "Tare Weight", "Measurement",
    "Description of Goods", "Kinds of Packages; Description of Goods", "Description", "Commodity", "Marks and Numbers",
    "Vessel", "Ocean Vessel", "Vessel Name", "Export Carrier (vessel, voyage)", "Voyage", "Voyage No.", "Voy.", "Voy. No",
    "Booking Reference", "Booking No.", "Booking Ref", "B/L No.", "BL No.", "Bill of Lading No.", "B/L Number", "HS Code", "Freight", "OC No.",
    "Order No.", "Invoice No.", "Place of Delivery", "Place of Receipt", "Shipper/Forwarders Reference", "Shipper's Reference",
    "Forwarder's Reference", "Forwarders Reference", "Shipper's Reference Number", "Shipper's Reference No.", "Shipper's Ref. No.",
    "Shipper's Ref", "Shipper - reference", "Shipper Reference", "Consignee's Reference", "Consignee Reference", "Consignee's Ref",
    "Shipper's declared value", "Shipper's declared value of", "Above Particulars as declared by Shipper", "Particulars furnished by Shipper",
    "Place of Final Delivery", "Port of Final Delivery", "Final Delivery", "Delivery", "Negotiable", "Non-Negotiable", "Not Negotiable", "Complete", "Port of",
]
# Wordings that resolve only as they are.
EXACT_ONLY = {"port_of_discharge": ["Port of Unlading", "Port of Unloading", "Unloading Port"]}
# Rules in order; the first that matches wins, None for none of the fields.
RULES: list[tuple[str | None, str]] = [
    (None, r"^CONTAINERS?\s+(NO|NOS|NUMBERS?)$"),
    (None, r"^(NET|TARE)\s+(WEIGHT|WT)"),
    (None, r"\b(MARKS|MKS)\b"),
    ("notify_party", r"\bNOTIFY\b"),
    ("shipper", r"\b(SHIPPER|EXPORTER|CONSIGNOR)\b"),
    ("consignee", r"\b(CONSIGNEE|TO THE ORDER OF|TO ORDER OF)\b"),
    (None, r"\b(AGENTS?|ENDORSEMENTS?)\b"),
    ("port_of_loading", r"\b(PORT OF LOADING|LOADING PORT|LOAD PORT|POL)\b"),
    ("port_of_discharge", r"\b(PORT OF DISCHARGE|DISCHARGE PORT|DISCHARGING PORT|POD)\b"),
    ("container_count", r"\bCONTAINERS?\b.*\b(COUNT|QTY|QUANTITY)\b|\b(NO|NOS|NUMBER|TOTAL|QTY|QUANTITY)\b.*\bCONTAINERS?\b|^CONTAINERS?$"),
    ("gross_weight_kg", r"\bGROSS\b.*(WEIGHT|WT)"),
    ("gross_weight_kg", r"\bG\s*W\b"),
    (None, r"\b(DESCRIPTION|COMMODITY|MARKS)\b"),
    (None, r"\b(VESSEL|VOYAGE|VOY|CARRIER)\b"),
    (None, r"\b(BOOKING|HS\s*CODE|FREIGHT|INVOICE|ORDER)\b"),
    (None, r"^(B\s*L|BILL OF LADING)\s*(NO|NUMBER)"),
]
FUZZY_CUTOFF, FUZZY_KEY_CHARS = 88.0, 6
# What token and partial ratios count, and how many times longer one text is where each is taken.
TOKENS, PARTIAL, PARTIAL_FAR, LONGER, MUCH_LONGER = 0.95, 0.9, 0.6, 1.5, 8
#: Keys compared at once, and remembered by a worker.
BATCH, REMEMBERED = 4096, 200_000


def key(text: str) -> str:
    """What basic() makes of ASCII text; used for the constant tables."""
    return " ".join(re.sub("[^A-Z0-9]+", " ", text.upper().replace("&", " AND ")).split())


def _keys(wordings: list[str]) -> list[str]:
    return list(dict.fromkeys(map(key, wordings)))


FUZZY_POOL = [(k, f) for f, v in SYNONYMS.items() for k in _keys(v) if len(k) >= FUZZY_KEY_CHARS]


def resolve(label: Column) -> Column:
    """A struct (field, step): step 1 known wording, 2 rule, 0 undecided. field is null for none of the seven."""
    return resolve_key(basic(label))


def resolve_key(k: Column) -> Column:
    """resolve() of a label's basic form, which should be a column of its own: every rule asks for it."""
    answer = lambda f, n: F.struct(F.lit(f).cast("string").alias("field"), F.lit(n).alias("step"))
    chain = F.when(k == "", answer(None, 1)).when(k.isin(_keys(IGNORED)), answer(None, 1))
    for field, wordings in [*SYNONYMS.items(), *EXACT_ONLY.items()]:
        chain = chain.when(k.isin(_keys(wordings)), answer(field, 1))
    for field, pattern in RULES:
        chain = chain.when(k.rlike(pattern), answer(field, 2))
    return chain.otherwise(answer(None, 0))


def _places(text: str) -> dict[str, int]:
    """For each character a bit set of its places."""
    found: dict[str, int] = {}
    for i, c in enumerate(text):
        found[c] = found.get(c, 0) | 1 << i
    return found


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence: one bit a character of a, all moved on at once by each one of b."""
    places, all_ = _places(a), (1 << len(a)) - 1
    row = all_
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & all_
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised indel similarity in percent."""
    return 200.0 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a window of its length, cut off at the longer text's ends."""
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    cuts = {b[max(0, i) : i + len(a)] for i in range(1 - len(a), len(b))}
    return max(ratio(a, c) for c in cuts)


def _token_views(a: str, b: str) -> tuple[str, str, str, str, str]:
    x, y = set(a.split()), set(b.split())
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    return " ".join(sorted(a.split())), " ".join(sorted(b.split())), both, left, right


def token_ratio(a: str, b: str) -> float:
    """The better of the ratios of sorted tokens and of token sets."""
    sa, sb, both, left, right = _token_views(a, b)
    if both and (not left or not right):
        return 100.0
    found = max(ratio(sa, sb), ratio(f"{both} {left}".strip(), f"{both} {right}".strip()))
    if both:
        found = max(found, ratio(both, f"{both} {left}"), ratio(both, f"{both} {right}"))
    return found


def partial_token_ratio(a: str, b: str) -> float:
    sa, sb, both, left, right = _token_views(a, b)
    return 100.0 if both else max(partial_ratio(sa, sb), partial_ratio(left, right))


def weighted_ratio(a: str, b: str) -> float:
    """The published weighted ratio: whole and token ratios, partial ones if the lengths differ much."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    whole = ratio(a, b)
    if longer < LONGER:
        return max(whole, TOKENS * token_ratio(a, b))
    scale = PARTIAL if longer <= MUCH_LONGER else PARTIAL_FAR
    return max(whole, scale * partial_ratio(a, b), TOKENS * scale * partial_token_ratio(a, b))


def _counts(texts: list[str]) -> np.ndarray:
    """How often each of the letters, digits and the space is in each text."""
    codes = np.frombuffer("".join(texts).encode("ascii", "replace"), dtype=np.uint8) & 63
    row = np.repeat(np.arange(len(texts)), list(map(len, texts)))
    return np.bincount(row * 64 + codes, minlength=64 * len(texts)).reshape(-1, 64).astype(np.int16)


class Candidates:
    """The known wordings, and for keys those that can reach the cutoff at all.

    A common subsequence has no more of a character than either text, which bounds the ratios from above, of the whole
    texts and of their sets of tokens alike; and where tokens are shared, those alone are compared by their lengths.
    Of wordings shorter than the piece of a text in which one missing character costs too much, only whole ones count.
    """

    def __init__(self, pool: list[str]) -> None:
        self.pool = pool
        self.sizes, self.counts = np.array(list(map(len, pool))), _counts(pool)
        self.tokens: dict[str, int] = {}
        for i, wording in enumerate(pool):
            for t in wording.split():
                self.tokens[t] = self.tokens.get(t, 0) | 1 << i
        self.sets = [" ".join(sorted(set(w.split()))) for w in pool]
        self.set_sizes, self.set_counts = np.array(list(map(len, self.sets))), _counts(self.sets)

    def of(self, keys: list[str]) -> Iterator[tuple[int, list[int]]]:
        """Numbers of keys and of the wordings that may be similar to them, in order."""
        sizes, sets = np.array(list(map(len, keys)))[:, None], [" ".join(sorted(set(k.split()))) for k in keys]
        set_sizes = np.array(list(map(len, sets)))[:, None]
        common = lambda a, b: np.column_stack([np.minimum(a, one).sum(axis=1) for one in b])
        whole, tokens = common(_counts(keys), self.counts), common(_counts(sets), self.set_counts)
        with np.errstate(divide="ignore", invalid="ignore"):
            longer = np.maximum(sizes, self.sizes) / np.minimum(sizes, self.sizes)
            alike = (200 * whole / (sizes + self.sizes) >= FUZZY_CUTOFF) | (TOKENS * 200 * tokens / (set_sizes + self.set_sizes) >= FUZZY_CUTOFF)
            short = np.minimum(sizes, self.sizes)
            inside = PARTIAL * 200 * whole / (short + whole) >= FUZZY_CUTOFF
        close = longer < LONGER
        found = np.where(close, alike, inside & (longer <= MUCH_LONGER))
        # Wordings that share a token, for the comparison of what is shared with the rest.
        shared = [reduce(or_, (self.tokens.get(t, 0) for t in k.split()), 0) for k in keys]
        exact = PARTIAL * 100 * (2 * short - 2) / (2 * short - 1) < FUZZY_CUTOFF
        for i in range(len(keys)):
            mine = [int(j) for j in np.flatnonzero(found[i]) if close[i, j] or not exact[i, j] or keys[i] in self.pool[j] or self.pool[j] in keys[i]]
            if shared[i]:
                mine = sorted({*mine, *(j for j in range(len(self.pool)) if shared[i] >> j & 1 and close[i, j] and self._by_shared(sets[i], j))})
            if mine:
                yield i, mine

    def _by_shared(self, tokens: str, j: int) -> bool:
        """The shared tokens alone are similar enough to all of either side's."""
        a, b = set(tokens.split()), set(self.sets[j].split())
        both = len(" ".join(a & b))
        return TOKENS * 200 * both / (both + min(len(tokens), len(self.sets[j]))) >= FUZZY_CUTOFF


_CANDIDATES = Candidates([k for k, _ in FUZZY_POOL])


def most_similar(keys: list[str]) -> list[str | None]:
    """For each key the field of the most similar known wording at the cutoff or above, first of equals; short keys have
    none. Only wordings whose upper bound reaches the cutoff are scored."""
    out: list[str | None] = [None] * len(keys)
    asked = [i for i, k in enumerate(keys) if len(k) >= 8 or len(k.split()) >= 2]
    for a in range(0, len(asked), BATCH):
        own = asked[a : a + BATCH]
        for i, mine in _CANDIDATES.of([keys[i] for i in own]):
            best, field = FUZZY_CUTOFF, None
            for j in mine:
                score = weighted_ratio(keys[own[i]], FUZZY_POOL[j][0])
                if score > best or (score == best and field is None):
                    best, field = score, FUZZY_POOL[j][1]
            out[own[i]] = field
    return out


#: Keys that a worker has settled.
_SETTLED: dict[str, str | None] = {}


def _remembered(distinct: list[str | None]) -> list[str | None]:
    """most_similar of keys that differ, each asked once a worker."""
    new = [k for k in distinct if k is not None and k not in _SETTLED]
    if len(_SETTLED) + len(new) > REMEMBERED:
        _SETTLED.clear()
        new = [k for k in distinct if k is not None]
    _SETTLED.update(zip(new, most_similar(new), strict=True))
    return [*map(_SETTLED.get, distinct)]


@F.pandas_udf(StringType())
def _similar(keys: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(keys)
    return pd.Series(np.array([*_remembered(list(distinct)), None], dtype=object)[codes], index=keys.index)


@F.arrow_udf(ArrayType(StringType()))
def similar_fields(keys: pa.Array) -> pa.Array:
    """most_similar of the keys of each list; null stays null, and a null list becomes an empty one."""
    coded = keys.flatten().dictionary_encode()
    fields = pa.array(_remembered(coded.dictionary.to_pylist()), pa.string()).take(coded.indices)
    sizes = pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), fields)


def with_fields(df: DataFrame, label: str, into: str = "field", fuzzy: bool = True) -> DataFrame:
    """df with the field of its label. Rows stay where they are: an undecided label's key, null for all others, goes to
    Python in columns, where each distinct one is compared once a worker."""
    given = df.withColumn("__k", basic(F.col(label))).withColumn("__r", resolve_key(F.col("__k")))
    if not fuzzy:
        return given.withColumn(into, F.col("__r.field")).drop("__k", "__r")
    similar = _similar(F.when(F.col("__r.step") == 0, F.col("__k")))
    return given.withColumn("__f", similar).withColumn(into, F.coalesce("__r.field", "__f")).drop("__k", "__r", "__f")
