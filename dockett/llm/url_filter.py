"""URL filters: a blocked Bloom filter of listed keys passes possible hits to an exact hash join.

A listed key is a canonical host and the beginning of a path. A url has one possible key for each ending
of its host at a label and each listed path length; those that the filter passes are joined with the
list, which removes false positives, and the longest real hit decides. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dealt_join, materialize

#: Bits of the filter for each key, bits set in one 64-bit block for a key, and the largest filter (in
#: blocks, 64 kB) that is put into the plan as a literal. A larger one is joined by block number.
BITS_PER_KEY, PROBES, LITERAL_BLOCKS = 16, 4, 8192

# The production rules, (host, beginning of the path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or for null."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without :// or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """The bits of a key within its block."""
    h = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 6 * i), F.lit(64)).cast("int")))
    return mask


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, bits): the blocked Bloom filter of a column named key."""
    return keys.select(_block(F.col("key"), blocks).alias("block"), _mask(F.col("key")).alias("m")).groupBy("block").agg(F.bit_or("m").alias("bits"))


def suffixes(host: Column) -> Column:
    """A host and its endings after each dot."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    listed has (host, path, verdict). A rule fits its host and every subdomain if the path starts with the
    rule's. The longest host and path together wins; of equally long ones the longer host, then block. Null
    urls and urls without :// have empty host and path and match no rule; unmatched urls get `otherwise`.
    Null ids and repeated rows keep their rows; an empty list or table is no error.
    """
    rules = listed.select(lower_ascii(F.col("host")).alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v")).filter("h is not null and p is not null and v is not null")
    # \x00 cannot be in a host, so keys are unambiguous. Of rules with one key, block counts.
    best = rules.groupBy("h", "p").agg(F.max("v").alias("v")).select(F.concat_ws("\0", "h", "p").alias("key"), F.concat("h", "p").alias("rule"), F.length("h").alias("hl"), F.col("v").alias("listed"))
    n, lengths = rules.agg(F.count(F.lit(1)), F.array_sort(F.collect_set(F.length("p")))).first()  # at most one per path length
    blocks = 1 << max(4, (n * BITS_PER_KEY // 64).bit_length())

    # Equal rows are judged once; the exchange by (id, url) serves the last grouping as well.
    rows = pages.groupBy(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).agg(F.count(F.lit(1)).alias("copies"))
    cut = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    sizes = F.array(*[F.lit(k) for k in lengths]).cast("array<int>")
    fits = F.filter(sizes, lambda k: k <= F.length("path"))
    keys = F.flatten(F.transform(suffixes(F.col("host")), lambda h: F.transform(fits, lambda k: F.concat_ws("\0", h, F.substring(F.col("path"), F.lit(1), k)))))
    keys = F.when(F.col("host") != "", keys).otherwise(F.array().cast("array<string>"))
    one = ["page_id", "url", "copies", "host", "path"]
    filter_ = bloom(best, blocks)
    if blocks <= LITERAL_BLOCKS:
        bits = [0] * blocks
        for r in filter_.collect():
            bits[r.block] = r.bits
        table = F.lit(bits).cast("array<bigint>")
        passed = F.filter(keys, lambda k: F.element_at(table, _block(k, blocks) + 1).bitwiseAND(_mask(k)) == _mask(k))
        found = cut.select(*one, F.explode_outer(passed).alias("key")).join(best, "key", "left")
    else:
        # Keys meet the filter's block first; only pages with a key that passes go on to the list. Blocks and keys that many
        # pages have are dealt over as many parts as their counts ask for.
        every = materialize(cut.select("page_id", "url", F.explode(keys).alias("key")).withColumns({"block": _block(F.col("key"), blocks), "mask": _mask(F.col("key"))}), "url-keys")
        tested = dealt_join(every, filter_, ["block"], by=["page_id", "url", "key"])
        passed = materialize(tested.filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("page_id", "url", "key"), "possible-keys")
        hits = dealt_join(passed, best, ["key"], by=["page_id", "url"]).drop("key")
        found = cut.alias("c").join(hits.alias("h"), F.expr("c.page_id <=> h.page_id and c.url <=> h.url"), "left").select(*[F.col(f"c.{c}") for c in one], "rule", "hl", "listed")
    score = F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("n"), "hl", F.col("listed").alias("v"), "rule"))
    judged = found.groupBy("page_id", "url").agg(F.first("copies").alias("copies"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(score).alias("best"))
    spread = judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(otherwise)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return spread.drop("copy")


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """judge with the production rules."""
    return judge(pages, pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string"), id_col, url_col)
