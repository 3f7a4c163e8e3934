"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import edit_counts, exact_dedup, language, lexical, mixing, piece_sampling, simhash, sstable, substring_dedup, topk, toxicity, url_filter, vector_codes
from .common import public_tokenizer, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_table(sstable.write_table(table(spark, sf_dir, "documents"), public_tokenizer("word_bpe_49k.json"), end_id=1))


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integers(table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return edit_counts.edit_aware_counts(docs, edit_counts.scripted_edits(docs), public_tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op8_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The pieces are the result; the digest columns say what they are.
    return piece_sampling.sampled_pieces(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"), k=2)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), radius=2, shingle=3)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), k=10)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings")).drop("label")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"), public_tokenizer("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_exact_dedup, op3_token_shards, op4_top_k, op5_toxicity, op6_edit_counts, op7_url_filter, op8_piece_sampling, op9_substring_dedup, op10_simhash, op11_lexical_search, op12_vector_codes, op13_language)}

_WS = r"[\x20\x09-\x0D]+"


def _codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Vector codes in SQL: a block of tables for each round, and at last the codes."""
    near = """
        near{r} AS MATERIALIZED (SELECT vec_id, part, x, label, entry, far FROM (
            SELECT p.vec_id, p.part, p.x, p.label, b.entry, list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS far FROM p JOIN book{r} b USING (part))
            QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1)"""
    step = """
        mean{r} AS (SELECT part, entry, list(CAST(s // n - CAST(s % n < 0 AS BIGINT) AS BIGINT) ORDER BY i) AS c FROM (
            SELECT part, entry, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM near{r}) GROUP BY part, entry, i) GROUP BY part, entry),
        book{next} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (part, entry))"""
    blocks = [near.format(r=r) + "," + step.format(r=r, next=r + 1) for r in range(rounds)] + [near.format(r=rounds)]
    return f"""
        WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        p AS MATERIALIZED (SELECT vec_id, label, part, v[part * len(v) // {parts} + 1:(part + 1) * len(v) // {parts}] AS x FROM k, (SELECT unnest(range({parts})) AS part)),
        book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {entries})),
        {",".join(blocks)},
        digest AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, i)) AS h FROM (SELECT part, entry, unnest(c) AS v, unnest(range(1, len(c) + 1)) AS i FROM book{rounds})),
        coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, digest
    """


ORACLE_SQL = {
    "op2_exact_dedup": rf"""
        WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_WS}', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM n WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op4_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
    """,
    "op7_url_filter": r"""
        WITH u AS (
            SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
        f AS (SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS n
              FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE n = 1
    """,
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
        s AS (SELECT doc_id, i, word, md5(string_agg(word, ' ') OVER ahead) AS h, count(*) OVER ahead AS n
              FROM p WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
        r AS (SELECT doc_id, i, word, n = 20 AND row_number() OVER (PARTITION BY h, n ORDER BY doc_id, i) > 1 AS later FROM s),
        c AS (SELECT doc_id, i, word, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
        k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
        FROM d LEFT JOIN k USING (doc_id)
    """,
    "op11_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
        c AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM d),
        tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(t) AS term FROM d) GROUP BY row, term),
        i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, c GROUP BY term),
        m AS (SELECT row, doc_id, 25 + (75 * len(t) * docs) // terms AS m FROM d, c WHERE len(t) > 0),
        s AS (SELECT item_id, row, doc_id, CAST(sum(w * times * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
              FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item_id, row, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
        QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
    """,
    "op12_vector_codes": _codes_sql(),
}
