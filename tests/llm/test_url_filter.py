import random
import re

import pytest

from dockett.llm import url_filter

EDGE = [None, "", "example.net/en/", "http://", "http:///de/", "HTTP://EXAMPLE.NET/en/1", "http://a.Example.net/fr/", "https://net/x", "https://xnet/x", "http://x.net", "http://x.net?q=/", "http://x.net#/a",
        "http://example.com/de/a?b#c", "http://example.com/DE/", "http://example.com.net/de/", "http://a.b.org/fr/x", "http://org/fr/", "http://org/fr", "a://b.org/fr/://example.com/de/", "ftp://u@example.net:80/en/", "http://ÉXAMPLE.net/x", "http://.net/", "http://..org/fr/\nx", "//net/", "\n://net/a\nb"]


def brute(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and host]
    return host, path, max(fit)[3] if fit else None, max(fit)[2] if fit else "allow"


@pytest.mark.parametrize("literal", [8192, 1])
def test_rules_against_brute_force(spark, monkeypatch, literal):
    monkeypatch.setattr(url_filter, "LITERAL_BLOCKS", literal)
    rng = random.Random(2)
    hosts, paths = ["net", "a.net", "b.a.net", "org", "x.org", "com", "é.com"], ["/", "/a", "/a/", "/a/b", "", "/ab"]
    rules = sorted({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((rng.choice(hosts), rng.choice(paths)) for _ in range(25))}.values())
    urls = EDGE + [f"http://{rng.choice(['', 'q.', 'A.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '1', '?x', '#y'])}" for _ in range(300)]
    data = [(i if i % 17 else None, u, "rule", "x") for i, u in enumerate(urls)] + [(3, urls[3], "rule", "x")]
    pages = spark.createDataFrame(data, "page_id long, url string, rule string, host string")
    for given in (rules, url_filter.RULES, []):
        got = url_filter.judge(pages, spark.createDataFrame(given, "host string, path string, verdict string"))
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((d[0], *brute(d[1], given))) for d in data)


def test_no_pages(spark):
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    from pyspark.sql import functions as F

    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bits = {r.block: r.bits for r in url_filter.bloom(keys, 2048).collect()}
    probes = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), url_filter._block(F.concat(F.lit("k"), "id"), 2048).alias("b"), url_filter._mask(F.concat(F.lit("k"), "id")).alias("m")).collect()
    hit = [bits.get(r.b, 0) & r.m == r.m for r in probes]
    assert all(hit[:5000]) and sum(hit[5000:]) < 0.02 * 15_000
