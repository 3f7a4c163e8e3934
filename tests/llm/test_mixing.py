import random

import pytest

from dockett.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    rng = random.Random(3)
    data = []
    for i in range(900):
        source = rng.choice(["a", "b", "B", "é", "zz", None, "hot", "hot", "hot", "hot", "hot"])
        data.append((i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 60))), "en", source, 1))
    data += [(900, None, None, "a", None), (901, "", "en", "only-empty", 0), (902, " \n\t", "en", None, 1), (None, "x y z", "en", "b", 1), (5, "again here", "en", "a", 1), (5, "again here", "en", "a", 1)]
    data += [(903, "word " * 4000, "en", "long", 1), (904, "tiny words", "en", "tiny", 1)]
    return spark.createDataFrame(data, SCHEMA), data


def brute_targets(sizes):
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(keys)}
    total, stopped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in keys if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_taken(spark):
    docs, data = documents(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(data)
    sizes = {}
    for _, t, _, s, _ in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = brute_targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], abs=12 + 0.01 * want[s])
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


@pytest.mark.parametrize("slots", [1, 8, 64, 1024])
def test_targets_met_by_wide_slots(spark, slots):
    """Sources far smaller than a slot meet their targets, and whole small sources stay in the mix."""
    docs, data = documents(spark)
    got = mixing.mix(docs, slots=slots).collect()
    taken, target = {}, {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and 0 <= r.copies <= 3
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert len(got) == len(data) and all(abs(taken[s] - target[s]) <= 1 for s in target)
    tiny = next(r for r in got if r.source == "tiny")
    assert (tiny.target, tiny.taken, tiny.copies) == (6, 6, 3)


def test_mixed_keeps_columns_and_repeats(spark):
    docs, _ = documents(spark)
    mixed = mixing.mixed(docs.withColumn("rank", docs.doc_id))
    assert mixed.columns == [*docs.columns, "rank"]
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert copies == {k: v for k, v in want.items() if v} and max(v for k, v in copies.items() if k != 5) <= 3


def test_schedule_ranks_slots(spark):
    shares = spark.createDataFrame([("0a", 0.0, 0.2), ("0b", 0.2, 0.2), ("0c", 0.2, 0.7), ("1", 0.7, 1.0)], "source string, upto_low double, upto double")
    rows = mixing.schedule(shares, 10_000).orderBy("slot").collect()
    assert len(rows) == 10_000
    seen = {}
    for r in rows:
        assert r.rank == seen.get(r.source, 0)
        seen[r.source] = r.rank + 1
        point = r.slot * mixing.PHI % 1
        assert {"0a": point < 0.2, "0c": 0.2 <= point < 0.7, "1": point >= 0.7}[r.source]
    assert all(abs(seen[s] - n) < 12 for s, n in (("0a", 2000), ("0c", 5000), ("1", 3000)))


def test_nothing_to_mix(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 0)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in got) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
