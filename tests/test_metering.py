"""Questions under a budget come out as if asked one after the other."""

import random

import pytest

from dockett.operators import metering
from dockett.storage import running

COLUMNS = "at long, key string, purpose string, model string, said string, input_tokens long, cached_tokens long, output_tokens long"


def one_by_one(rows, cache, budget):
    known, total, spent, out = {k: (i, o) for k, i, o in cache}, 0, False, {}
    for at, key, _, model, said, fresh, cached, given in sorted(rows):
        if key in known:
            out[at] = ("hit", *known[key], 0)
        elif spent:
            out[at] = ("unavailable", 0, 0, 0)
        elif said != "answered":
            out[at] = ("refused" if said == "refused" else "failed", 0, 0, 0)
        else:
            a, b, c = (round(float(p) * 1000) for p in metering.PRICES[model])
            fresh, cached, given = fresh or 0, cached or 0, given or 0
            price = max(0, fresh - cached) * a + cached * b + given * c
            known[key] = (fresh, given)
            out[at] = ("answered", fresh, given, price)
            total += price
            spent = total >= round(float(budget) * 1e9)
    return out


@pytest.mark.parametrize(("budget", "seed"), [("0", 1), ("0.01", 2), ("0.05", 3), ("100", 4)])
def test_as_if_asked_in_turn(spark, budget, seed):
    r = random.Random(seed)
    keys = ["hot"] * 60 + [f"k{n}" for n in range(90)]
    rows = [(at, r.choice(keys), r.choice("abc"), r.choice([*metering.PRICES]), r.choice(["answered"] * 6 + ["refused", "failed", None]), r.choice([None, 0, 500, 2000]), r.choice([None, 100]), r.choice([None, 300, 800])) for at in r.sample(range(5000), 300)]
    cache = [(f"k{n}", 7, 9) for n in range(80, 95)]
    old = [(k, 0, i + 1, 1) for k, i, _ in cache] + [(k, 1, i, o) for k, i, o in cache]
    got = metering.metered(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(old, "key string, at long, input_tokens long, output_tokens long"), budget)
    mine = {x.at: (x.state, x.tokens_in, x.tokens_out, x.cost) for x in got.collect()}
    want = one_by_one(rows, cache, budget)
    assert mine == want
    whole = metering.usage(got).filter("purpose is null").first()
    assert (whole.calls, whole.cost_usd) == (sum(s in ("hit", "answered") for s, *_ in want.values()), pytest.approx(sum(w[3] for w in want.values()) / 1e9, abs=1e-6))


def test_no_questions_no_cache_and_a_model_without_price(spark):
    none = spark.createDataFrame([], "key string, at long, input_tokens long, output_tokens long")
    assert metering.metered(spark.createDataFrame([], COLUMNS), none).count() == 0
    row = (1, "k", "p", "of nobody", "answered", 1, 0, 1)
    with pytest.raises(Exception, match="no price of model of nobody"):
        metering.metered(spark.createDataFrame([row], COLUMNS), none).collect()
    # One that gave no answer is not paid for, so its price is not looked up.
    assert metering.metered(spark.createDataFrame([(*row[:4], "failed", 1, 0, 1)], COLUMNS), none).first().state == "failed"


def test_running_sums_over_ranges(spark):
    rows = [(n, (n * 37) % 11 if n % 5 else None) for n in range(2000)]
    got = {x.n: x.total for x in running(spark.createDataFrame(rows, "n long, v long").repartition(7), ["n"], "v", "total").collect()}
    total = 0
    for n, v in rows:
        total += v or 0
        assert got[n] == total
