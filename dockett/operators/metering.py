"""What questions to a model cost, and which of them a run's budget still lets through.

No call is made here. How each question would end is a column; questions are as if asked one after the other, but no row
waits for another: whoever pays for a key, and where the budget is used up, follows from sums over ranges.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import running, written

# US dollars for a million tokens by model (put in, put in and known to the provider, given out), and the budget of a run.
PRICES = {
    "gpt-5": ("1.25", "0.125", "10.00"),
    "gpt-5-mini": ("0.25", "0.025", "2.00"),
    "gpt-5-nano": ("0.05", "0.005", "0.40"),
    "gpt-4.1-mini": ("0.40", "0.10", "1.60"),
    "gpt-4.1-nano": ("0.10", "0.025", "0.40"),
    "gpt-4o-mini": ("0.15", "0.075", "0.60"),
}
RUN_BUDGET = "2.00"
# A billionth of a dollar: every price is a whole number of them a token.
NANO = Decimal(10) ** 9


def cost(model: Column, fresh: Column, known: Column, out: Column) -> Column:
    """Billionths of a dollar that a call cost; fresh counts known tokens too. A model without a price is an error."""
    each = [F.create_map(*[x for m, p in PRICES.items() for x in (F.lit(m), F.lit(int(Decimal(p[i]) * 1000)).cast("long"))]) for i in range(3)]
    fresh, known, out = (F.coalesce(c.cast("long"), F.lit(0)) for c in (fresh, known, out))
    priced = [F.try_element_at(m, model) for m in each]
    total = F.greatest(F.lit(0), fresh - known) * priced[0] + known * priced[1] + out * priced[2]
    return F.when(F.coalesce(model.isin(list(PRICES)), F.lit(False)), total).otherwise(F.raise_error(F.concat(F.lit("no price of model "), F.coalesce(model, F.lit("null")))).cast("long"))


def metered(questions: DataFrame, cache: DataFrame, budget: str = RUN_BUDGET) -> DataFrame:
    """questions with state, tokens_in, tokens_out and cost (billionths of a dollar), as if asked in the order of at.

    questions: at (tells all rows apart), key (never null), model, said (answered, refused, or what counts as failed),
    input_tokens, cached_tokens, output_tokens, and more. cache: key, at, input_tokens, output_tokens of earlier runs; of
    several of a key the last one counts. state is hit (remembered, free, with the tokens of the answer), answered (paid
    for), refused or failed (free, and remembered by nobody), or unavailable: the sum of what was paid had reached the
    budget. Hits go on after that. The answer that reaches the budget is still taken, even the first one of a run
    without a budget.
    """
    tokens = F.struct(F.coalesce("input_tokens", F.lit(0)).cast("long").alias("i"), F.coalesce("output_tokens", F.lit(0)).cast("long").alias("o"))
    held = cache.groupBy("key").agg(F.max_by(tokens, "at").alias("__held"))
    answered = F.col("said") == "answered"
    price = F.when(answered & F.col("__held").isNull(), cost(F.col("model"), F.col("input_tokens"), F.col("cached_tokens"), F.col("output_tokens")))
    asked = questions.join(held, "key", "left").withColumn("__cost", price)
    # The first answer of a key is the one that is paid for: unless it comes too late for the budget, later ones are hits.
    paid = asked.filter(F.col("__held").isNull() & answered).groupBy("key").agg(F.min(F.struct("at", F.col("__cost").alias("cost"), tokens.alias("tokens"))).alias("__paid"))
    paid = written(paid, "paid")
    sums = running(paid.select(F.col("__paid.at").alias("at"), F.col("__paid.cost").alias("cost")), [F.col("at")], "cost", "total")
    last = sums.filter(F.col("total") >= F.lit(int(Decimal(budget) * NANO))).agg(F.min("at").alias("__last"))
    rows = asked.join(paid, "key", "left").crossJoin(F.broadcast(last))  # last is one row
    late = lambda at: F.coalesce(at > F.col("__last"), F.lit(False))
    again = F.coalesce(F.col("__paid.at") < F.col("at"), F.lit(False)) & ~late(F.col("__paid.at"))
    ended = F.when(answered | (F.col("said") == "refused"), F.col("said")).otherwise("failed")
    state = F.when(F.col("__held").isNotNull() | again, "hit").when(late(F.col("at")), "unavailable").otherwise(ended)
    rows = rows.withColumn("state", state)
    known = F.when(F.col("state") == "hit", F.coalesce("__held", "__paid.tokens")).when(F.col("state") == "answered", tokens)
    out = rows.withColumns({"tokens_in": F.coalesce(known["i"], F.lit(0)), "tokens_out": F.coalesce(known["o"], F.lit(0)), "cost": F.when(F.col("state") == "answered", F.col("__cost")).otherwise(0)})
    return out.select(*questions.columns, "state", "tokens_in", "tokens_out", "cost")


def usage(metered: DataFrame) -> DataFrame:
    """purpose (null: all of them), calls, cached_calls, live_calls, input_tokens, output_tokens, cost_usd, refusals, errors
    and unavailable. Calls are those that gave an answer."""
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    sums = [
        n("hit", "answered").alias("calls"), n("hit").alias("cached_calls"), n("answered").alias("live_calls"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("output_tokens"),
        F.bround(F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(28,0)") / F.lit(NANO).cast("decimal(10,0)"), 6).cast("double").alias("cost_usd"), n("refused").alias("refusals"), n("failed").alias("errors"), n("unavailable").alias("unavailable"),
    ]
    named = metered.withColumn("purpose", F.coalesce("purpose", F.lit("")))
    return named.groupBy("purpose").agg(*sums).unionByName(metered.agg(*sums).withColumn("purpose", F.lit(None).cast("string")))
