"""Cases that cannot be decided set apart: what one row does must not end a run.

A plan over all cases either ends or raises, and Spark says of neither which row it was. So a plan that raised is run
again over each half of its cases, by digests of their ids, and what ends is kept; halves that raise are cut on until one
case is left, which is put down with its error. A run without faults costs nothing more; each fault costs about as
much again as the run, less where halves with several are cut together.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: Cases that may be set apart; with more there is something wrong with the run itself, and its error is raised.
MOST_FAULTS = 64
_SPACE = 1 << 30


def _said(e: Exception) -> str:
    """The kind of an error and what it says first."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    return f"{type(e).__name__}: {' '.join(lines[:2])}"[:500]


def isolated(decide: Callable[[DataFrame | None], DataFrame], keys: DataFrame, key: str = "case_id") -> tuple[DataFrame | None, DataFrame]:
    """What decide makes of all keys but those that make it raise (None if all do), written; and those: key, error.

    decide gets the keys, None for all of them; it should write what it takes of some keys first, as the optimizer may
    else move its steps before the choice of rows.
    """
    spark = keys.sparkSession
    dealt = written(keys.select(key, F.pmod(F.xxhash64(key), F.lit(_SPACE)).alias("__h")).distinct(), "keys")
    kept: list[DataFrame] = []
    faults: list[tuple] = []

    def run(low: int, high: int, own: DataFrame) -> None:
        try:
            kept.append(written(decide(own.select(key) if high - low < _SPACE else None), "decided"))
        except (PySparkException, Py4JJavaError) as e:
            ids = [r[0] for r in own.select(key).limit(2).collect()]
            if len(ids) == 1 or high - low == 1:
                ids = ids if len(ids) == 1 else [r[0] for r in own.select(key).limit(MOST_FAULTS + 1).collect()]
                faults.extend((i, _said(e)) for i in ids)
            if len(faults) > MOST_FAULTS:
                raise
            if len(ids) > 1 and high - low > 1:
                half = (low + high) // 2
                for a, b in ((low, half), (half, high)):
                    part = own.filter((F.col("__h") >= a) & (F.col("__h") < b))
                    if not part.isEmpty():
                        run(a, b, part)

    run(0, _SPACE, dealt)
    named = spark.createDataFrame([f for f in faults], f"{key} {keys.schema[key].dataType.simpleString()}, error string")
    return (reduce(DataFrame.unionByName, kept) if kept else None), named
