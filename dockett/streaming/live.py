"""A run that goes on: mails as a stream, a decision a mail, and results to look at after every batch.

Each batch is decided by the plan of a whole run and put into a versioned table by mail, so a mail that is sent again
replaces its row and keeps its place. A batch that is repeated after a failure is known by its number and changes nothing.
What a batch does not name is not read: documents are taken by the batch's mails alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import reports
from ..plans import run
from ..sources import versions
from ..storage import written

STREAM = "mails"


def decide(mails: DataFrame, docs: Callable[[DataFrame], DataFrame], path: str, batch: int, fuzzy: bool = True) -> None:
    """One batch: mails (email_id, sender, subject, body, at) decided and put into the table at path. docs gives the
    documents of mails, as run.run takes them. Of a mail that a batch has twice the last (by at) counts."""
    names = [c for c in mails.columns if c != "email_id"]
    once = written(mails.groupBy("email_id").agg(F.max_by(F.struct(*names), "at").alias("m")).select("email_id", "m.*"), "batch")
    decided = run.run(once.drop("at"), docs(once), fuzzy=fuzzy)
    dated = decided.join(once.select(F.col("email_id").alias("case_id"), "at"), "case_id")
    versions.upsert(dated, path, "case_id", "at", (STREAM, batch))


def start(mails: DataFrame, docs: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, fuzzy: bool = True, once: bool = False) -> StreamingQuery:
    """Starts a run over a stream of mails; once: takes what is there and ends."""
    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            decide(rows, docs, path, number, fuzzy)

    stream = mails.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()


def progress(spark: SparkSession, path: str) -> DataFrame:
    """The report of what has been decided so far, from one version of the table."""
    return reports.run_report(versions.read(spark, path))
