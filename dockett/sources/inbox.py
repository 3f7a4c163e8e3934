"""An inbox of mails (JSON files) and attachments (any files), and the sinks of a run."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.readers import MAX_BYTES, TEXT_KINDS, unreadable
from ..storage import written
from . import office

#: First bytes of a file that are looked at, and those of a zipped one.
HEAD, ZIP = 8, b"PK"

_MAIL = "email_id string, `from` string, subject string, body string, attachments array<string>"


def emails(spark: SparkSession, root: str, limit: int | None = None) -> DataFrame:
    """email_id, sender, subject, body, attachments; nulls as empty. limit takes the first by id."""
    rows = spark.read.schema(_MAIL).option("multiLine", True).json(f"{root}/inbox/email_*.json")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    mails = rows.select("email_id", text("from").alias("sender"), text("subject").alias("subject"), text("body").alias("body"), F.coalesce("attachments", F.array().cast("array<string>")).alias("attachments"))
    return mails.orderBy("email_id").limit(limit) if limit else mails


def _looked_up(batches: Iterator[pa.RecordBatch], root: str) -> Iterator[pa.RecordBatch]:
    """Length and first bytes of named files, or why they cannot be had."""
    store, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:/") else (fs.LocalFileSystem(), root)
    for batch in batches:
        names = batch.column("name").to_pylist()
        sizes, heads, errors = [], [], []
        for name in names:
            size, head, error = None, None, None
            try:
                info = store.get_file_info(f"{base.rstrip('/')}/{name}")
                if info.type == fs.FileType.File:
                    size = info.size
                    with store.open_input_stream(info.path) as f:
                        head = f.read(HEAD)
            except Exception as e:  # noqa: BLE001  a file that cannot be opened is a result
                error = f"{type(e).__name__}: {e}"[:500]
            sizes.append(size)
            heads.append(head)
            errors.append(error)
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64()), pa.array(heads, pa.binary()), pa.array(errors, pa.string())], names=["name", "n_bytes", "head", "error"])


def looked_up(names: DataFrame, root: str) -> DataFrame:
    """name, n_bytes, head (the first bytes), error of files that are named below root, asked for by tasks; a name
    without a file has no length, and neither has one that leads out of root."""
    inside = ~F.concat(F.lit("/"), F.col("name"), F.lit("/")).rlike(r"/\.\./")
    once = names.select("name").filter(F.col("name").isNotNull() & inside).distinct()
    return once.mapInArrow(partial(_looked_up, root=root), "name string, n_bytes long, head binary, error string")


def attachments(spark: SparkSession, root: str, mails: DataFrame) -> DataFrame:
    """case_id, ord, path, n_bytes, text, unreadable: a row an attachment that a mail names, in its order.

    unreadable is null, missing_file, empty_file (no bytes, or blank), corrupt (it cannot be opened, or is not the kind
    of file that its name says), or unsupported (too large, or of no kind that is read). Bytes that are no UTF-8 become
    replacement characters. Only files of kinds that are read are opened; the names and lengths of office files pass the
    driver, which plans them into tasks.
    """
    named = mails.select(F.col("email_id").alias("case_id"), F.posexplode("attachments").alias("ord", "path")).withColumn("name", F.substring_index("path", "attachments/", -1))
    folder = f"{root}/attachments"
    there = written(looked_up(named, folder), "files")
    kind = F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1))
    zipped = F.substring("head", 1, len(ZIP)) == F.lit(ZIP)
    there = there.withColumn("error", F.when(kind.isin(list(office.KINDS)) & (F.col("n_bytes") > 0) & ~zipped, "no zipped file").otherwise(F.col("error")))
    glob = "*{" + ",".join(c for k in TEXT_KINDS for c in (k, k.upper())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).filter(F.col("length") <= MAX_BYTES)
    content = files.select(F.substring_index("path", "/attachments/", -1).alias("name"), F.expr("make_valid_utf8(cast(content as string))").alias("text"))
    sheets = there.filter(kind.isin(list(office.KINDS)) & zipped & (F.col("n_bytes") <= MAX_BYTES)).select("name", "n_bytes").collect()
    if sheets:
        read = office.texts(office.cells(spark, [(f"{folder}/{r.name}", r.n_bytes) for r in sheets]))
        made = read.select(F.substring_index("path", "/attachments/", -1).alias("name"), "text", F.col("error").alias("broken"))
        content = content.withColumn("broken", F.lit(None).cast("string")).unionByName(made)
    else:
        content = content.withColumn("broken", F.lit(None).cast("string"))
    rows = named.join(there, "name", "left").join(content, "name", "left")
    why = unreadable(F.col("path"), F.col("n_bytes"), F.col("text"), F.coalesce("error", "broken"), [*TEXT_KINDS, *office.KINDS])
    return rows.select("case_id", "ord", "path", "n_bytes", "text", why.alias("unreadable"))


def write_submission(cases: DataFrame, path: str) -> None:
    """One JSON line a case: case_id, category, status, review_reason, defect_fields, has_defect, decided_by."""
    fields = F.array_sort(F.filter(F.split("defect_fields", ","), lambda x: x != ""))
    cases.select("case_id", "category", "status", "review_reason", fields.alias("defect_fields"), "has_defect", "decided_by").write.mode("overwrite").json(path)
