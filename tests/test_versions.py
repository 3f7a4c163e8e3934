"""Versioned tables, ranks by ranges, and runs over streams of mails."""

import json

import pytest
from pyspark.sql import functions as F

from dockett.sources import versions
from dockett.storage import numbered
from dockett.streaming import live

FRESH = "case_id long, at long, status string"


def fresh(spark, *rows):
    return spark.createDataFrame(rows, FRESH)


def table(spark, path, version=None):
    return sorted((r.case_id, r.status, r.ord) for r in versions.read(spark, path, version).collect())


def test_rows_are_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.upsert(fresh(spark, (7, 1, "a"), (3, 2, "b"), (7, 3, "c")), path, "case_id", "at", buckets=4) == 1
    assert table(spark, path) == [(3, "b", 0), (7, "c", 1)]
    assert versions.upsert(fresh(spark, (7, 4, "d"), (9, 5, "e"), (1, 5, "f")), path, "case_id", "at") == 2
    assert table(spark, path) == [(1, "f", 2), (3, "b", 0), (7, "d", 1), (9, "e", 3)] and table(spark, path, 1) == [(3, "b", 0), (7, "c", 1)]
    assert versions.upsert(fresh(spark), path, "case_id", "at") == 3 and len(table(spark, path)) == 4
    assert versions.forget(spark, path) > 0 and versions.versions(spark, path) == [3] and len(table(spark, path)) == 4
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    for _ in range(2):
        assert versions.upsert(fresh(spark, (1, 1, "a")), path, "case_id", "at", ("s", 0)) == 1
    assert versions.upsert(fresh(spark, (1, 2, "b")), path, "case_id", "at", ("s", 1)) == 2
    assert versions.upsert(fresh(spark, (1, 1, "a")), path, "case_id", "at", ("s", 0)) == 2 and table(spark, path) == [(1, "b", 0)]


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.upsert(fresh(spark, (1, 1, "a"), (2, 1, "b")), path, "case_id", "at")

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions, "_publish", die)
        with pytest.raises(RuntimeError):
            versions.upsert(fresh(spark, (1, 2, "z")), path, "case_id", "at")
    assert versions.versions(spark, path) == [1] and table(spark, path) == [(1, "a", 0), (2, "b", 1)]
    versions.upsert(fresh(spark, (1, 2, "y")), path, "case_id", "at")
    assert table(spark, path) == [(1, "y", 0), (2, "b", 1)]


def test_of_two_writers_one_is_first(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.upsert(fresh(spark, (1, 1, "a")), path, "case_id", "at")
    with pytest.raises(versions.Conflict):
        versions._publish(spark, path, versions.latest(spark, path))
    assert table(spark, path) == [(1, "a", 0)]


def test_places_by_ranges(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), "id").repartition(5)
    got = numbered(rows, [F.desc("k")], "place").collect()
    assert sorted((r.place, r.k) for r in got) == [(i + 1, 999 - i) for i in range(1000)]
    assert numbered(rows.limit(0), ["k"], "place").count() == 0


SI = "SHIPPING INSTRUCTION\n====\nShipper: ACME PTE. LTD.\nConsignee: BETA TRADING CO\nNotify Party: GAMMA\nPort of Loading: PENANG\nPort of Discharge: OSLO\nNo. of Containers: 2 x 40'HC\nGross Weight (KG): 21,577 KG\n"
BL = SI.replace("SHIPPING INSTRUCTION", "DRAFT BILL OF LADING").replace("====", "====\nB/L No.: 88")
MAIL = "email_id string, sender string, subject string, body string, at long"


def test_a_stream_of_mails(spark, tmp_path):
    """Two batches: the second sends a mail again and brings a new one."""
    path, source = str(tmp_path / "cases"), tmp_path / "mails"
    ask = "Attached are the SI and draft BL. Please compare the SI and draft BL."
    docs = spark.createDataFrame([(m, i, f"{m}_{s}.txt", t, None) for m, bl in (("a", BL), ("b", BL.replace("OSLO", "BERGEN"))) for i, (s, t) in enumerate((("SI", SI), ("BL", bl)))], "case_id string, ord int, path string, text string, unreadable string")
    of = lambda mails: docs.join(mails.select(F.col("email_id").alias("case_id")), "case_id", "left_semi")

    def send(n, *rows):
        source.mkdir(exist_ok=True)
        (source / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("email_id", "sender", "subject", "body", "at"), r, strict=True))) for r in rows))
        live.start(spark.readStream.schema(MAIL).json(str(source)), of, path, str(tmp_path / "checkpoint"), once=True).awaitTermination()
        return {r.case_id: (r.status, r.defect_fields, r.ord) for r in versions.read(spark, path).collect()}

    assert send(1, ("a", "x@y.z", "TO CONFIRM DOCS", ask, 1), ("s", "q@w.e", "You have won", "Congratulations!!! Claim now, click here.", 2)) == {"a": ("OK", "", 0), "s": ("OK", "", 1)}
    assert {(r.kind, r.value): r.n for r in live.progress(spark, path).collect()}["total", "emails"] == 2
    got = send(2, ("b", "x@y.z", "TO CONFIRM DOCS", ask, 3), ("s", "q@w.e", "TO CONFIRM DOCS", ask, 4))
    assert got == {"a": ("OK", "", 0), "b": ("MISMATCH", "port_of_discharge", 2), "s": ("NEEDS_REVIEW", "", 1)}
