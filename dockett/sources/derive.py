"""Deterministic pairs of instruction and draft, their texts, and emails, built from the star schema.

One pair an order with line items; order number modulo 20 plants a variation on the draft's side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FIELDS
from ..storage import dealt


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, v (the variation), and si_<field> and bl_<field> as printed (null: the label is absent)."""
    t = lambda name: read(spark, sf_dir, name)
    items = t("lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count(F.lit(1)).alias("n"), F.min("l_suppkey").alias("s1"), F.max("l_suppkey").alias("s2"), (F.sum("l_quantity").cast("bigint") * 100).alias("w"))
    suppliers = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", F.col("n_name").alias("s_nation"), F.col("n_nationkey").alias("s_key"))
    first = suppliers.toDF("s1", "s1_name", "pol", "pol_key")
    second = suppliers.toDF("s2", "s2_name", "s2_nation", "s2_key").select("s2", "s2_name")
    buyers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_name", F.col("n_name").alias("pod"), F.col("n_nationkey").alias("pod_key"))
    orders = t("orders").select(F.col("o_orderkey").alias("case_id"), "o_custkey")
    base = orders.join(items, "case_id").join(buyers, "o_custkey").join(first, "s1").join(second, "s2").withColumn("v", (F.col("case_id") % 20).cast("int"))

    code = lambda name, k: F.concat(F.upper(F.substring(name, 1, 2)), F.lit("P"), F.lpad(F.col(k).cast("string"), 2, "0"))
    port = lambda name, codes: F.concat(F.col(name), F.lit(", PORT ("), codes, F.lit(")"))
    kg = F.concat(F.col("w").cast("string"), F.lit(" KG"))
    count = F.concat(F.col("n").cast("string"), F.lit(" x 40'HC"))
    base = base.withColumns(
        {
            "si_shipper": F.concat("s1_name", F.lit(" PTE. LTD.")), "si_consignee": F.concat("c_name", F.lit(" TRADING CO")), "si_notify_party": F.col("s2_name"),
            "si_port_of_loading": port("pol", code("pol", "pol_key")), "si_port_of_discharge": port("pod", code("pod", "pod_key")), "si_container_count": count, "si_gross_weight_kg": kg,
        }
    )
    v = F.col("v")
    return dealt(base, "case_id").select(
        "case_id", "v", *[f"si_{f}" for f in FIELDS],
        F.when(v == 4, F.concat("s1_name", F.lit(" Limited"))).when(v == 12, "TBA").otherwise(F.col("si_shipper")).alias("bl_shipper"),
        F.when(v == 3, F.replace(F.upper("si_consignee"), F.lit("O"), F.lit("0"))).otherwise(F.col("si_consignee")).alias("bl_consignee"),
        F.when(v == 6, F.lit(None)).otherwise(F.col("si_notify_party")).alias("bl_notify_party"),
        F.col("si_port_of_loading").alias("bl_port_of_loading"),
        F.when(v == 1, port("pol", code("pod", "pod_key"))).otherwise(F.col("si_port_of_discharge")).alias("bl_port_of_discharge"),
        F.when(v == 8, F.concat((F.col("n") - 1).cast("string"), F.lit(" x 40'HC"))).when(v == 11, F.concat(F.lit("40HC x "), F.col("n").cast("string"))).when(v == 14, F.lit("ONE x 20'GP")).otherwise(count).alias("bl_container_count"),
        F.when(v == 0, F.concat((F.col("w") + 500).cast("string"), F.lit(" KG"))).when(v == 2, "???").when(v == 5, F.concat(F.col("w").cast("string"), F.lit(" LBS")))
        .when(v == 9, F.concat(F.floor(F.col("w") / 1000).cast("string"), F.lit("."), F.lpad((F.col("w") % 1000).cast("string"), 3, "0"), F.lit(" MT"))).when(v == 13, F.concat(F.col("w").cast("string"), F.lit("B KG"))).otherwise(kg).alias("bl_gross_weight_kg"),
    )


def values(pairs: DataFrame) -> DataFrame:
    """case_id, v, field, field_ord, si_raw, bl_raw: seven rows a pair, in canonical order, without a shuffle."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(i).alias("field_ord"), F.col(f"si_{f}").alias("si_raw"), F.col(f"bl_{f}").alias("bl_raw")) for i, f in enumerate(FIELDS, 1)])
    return pairs.select("case_id", "v", F.explode(rows).alias("r")).select("case_id", "v", "r.*")


# Wordings of the labels, one set for the instruction and three for drafts (by order number modulo 3).
WORDINGS = [
    ["Shipper/Exporter", "Consignee", "Notify Party", "Port of Loading", "Port of Discharge", "No. of Containers", "Gross Weight (KG)"],
    ["Shipper", "To the Order of", "Also Notify", "POL", "POD", "Total Containers", "Total Gross Wt"],
    ["Exporter", "Consignee (Non-Negotiable)", "Notify Address", "Load Port", "Discharge Port", "Container Count", "G.W. (KGS)"],
]


def texts(pairs: DataFrame) -> DataFrame:
    """case_id, v, side (SI, BL), path, text: each pair as two attachments of labelled lines.

    Variation 7 wraps the draft's consignee onto a second line, 10 has an invoice for a draft.
    """
    def lines(side: str, wording: list[str]) -> list:
        out = []
        for f, label in zip(FIELDS, wording, strict=True):
            value = F.col(f"{side}_{f}")
            if f == "consignee" and side == "bl":
                value = F.when(F.col("v") == 7, F.replace(value, F.lit(" TRADING"), F.lit("\n  TRADING"))).otherwise(value)
            out.append(F.concat(F.lit(f"{label}: "), value))
        return out

    head = lambda *x: [F.lit(t) if isinstance(t, str) else t for t in x]
    ref = F.concat(F.lit("Booking Reference: BK"), F.col("case_id").cast("string"))
    si = F.concat_ws("\n", *head("SHIPPING INSTRUCTION", "====", ref), *lines("si", WORDINGS[0]), F.lit("Net Weight: 1 KG"))
    title = F.when(F.col("v") == 10, "COMMERCIAL INVOICE\n====\nInvoice No.: 77\nTotal Amount: 5").otherwise("DRAFT BILL OF LADING\n====\nB/L No.: 88")
    bl = F.when(F.col("case_id") % 3 == 0, F.concat_ws("\n", title, *lines("bl", WORDINGS[0]))).when(F.col("case_id") % 3 == 1, F.concat_ws("\n", title, *lines("bl", WORDINGS[1]))).otherwise(F.concat_ws("\n", title, *lines("bl", WORDINGS[2])))
    both = F.array(F.struct(F.lit("SI").alias("side"), si.alias("text")), F.struct(F.lit("BL").alias("side"), bl.alias("text")))
    return pairs.select("case_id", "v", F.explode(both).alias("d")).select("case_id", "v", "d.side", F.concat(F.lit("attachments/email_"), F.col("case_id").cast("string"), F.lit("_"), F.col("d.side"), F.lit(".txt")).alias("path"), "d.text")


# Twelve mails: subject, body, sender.
MAILS = [
    ("TO CONFIRM DOCS _ {n}", "Hi Ann,\n\nAttached are the SI and draft BL for booking {n}. Please compare the SI and draft BL.\n\nBest regards\nBob", "bob@carrier-one.com"),
    ("RE: Request BL draft _ PO {n}", "Dear Ann,\n\nPlease assist to send the draft BL for {n} for checking asap.\n\nThanks\nBob", "eve@liner.example.com"),
    ("AIE - SINGAPORE - MSC(BK{n})", "Kindly check the draft BL against the SI (attachments appear to have been dropped).\n\nRegards,\nBob", "docs@forwarder.net"),
    ("SI - {n} - DIRECT(MSC)", "Please find Shipping instruction for {n}.\n\nPOL: PENANG\nPOD: OSLO\nShipper: ACME\nConsignee: BETA\nGross Wt: 5 KG\n\nRevert with draft BL once available.", "bob@carrier-one.com"),
    ("CUST SI for {n}", "Request attached.\nDocuments required: packing list", "sam@shipper.co"),
    ("BILLING {n} MISSING GR", "Invoice # 50701462 for {n}: the GR is still missing, please post the GR.", "acc@carrier-one.com"),
    ("D&D charges {n}", "Detention and demurrage for {n}, THC apart.\n\nOn Monday Bob wrote:\nold text", "acc@liner.example.com"),
    ("UPDATE SUMMARY {n}", "Dear all,\n\nThis is an automated notification. No action required.", "noreply@port.gov"),
    ("_Reminder_Paper - Submit SI & AED_{n}", "Reminder: Please submit SI & AED for all pending shipments by end of day.", "hr@carrier-one.com"),
    ("You have won {n}", "Congratulations!!! Claim now, click here.", "winner@prize-claims.info"),
    ("Mailbox full {n}", "Dear user, your mailbox has exceeded its storage limit; verify your account within 24 hours.", "it@webmail-verify.co"),
    ("hello {n}", "WARNING: external mail\nHow are you?", "x@friend.org"),
]


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """email_id, sender, subject, body: a mail an order, by order number modulo 12."""
    return mails_of(read(spark, sf_dir, "orders"))


def mails_of(orders: DataFrame) -> DataFrame:
    """The mails of some orders, which may be a stream."""
    orders = orders.select(F.col("o_orderkey").alias("email_id"))
    pick = F.element_at(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("subject", "body", "sender"), m, strict=True)]) for m in MAILS]), (F.col("email_id") % 12 + 1).cast("int"))
    number = F.col("email_id").cast("string")
    fill = lambda c: F.replace(F.col(f"m.{c}"), F.lit("{n}"), number).alias(c)
    return orders.withColumn("m", pick).select("email_id", "m.sender", fill("subject"), fill("body"))


def words(pairs: DataFrame) -> DataFrame:
    """doc, page, text, x0, x1, top, size, fontname: each draft as a form of seven rows, a bold label and its value.

    A character is five points wide. In variation 15 the values begin inside their labels.
    """
    rows = values(pairs).withColumn("label", F.element_at(F.array(*map(F.lit, WORDINGS[0])), F.col("field_ord")))

    def spread(text, left, top, font):
        w = F.split(text, " ")
        at = lambda i: left + 5.0 * F.when(i == 0, 0).otherwise(F.length(F.array_join(F.slice(w, F.lit(1), i), " ")) + 1)
        return F.transform(w, lambda x, i: F.struct(x.alias("text"), at(i).alias("x0"), (at(i) + 5.0 * F.length(x)).alias("x1"), top.alias("top"), F.lit(10.0).alias("size"), F.lit(font).alias("fontname")))

    top = 100.0 + 14.0 * F.col("field_ord")
    left = F.when(F.col("v") == 15, 60.0).otherwise(220.0)
    labels = spread(F.col("label"), F.lit(40.0), top, "Helvetica-Bold")
    printed = F.when(F.col("bl_raw").isNotNull(), spread(F.col("bl_raw"), left, top + 1.5, "Helvetica")).otherwise(F.filter(labels, lambda x: F.lit(False)))
    return rows.select(F.col("case_id").alias("doc"), F.lit(1).alias("page"), F.explode(F.concat(labels, printed)).alias("w")).select("doc", "page", "w.*")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, tbl, row, col, text: a table an order. Even orders list a container a row under a header of three columns;
    odd ones have a label, a value and the value once more (a merged cell), or nothing."""
    items = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.sum("l_quantity").cast("bigint").cast("string").alias("q"))
    even = F.col("l_orderkey") % 2 == 0
    n, empty = F.col("l_linenumber"), F.col("p") % 5 == 0
    other = lambda x: F.when(empty, " ").otherwise(x)
    listed = F.when(even, F.array(F.concat(F.lit("CONT"), F.col("p").cast("string")), F.concat(F.lit("SEAL"), F.col("s").cast("string")), F.col("q"))).otherwise(F.array(other(F.concat(F.lit("Item "), n.cast("string"))), other(F.col("q")), other(F.col("q"))))
    rows = items.select("l_orderkey", F.when(even, n + 1).otherwise(n).alias("row"), listed.alias("c"))
    heads = items.filter(even).select("l_orderkey").distinct().select("l_orderkey", F.lit(1).alias("row"), F.array(*map(F.lit, ("Container Nr.", "Seal Nr.", "Packages"))).alias("c"))
    return rows.unionByName(heads).select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("tbl"), "row", F.posexplode("c").alias("col", "text"))


def run_docs(pairs: DataFrame) -> DataFrame:
    """case_id, ord, path, text, unreadable: attachments of a run. Mails of two templates carry the pair of their order; of
    some the draft is left out or cannot be opened."""
    k, draft = F.col("case_id"), F.col("side") == "BL"
    carried = texts(pairs).filter((k % 12).isin(0, 11) & ~(draft & (k % 7 == 3)))
    broken = draft & (k % 7 == 5)
    return carried.select("case_id", F.when(draft, 1).otherwise(0).alias("ord"), "path", F.when(~broken, F.col("text")).alias("text"), F.when(broken, "corrupt").alias("unreadable"))
