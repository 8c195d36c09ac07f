"""Replay of approval actions, and streams against tables."""

import pytest
from pyspark.sql import functions as F

from docaudit.operators import workflow as W
from docaudit.streaming import jobs as J

APPROVE, TRANSFER, SIGN, REJECT, REVOKE = "APPROVE", "TRANSFER", "ADD_SIGN", "REJECT", "REVOKE"


def run(spark, *steps, assignees=(10, 20), applicant=1):
    rows = [(1, i, a, who, *(list(rest) + [None, None])[:2]) for i, (a, who, *rest) in enumerate(steps)]
    actions = spark.createDataFrame(rows, "instance_id long, seq long, action string, operator_id long, target_user_id long, add_sign_type string")
    instances = spark.createDataFrame([(1, applicant, list(assignees))], "instance_id long, applicant_id long, assignees array<long>")
    out = W.replay(actions, instances).orderBy("seq").collect()
    return [r.error for r in out], out[-1].instance_status, out[-1].document_status, out[-1].pending_assignee


@pytest.mark.parametrize("steps, errors, instance, document, pending", [
    ([(APPROVE, 10), (APPROVE, 20)], [None, None], "COMPLETED", "APPROVED", None),
    ([(REJECT, 10), (APPROVE, 10)], [None, "TASK_CLOSED"], "TERMINATED", "REJECTED", None),
    ([(TRANSFER, 10, 11), (TRANSFER, 11, 10), (TRANSFER, 11, 11)], [None, "TRANSFER_LOOP", "TARGET_IS_SELF"], "RUNNING", "PENDING_APPROVAL", 11),
    ([(SIGN, 10, 12, "BEFORE"), (APPROVE, 10), (APPROVE, 12)], [None, "NOT_ALLOWED", None], "RUNNING", "PENDING_APPROVAL", 10),
    ([(SIGN, 10, 12, "AFTER"), (APPROVE, 12)], [None, None], "RUNNING", "PENDING_APPROVAL", 20),
    ([(SIGN, 10, 12, "BEFORE"), (TRANSFER, 12, 13), (APPROVE, 13)], [None, None, None], "RUNNING", "PENDING_APPROVAL", 20),
    ([(REVOKE, 1)], [None], "CANCELLED", "CANCELLED", None),
    ([(APPROVE, 10), (REVOKE, 1)], [None, "REVOKE_AFTER_APPROVAL"], "RUNNING", "PENDING_APPROVAL", 20),
    ([(SIGN, 10, 12), (TRANSFER, 10)], ["ADD_SIGN_TYPE_MISSING", "TARGET_MISSING"], "RUNNING", "PENDING_APPROVAL", 10),
])
def test_replay(spark, steps, errors, instance, document, pending):
    assert run(spark, *steps) == (errors, instance, document, pending)


def test_duplicate_stream_finds_what_the_table_finds(spark, tmp_path):
    from docaudit.operators import invoices as I

    rows = [(d, f"{i:03d}", "C", str(n), f"D{d}", s, a) for i, (d, n, s, a) in enumerate(
        [(1, 5, "APPROVED", 1), (1, 5, "APPROVED", 2), (2, 5, "APPROVED", 1), (3, 6, "DRAFT", 1), (4, 6, "APPROVED", 1)])]
    df = spark.createDataFrame(rows, "document_id long, invoice_key string, invoice_code string, invoice_number string, document_no string, status string, a int").select(
        "*", F.col("a").cast("decimal(14,2)").alias("total_amount"), F.lit("x").alias("issue_date"), F.lit("s").alias("seller_tax_id"), F.lit("n").alias("seller_name"))
    source, job = str(tmp_path / "in"), str(tmp_path / "job")
    run = lambda: sorted(
        (r.document_id, r.kind, r.conflict_document, r.amount_changed)
        for r in J.run_available(spark.readStream.schema(df.schema).parquet(source), "append", J.DuplicateHandler(), job).where("kind is not null").collect()
    )
    df.coalesce(1).write.parquet(source)
    first = [(1, "across", 2, False), (1, "inside", 1, True), (2, "across", 1, True), (3, "across", 4, False)]
    assert run() == first and I.duplicates_inside(df).count() == 1
    # A later batch meets the claims of the earlier one; those keep their judgement.
    df.where("document_id = 1 and a = 1").withColumn("document_id", F.lit(9).cast("long")).coalesce(1).write.mode("append").parquet(source)
    assert run() == [*first, (9, "across", 2, False)]
