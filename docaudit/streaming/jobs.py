"""Stream jobs: deadlines, completion handling, and a runner that lands results as tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from docaudit.functions.ordered import first_per_key
from docaudit.functions.scalars import identity_key
from docaudit.params import DEFAULTS, AuditParams
from docaudit.plans import decide
from docaudit.schemas import names
from docaudit.session import scratch, shared_folder
from docaudit.sources.sinks import ReportStore
from docaudit.streaming.events import TERMINAL, missed_deadlines
from docaudit.streaming.history import History, Index, hashed


def run_available(
    stream: DataFrame, mode: str, handle: Callable[[DataFrame, str, History], None] | None = None, folder: str | None = None
) -> DataFrame:
    """Process what the source holds now; every micro-batch becomes one partition of a table.

    ``folder`` names the job: it holds the output and the checkpoint. A job run again in its folder goes on where it
    stopped; a batch repeated after a failure overwrites its own partition, so nothing is doubled. Without a folder the
    job is a new one. ``handle`` gets the batch, the path to write to, and what earlier batches remember; landed rows
    are not read again.
    """
    spark = stream.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/docaudit-stream/{uuid.uuid4().hex}"
    # A source without rows runs no batch; the empty part keeps the result readable.
    columns = _landed(stream, handle)
    spark.createDataFrame([], columns).drop("batch").write.mode("ignore").parquet(f"{folder}/out/batch=-1")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).foreachBatch(lambda batch, batch_id: land(spark, folder, handle, batch, batch_id)).start()
    )
    query.awaitTermination()
    return spark.read.schema(columns).parquet(f"{folder}/out")


def land(spark: SparkSession, folder: str, handle: Callable[[DataFrame, str, History], None] | None, batch: DataFrame, batch_id: int) -> None:
    """One micro-batch of a job in its folder; what it stores on the way goes when it is done."""
    target = f"{folder}/out/batch={batch_id}"
    if not handle:
        batch.write.mode("overwrite").parquet(target)
        return
    history = History(spark, folder, batch_id)
    history.forget_merged()
    with scratch(spark):
        handle(batch, target, history)


class ConsumeOnce:
    """SM4: which events are consumed, remembered for ever.

    Of a batch the first event per id counts, then the first per (task, version); ids and pairs that earlier batches
    consumed are left out. No watermark, so no event is too late. Only the cells of the batch's ids and pairs are read.
    """

    schema = "event_id string, task_id string, audit_version int, occurred_at timestamp, seq bigint, accepted boolean"
    IDS = Index("ids", "event_id string", hashed("event_id"))
    TAKEN = Index("taken", "task_id string, audit_version int", hashed("task_id", "audit_version"))

    def __call__(self, batch: DataFrame, target: str, history: History) -> None:
        order = [F.col("occurred_at"), F.col("seq")]
        once = history.stored(first_per_key(batch.select("event_id", "task_id", "audit_version", "occurred_at", "seq"), ["event_id"], order))
        new = once.join(history.of_keys(self.IDS, once.select("event_id")), "event_id", "left_anti")
        taken = history.of_keys(self.TAKEN, once.select("task_id", "audit_version"))
        first = first_per_key(new, ["task_id", "audit_version"], order).join(taken, ["task_id", "audit_version"], "left_anti")
        marked = new.join(first.select("event_id", F.lit(True).alias("_first")), "event_id", "left")
        landed = history.stored(marked.select(
            "event_id", "task_id", "audit_version", "occurred_at", "seq", F.coalesce("_first", F.lit(False)).alias("accepted")
        ))
        landed.write.mode("overwrite").parquet(target)
        history.remember(self.IDS, landed)
        history.remember(self.TAKEN, landed.where("accepted"))


def _landed(stream: DataFrame, handle) -> str:
    columns = handle.schema if handle else ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)
    return f"{columns}, batch bigint"


def newest(landed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the last batch that updated a key (results of update mode)."""
    rest = [c for c in landed.columns if c not in keys and c != "batch"]
    return landed.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


class DeadlineHandler:
    """SM6: tasks that miss the deadline on the event clock, with every event taken into account however late it comes.

    A task gets a row ``missed`` when its deadline and ``delay_s`` have passed on the clock (the newest event) without a
    terminal event inside the deadline. If a later batch brings that event or an earlier start, a row ``withdrawn`` takes
    it back. Starts wait in cells of ``SLOT_US`` by the instant they are due. A batch judges the tasks it has events of and
    those that became due since the batch before, and reads the facts of these tasks only.
    """

    schema = "event string, task_id string, occurred_at timestamp"
    SLOT_US = 3600 * 10**6
    FACTS = Index("facts", schema, hashed("task_id"))
    DUE = Index("due", "task_id string, due_us bigint", f"cast((due_us - pmod(due_us, {SLOT_US})) div {SLOT_US} as int)")
    CLOCK = Index("clock", "clock_us bigint", "0")

    def __init__(self, delay_s: int = 600, params: AuditParams = DEFAULTS):
        self.params, self.wait_us = params, (params.task_deadline_s + delay_s) * 10**6

    def __call__(self, batch: DataFrame, target: str, history: History) -> None:
        facts = history.stored(self.facts(batch))
        before_us = history.rows(self.CLOCK).agg(F.max("clock_us")).first()[0]
        clock = facts.where("event = 'clock'").select(F.unix_micros("occurred_at").alias("clock_us"))
        clock_us = max((x for x in (before_us, clock.agg(F.max("clock_us")).first()[0]) if x is not None), default=None)
        events = facts.where("event <> 'clock'")
        tasks = events.select("task_id")
        if before_us is not None:
            slots = range(before_us // self.SLOT_US, clock_us // self.SLOT_US + 1)
            tasks = tasks.unionByName(history.rows(self.DUE, slots.__contains__).where(F.col("due_us") <= clock_us).select("task_id"))
        tasks = history.stored(tasks.distinct())
        known = history.stored(history.of_keys(self.FACTS, tasks))
        now = history.stored(self.late(known.select(*names(self.schema)).unionByName(events), clock_us))
        before = history.stored(self.missed(known))
        same = lambda left, right: left.alias("l").join(
            right.alias("r"), F.col("l.task_id").eqNullSafe(F.col("r.task_id")) & (F.col("l.started_at") == F.col("r.started_at")), "left_anti"
        )
        verdict = lambda df, event: df.select(F.lit(event).alias("event"), "task_id", F.col("started_at").alias("occurred_at"))
        changes = history.stored(verdict(same(now, before), "missed").unionByName(verdict(same(before, now), "withdrawn")))
        changes.write.mode("overwrite").parquet(target)
        waiting = F.lit(True) if clock_us is None else F.col("due_us") > clock_us
        due = events.where("event = 'task_started'").select("task_id", (F.unix_micros("occurred_at") + self.wait_us).alias("due_us"))
        history.remember(self.FACTS, events.unionByName(changes))
        history.remember(self.DUE, due.where(waiting), keep=waiting)
        history.remember(self.CLOCK, clock, keep=F.col("clock_us") == F.lit(clock_us))

    def facts(self, batch: DataFrame) -> DataFrame:
        """First starts, terminal events, and one row ``clock`` with the newest event of a batch."""
        events = batch.where(F.col("occurred_at").isNotNull()).select("event", "task_id", "occurred_at")
        starts = events.where("event = 'task_started'").groupBy("event", "task_id").agg(F.min("occurred_at").alias("occurred_at"))
        ends = events.where(F.col("event").isin(*TERMINAL)).distinct()
        clock = events.agg(F.max("occurred_at").alias("occurred_at")).where("occurred_at is not null")
        return starts.unionByName(ends).unionByName(clock.select(F.lit("clock").alias("event"), F.lit(None).cast("string").alias("task_id"), "occurred_at"))

    def late(self, facts: DataFrame, clock_us: int | None) -> DataFrame:
        """task_id and started_at of the tasks that are late at an instant of the clock."""
        passed = F.lit(False) if clock_us is None else F.unix_micros("started_at") + self.wait_us <= clock_us
        return missed_deadlines(facts, self.params).where(passed)

    @staticmethod
    def missed(landed: DataFrame) -> DataFrame:
        """task_id and started_at of what is missed and not withdrawn."""
        verdicts = landed.where("event in ('missed', 'withdrawn')").withColumnRenamed("occurred_at", "started_at")
        return newest(verdicts, ["task_id", "started_at"]).where("event = 'missed'").drop("event")


class DuplicateHandler:
    """SM8: every micro-batch of invoices (with document_no and status of their document) judged like the table rules.

    Every claim is remembered for ever, and a batch is judged against all of them: a claim after the document's first
    one of its key is ``inside``; a first claim is ``across`` when another active document, stored before or in the same
    batch, claims the key, and the highest such document is named. Other claims have no kind. Only the cells of the
    batch's keys are read from the history; hot keys are reduced by aggregates before they meet the batch. A claim whose
    key comes once has no kind, so hashes and counts tell these first, and the others alone are moved to be judged.
    """

    CLAIMS = Index(
        "claims", "document_id bigint, invoice_key string, identity_key string, amount decimal(38,2), is_active boolean", hashed("identity_key")
    )
    schema = f"{CLAIMS.schema}, kind string, conflict_document bigint, amount_changed boolean"
    _CLAIM = ("document_id", "invoice_key", "identity_key", "amount", "is_active")

    def __init__(self, params: AuditParams = DEFAULTS):
        self.params = params

    def __call__(self, batch: DataFrame, target: str, history: History) -> None:
        new = history.stored(self.claims(batch))
        before = history.stored(history.of_keys(self.CLAIMS, new.select("identity_key")).select(*self._CLAIM))
        hashed_ = lambda df: df.withColumn("_hash", F.xxhash64("identity_key"))
        seen = hashed_(new.select("identity_key").unionByName(before.select("identity_key"))).groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"))
        repeated = history.stored(seen.where(F.col("_n") > 1).select("_hash"))
        judged = self.judged(hashed_(new).join(repeated, "_hash", "left_semi").drop("_hash"), before)
        alone = hashed_(new).join(repeated, "_hash", "left_anti").drop("_hash")
        judged.unionByName(alone, allowMissingColumns=True).write.mode("overwrite").parquet(target)
        history.remember(self.CLAIMS, new)

    def claims(self, batch: DataFrame) -> DataFrame:
        """The claims of a batch, one per invoice with an identity."""
        return batch.select(
            "document_id", "invoice_key", identity_key(F.col("invoice_code"), F.col("invoice_number")).alias("identity_key"),
            F.coalesce("total_amount", F.lit(0)).cast("decimal(38,2)").alias("amount"),
            F.coalesce(F.col("status").isin(*self.params.active_statuses), F.lit(False)).alias("is_active"),
        ).where(F.col("identity_key").isNotNull())

    def judged(self, new: DataFrame, before: DataFrame) -> DataFrame:
        """New claims judged against each other and the earlier claims of their keys."""
        claims = before.select(*self._CLAIM, F.lit(0).alias("_age")).unionByName(new.withColumn("_age", F.lit(1)))
        per_document = claims.groupBy("identity_key", "document_id").agg(
            F.min(F.struct("_age", "invoice_key", "amount")).alias("_first"),
            F.max_by(F.when(F.col("is_active"), F.struct("amount")), F.when(F.col("is_active"), F.struct("_age", "invoice_key"))).alias("_active"),
        )
        active = per_document.where(F.col("_active").isNotNull())
        top = first_per_key(active, ["identity_key"], [F.col("document_id").desc()], 2).groupBy("identity_key").agg(
            F.max(F.struct("document_id", F.col("_active.amount").alias("amount"))).alias("_newest"),
            F.min(F.struct("document_id", F.col("_active.amount").alias("amount"))).alias("_older"),
        )
        facts = new.join(per_document.drop("_active"), ["identity_key", "document_id"]).join(top, "identity_key", "left")
        later = (F.col("_first._age") == 0) | (F.col("_first.invoice_key") < F.col("invoice_key"))
        other = F.when(F.col("_newest.document_id") != F.col("document_id"), F.col("_newest")).when(
            F.col("_older.document_id") != F.col("document_id"), F.col("_older")
        )
        kind = F.when(later, F.lit("inside")).when(other.isNotNull(), F.lit("across"))
        against = F.when(later, F.col("_first.amount")).otherwise(other["amount"])
        return facts.select(
            *self._CLAIM, kind.alias("kind"),
            F.when(later, F.col("document_id")).otherwise(other["document_id"]).alias("conflict_document"),
            F.when(kind.isNotNull(), against != F.col("amount")).alias("amount_changed"),
        )


class CompletionHandler:
    """SM5: per micro-batch of ended audits store the reports, then decide.

    The first terminal event of a (task, version) counts, once for ever: what earlier batches ended is left out. A
    failed audit marks its task FAILED with the message of its event. A completed one gets a decision from the stored
    ``findings`` (document_id, rule_code, risk_level, is_overridable) and ``completeness`` (document_id,
    audit_completeness); its report is kept even when no decision can be made, with the reason in ``workflow_error``.
    With a ``store`` the reports are saved there too. A retry overwrites the batch and repeats the save with the same rows.
    """

    schema = (
        "task_id string, audit_version int, document_id bigint, status string, message string, overall_risk_level string,"
        " audit_completeness string, total_amount decimal(14,2), has_veto boolean, invoice_missing boolean,"
        " has_report boolean, action string, target_state string, required_nodes array<string>, workflow_error string"
    )
    ENDED = Index("ended", "task_id string, audit_version int", hashed("task_id", "audit_version"))

    def __init__(
        self, documents: DataFrame, findings: DataFrame, completeness: DataFrame, params: AuditParams = DEFAULTS,
        store: ReportStore | None = None,
    ):
        self.documents, self.params, self.store = documents, params, store
        self.flags = findings.groupBy("document_id").agg(*decide.veto_counts())
        self.completeness = completeness.select("document_id", "audit_completeness")

    def __call__(self, batch: DataFrame, target: str, history: History) -> None:
        ends = history.stored(batch.where(F.col("event").isin(*TERMINAL)))
        pair = ["task_id", "audit_version"]
        done = history.stored(self.ended(ends.join(history.of_keys(self.ENDED, ends.select(*pair)), pair, "left_anti")))
        if self.store:
            reports = done.where("has_report").groupBy("task_id").agg(
                F.max_by(F.struct("document_id", "overall_risk_level"), "audit_version").alias("_r")
            ).select("task_id", "_r.*")
            self.store.save(reports, reports.sparkSession.createDataFrame([], "task_id string"))
        done.write.mode("overwrite").parquet(target)
        history.remember(self.ENDED, done)

    def ended(self, batch: DataFrame) -> DataFrame:
        """One row per ended (task, version) of audit events (task_id, audit_version, document_id, event, occurred_at,
        seq, data) with its report and decision."""
        terminal = batch.where(F.col("event").isin(*TERMINAL))
        first = first_per_key(terminal, ["task_id", "audit_version"], [F.col("occurred_at"), F.col("seq")])
        field = lambda name: F.get_json_object("data", f"$.{name}")
        known = self.documents.select("document_id", "total_amount", F.lit(True).alias("_known"))
        facts = (
            first.select(
                "task_id", "audit_version", "document_id",
                (F.col("event") == "task_completed").alias("has_report"),
                F.coalesce(field("error_detail"), field("error_code")).alias("message"),
                field("overall_risk_level").alias("overall_risk_level"),
            )
            .join(known, "document_id", "left").join(self.flags, "document_id", "left").join(self.completeness, "document_id", "left")
            .withColumn("status", F.when(F.col("has_report"), F.lit("COMPLETED")).otherwise(F.lit("FAILED")))
            .withColumn("message", F.when(~F.col("has_report"), F.col("message")))
        )
        error = F.when(F.col("has_report") & F.col("_known").isNull(), F.lit("DOCUMENT_MISSING")).when(
            F.col("has_report") & F.col("total_amount").isNull(), F.lit("TOTAL_MISSING")
        )
        decided = decide.decide(facts, self.params).withColumn("workflow_error", error)
        sure = F.col("has_report") & F.col("workflow_error").isNull()
        decided = decided.withColumns({n: F.when(sure, F.col(n)) for n in ("action", "target_state", "required_nodes")})
        return decided.select(*names(self.schema))
