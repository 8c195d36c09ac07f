"""Approval workflow: start, assignees, action rules, replay of action logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F


# States an instance, its document and its first task get from a decision.
START = {
    "AUTO_APPROVE": ("COMPLETED", "APPROVED", "AUTO_PASSED", "AUTO_PASS"),
    "REJECT": ("TERMINATED", "REJECTED", None, "AUTO_REJECT"),
    "NEED_SUPPLEMENT": ("SUSPENDED", "NEED_SUPPLEMENT", None, "NEED_SUPPLEMENT"),
    "MANUAL_REVIEW": ("RUNNING", "PENDING_APPROVAL", "PENDING", "SUBMIT_FOR_REVIEW"),
}


def first_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("node_order") == 1)


def pick_workflow(documents: DataFrame, workflows: DataFrame) -> DataFrame:
    """Active workflow of the document type, else any active one (lowest id).

    The catalogue of workflows is small by nature but not bounded, so the join strategy is left to
    the optimizer's size check.
    """
    active = workflows.where("is_active")
    by_type = active.groupBy("document_type").agg(F.min("workflow_id").alias("_own"))
    fallback = active.agg(F.min("workflow_id")).scalar()
    return (
        documents.join(by_type, "document_type", "left")
        .withColumn("workflow_id", F.coalesce(F.col("_own"), fallback))
        .drop("_own")
    )


def assignees(documents: DataFrame, nodes: DataFrame, users: DataFrame, role_users: DataFrame) -> DataFrame:
    """WF2: assignee per document and node: the node's user, else the applicant's manager, else the role.

    ``documents`` carry document_id, applicant_id, workflow_id; ``role_users`` maps role_code to a
    user and holds the key DEFAULT for everything unresolved.
    """
    managers = users.select(F.col("user_id").alias("applicant_id"), "manager_id")
    by_role = role_users.select("role_code", F.col("user_id").alias("_role_user"))
    default = role_users.where("role_code = 'DEFAULT'").agg(F.min("user_id")).scalar()
    typed = F.col("approver_type")
    found = F.coalesce(
        "user_id",
        F.when(typed == "MANAGER", F.col("manager_id")),
        F.when(typed == "ROLE", F.col("_role_user")),
        default,
    )
    return (
        documents.select("document_id", "applicant_id", "workflow_id")
        .join(nodes.select("workflow_id", "node_id", "node_order", "approver_type", "user_id", "role_code"), "workflow_id")
        .join(managers, "applicant_id", "left")
        .join(by_role, "role_code", "left")
        .select("document_id", "workflow_id", "node_id", "node_order", found.alias("assignee_id"))
    )


def start_workflows(
    decisions: DataFrame, workflows: DataFrame, nodes: DataFrame, users: DataFrame, role_users: DataFrame,
    running: DataFrame | None = None,
) -> DataFrame:
    """WF1: instance, document and first task per decision.

    ``decisions``: document_id, document_type, applicant_id, action. A document with a running
    instance (``running``: document_id) keeps it and starts nothing.
    """
    todo = decisions
    if running is not None:
        todo = todo.join(running.select("document_id").distinct(), "document_id", "left_anti")
    chosen = pick_workflow(todo, workflows)
    heads = assignees(chosen, first_nodes(nodes), users, role_users).drop("node_order", "workflow_id")
    out = chosen.join(heads, "document_id", "left")
    values = {}
    for i, name in enumerate(("instance_status", "document_status", "task_status", "log_action")):
        column = F.lit(None).cast("string")
        for action, states in START.items():
            column = F.when(F.col("action") == action, F.lit(states[i])).otherwise(column)
        values[name] = column
    manual = F.col("action") == "MANUAL_REVIEW"
    return out.withColumns(values).select(
        "document_id", "workflow_id", "action", "instance_status", "document_status", "task_status", "log_action",
        F.when(F.col("task_status").isNotNull(), F.col("node_id")).alias("node_id"),
        F.when(manual, F.col("assignee_id")).alias("assignee_id"),
        F.when(manual & F.col("node_id").isNull(), F.lit("WORKFLOW_HAS_NO_NODE")).alias("workflow_error"),
    )


def action_violations(actions: DataFrame) -> DataFrame:
    """WF4: actions a rule forbids, judged from the log alone.

    Transfer or add-sign without target or to oneself; add-sign without type; transfer to someone
    who already took part in the same task line; revoke after an approval. First participation and
    first approval are found by aggregation, so no list of participants is collected.
    """
    target, who = F.col("target_user_id"), F.col("operator_id")
    moves = F.col("action").isin("TRANSFER", "ADD_SIGN")
    part = (
        actions.select("instance_id", "task_no", F.col("operator_id").alias("user_id"), "seq")
        .unionByName(
            actions.where((F.col("action") == "TRANSFER") & target.isNotNull())
            .select("instance_id", "task_no", target.alias("user_id"), "seq")
        )
        .groupBy("instance_id", "task_no", "user_id").agg(F.min("seq").alias("_joined"))
        .withColumnRenamed("user_id", "target_user_id")
    )
    approved = actions.where("action = 'APPROVE'").groupBy("instance_id").agg(F.min("seq").alias("_approved"))
    facts = actions.join(part, ["instance_id", "task_no", "target_user_id"], "left").join(approved, "instance_id", "left")
    violation = (
        F.when(moves & target.isNull(), F.lit("TARGET_MISSING"))
        .when(moves & (target == who), F.lit("TARGET_IS_SELF"))
        .when((F.col("action") == "ADD_SIGN") & F.col("add_sign_type").isNull(), F.lit("ADD_SIGN_TYPE_MISSING"))
        .when((F.col("action") == "TRANSFER") & (F.col("_joined") < F.col("seq")), F.lit("TRANSFER_LOOP"))
        .when((F.col("action") == "REVOKE") & (F.col("_approved") < F.col("seq")), F.lit("REVOKE_AFTER_APPROVAL"))
    )
    return facts.withColumn("violation", violation).where(F.col("violation").isNotNull()).select(
        "instance_id", "seq", "action", "violation"
    )


REPLAY_SCHEMA = (
    "instance_id bigint, seq bigint, action string, accepted boolean, error string, instance_status string,"
    " document_status string, current_order int, pending_assignee bigint"
)


class _Instance:
    """State of one approval instance. One task is pending at a time; a task suspended by an
    add-sign in front of it is kept as ``parent`` (assignee, its own parent)."""

    def __init__(self, instance_id: int, applicant: int, assignees: list[int]):
        self.instance_id, self.applicant, self.assignees = instance_id, applicant, assignees
        self.status, self.document, self.approved = "RUNNING", "PENDING_APPROVAL", False
        self.order, self.current, self.parent, self.visited = 0, None, None, set()
        self._enter(1)

    def _enter(self, order: int) -> None:
        self.parent = None
        if order <= len(self.assignees):
            self.order, self.current = order, self.assignees[order - 1]
            self.visited = {self.current}
        else:
            self._close("COMPLETED", "APPROVED")

    def _close(self, status: str, document: str) -> None:
        self.status, self.document, self.current = status, document, None

    def _hand_over(self, target: int, parent) -> None:
        self.visited.add(target)
        self.current, self.parent = target, parent

    def _refusal(self, action: str, operator: int, target: int | None, kind: str | None) -> str | None:
        if self.current is None:
            return "TASK_CLOSED"
        if operator != (self.applicant if action == "REVOKE" else self.current):
            return "NOT_ALLOWED"
        if action in ("TRANSFER", "ADD_SIGN") and target is None:
            return "TARGET_MISSING"
        if action in ("TRANSFER", "ADD_SIGN") and target == operator:
            return "TARGET_IS_SELF"
        if action == "TRANSFER" and target in self.visited:
            return "TRANSFER_LOOP"
        if action == "ADD_SIGN" and kind not in ("BEFORE", "AFTER"):
            return "ADD_SIGN_TYPE_MISSING"
        if action == "REVOKE" and self.approved:
            return "REVOKE_AFTER_APPROVAL"
        return None

    def apply(self, action: str, operator: int, target: int | None, kind: str | None) -> str | None:
        """None when the action is carried out, else the reason it is refused."""
        error = self._refusal(action, operator, target, kind)
        if error:
            return error
        if action == "APPROVE":
            self.approved = True
            if self.parent:
                self.current, self.parent = self.parent
            else:
                self._enter(self.order + 1)
        elif action == "REJECT":
            self._close("TERMINATED", "REJECTED")
        elif action == "REVOKE":
            self._close("CANCELLED", "CANCELLED")
        elif action == "TRANSFER":
            self._hand_over(target, None)
        elif kind == "BEFORE":
            self._hand_over(target, (self.current, self.parent))
        else:
            self.approved = True
            self._hand_over(target, None)
        return None


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold sorted actions; only the state of the instance at hand is kept across batches."""
    state: _Instance | None = None
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            if state is None or state.instance_id != row.instance_id:
                state = _Instance(row.instance_id, row.applicant_id, [int(a) for a in row.assignees])
            target = None if pd.isna(row.target_user_id) else int(row.target_user_id)
            error = state.apply(row.action, row.operator_id, target, row.add_sign_type)
            out.append((
                row.instance_id, row.seq, row.action, error is None, error, state.status, state.document,
                state.order, state.current,
            ))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in REPLAY_SCHEMA.split(",")])
        frame["pending_assignee"] = frame["pending_assignee"].astype("Int64")
        yield frame


def replay(actions: DataFrame, instances: DataFrame) -> DataFrame:
    """WF3: outcome of every action of an instance, in log order.

    ``instances``: instance_id, applicant_id, assignees (array by node order). The fold is ordered
    by nature: actions are hashed by instance and sorted, then streamed through Python batch by
    batch, so memory does not grow with the length of a log.
    """
    joined = actions.join(instances.select("instance_id", "applicant_id", "assignees"), "instance_id")
    columns = ["instance_id", "seq", "action", "operator_id", "target_user_id", "add_sign_type", "applicant_id", "assignees"]
    return (
        joined.select(*columns)
        .repartition("instance_id")
        .sortWithinPartitions("instance_id", "seq")
        .mapInPandas(_replay, REPLAY_SCHEMA)
    )


def final_states(replayed: DataFrame) -> DataFrame:
    """State of every instance after its last action."""
    return replayed.groupBy("instance_id").agg(
        F.max_by(F.struct("instance_status", "document_status", "current_order", "pending_assignee"), "seq").alias("_s"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("refused"),
    ).select("instance_id", "_s.*", "accepted", "refused")


def pending_tasks(tasks: DataFrame, instances: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """WF5: pending tasks of every user with document and node; sort by created_at for display."""
    return (
        tasks.where("status = 'PENDING'")
        .join(instances.select("instance_id", "document_id"), "instance_id")
        .join(documents.select("document_id", "document_no", "document_type", "title", "total_amount"), "document_id")
        .join(nodes.select("node_id", "node_name", "node_order"), "node_id")
        .select(
            "assignee_id", "task_id", "instance_id", "document_id", "document_no", "document_type", "title",
            "total_amount", "node_name", "node_order", "created_at",
        )
    )


def instance_trace(instances: DataFrame, tasks: DataFrame, nodes: DataFrame, logs: DataFrame) -> DataFrame:
    """WF6: tasks and log entries of every instance as ordered rows (kind, position)."""
    own = instances.select("instance_id", "document_id", F.col("status").alias("instance_status"))
    task_rows = (
        tasks.join(nodes.select("node_id", "node_name"), "node_id")
        .select("instance_id", F.lit("task").alias("kind"), F.col("task_id").alias("position"),
                F.concat_ws(" ", "node_name", "status").alias("entry"))
    )
    log_rows = logs.select(
        "instance_id", F.lit("log").alias("kind"), F.lpad(F.col("seq").cast("string"), 19, "0").alias("position"),
        F.concat_ws(" ", "action", F.col("operator_id").cast("string")).alias("entry"),
    )
    return task_rows.unionByName(log_rows).join(own, "instance_id")
