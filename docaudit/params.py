"""Thresholds and value sets used by the rules, gathered in one frozen object.

The numbers and names below are fixed values: the results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Document types.
TRAVEL = "TRAVEL_REIMBURSEMENT"
EXPENSE = "EXPENSE_REIMBURSEMENT"
CORPORATE_TYPES = ("CORP_PAYMENT", "ADVANCE_PAYMENT", "BATCH_PAYMENT")
DOCUMENT_TYPES = (TRAVEL, EXPENSE) + CORPORATE_TYPES

# Roles, in plan order.
ROLES = ("amount_agent", "policy_agent", "anomaly_agent", "supplier_agent")
REVIEWER = "reviewer_agent"
FINDING_ROLES = ROLES + (REVIEWER,)
EVENT_ROLES = ("supervisor", "document_agent") + FINDING_ROLES + ("report_agent",)

# Invoice types that mean travel.
TICKET_WORDS = ("铁路", "火车", "航空", "机票", "客票", "行程单")
TRANSPORT_WORDS = TICKET_WORDS + ("出租车", "打车", "网约车", "交通")

# Night units.
NIGHT_UNITS = ("晚", "夜", "间夜", "间/夜", "间·夜")

# Allowance words and expense types.
ALLOWANCE_WORDS = ("津贴", "补贴", "补助", "包干", "餐补", "油补", "车补", "房补", "外勤")
ALLOWANCE_TYPES = (
    "差旅津贴", "交通补贴", "伙食补贴", "通讯补贴", "定额补助", "出差补贴",
    "加班餐补", "市内交通补贴", "包干补贴", "自驾油补", "误餐补助",
)
ALLOWANCE_RULE_WORDS = ("ALLOWANCE_EXEMPT", "POL_TRAVEL_ALLOWANCE", "POLICY_ALLOWANCE")

# Words that point to private spending.
SENSITIVE_WORDS = ("高尔夫", "游戏充值", "酒吧", "ktv", "美容美发", "奢侈品", "名牌包", "个人烟酒", "度假村套票")

# Abnormal company states.
ABNORMAL_STATUS_WORDS = ("注销", "吊销", "异常", "经营异常", "撤销")

# Words of a question that match every finding.
GENERIC_QUESTION_WORDS = ("超标", "发票", "金额", "公司", "连号", "行程")

# Document states.
ACTIVE_STATUSES = ("APPROVED", "PENDING_APPROVAL", "IN_REVIEW")
SUBMITTABLE = ("DRAFT", "REJECTED", "NEED_SUPPLEMENT")
RESUBMITTABLE = ("REJECTED", "NEED_SUPPLEMENT")
CANCELLABLE = ("SUBMITTED", "IN_REVIEW", "PENDING_APPROVAL")
EDITABLE = ("DRAFT", "REJECTED")


@dataclass(frozen=True)
class AuditParams:
    """Rule thresholds (money in yuan, distance in km, time in hours)."""

    tax_tolerance: str = "0.01"
    balance_tolerance: str = "0.01"
    allowance_tolerance: str = "0.01"
    run_min_length: int = 3
    run_min_total: str = "3000.00"
    run_high_total: str = "10000.00"
    run_high_length: int = 4
    run_chunk: int = 65536
    min_distance_km: float = 100.0
    unknown_distance_km: float = 999.0
    max_speed_kmh: float = 250.0
    speed_window_hours: float = 2.0
    high_overrun: str = "1.5"
    auto_approve_limit: str = "500.00"
    cfo_limit: str = "10000.00"
    split_days: int = 3
    split_limit: str = "3000.00"
    gated_categories: tuple[str, ...] = ("招待", "采购")
    gate_limit: str = "2000.00"
    price_percent: int = 90
    price_min_purchases: int = 10
    price_medium_percent: int = 10
    price_high_percent: int = 30
    score_high: int = 25
    score_medium: int = 10
    score_low: int = 3
    active_statuses: tuple[str, ...] = ACTIVE_STATUSES
    role_limits_ms: dict[str, int] = field(
        default_factory=lambda: {"amount_agent": 3000, "policy_agent": 15000, "anomaly_agent": 10000, "supplier_agent": 15000}
    )
    role_limit_default_ms: int = 30000
    task_deadline_s: int = 120
    verdict_ttl_s: int = 86400


DEFAULTS = AuditParams()
