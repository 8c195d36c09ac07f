"""The shared findings table: rule catalogue and row builder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docaudit import params as P
from docaudit.schemas import FINDINGS, names

# Rule variant -> rule code, rule name, level, role, overridable.
RULES = {
    "header_line": ("R01_HEADER_LINE_MISMATCH", "单据总额与明细行累加不符", "high", "amount_agent", False),
    "invoice_sum": ("R02_INVOICE_SUM_MISMATCH", "发票价税合计与申报总额不符", "high", "amount_agent", False),
    "contract": ("R03_CONTRACT_OVERPAYMENT", "合同累计付款超过合同总额", "high", "amount_agent", False),
    "prepayment": ("R04_PREPAYMENT_OVER_OFFSET", "预付款超额冲销", "high", "amount_agent", False),
    "tax": ("R05_TAX_AMOUNT_MISMATCH", "发票不含税金额与税额之和异常", "medium", "amount_agent", True),
    "policy_exceeded": ("R05_POLICY_EXCEEDED", "差旅住宿费用超标", "medium", "policy_agent", True),
    "manual": ("R07_MANUAL_OVERRIDE_FLAG", "经办人手动修正票面数据提示", "medium", "amount_agent", True),
    "duplicate_inside": ("R08_INVOICE_DUPLICATE", "发票单内重复报销", "high", "anomaly_agent", False),
    "duplicate_across": ("R08_INVOICE_DUPLICATE", "发票跨单重复报销 (全局红线)", "high", "anomaly_agent", False),
    "collision": ("R09_SPATIO_TEMPORAL_COLLISION", "跨单行程时空物理轨迹碰撞", "high", "anomaly_agent", True),
    "transit_collision": ("R09_SPATIO_TEMPORAL_COLLISION", "交通行程期间异地消费冲突", "high", "anomaly_agent", True),
    "destination": ("R09_TRAVEL_DESTINATION_MISMATCH", "交通行程目的地与报销申报城市不一致", "high", "anomaly_agent", True),
    "hotel_date": ("R09_TRAVEL_HOTEL_DATE_CONFLICT", "交通行程时间与住宿日期冲突", "high", "anomaly_agent", True),
    "overlap": ("R09_TRAVEL_SEGMENT_OVERLAP", "多段交通行程时间重叠冲突", "high", "anomaly_agent", True),
    "sequential": ("R10_SEQUENTIAL_INVOICES", "同商户连号发票拆单风险", "medium", "anomaly_agent", True),
    "unregistered": ("R12_SUPPLIER_UNREGISTERED", "统一社会信用代码校验失败", "high", "supplier_agent", False),
    "policy_version": ("R12_POLICY_VERSION_MISMATCH", "报销所依据的制度版本已废止", "low", "policy_agent", True),
    "split_purchase": ("R07_SPLIT_PURCHASE", "同申请人同科目短期累计超审批阈值", "high", "anomaly_agent", True),
    "pre_approval": ("R10_MISSING_PRE_APPROVAL", "大额招待或采购缺少事前审批", "high", "policy_agent", False),
    "batch_total": ("R04_BATCH_TOTAL_MISMATCH", "批量付款明细之和与批次总额不符", "high", "amount_agent", False),
    "batch_count": ("R04_BATCH_COUNT_MISMATCH", "批量付款明细笔数与申报笔数不符", "high", "amount_agent", False),
    "batch_repeated": ("R04_REPEATED_ACCOUNT", "批次内收款账号重复", "medium", "amount_agent", True),
    "batch_shared": ("R04_SHARED_ACCOUNT", "不同收款人共用收款账号", "medium", "amount_agent", True),
    "price": ("R06_MARKET_PRICE_DEVIATION", "申报单价高于市场基准高位", "medium", "policy_agent", True),
    "dishonest": ("R13_SUPPLIER_DISHONEST", "供应商为最高法失信被执行人 (老赖)", "high", "supplier_agent", False),
    "policy_missing": ("R14_POLICY_NOT_FOUND", "差旅城市缺失或无对应制度标准", "low", "policy_agent", True),
    "shell": ("R15_SHELL_COMPANY", "供应商经营状态异常 (已注销/吊销/空壳)", "high", "supplier_agent", False),
    "purpose": ("R16_BUSINESS_PURPOSE_MISMATCH", "报销事由与明细偏离(公款私用嫌疑)", "high", "policy_agent", True),
    "scope": ("R17_SUPPLIER_SCOPE_DEVIATION", "供应商经营范围与采购业务严重偏离", "high", "supplier_agent", True),
}

# Advice per rule code or rule variant, in our own words.
ADVICE = {
    "R01": "核对明细金额后重新提交",
    "R02": "补齐发票或调整申报金额",
    "R03": "核对合同总额与已付款项，停止超付",
    "R04": "核对预付余额后调整冲销金额",
    "R05": "复核金额，超出部分自理或特批",
    "R06": "提供询价记录或重新议价",
    "R07": "对照原票核实修改后的金额",
    "R08": "剔除重复使用的发票",
    "R09": "核实交通凭证与真实行程",
    "R10": "核实是否拆单开票",
    "R12": "核实供应商登记代码",
    "R13": "更换供应商，暂停付款",
    "R14": "补充城市或制度标准",
    "R15": "停止付款并退回单据",
    "R16": "补充公务证明材料",
    "R17": "核查供应商履约能力",
    "H99": "该维度未完成核验，请人工复核",
    "policy_version": "按现行制度版本重新核定",
    "pre_approval": "补录有效的事前审批单",
    "batch_total": "核对付款明细与批次总额",
    "batch_count": "核对付款明细与申报笔数",
    "batch_repeated": "核实重复收款账号",
    "batch_shared": "核实收款人与账号的对应关系",
    "split_purchase": "合并金额后按审批权限重新申报",
}

_TITLE_LIMIT = 128


def _text_map(values: dict[str, Column] | None) -> Column:
    if not values:
        return F.create_map().cast("map<string,string>")
    parts = []
    for key, value in values.items():
        parts += [F.lit(key), value.cast("string")]
    return F.create_map(*parts)


def finding_row(
    rule: str,
    subject: Column,
    *,
    amount: Column | None = None,
    level: Column | None = None,
    title: Column | None = None,
    description: Column | None = None,
    actual: dict[str, Column] | None = None,
    expected: dict[str, Column] | None = None,
    evidence: tuple[str, ...] = (),
) -> Column:
    """One finding as a struct without its document id."""
    code, name, default_level, role, overridable = RULES[rule]
    head = F.lit(name) if title is None else title
    return F.struct(
        F.lit(code).alias("rule_code"),
        F.lit(name).alias("rule_name"),
        (F.lit(default_level) if level is None else level).alias("risk_level"),
        F.lit(role).alias("agent_role"),
        subject.cast("string").alias("subject_key"),
        (F.lit(None) if amount is None else amount).cast("decimal(38,2)").alias("discrepancy_amount"),
        F.lit(overridable).alias("is_overridable"),
        _text_map(actual).alias("actual_value"),
        _text_map(expected).alias("expected_value"),
        F.substring(head, 1, _TITLE_LIMIT).alias("title"),
        (head if description is None else description).alias("description"),
        F.lit(ADVICE.get(rule) or ADVICE[code[:3]]).alias("suggestion"),
        F.array(*[F.lit(e) for e in evidence]).cast("array<string>").alias("evidence_ids"),
    )


def emit(df: DataFrame, row: Column) -> DataFrame:
    """Every row of ``df`` becomes a finding."""
    return df.select("document_id", row.alias("_f")).select("document_id", "_f.*")


def emit_where(df: DataFrame, checks: list[tuple[Column, Column]]) -> DataFrame:
    """Several row checks in one pass over the input: (condition, finding struct) pairs."""
    found = F.array(*[F.when(F.coalesce(cond, F.lit(False)), row) for cond, row in checks])
    return (
        df.select("document_id", F.explode(F.array_compact(found)).alias("_f")).select("document_id", "_f.*")
    )


def union_findings(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def normalize_findings(findings: DataFrame) -> DataFrame:
    """Drop rows that break the finding contract and make discrepancies absolute."""
    valid = (
        F.col("rule_code").isNotNull()
        & F.col("rule_name").isNotNull()
        & F.col("title").isNotNull()
        & F.col("risk_level").isin("high", "medium", "low")
        & F.col("agent_role").isin(*P.FINDING_ROLES)
    )
    return (
        findings.where(valid)
        .withColumn("title", F.substring("title", 1, _TITLE_LIMIT))
        .withColumn("discrepancy_amount", F.abs("discrepancy_amount"))
        .select(*names(FINDINGS))
    )
