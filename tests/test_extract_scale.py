"""Extraction over many tokens: casts that never raise, patterns asked only where a sign of them is, tasks of bounded size."""

import datetime

from pyspark.sql import functions as F

from docaudit.fixtures import catalog, views
from docaudit.operators import extract as E, tickets as K


def tokens(spark, *texts):
    rows = [(1, i, text, 300, 600, 0.9) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "file_id long, token_idx int, text string, ymin int, xmin int, confidence double")


def strict(monkeypatch):
    """From now on a cast that meets no number fails instead of raising unseen."""
    column = type(F.lit(1))
    monkeypatch.setattr(column, "try_cast", column.cast)


def test_texts_without_a_date_raise_nothing(spark, monkeypatch):
    strict(monkeypatch)
    found = E.date_candidates(tokens(spark, "备注", "2024年3月5日", "", None, "1999-01-01", "2024-13-01")).collect()
    assert [(r.token_idx, r.issue_date) for r in found] == [(1, "2024-03-05")]


def test_tickets_without_a_departure_raise_nothing(spark, monkeypatch):
    strict(monkeypatch)
    assert len(K.parse_tickets(tokens(spark, "D1234", "备注", "2017年06月24日14:37开")).collect()) == 1


def test_patterns_are_asked_where_a_sign_is(spark):
    texts = ["见清单 12345678", "¥5", "￥7元", "3元", "1.50", "$2", None, "13%", "免税", "不征税 6%"]
    rows = tokens(spark, *texts).select("token_idx", E._money_items().alias("m"), E._rate_items().alias("r")).orderBy("token_idx").collect()
    assert [r.m and [int(m.cents) for m in r.m] for r in rows] == [None, [500], [700], [300], [150], [200], None, None, None, None]
    assert [r.r and [float(x.rate) for x in r.r] for r in rows] == [None] * 7 + [[0.13], [0.0], [0.06, 0.0]]


def test_tokens_are_dealt_by_the_size_of_their_table(spark, tmp_path, monkeypatch):
    day = datetime.date(2024, 1, 2)
    rows = [(k, k, "O", 1000.0 + k, day) for k in range(1, 601)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    monkeypatch.setattr(views, "DEALT_ROWS", 10, raising=False)
    made = views.Tables(spark, str(tmp_path)).tokens
    assert made.rdd.getNumPartitions() == 60
    assert made.groupBy("file_id").count().where("count = 16").count() == 600


def test_long_methods_are_not_generated(spark, tmp_path):
    views.Tables(spark, str(tmp_path))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_triples_are_searched_in_no_filter(spark):
    rows = [(f, i, text, 400, 600, 0.9) for f, texts in ((1, ("¥10.00", "¥1.30", "¥11.30")), (2, ("备注",)), (3, ("免税", None))) for i, text in enumerate(texts)]
    made = E.amount_fields(spark.createDataFrame(rows, "file_id long, token_idx int, text string, ymin int, xmin int, confidence double"))
    assert [(r.file_id, int(r.total_cents)) for r in made.collect()] == [(1, 1130)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "transform(" in line]


def test_category_reads_the_tokens_once(spark, tmp_path):
    day = datetime.date(2024, 1, 2)
    rows = [(k, k, "O", 1000.0 + k, day) for k in (1, 2, 3, 3, 4)] + [(None, 1, "O", 7.0, day)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate date").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    made = catalog.QUERIES["ex12_expense_category"](views.Tables(spark, str(tmp_path)))
    plan = made._jdf.queryExecution().executedPlan().toString()
    # Before: the tokens were made once for the words and once more for the parties.
    assert plan.count("Generate inline") == 1
    # Entries are built behind the shuffle alone, not in a filter on them as well.
    assert "size(" not in plan
    facts = E.text_flags(views.Tables(spark, str(tmp_path)).tokens).join(E.party_fields(views.Tables(spark, str(tmp_path)).tokens), "file_id")
    line = E.recommended_line(F.col("file_id").cast("decimal(36,0)"), F.col("seller_name.value"))
    apart = facts.select("file_id", line.alias("line")).where("line is not null").select("file_id", "line.*")
    assert sorted(made.collect()) == sorted(apart.collect()) and made.count() == 4


def test_words_are_found_wherever_they_stand(spark):
    words = sorted({w for held in E.FLAG_WORDS.values() for w in held})
    texts = [*words, *(f"上全{w}二" for w in words), *(w[:-1] for w in words), "", "备注", "一\n酒店", "13%", None, "酒 店", "高"]
    made = tokens(spark, *texts).withColumn("file_id", F.col("token_idx").cast("long"))
    for row in E.text_flags(made).collect():
        text = texts[row.file_id] or ""
        assert {n: row[n] for n in E.FLAG_WORDS} == {n: any(w in text for w in held) for n, held in E.FLAG_WORDS.items()}


def test_bare_numbers_are_told_from_longer_and_shorter_digits(spark):
    texts = ["1234567", "12345678", "123456789", "1" * 20, "1" * 21, "1234567890", "123456789012", "单号12345678", "No.1234567", "发票代码0123456789", "x2345678", None]
    made = tokens(spark, *texts).withColumn("file_id", F.col("token_idx").cast("long"))
    found = {texts[r.file_id]: (r.number and r.number.value, r.code and r.code.value) for r in E.invoice_numbers(made).collect()}
    expected = {t: (None, None) for t in texts} | {t: (t, None) for t in ("12345678", "1" * 20)} | {t: (None, t) for t in ("1234567890", "123456789012")}
    assert found == expected | {"单号12345678": ("12345678", None), "发票代码0123456789": (None, "0123456789")}
