"""Worked examples through Spark."""

import pytest
from pyspark.sql import functions as F

from docketry.functions import citations as C
from docketry.functions import dates as D
from docketry.functions import labels as L
from docketry.functions import text as T
from docketry.operators import corpus, evaluation, intake, rules


def one(spark, build, *values):
    """Value of an expression over one row of string columns a, b, ..."""
    schema = ", ".join(f"{chr(97 + i)} string" for i in range(len(values)))
    row = spark.createDataFrame([tuple(values)], schema)
    return row.select(build(*[F.col(chr(97 + i)) for i in range(len(values))]).alias("v")).head()["v"]


@pytest.mark.parametrize("text, expected", [
    ("洗錢防制法§22", "洗錢防制法第22條"),
    ("洗錢防制法第 22 條第 1 項", "洗錢防制法第22條"),
    ("訴願人違反空氣汙染防制法第15條之2", "空氣污染防制法第15條之2"),
    ("洗錢防制法§15-2", "洗錢防制法第15條之2"),
    ("洗錢防制法第０２２條", "洗錢防制法第22條"),
    ("棄物清理法第27條", "廢棄物清理法第27條"),
    ("業者違反攤販管理自治條例第3條", "攤販管理自治條例第3條"),
    ("惟同法第3條", None), ("判決-洗錢防制法第22條", None), ("", None), (None, None),
])
def test_normalize_citation(spark, text, expected):
    assert one(spark, C.normalize_citation, text) == expected


def test_extract_keeps_order_and_drops_copies(spark):
    text = "依訴願法第77條，洗錢防制法§22及訴願法第077條，按本法第3條"
    assert one(spark, C.citation_names, text) == ["訴願法第77條", "洗錢防制法第22條"]


def test_follow_on_takes_the_law_before_it(spark):
    text = "第1條、廢棄物清理法第27條及第50條，訴願法第77條或第79條之1"
    assert one(spark, C.follow_on_citations, text) == ["廢棄物清理法第50條", "訴願法第79條之1"]
    assert one(spark, C.follow_on_citations, "及第50條") == []


def test_follow_on_counts_a_repeated_citation_once(spark):
    # the last distinct citation decides, so a repeated one does not move to the end
    text = "訴願法第1條，建築法第2條，訴願法第1條及第3條"
    assert one(spark, C.follow_on_citations, text) == ["建築法第3條"]


@pytest.mark.parametrize("text, hits", [
    ("依第15條之，", ["依第15條之，"]), ("第條", ["第條"]), ("§ 前", ["§ 前"]), ("第15條之2", []), ("第15條之 2", ["第15條之 2"]), ("正常", []),
])
def test_malformed(spark, text, hits):
    assert one(spark, C.malformed_citations, text) == hits


def test_malformed_windows_may_overlap(spark):
    found = one(spark, C.malformed_citations, "一二三四五六七八九十甲乙丙第條丁\n第條戊")
    assert found == ["二三四五六七八九十甲乙丙第條丁 第條戊", "六七八九十甲乙丙第條丁 第條戊"]


@pytest.mark.parametrize("text, day", [
    ("民國114年3月5日", "2025-03-05"), ("114.3.5", "2025-03-05"), ("114/03/05", "2025-03-05"), ("2025-03-05", "2025-03-05"),
    ("民國112年2月29日", None), ("民國113年2月29日", "2024-02-29"), ("民國１１４年３月５日", "2025-03-05"), ("不詳", None), ("", None), (None, None),
])
def test_parse_date(spark, text, day):
    assert one(spark, lambda a: D.parse_date(a).cast("string"), text) == day


def test_leap_day_has_no_limitation_end(spark):
    assert one(spark, lambda a: D.limitation_end(a.cast("date")).cast("string"), "2024-02-29") is None
    assert one(spark, lambda a: D.limitation_end(a.cast("date")).cast("string"), "2024-03-01") == "2027-03-01"


def test_roc_year(spark):
    assert one(spark, D.roc_year, "2024-11-28") == 113
    assert one(spark, D.roc_year, "") == 0


@pytest.mark.parametrize("raw, clause", [("77-2", "2"), ("77(2)", "2"), ("77（2）", "2"), ("2", "2"), ("第77條第2款", None), ("77-5", None), ("無", None), (None, None)])
def test_clause_number(spark, raw, clause):
    # '第77條第2款' has no clause right after 77, so its first number (77) decides and no template knows it
    assert one(spark, L.clause_number, raw) == clause


@pytest.mark.parametrize("text, number", [
    ("於3月1日以北府經司字第1140012345號", "北府經司字第1140012345號"), ("依環署廢字第 1130001 號", "環署廢字第1130001號"), ("以府字第1號", "以府字第1號"), ("無", ""),
])
def test_document_number(spark, text, number):
    assert one(spark, T.document_number, text) == number


@pytest.mark.parametrize("text, amount", [
    ("依第27條處新臺幣3,000元", 3000), ("罰鍰6萬元", 60000), ("第27元", None), ("10元及裁處10,000元罰鍰", 10000), (",元", None),
])
def test_amount(spark, text, amount):
    assert one(spark, T.penalty_amount, text) == amount


def test_digits_split_over_lines_are_joined(spark):
    assert one(spark, T.normalize_text, "1\n13 年\r\n第　 22\t條\n\n\n\n完 ") == "113 年\n第 22 條\n\n完"


@pytest.mark.parametrize("text, expected", [
    ("一、甲\n(二)乙\n3. 丙", ["甲", "乙", "丙"]), ("甲。乙；丙", ["甲", "乙", "丙"]), ("整段", ["整段"]), ("", []),
])
def test_split_claims(spark, text, expected):
    assert [c["quote"] for c in one(spark, T.split_claims, text)] == expected


def masked(spark, text):
    return corpus.mask_pii(spark.createDataFrame([(1, text)], "doc_id int, text string")).head()


def test_party_names(spark):
    row = masked(spark, "訴訟代理人 劉杉涼\n陳錦英\n王綉\n主文\n陳二三\n訴 願 人　王綉 律師\n原告 歐陽大同（住）\n訴願人 遂於\n訴願人 遂於113年\n05 被告 張三 會計師")
    assert row["text"] == ("訴訟代理人 劉○涼\n陳○英\n王○\n主文\n陳二三\n訴 願 人　王○ 律師\n原告 歐○○同（住）\n訴願人 遂於\n訴願人 遂於113年\n05 被告 張○ 會計師")
    assert (row["n_party"], row["n_following"]) == (4, 2)


def test_fixed_kinds_of_personal_data(spark):
    row = masked(spark, "電話0912-345-678，A123456789，住新北市板橋區文化路一段12號3樓，文號1131914523，B1234567890")
    assert row["text"] == "電話○○○，○○○，○○○，文號1131914523，B1234567890"
    assert (row["n_id"], row["n_address"], row["n_phone"]) == (1, 1, 1)


def test_masking_twice_equals_masking_once(spark):
    text = "訴訟代理人 劉杉涼\n陳錦英\n電話0912-345-678 A123456789\n代表人 李四\n新北市板橋區文化路12號"
    once = masked(spark, text)["text"]
    again = masked(spark, once)
    assert again["text"] == once
    assert not any(again[n] for n in ("n_id", "n_address", "n_phone", "n_party", "n_following"))


def test_keyword_tie_goes_to_the_first_class(spark):
    assert one(spark, lambda a: intake.case_type_of(a)["label"], "使用執照與分貝") == "建築法"
    assert one(spark, lambda a: intake.case_type_of(a)["label"], "無") == "其他"
    assert one(spark, lambda a: intake.case_type_of(a)["confidence"], "洗錢防制法") == 1.0


def test_triage_precedence(spark):
    rows = [("程式", 30), ("程式不合未補正", 30), ("未成年且為無關第三人", 30), ("原處分現況為「有效」。", 30),
            ("於民國113年1月1日送達之行政處分,於民國113年2月5日提起訴願", 30), ("於民國113年1月1日送達之行政處分,於民國113年2月5日提起訴願", 60)]
    table = spark.createDataFrame([(i, t, None, None, d) for i, (t, d) in enumerate(rows)],
                                  "case_id int, narrative string, service_component string, filed_component string, statutory_days int")
    got = [r["clause"] for r in rules.triage_rules(table).orderBy("case_id").collect()]
    assert got == [None, "77(1)", "77(4)", None, "77(2)", None]


def test_stated_days_are_the_fallback(spark):
    table = spark.createDataFrame([(1, "距收受原處分之日已 45 日"), (2, "未成年"), (3, "未成年且無法定代理人")], "case_id int, text string")
    got = {r["case_id"]: (r["clause"], r["reason"]) for r in rules.triage_rules_pdf(table).collect()}
    assert got[1] == ("77(2)", "提起訴願逾法定 30 日期間(訴願書載明已 45 日,逾期 15 日)。")
    assert got[2][0] is None and got[3][0] == "77(4)"


def test_review_without_verdict_falls_back_to_the_first_label(spark):
    first = spark.createDataFrame([(1, 1, "", "a", "高"), (2, 0, "77(4)", "b", "高"), (3, None, None, None, None), (4, 1, "", "d", "低")],
                                  "id int, label int, clause string, reason string, confidence string")
    second = spark.createDataFrame([(1, None, None, None), (2, 1, "", "x"), (3, 0, "77(2)", "y"), (4, 0, "77 (4)", "z")],
                                   "id int, label_2 int, clause_2 string, reason_2 string")
    cascade = evaluation.cascade_review(first, second, "id")
    got = {r["id"]: (r["reviewed"], r["final_label"], r["used"]) for r in cascade.collect()}
    assert got == {1: (1, 1, "first (no review result)"), 2: (0, 0, "first"), 3: (1, 0, "second"), 4: (1, 0, "second")}
    people = cascade.withColumn("is_adult", F.lit(1)).withColumn("is_company", F.lit(0)).withColumn("born", F.lit("民國80年1月1日")).withColumn("age", F.lit(33))
    guarded = {r["id"]: (r["overruled"], r["final_label"], r["final_clause"]) for r in evaluation.capacity_guard(people).collect()}
    assert guarded[4] == (1, 1, "") and guarded[1] == (0, 1, None) and guarded[3] == (0, 0, "77(2)")


def test_scorer_input_has_no_answers(spark):
    records = spark.createDataFrame([("1", "x", "受理", "77(2)", "r", "e", 3)], "`案號` string, narrative string, `受理與否` string, `不受理款次` string, `判定理由` string, `實體結果` string, `逾期天數` int")
    assert intake.mask_answer_columns(records).columns == ["案號", "narrative"]


def test_missing_values_become_null_once(spark):
    row = intake.normalize_missing(spark.createDataFrame([("", 0, "a")], "x string, n int, y string")).head()
    assert (row["x"], row["n"], row["y"]) == (None, 0, "a")
