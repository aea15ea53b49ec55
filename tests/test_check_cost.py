"""What the draft checks read once: laws, texts, the tables their metrics come from; and odd inputs of what reads them."""

from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions import citations as C, dates as D, text as T
from docketry.operators import verification as X
from docketry.plans.derive import Inputs
from docketry.plans.verification_queries import _CHECKED, checks_of, quality_flags

ODD = [None, "", "\0", "依訴願法第１０條", "洗錢防制法第22條\0訴願法第1條", "訴願法", "第3條", "建築法第5條之２及建築法第5條之2", " 訴願法第1條\n", "法第1條", "行政罰法§7、行政罰法第07條"]


def plan_of(table):
    table.collect()
    return table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_many_texts_are_read_like_each_alone(monkeypatch):
    reader = C._Reader()
    alone = [[part["citation"] for part in reader.distinct(text)] for text in ODD * 3]
    for at_once in (1, 7, 40, 1 << 20):
        monkeypatch.setattr(C, "_AT_ONCE", at_once)
        assert list(reader.names_of_each(ODD * 3)) == alone
    assert list(reader.names_of_each([])) == [] and alone[3] == ["訴願法第10條"] and alone[4] == ["洗錢防制法第22條", "訴願法第1條"]


def test_declared_citations_that_parse(spark):
    rows = [(0, None), (1, []), (2, [None]), (3, ["訴願法第1條", "無", None, "訴願法第1條"]), (4, ["無"]), (5, ["　行政罰法§７ "])]
    table = spark.createDataFrame(rows, "id int, cites array<string>").repartition(1)
    found = {r[0]: r[1] for r in table.select("id", C.parsed_citations(F.col("cites"))).collect()}
    assert found == {0: [], 1: [], 2: [], 3: ["訴願法第1條", "訴願法第1條"], 4: [], 5: ["行政罰法第7條"]}
    given = {r[0]: r[1] for r in table.filter("id > 0").select("id", X._given(F.col("cites"))).collect()}
    assert given == {1: 0, 2: 0, 3: 3, 4: 1, 5: 1}


def test_laws_are_read_in_one_pass(spark):
    rows = [(1, "訴願法第1條", "行政罰法", "7", None, "建築法第2條", None), (2, "無", " 行政罰法 ", " 7", "t", "建築法第2條", None), (3, "", "行政罰法", "", "建築法第1條", "建築法第2條、建築法第1條", "訴願法第3條"),
            (4, None, None, "7", None, None, None), (5, None, "行政罰法", "第8條之1", None, "建築法第2條", None), (6, None, "同法", "3", None, "同法第9條，建築法第2條", None)]
    laws = spark.createDataFrame(rows, "case_id int, citation string, law string, article string, title string, text string, source string")
    items = X.allowed_items(laws)
    found = {}
    for r in items.collect():
        found.setdefault(r["case_id"], []).append(r["item"])
    assert found == {1: ["訴願法第1條"], 2: ["行政罰法第7條"], 3: ["建築法第1條", "建築法第2條", "建築法第1條", "訴願法第3條"], 5: ["行政罰法第8條之1"], 6: ["建築法第2條"]}
    assert plan_of(items).count("Scan") == 1


def drafted(spark):
    paragraphs = spark.createDataFrame([(1, "並無違誤，原處分撤銷", ["訴願法§1"]), (1, "  ", []), (2, None, None), (2, "訴願駁回第條", ["無"])], "case_id long, text string, cites array<string>")
    drafts = spark.createDataFrame([(1, "原處分撤銷。"), (2, "訴願駁回。"), (3, "訴願駁回。")], "case_id long, main string")
    return paragraphs, drafts


def test_metrics_of_a_table_are_gathered_in_one_pass(spark):
    paragraphs, drafts = drafted(spark)
    judged = X.judge(drafts, [X.v3_article_format(paragraphs), X.v9_ruling_consistency(drafts, paragraphs)])
    gathered = [line for line in plan_of(judged).split("\n") if "partial_sum(v3_broken" in line]
    assert gathered and all("partial_sum(v9_filled" in line for line in gathered)
    found = {r["case_id"]: [(c["status"], c["level"], c["n_items"], c["n_evidence"]) for c in r["checks"]] for r in judged.collect()}
    assert found == {1: [("pass", "red", 1, 0), ("fail", "red", 1, 1)], 2: [("fail", "red", 1, 1), ("pass", "red", 1, 0)], 3: [("skipped", "red", 0, 0), ("skipped", "red", 0, 0)]}


def test_two_checks_made_apart_from_one_table_count_once(spark):
    items = spark.createDataFrame([(1, "訴願法第1條", X.DECLARED | X.ALLOWED), (1, "訴願法第2條", X.DECLARED | X.INLINE), (1, "訴願法第3條", X.INLINE)], "case_id long, item string, flags int")
    (row,) = X.judge(items.select("case_id"), [X.v1_unlisted_citations(items), X.v2_undeclared_inline(items)]).collect()
    assert [(c["n_items"], c["n_evidence"]) for c in row["checks"]] == [(2, 1), (2, 1)]


def test_cases_keep_only_what_is_read_and_their_dates_are_parsed_once(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    checks = {check.check_id: check for check in checks_of(t)}
    (ruled,) = {id(part.source): part.source for name in ("V7", "V8") for part in checks[name].rows}.values()
    assert ruled.columns == list(_CHECKED) and ruled.count() == t.cases.count()
    assert "regexp" not in plan_of(X.v6_ungrounded_dates(ruled, t.date_paragraphs.limit(0)).rows[0].source).lower()


def test_sentences_read_only_what_can_fail_red(spark):
    checks = {check.check_id: check for check in checks_of(Inputs(spark, "/root/testdata/sf0.001"))}
    assert {name for name, check in checks.items() if check.red_evidence is not None} == {"V1", "V3", "V4", "V5"}
    # unknown articles and responses to unknown claims are amber
    assert checks["V5"].evidence.filter("state = 'unknown'").count() > 0
    assert checks["V5"].red_evidence.count() == checks["V5"].evidence.filter("state = 'not_effective'").count()
    missing = checks["V4"].red_evidence
    assert 0 < missing.count() < checks["V4"].evidence.count()


def test_compared_claims_are_stored_for_sentences(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    v4 = {check.check_id: check for check in checks_of(t, listed=True)}["V4"]
    assert "Aggregate" not in plan_of(v4.red_evidence)
    plain = {check.check_id: check for check in checks_of(t)}["V4"]
    assert sorted(v4.evidence.collect()) == sorted(plain.evidence.collect())


def test_flags_never_broadcast_the_cases(spark):
    flags = quality_flags(spark, Inputs(spark, "/root/testdata/sf0.001"))
    assert "Broadcast" not in plan_of(flags)


def test_dates_that_no_calendar_has(spark):
    rows = ["0000年1月1日", "00年1月1日", "113年2月29日", "112年2月29日", "１１３年０１月９日", "2024/13/1", "2024.1.31 與 99年1月1日", "民國 99 年 12 月 31 日", "", None, "9年1月1日"]
    table = spark.createDataFrame([(text,) for text in rows], "x string")
    days = [r[0] for r in table.select(D.parse_date(F.col("x")).cast("string")).collect()]
    assert days == [None, "1911-01-01", "2024-02-29", None, "2024-01-09", None, "2024-01-31", "2010-12-31", None, None, None]
    written = spark.createDataFrame([("於113年2月29日、112 年 2 月 29 日、2024-1-5、0201/1/2及０８８/02/03",)], "x string") \
        .select(F.explode(D.date_texts(F.col("x"))).alias("raw")).select("raw", D.written_day(F.col("raw")).cast("string")).collect()
    assert [tuple(r) for r in written] == [("113年2月29日", "2024-02-29"), ("112 年 2 月 29 日", None), ("2024-1-5", "2024-01-05"), ("0201/1/2", "0201-01-02"), ("088/02/03", "1999-02-03")]


def test_fill_writes_like_a_formatter(spark):
    table = spark.createDataFrame([("a", 3), (None, None)], "x string, n long")
    values = (F.col("x"), F.col("n"), F.lit(30), F.col("x"))
    for row in table.select(T.fill(V.PERIOD_COUNTED, *values).alias("ours"), F.format_string(V.PERIOD_COUNTED, *values).alias("theirs")).collect():
        assert row["ours"] == row["theirs"]
