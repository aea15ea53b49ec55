"""Readers, writers, and streams against their batch form."""

import json

from pyspark.sql import functions as F

from docketry.operators import intake, rules
from docketry.plans.derive import Inputs
from docketry.plans.flow_queries import _EVENT_SCHEMA, _FLOW_SCHEMA, flow_laws
from docketry.sources import files
from docketry.streaming import arrivals

FOLDER = "/root/testdata/sf0.001"


def test_json_documents(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"title": name, "full_text": "文\n字"}, indent=1, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "a.json.metadata.json").write_text("{}")
    (tmp_path / "bad.json").write_text("{ nothing")
    (tmp_path / "note.txt").write_text("x")
    docs = files.scan_json_docs(spark, str(tmp_path), "title string, full_text string")
    good, bad = files.quarantine(docs)
    assert sorted(r["title"] for r in good.collect()) == ["a", "b"]
    assert [r["file_path"].rsplit("/", 1)[1] for r in bad.collect()] == ["bad.json"]


def test_label_lines_skip_blank_ones(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"案號":"S1","受理與否":"受理"}\n\n{"案號":"S2","受理與否":"不受理","不受理款次":"77(2)"}\n  \n', encoding="utf-8")
    got = files.scan_jsonl_labels(spark, str(tmp_path), "案號", "受理與否", "受理", "不受理款次").orderBy("case_id").collect()
    assert [tuple(r) for r in got] == [("S1", 1, None), ("S2", 0, "77(2)")]


def test_charsets(spark, tmp_path):
    texts = {"u": "文字".encode(), "s": "文字".encode("utf-8-sig"), "b": "文字".encode("big5"), "x": b"\xff\xfe\x80ok"}
    for name, raw in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(raw)
    got = {r["path"][-5:-4]: (r["text"], r["charset"]) for r in files.decode_texts(files.scan_binary(spark, str(tmp_path))).collect()}
    # UTF-8 is tried first and accepts a byte order mark
    assert got == {"u": ("文字", "utf-8"), "s": ("﻿文字", "utf-8"), "b": ("文字", "big5"), "x": ("ok", "utf-8 (lossy)")}


def test_rerun_replaces_only_its_partitions(spark, tmp_path):
    table = spark.range(20).selectExpr("id AS case_id", "id % 4 AS slice", "1 AS revision")
    files.write_stage(table, str(tmp_path), "analysis", "slice")
    files.write_stage(table.filter("slice = 2").withColumn("revision", F.lit(2)), str(tmp_path), "analysis", "slice")
    got = files.read_stage(spark, str(tmp_path), "analysis")
    assert got.count() == 20 and got.filter("revision = 2").select("slice").distinct().collect()[0][0] == 2


def test_each_file_lands_once(spark, tmp_path):
    cases = Inputs(spark, FOLDER).event_cases
    source, target, checkpoint = (str(tmp_path / n) for n in ("input", "landed", "checkpoint"))
    cases.filter("case_id % 2 = 0").write.json(source)
    arrivals.land(arrivals.case_arrivals(spark, source, _EVENT_SCHEMA), target, checkpoint)
    arrivals.land(arrivals.case_arrivals(spark, source, _EVENT_SCHEMA), target, checkpoint)
    cases.filter("case_id % 2 = 1").write.mode("append").json(source)
    arrivals.land(arrivals.case_arrivals(spark, source, _EVENT_SCHEMA), target, checkpoint)
    landed = spark.read.parquet(target)
    assert landed.count() == cases.count() == landed.select("case_id").distinct().count()
    batch = {(r["case_id"], r["clause"]) for r in arrivals.analyze(cases).select("case_id", "clause").collect()}
    assert {(r["case_id"], r["clause"]) for r in arrivals.analyze(landed).select("case_id", "clause").collect()} == batch


def test_stages_of_the_stream_equal_the_batch(spark, tmp_path):
    t = Inputs(spark, FOLDER)
    cases, laws = t.flow_cases, flow_laws(t)
    cases.repartition(3).write.json(str(tmp_path / "input"))
    stream = arrivals.case_arrivals(spark, str(tmp_path / "input"), _FLOW_SCHEMA, files_per_batch=1)
    arrivals.stage_flow(stream, str(tmp_path / "stages"), str(tmp_path / "checkpoint"), laws)
    analysis = files.read_stage(spark, str(tmp_path / "stages"), "analysis")
    assert analysis.select("batch_id").distinct().count() == 3
    assert not [c for c in analysis.columns if c.startswith("_")]
    whole = arrivals.analyze(cases)
    paragraphs, findings = arrivals.draft_paragraphs(whole), rules.defect_checks(whole)
    verdicts = arrivals.verify_drafts(intake.public_projection(whole), paragraphs, findings, laws)
    for stage, table in (("draft", paragraphs.select("case_id", "main", "text")), ("findings", findings.select("case_id", "check_id")), ("verify", verdicts)):
        ours = files.read_stage(spark, str(tmp_path / "stages"), stage).select(*table.columns)
        assert ours.exceptAll(table).count() == 0 and table.exceptAll(ours).count() == 0
    assert {r["check_id"] for r in verdicts.select("check_id").distinct().collect()} == {f"V{i}" for i in range(1, 11)}


def test_later_drafts_meet_earlier_analyses_and_reruns_change_nothing(spark, tmp_path):
    root, folder = str(tmp_path / "stages"), tmp_path / "input"
    folder.mkdir()

    def arrive(name, *rows):
        base = {"agency": "府", "doc_no": "字", "legal_basis": "", "disposition_date": "民國113年1月2日", "service_date": "民國113年1月2日", "act_date": "",
                "service_method": "本人", "revoked": "", "disposition_revoked": "", "previously_decided": ""}
        lines = [json.dumps(base | row, ensure_ascii=False) for row in rows]
        (folder / name).write_text("\n".join(lines), encoding="utf-8")

    def reply(main, text, responds="C1"):
        return json.dumps({"main": main, "remedy_notice": "", "paragraphs": [{"text": text, "cites": ["洗錢防制法第9條"], "responds_to": [responds]}]}, ensure_ascii=False)

    def verdicts(case):
        rows = files.read_stage(spark, root, "verify").filter(F.col("case_id") == case).orderBy("batch_id").collect()
        return [(r["batch_id"], r["check_id"], r["status"]) for r in rows]

    law = [(case, None, "洗錢防制法", article, "", "", "") for case, article in ((1, "9"), (2, "8"))]
    laws = spark.createDataFrame(law, "case_id bigint, citation string, law string, article string, title string, text string, source string")

    def flow():
        stream = arrivals.case_arrivals(spark, str(folder), _FLOW_SCHEMA)
        arrivals.stage_flow(stream, root, str(tmp_path / "checkpoint"), laws)

    arrive("a.json", {"case_id": 1, "filed_date": "民國113年1月9日", "claim_ids": "C1", "reply": reply("訴願駁回。", "按洗錢防制法第9條")},
           {"case_id": 2, "filed_date": "民國113年1月9日", "claim_ids": "C1"}, {"case_id": 3, "filed_date": "民國113年9月9日", "reply": reply("訴願駁回。", "x")})
    flow()
    assert {c for _, c, _ in verdicts(1)} == {f"V{i}" for i in range(1, 11)} and not verdicts(2) and not verdicts(3)
    assert dict((c, s) for _, c, s in verdicts(1))["V1"] == "pass"
    # a draft that comes later meets the analysis, findings and laws of the first batch
    late = spark.createDataFrame([(2, reply("訴願不受理。", "按洗錢防制法第9條", "C9")), (77, reply("訴願駁回。", "no analysis"))], "case_id bigint, reply string")
    arrivals.land_drafts(late, root, 1_000)
    flow()
    found = {c: s for _, c, s in verdicts(2)}
    assert (found["V1"], found["V4"], found["V7"], found["V10"]) == ("fail", "fail", "fail", "fail") and not verdicts(77)
    before = sorted(files.read_stage(spark, root, "verify").collect())
    # the same drafts written once more, as after a lost driver: their batch is verified anew and replaced
    arrivals.land_drafts(late, root, 1_000)
    flow()
    assert sorted(files.read_stage(spark, root, "verify").collect()) == before
    # a second batch of cases leaves the first alone; a case that comes again is judged by its last analysis
    arrive("b.json", {"case_id": 2, "filed_date": "民國113年1月9日", "claim_ids": "C9", "legal_basis": "法", "reply": reply("訴願駁回。", "按洗錢防制法第9條", "C9")})
    flow()
    assert [r for r in sorted(files.read_stage(spark, root, "verify").collect()) if r["case_id"] == 1] == [r for r in before if r["case_id"] == 1]
    again = {c: s for batch, c, s in verdicts(2) if batch == 1}
    assert (again["V4"], again["V7"], again["V10"]) == ("pass", "pass", "skipped")


def test_requests_of_several_batches_are_told_apart(spark, tmp_path):
    """A repeat in a later batch is dropped while the state lasts; after the delay it counts again."""
    source, once, checkpoint = (str(tmp_path / n) for n in ("input", "once", "checkpoint"))
    schema = "ts timestamp, body string"

    def batch(*rows):
        spark.createDataFrame(rows, "ts string, body string").selectExpr("CAST(ts AS timestamp) AS ts", "body").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        arrivals.land(arrivals.dedup_stream(stream, ["body"], "ts", "10 days"), once, checkpoint)

    batch(("2024-01-01", "a"), ("2024-01-01", "a"), ("2024-01-02", "b"))
    batch(("2024-01-05", "a"), ("2024-01-06", "c"))
    assert sorted(r["body"] for r in spark.read.parquet(once).collect()) == ["a", "b", "c"]
    batch(("2024-03-01", "d"))
    batch(("2024-03-02", "a"))
    assert sorted(r["body"] for r in spark.read.parquet(once).collect()) == ["a", "a", "b", "c", "d"]


def test_broken_and_empty_files_are_counted_and_good_cases_landed_once(spark, tmp_path):
    folder, root = tmp_path / "input", str(tmp_path / "tables")
    folder.mkdir()
    good = ['{"case_id": %d, "agency": "府"}' % i for i in range(6)]
    (folder / "good.json").write_text("\n".join(good[:3]), encoding="utf-8")
    (folder / "mixed.json").write_text("\n".join([good[3], '{"case_id": 9, "agency": "', good[4]]), encoding="utf-8")
    (folder / "broken.json").write_bytes(b"\xff\xfe\x00 nothing")
    (folder / "empty.json").write_text("\n \n")

    def state():
        rows = arrivals.arrival_report(spark, root).collect()
        return {r["file_path"].rsplit("/", 1)[1]: (r["state"], r["n_good"], r["n_bad"]) for r in rows}

    def landed():
        return sorted(r["case_id"] for r in spark.read.parquet(f"{root}/landed").select("case_id").collect())

    arrivals.land_cases(spark, str(folder), "case_id bigint, agency string", root, files_per_batch=2)
    first = {"good.json": ("good", 3, 0), "mixed.json": ("partly", 2, 1), "broken.json": ("broken", 0, 1), "empty.json": ("empty", 0, 0)}
    assert state() == first and landed() == [0, 1, 2, 3, 4]
    assert sorted(r["record"][:12] for r in spark.read.parquet(f"{root}/quarantine").collect())[0] == '{"case_id": '
    # what has been landed is not landed again
    arrivals.land_cases(spark, str(folder), "case_id bigint, agency string", root)
    assert state() == first and landed() == [0, 1, 2, 3, 4]
    (folder / "later.json").write_text(good[5], encoding="utf-8")
    arrivals.land_cases(spark, str(folder), "case_id bigint, agency string", root)
    assert state() == first | {"later.json": ("good", 1, 0)} and landed() == list(range(6))
