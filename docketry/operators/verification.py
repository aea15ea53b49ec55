"""Verification of drafts: set comparisons V1-V10, the report, rewrite and quality rules.

A check brings rows (case_id, metrics) and a verdict over the sums of its metrics per case. Checks
are judged by aggregations on case_id, which combine on the map side: nothing is gathered per case,
and a case with very many rows stays spread over all tasks. Tables that have a row per case or more are
joined by merge joins at every size: judged by their files alone they may look small enough for the driver. Sets are compared
by tagging both sides and aggregating on (case_id, item). What a check objects to is a long table
(case_id, check_id, item).
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions import citations, dates, labels, text as T
from docketry.functions.labels import contains_any
from docketry.session import stored


class Rows(NamedTuple):
    """Metrics over the rows of a table: those that all checks take from one table are gathered in a single pass over it."""
    source: DataFrame
    sums: dict[str, Column] = {}
    bits: dict[str, Column] = {}      # joined by OR instead


class Check(NamedTuple):
    check_id: str
    rows: list[DataFrame | Rows]     # case_id and numeric metrics, summed per case
    status: Column            # over the sums
    level: Column
    n_items: Column
    n_evidence: Column
    evidence: DataFrame | None = None
    detail: Column | None = None        # what a red failure says, over the sums and the texts
    texts: Rows | None = None           # texts that the detail mentions, over a table with a row per case
    red_evidence: DataFrame | None = None      # the items that a red failure lists; none for checks that never fail red or whose detail lists them


def _n(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _status(skipped: Column, failed: Column) -> Column:
    return F.when(skipped, "skipped").when(failed, "fail").otherwise("pass")


def judge(cases: DataFrame, checks: list[Check]) -> DataFrame:
    """One row per case with the array of its verdicts.

    The rows are summed per case with the metrics of their own table only, and the sums meet by merge joins on the case, which
    need no further shuffle: no row carries the empty metrics of other tables, and no sums are ever broadcast.
    """
    rows = list({id(table): table for check in checks for table in check.rows}.values())   # checks may share their rows
    bits = {name for table in rows if isinstance(table, Rows) for name in table.bits}
    parts: list[DataFrame] = []
    for table in _by_source([table for table in rows if isinstance(table, Rows)]) + [table for table in rows if not isinstance(table, Rows)]:
        shared = [i for i, part in enumerate(parts) if set(part.columns) & set(table.columns) - {"case_id"}]
        for i in reversed(shared):      # a metric that several tables bring is summed over all of them
            table = parts.pop(i).unionByName(table, allowMissingColumns=True)
        parts.append(table)
    summed = cases.filter(F.col("case_id").isNotNull()).select("case_id").distinct()
    for part in parts:
        sums = part.groupBy("case_id").agg(*[(F.bit_or if c in bits else F.sum)(c).alias(c) for c in part.columns if c != "case_id"])
        summed = summed.join(sums.hint("merge"), "case_id", "left")
    for texts in _by_source([check.texts for check in checks if check.texts is not None]):
        summed = summed.join(texts.hint("merge"), "case_id", "left")
    verdicts = [F.struct(F.lit(c.check_id).alias("check_id"), c.status.alias("status"), c.level.alias("level"),
                         c.n_items.cast("bigint").alias("n_items"), c.n_evidence.cast("bigint").alias("n_evidence"), _detail(c).alias("detail")) for c in checks]
    return summed.select("case_id", F.array(*verdicts).alias("checks"))


def _by_source(rows: list[Rows]) -> list[DataFrame]:
    """case_id and the metrics of each table that the rows stem from."""
    found: dict[int, tuple[DataFrame, dict[str, Column]]] = {}
    for part in rows:
        found.setdefault(id(part.source), (part.source, {}))[1].update({**part.sums, **part.bits})
    return [source.select("case_id", *[value.alias(name) for name, value in metrics.items()]) for source, metrics in found.values()]


def _detail(check: Check) -> Column:
    """Null unless the check fails red."""
    said = F.lit(None).cast("string") if check.detail is None else check.detail
    return F.when((check.status == "fail") & (check.level == "red"), said)


def _py_list(items: Column) -> Column:
    """Items in quotes and brackets; in double quotes where they hold single ones."""
    def quoted(item: Column) -> Column:
        mark = F.when(F.contains(item, F.lit("'")), '"').otherwise("'")
        return F.concat(mark, item, mark)

    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def results(cases: DataFrame, *checks: Check) -> DataFrame:
    return judge(cases, list(checks)).select("case_id", F.explode("checks").alias("c")).select("case_id", "c.*").drop("detail")


def with_evidence(cases: DataFrame, check: Check) -> DataFrame:
    """Verdicts in long form: one row per item objected to, one row with a null item where there is none."""
    judged = stored(results(cases, check), "verdicts")
    failed = F.col("status") == "fail"
    # the evidence is the large and possibly skewed side; an inner join lets it be split
    listed = check.evidence.drop("check_id").join(judged.filter(failed).hint("merge"), "case_id")
    rest = judged.filter(~failed | (F.col("n_evidence") == 0))
    return listed.unionByName(rest, allowMissingColumns=True)


def _tagged(left: DataFrame, right: DataFrame) -> DataFrame:
    """(case_id, item) of two sides with flags in_left, in_right; duplicates collapse before the shuffle."""
    both = left.select("case_id", "item", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select("case_id", "item", F.lit(0).alias("l"), F.lit(1).alias("r")))
    return _collapse(both)


def _collapse(tagged: DataFrame) -> DataFrame:
    # stated for all readers alike: a join would add it to its own branch only and so break the reuse of the shuffle
    known = F.col("case_id").isNotNull() & F.col("item").isNotNull()
    return tagged.filter(known).groupBy("case_id", "item").agg(F.max("l").alias("in_left"), F.max("r").alias("in_right"))


def _objected(items: DataFrame, check: str, where: Column) -> DataFrame:
    return items.filter(where).select("case_id", F.lit(check).alias("check_id"), "item")


def _declared(cites: Column) -> Column:
    """Declared citations, normalised; the unparsable ones are left to V3."""
    return citations.parsed_citations(cites)


def allowed_items(laws: DataFrame) -> DataFrame:
    """Whitelist entries per case, copies included (``cited_items`` collapses them). ``laws``: case_id, citation, law, article, and free texts (title, text, source).

    The structured citation counts alone; else law and article; else whatever the texts mention.
    """
    fields = [F.col(c).cast("string") for c in ("citation", "law", "article", "title", "text", "source")]
    return laws.select("case_id", F.explode(citations.listed_citations(*fields)).alias("item"))


def allowed_citations(laws: DataFrame) -> DataFrame:
    """Distinct whitelist per case."""
    return allowed_items(laws).distinct()


def paragraph_facts(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs with all that the checks read out of their texts and citations, found in one pass and stored.

    Adds _declared and _inline (normalised citations), _broken and _cites (numbers of broken marks and of declared citations);
    the checks take these columns where they are present and find the same out by themselves where they are not.
    """
    return stored(paragraphs.select(
        "*", _declared(F.col("cites")).alias("_declared"), citations.citation_names(F.col("text")).alias("_inline"),
        citations.malformed_count(F.col("text")).alias("_broken"), _given(F.col("cites")).alias("_cites")), "paragraphs")


def _given(cites: Column) -> Column:
    return F.size(F.filter(cites, T.is_filled))


DECLARED, INLINE, ALLOWED = 1, 2, 4


def cited_items(paragraphs: DataFrame, allowed: DataFrame | None = None, inline: bool = True) -> DataFrame:
    """(case_id, item, flags): where a citation occurs, in one pass over the paragraphs.

    All places are bits of one column. The table is stored, since every check on citations reads it.
    """
    known = "_declared" in paragraphs.columns
    found = [F.col("_declared") if known else _declared(F.col("cites"))]
    if inline:
        found.append(F.col("_inline") if known else citations.citation_names(F.col("text")))
    places = paragraphs.select("case_id", *[places.alias(f"_{i}") for i, places in enumerate(found)])
    # the declared ones come first
    rows = places.select("case_id", F.size("_0").alias("n"), F.posexplode(F.concat(*[f"_{i}" for i in range(len(found))])).alias("at", "item")) \
        .select("case_id", "item", F.when(F.col("at") < F.col("n"), DECLARED).otherwise(INLINE).alias("flag"))
    known = F.col("case_id").isNotNull() & F.col("item").isNotNull()     # see _collapse
    if allowed is not None:
        rows = rows.unionByName(allowed.select("case_id", "item", F.lit(ALLOWED).alias("flag")))
    return stored(rows.filter(known).groupBy("case_id", "item").agg(F.bit_or("flag").alias("flags")), "cited-items")


def _has(flag: int) -> Column:
    return (F.col("flags").bitwiseAND(flag) > 0).cast("int")


def citation_set_checks(items: DataFrame) -> list[Check]:
    """V1: declared citations must be on the whitelist. V2: citations in the text must be declared.

    ``items``: see ``cited_items``; both checks count over the same rows.
    """
    declared, inline, allowed = _has(DECLARED), _has(INLINE), _has(ALLOWED)
    unlisted, undeclared = declared * (1 - allowed), inline * (1 - declared)
    rows = Rows(items, {"v1_cited": declared, "v1_allowed": allowed, "v1_bad": unlisted, "v2_inline": inline, "v2_bad": undeclared})
    bad = _objected(items, "V1", unlisted == 1)
    return [
        Check("V1", [rows], _status((_n("v1_allowed") == 0) | (_n("v1_cited") == 0), _n("v1_bad") > 0), F.lit("red"),
              _n("v1_cited"), _n("v1_bad"), bad, T.fill(V.UNLISTED, _n("v1_bad").cast("bigint")), red_evidence=bad),
        Check("V2", [rows], _status(_n("v2_inline") == 0, _n("v2_bad") > 0), F.lit("amber"),
              _n("v2_inline"), _n("v2_bad"), _objected(items, "V2", undeclared == 1)),
    ]


def v1_unlisted_citations(items: DataFrame) -> Check:
    return citation_set_checks(items)[0]


def v2_undeclared_inline(items: DataFrame) -> Check:
    return citation_set_checks(items)[1]


def broken_marks(paragraphs: DataFrame) -> DataFrame:
    """Evidence of V3: the broken article marks with what stands around them, one row each."""
    marked = paragraphs.filter(F.col("_broken") > 0) if "_broken" in paragraphs.columns else paragraphs
    return marked.select("case_id", F.lit("V3").alias("check_id"), F.explode(citations.malformed_citations(F.col("text"))).alias("item"))


def v3_article_format(paragraphs: DataFrame) -> Check:
    """Broken article marks in the text are red, declared citations that do not parse amber."""
    if "_declared" in paragraphs.columns:
        broken, given, parsed = F.col("_broken"), F.col("_cites"), F.size("_declared")
    else:
        broken, given, parsed = citations.malformed_count(F.col("text")), _given(F.col("cites")), F.size(_declared(F.col("cites")))
    rows = Rows(paragraphs, {"v3_broken": broken, "v3_cites": given, "v3_bad": given - parsed})
    broken, bad, marks = _n("v3_broken") > 0, _n("v3_bad") > 0, broken_marks(paragraphs)
    return Check("V3", [rows], F.when(broken | bad, "fail").when(_n("v3_cites") == 0, "skipped").otherwise("pass"),
                 F.when(~broken & bad, "amber").otherwise("red"), _n("v3_cites"), F.when(broken, _n("v3_broken")).otherwise(_n("v3_bad")),
                 marks, T.fill(V.BROKEN_ARTICLES, _n("v3_broken").cast("bigint")), red_evidence=marks)


def v4_claim_coverage(claims: DataFrame, paragraphs: DataFrame, listed: bool = False) -> Check:
    """Claims without a response are red, responses to unknown claims amber.

    ``listed``: the evidence is read as well as the verdict, so the compared sets are stored.
    """
    responded = paragraphs.select("case_id", F.explode("responds_to").alias("item")).filter(F.coalesce("item", F.lit("")) != "")
    sides = _tagged(claims.select("case_id", F.col("claim_id").alias("item")), responded)
    if listed:
        sides = stored(sides, "claim-sides")
    missing, extra = F.col("in_left") * (1 - F.col("in_right")), F.col("in_right") * (1 - F.col("in_left"))
    rows = Rows(sides, {"v4_claims": F.col("in_left"), "v4_missing": missing, "v4_extra": extra})
    unanswered = _objected(sides, "V4", missing == 1)
    is_red = _n("v4_missing") > 0
    level = F.when((_n("v4_claims") > 0) & ~is_red & (_n("v4_extra") > 0), "amber").otherwise("red")
    # what is missing counts first; surplus responses are the objection only where nothing is missing
    missing_cases = sides.filter(missing == 1).select("case_id").distinct()
    surplus = _objected(sides, "V4", extra == 1).join(missing_cases.hint("merge"), "case_id", "left_anti")
    return Check("V4", [rows], _status(_n("v4_claims") == 0, is_red | (_n("v4_extra") > 0)), level, _n("v4_claims"),
                 F.when(is_red, _n("v4_missing")).otherwise(_n("v4_extra")), unanswered.unionByName(surplus),
                 T.fill(V.UNANSWERED, _n("v4_claims").cast("bigint"), _n("v4_missing").cast("bigint")), red_evidence=unanswered)


def effective_periods(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The days on which any version of a citation is valid, as tables without a row per version.

    First table: a row per citation, with the day before which it is valid by versions without a beginning (``until``) and the day
    from which it is valid by versions without an end (``since``). Second table: for a citation and year the periods
    that touch the year, joined where they meet, so that no year has more than half as many as days.
    """
    known = versions.filter(F.col("citation").isNotNull()).select(F.col("citation").alias("item"), F.col("effective_from").alias("start"), F.col("repealed_on").alias("end"))
    begun, ended = F.col("start").isNotNull(), F.col("end").isNotNull()
    whole = known.groupBy("item").agg(
        F.max(F.when(~begun & ended, F.col("end"))).alias("until"), F.min(F.when(~ended, F.coalesce("start", F.lit("0001-01-01").cast("date")))).alias("since"))
    years = F.sequence(F.year("start"), F.year(F.date_sub("end", 1)))
    parts = known.filter(begun & ended & (F.col("start") < F.col("end"))).withColumn("year", F.explode(years))
    first = F.greatest("start", F.make_date("year", F.lit(1), F.lit(1)))
    last = F.least("end", F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)))
    # of equal beginnings only the longest counts, which the map side finds
    longest = parts.select("item", "year", first.alias("start"), last.alias("end")).groupBy("item", "year", "start").agg(F.max("end").alias("end"))
    day = F.sort_array(F.collect_list(F.struct("start", "end")))
    none = F.array().cast("array<struct<start:date,end:date>>")

    def join_on(done: Column, period: Column) -> Column:
        before = F.try_element_at(done, F.lit(-1))
        meets = F.coalesce(period["start"] <= before["end"], F.lit(False))
        joined = F.struct(before["start"].alias("start"), F.greatest(before["end"], period["end"]).alias("end"))
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(period)))

    yearly = longest.groupBy("item", "year").agg(F.aggregate(day, none, join_on).alias("periods"))
    return whole, yearly


def effective_state(cited: DataFrame, versions: DataFrame) -> DataFrame:
    """case_id, item and state of cited articles at the day ``act``: effective, not_effective or unknown.

    ``cited``: case_id, item, act; ``versions``: citation, effective_from (null: always), repealed_on (null: never; the day itself is
    not valid any more). A cited article meets one row of each table, however many versions it has.
    """
    whole, yearly = effective_periods(versions)
    asked = cited.withColumn("year", F.year("act"))
    found = asked.join(whole.withColumn("known", F.lit(1)), "item", "left").join(yearly, ["item", "year"], "left")
    inside = F.exists("periods", lambda p: (p["start"] <= F.col("act")) & (F.col("act") < p["end"]))
    valid = reduce(lambda a, b: a | b, [F.coalesce(test, F.lit(False)) for test in (F.col("act") < F.col("until"), F.col("act") >= F.col("since"), inside)])
    return found.select("case_id", "item", F.when(F.col("known").isNull(), "unknown").when(valid, "effective").otherwise("not_effective").alias("state"))


def v5_effective_at_act(cases: DataFrame, items: DataFrame, versions: DataFrame | None) -> Check:
    """Cited articles valid on the act date: from <= act < repealed, as a lookup on the citation.

    ``versions``: citation, effective_from, repealed_on; several intervals per citation are fine. Without a
    version store the check is skipped for every case.
    """
    if versions is None:
        nothing = F.lit(0)
        return Check("V5", [], F.lit("skipped"), F.lit("red"), nothing, nothing, _objected(items, "V5", F.lit(False)))
    acts = cases.select("case_id", _parsed_day(cases, "act_date").alias("act")).filter(F.col("act").isNotNull())
    cited = items.filter(_has(DECLARED) == 1).select("case_id", "item").join(acts.hint("merge"), "case_id")
    looked = stored(effective_state(cited, versions), "looked-up")
    rows = Rows(looked, {"v5_cited": F.lit(1), "v5_bad": (F.col("state") == "not_effective").cast("int"), "v5_unknown": (F.col("state") == "unknown").cast("int")})
    bad, unknown = _n("v5_bad") > 0, _n("v5_unknown") > 0
    day = Rows(cases, {"v5_act": F.unix_date(_parsed_day(cases, "act_date"))})
    detail = T.fill(V.NOT_EFFECTIVE, _n("v5_bad").cast("bigint"), _iso("v5_act"))
    listed = looked.filter(F.col("state") != "effective").select("case_id", F.lit("V5").alias("check_id"), "item", "state")
    return Check("V5", [rows, day], _status(_n("v5_cited") == 0, bad | unknown), F.when(~bad & unknown, "amber").otherwise("red"), _n("v5_cited"),
                 F.when(bad, _n("v5_bad")).otherwise(_n("v5_unknown")),
                 listed, detail, red_evidence=listed.filter(F.col("state") != "unknown").drop("state"))    # what is unknown is no red objection


#: dates of a case and the columns of a timeline that hold them parsed
_PARSED = {"act_date": "_act", "disposition_date": "_disposition", "service_date": "_service", "filed_date": "_filed"}


def _parsed_day(cases: DataFrame, name: str) -> Column:
    """The day of a date of the cases; a timeline has parsed it already."""
    return F.col(_PARSED[name]) if _PARSED.get(name) in cases.columns else dates.parse_date(F.col(name))


def v6_ungrounded_dates(cases: DataFrame, paragraphs: DataFrame, allow_derived: bool = False) -> Check:
    """Dates in paragraphs that are not among the dates of the case."""
    sources = ["disposition_date", "service_date", "act_date", "filed_date"]
    if allow_derived:
        sources += ["service_effective_date", "appeal_deadline", "penalty_limitation_date"]
    known = cases.select("case_id", F.explode(F.array_distinct(F.array(*[_parsed_day(cases, c) for c in sources]))).alias("day")) \
        .filter(F.col("case_id").isNotNull() & F.col("day").isNotNull()).distinct()
    written = paragraphs.select("case_id", F.explode(dates.date_texts(F.col("text"))).alias("raw")) \
        .select("case_id", dates.written_day(F.col("raw")).alias("day"), "raw").filter(F.col("case_id").isNotNull() & F.col("day").isNotNull()) \
        .groupBy("case_id", "day", "raw").agg(F.count("*").alias("n"))
    # the verdict and the evidence both read it: the texts are searched once
    loose = stored(written.join(known.hint("merge"), ["case_id", "day"], "left_anti"), "loose-dates")
    rows = [Rows(known, {"v6_known": F.lit(1)}), Rows(loose, {"v6_loose": F.col("n")})]
    return Check("V6", rows, _status(_n("v6_known") == 0, _n("v6_loose") > 0), F.lit("amber"), _n("v6_known"), _n("v6_loose"),
                 loose.select("case_id", F.lit("V6").alias("check_id"), F.col("raw").alias("item")))


def v7_period_recheck(cases: DataFrame) -> Check:
    """Days from service to filing against the ruling.

    ``cases``: a gated timeline plus ``main``, the ruling of the draft. The raw service date counts
    here and no weekend is rolled, so the verdict can differ from the gate: ``period_conflicts``.
    """
    rows = Rows(cases, {"v7_elapsed": F.date_diff("_filed", "_service"),
                        "v7_rejects": F.contains(F.coalesce("main", F.lit("")), F.lit(V.RULING_WORDS["inadmissible"])).cast("int"),
                        "v7_service": F.unix_date("_service"), "v7_filed": F.unix_date("_filed")})
    elapsed, rejects = F.col("v7_elapsed"), F.col("v7_rejects") > 0
    late = elapsed > V.APPEAL_PERIOD_DAYS
    counted = T.fill(V.PERIOD_COUNTED, _iso("v7_service"), _iso("v7_filed"), elapsed.cast("bigint"), F.lit(V.APPEAL_PERIOD_DAYS))
    return Check("V7", [rows], _status(elapsed.isNull(), (elapsed < 0) | (late & ~rejects) | (~late & rejects)),
                 F.when(elapsed.isNull() | ((elapsed >= 0) & ~late & rejects), "amber").otherwise("red"), F.coalesce(elapsed, F.lit(0)), F.lit(0),
                 detail=F.concat(counted, F.when(elapsed < 0, V.PERIOD_REVERSED).otherwise(V.PERIOD_MISSED)))


def _iso(days: str) -> Column:
    """Days since 1970 as a date text; sums over one row per case are the day itself."""
    return F.date_format(F.date_from_unix_date(F.col(days).cast("int")), "yyyy-MM-dd")


def period_conflicts(cases: DataFrame) -> DataFrame:
    """Elapsed days beside the gate's view of the same case, to show where V7 and the gate disagree."""
    return cases.select("case_id", F.date_diff("_filed", "_service").alias("elapsed"),
                        F.coalesce(F.col("overdue_days") > 0, F.lit(False)).cast("int").alias("gate_overdue"))


def remedy_problems(notice: Column) -> Column:
    """Problems of a remedy notice: required words, period, abolished courts."""
    found = T.words_found(notice, V.ABOLISHED_COURTS)
    problems = F.filter(F.array(
        *[F.when(~F.contains(notice, F.lit(word)), V.REMEDY_NO_WORD % word) for word in V.REMEDY_REQUIRED],
        F.when(~contains_any(notice, V.REMEDY_PERIODS), V.REMEDY_NO_PERIOD),
        F.when(F.size(found) > 0, F.format_string(V.REMEDY_ABOLISHED, _py_list(found))),
    ), lambda p: p.isNotNull())
    return F.when(F.coalesce(notice, F.lit("")) == "", F.array().cast("array<string>")).otherwise(problems)


def v8_remedy_notice(drafts: DataFrame) -> Check:
    problems = remedy_problems(F.col("remedy_notice"))
    rows = Rows(drafts, {"v8_given": (F.coalesce("remedy_notice", F.lit("")) != "").cast("int"), "v8_bad": F.size(problems)})
    evidence = drafts.select("case_id", F.lit("V8").alias("check_id"), F.explode(problems).alias("item"))
    texts = Rows(drafts, {"v8_said": T.bind(problems, lambda p: F.when(F.size(p) > 0, F.concat(F.array_join(p, "；"), F.lit("。"), T.fill(V.CONCERNING, _py_list(p)))))})
    return Check("V8", [rows], _status(_n("v8_given") == 0, _n("v8_bad") > 0), F.lit("red"), _n("v8_given"), _n("v8_bad"), evidence, F.col("v8_said"), texts)


def v9_ruling_consistency(drafts: DataFrame, paragraphs: DataFrame) -> Check:
    """Words in the grounds that contradict the ruling; each paragraph is looked at on its own."""
    kind = labels.ruling_kind(F.coalesce("main", F.lit("")))
    ruled = Rows(drafts, {f"v9_{k}": F.coalesce(kind == k, F.lit(False)).cast("int") for k in V.CONTRADICTIONS})
    # a bit for each of the few fixed words
    flags = Rows(paragraphs, {"v9_filled": T.is_filled(F.col("text")).cast("int")}, {
        f"v9_words_{k}": reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.contains(F.col("text"), F.lit(word)), 1 << i).otherwise(0) for i, word in enumerate(words)])
        for k, words in V.CONTRADICTIONS.items()})
    hits = F.lit(0)
    for k in V.CONTRADICTIONS:
        hits = F.when(_n(f"v9_{k}") > 0, F.bit_count(_n(f"v9_words_{k}"))).otherwise(hits)
    no_kind = reduce(lambda a, b: a & b, [_n(f"v9_{k}") == 0 for k in V.CONTRADICTIONS])
    skipped = no_kind | (_n("v9_filled") == 0)
    # the words are few and fixed, so those that were found come from the sums
    found = F.filter(F.array(*[F.when((_n(f"v9_{k}") > 0) & (_n(f"v9_words_{k}").bitwiseAND(1 << i) > 0), word) for k, words in V.CONTRADICTIONS.items() for i, word in enumerate(words)]),
                     lambda word: word.isNotNull())
    texts = Rows(drafts, {"v9_main": F.coalesce("main", F.lit(""))})
    return Check("V9", [ruled, flags], _status(skipped, hits > 0), F.lit("red"), (_n("v9_filled") > 0).cast("int"), F.when(skipped, 0).otherwise(hits),
                 None, T.bind(_py_list(found), lambda listed: F.concat(T.fill(V.CONTRADICTED, F.col("v9_main"), listed), T.fill(V.CONCERNING, listed))), texts)


def v10_red_addressed(findings: DataFrame, paragraphs: DataFrame) -> Check:
    """Each red finding must be mentioned: one word of its title occurs in the grounds."""
    words = F.filter(F.split("title", r"[（）()、，,。\s/　]+", -1), lambda w: F.length(w) >= 2)
    reds = findings.filter(F.lower("level") == "red").select("case_id", F.col("check_id").alias("item"), words.alias("words"))
    mentioned = reds.join(paragraphs.select("case_id", "text").hint("merge"), "case_id") \
        .filter(F.exists("words", lambda w: F.contains(F.col("text"), w))).select("case_id", "item")
    # a title without words counts as mentioned
    both = reds.select("case_id", "item", F.lit(1).alias("l"), (F.size("words") == 0).cast("int").alias("r")).unionByName(
        mentioned.select("case_id", "item", F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = _collapse(both)
    bad = F.col("in_left") * (1 - F.col("in_right"))
    rows = Rows(sides, {"v10_reds": F.col("in_left"), "v10_bad": bad})
    return Check("V10", [rows], _status(_n("v10_reds") == 0, _n("v10_bad") > 0), F.lit("amber"), _n("v10_reds"), _n("v10_bad"), _objected(sides, "V10", bad == 1))


def issue_sentences(judged: DataFrame, checks: list[Check], width: int = 200) -> DataFrame:
    """The sentences that drive a rewrite, with detail and evidence: case_id, check_id, part, n_items, sentence; for every red failure.

    Evidence is listed in order of its text. A check that objects to at most ``width`` items has one sentence, part 0; more are dealt by the
    hash of the item to as many parts as hold about ``width`` each, so that no case, however large, gathers in a task. Every item stands in one part.
    """
    red = judged.select("case_id", F.explode("checks").alias("c")).select("case_id", "c.*").filter((F.col("status") == "fail") & (F.col("level") == "red"))
    items = reduce(lambda a, b: a.unionByName(b), [check.red_evidence.select("case_id", "check_id", "item") for check in checks if check.red_evidence is not None])
    part = F.pmod(F.xxhash64("item"), F.greatest(F.ceil(F.col("n_evidence") / width), F.lit(1)))
    dealt = items.join(red.select("case_id", "check_id", "n_evidence").hint("merge"), ["case_id", "check_id"]).select("case_id", "check_id", part.alias("part"), "item")
    listed = dealt.groupBy("case_id", "check_id", "part").agg(F.sort_array(F.collect_list("item")).alias("items"))
    name, hint = T.lit_map(V.CHECK_NAMES), T.lit_map(V.FIX_HINTS)
    rows = red.select("case_id", "check_id", "detail").join(listed.hint("merge"), ["case_id", "check_id"], "left")
    said = F.concat(F.coalesce("detail", F.lit("")), F.when(F.col("items").isNotNull(), T.fill(V.CONCERNING, _py_list(F.col("items")))).otherwise(""))
    return rows.select(
        "case_id", "check_id", F.coalesce("part", F.lit(0)).cast("bigint").alias("part"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        T.fill(V.ISSUE_SENTENCE, F.try_element_at(name, F.col("check_id")), said, F.coalesce(F.try_element_at(hint, F.col("check_id")), F.lit(""))).alias("sentence"))


def verification_report(judged: DataFrame) -> DataFrame:
    """Summary per case of ``judge``: counts, blocking checks, sentences for the rewrite with the detail of each check.

    What the checks object to is listed by ``issue_sentences``, in bounded parts.
    """
    def letter(check: Column) -> Column:
        of_level = F.when(check["level"] == "red", "r").when(check["level"] == "amber", "a").otherwise("f")
        return F.when(check["status"] == "fail", of_level).when(check["status"] == "pass", "p").when(check["status"] == "skipped", "s").otherwise("-")

    def count(letters: str) -> Column:
        """Verdicts of these letters: what is left of all after the others are struck out."""
        return F.length(F.translate("letters", "".join(sorted(set("rafps-") - set(letters))), "")).cast("bigint")

    # the verdicts of a case are gone through once: a letter each, and the sentences of those that block
    name, hint = T.lit_map(V.CHECK_NAMES), T.lit_map(V.FIX_HINTS)
    blocked = F.filter("checks", lambda c: (c["status"] == "fail") & (c["level"] == "red"))
    sentences = F.transform("blocked", lambda c: T.fill(
        V.ISSUE_SENTENCE, F.try_element_at(name, c["check_id"]), F.coalesce(c["detail"], F.lit("")), F.coalesce(F.try_element_at(hint, c["check_id"]), F.lit(""))))
    read = judged.select("case_id", F.array_join(F.transform("checks", letter), "").alias("letters"), blocked.alias("blocked"))
    counted = read.select(
        "case_id", F.length("letters").cast("bigint").alias("total"), count("p").alias("passed"), count("raf").alias("failed"),
        count("s").alias("skipped"), count("r").alias("red"), count("a").alias("amber"),
        F.array_join(F.col("blocked.check_id"), ",").alias("blocking"), F.array_join(sentences, "\n").alias("issues"))
    return counted.withColumn("all_passed", (F.col("failed") == 0).cast("int")).withColumn("blocking_passed", (F.col("red") == 0).cast("int"))


def needs_rewrite(reviews: DataFrame, max_rewrites: int = 1) -> DataFrame:
    """Rewrite decision and feedback. ``reviews``: passed, attacks (array of point, severity, fix), issues text, rewrites."""
    attacks = F.coalesce("attacks", F.array().cast("array<struct<point:string,severity:string,fix:string>>"))
    blocking = (F.coalesce("issues", F.lit("")) != "") | ~F.coalesce("passed", F.lit(True)) \
        | F.exists(attacks, lambda a: F.coalesce(a["severity"] == "high", F.lit(False)))
    heavy = F.filter(attacks, lambda a: a["severity"].isin("high", "medium"))
    lines = F.concat(
        F.filter(F.split(F.coalesce("issues", F.lit("")), "\n", -1), lambda i: i != ""),
        F.transform(heavy, lambda a: F.format_string(V.ATTACK_LINE, a["severity"], F.coalesce(a["point"], F.lit("")), F.coalesce(a["fix"], F.lit("")))))
    feedback = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")
    return reviews.select(
        *[c for c in reviews.columns if c != "attacks"], blocking.cast("int").alias("blocking_issue"),
        (blocking & (F.coalesce("rewrites", F.lit(0)) < max_rewrites)).cast("int").alias("rewrite"), feedback.alias("feedback"))


def quality_flags(outcomes: DataFrame) -> DataFrame:
    """Ordered flags per case; only red rule issues ask for human review.

    ``outcomes``: case_id, need_human_review, blocking (comma list), passed, risk, rewrites.
    """
    blocking = F.coalesce("blocking", F.lit(""))
    listed = F.concat(F.lit("['"), F.replace(blocking, F.lit(","), F.lit("', '")), F.lit("']"))
    flags = F.filter(F.array(
        F.when(F.col("need_human_review") == 1, V.FLAG_CONFIDENCE),
        F.when(blocking != "", F.when(F.col("rewrites") > 0, T.fill(V.FLAG_RED_AGAIN, listed)).otherwise(T.fill(V.FLAG_RED, listed))),
        F.when(~F.coalesce("passed", F.lit(True)), V.FLAG_REVIEW),
        F.when(F.col("risk").isin("high", "medium"), T.fill(V.FLAG_RISK, F.col("risk"))),
        F.when(F.col("rewrites") > 0, T.fill(V.FLAG_REWRITTEN, F.col("rewrites").cast("string"))),
    ), lambda f: f.isNotNull())
    return outcomes.select("case_id", F.array_join(flags, "；").alias("flags"), F.size(flags).alias("n_flags"),
                           (blocking != "").cast("int").alias("human_review"))


def candidate_issues(route: Column) -> Column:
    """Issues of the route, then the common ones, then the rest label; distinct, in this order."""
    pool = T.lits(V.ROUTE_ISSUES[V.DEFAULT_ROUTE])
    for key, issues in V.ROUTE_ISSUES.items():
        pool = F.when(route == key, T.lits(issues)).otherwise(pool)
    return F.array_distinct(F.concat(pool, T.lits(V.COMMON_ISSUES), F.array(F.lit(V.OTHER_LABEL))))


def constrain_issue_tags(claims: DataFrame, tags: DataFrame) -> DataFrame:
    """Tags outside the pool or of unknown claims go; a claim left without a tag gets the rest label.

    ``claims``: case_id, route_key, pos, claim_id. ``tags``: case_id, claim_id, tags array, one row per claim.
    """
    none = F.array().cast("array<string>")
    joined = claims.join(tags, ["case_id", "claim_id"], "left")
    pool = candidate_issues(F.col("route_key"))
    kept = F.filter(F.coalesce("tags", none), lambda tag: F.array_contains(F.col("pool"), tag))
    return joined.withColumn("pool", pool).select(
        "case_id", "pos", "claim_id", F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit(V.OTHER_LABEL))).alias("tags"))
