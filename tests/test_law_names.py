"""Law names by trie and by table, against plain rules over the list."""

import random

import pytest
from pyspark.sql import functions as F

from docketry import values as V
from docketry.functions import citations as C
from docketry.functions.law_names import LawNames

SIGNS = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉"


def many_laws(n, seed=3):
    rng, out = random.Random(seed), {}
    while len(out) < n:
        out["".join(rng.choices(SIGNS, k=rng.randint(3, 9))) + rng.choice(["法", "條例"])] = None
    return list(out)


def plain(name, laws):
    """Every rule as it is said, by looking at all laws."""
    whole = [law for law in laws if name.endswith(law)]
    clipped = [law for law in laws if len(law) >= 5 and name.endswith(law[1:])]
    pronouns = [word for word in V.PRONOUN_LAWS if name.endswith(word)]
    if whole or clipped or pronouns:
        return max(whole, key=len) if whole else clipped[0] if clipped else max(pronouns, key=len)
    rests = [name.rpartition(word)[2] for word in V.LAW_LEAD_WORDS if word in name]
    return min((rest for rest in rests if len(rest) >= 2), key=len, default=name)


def asked_names(laws, rng):
    out = ["", "法", "同法", "惟同法", "依法", "按依違反依某某辦法", "訴願人依依", "本件依據某辦法"]
    for law in rng.sample(laws, 60):
        out += [law, "訴願人違反" + law, law[1:], "依" + law[1:], law[2:], "業者按" + law + "辦法"]
    return out


@pytest.mark.parametrize("laws", [V.REGISTERED_LAWS, many_laws(400)], ids=["fixed list", "many"])
def test_walk_equals_plain_rules(laws):
    names, rng = LawNames(laws), random.Random(1)
    for name in asked_names(laws * 4, rng):
        assert names.resolve(name) == plain(name, laws), name


def test_table_of_fifty_thousand_laws(spark):
    """Walk and join agree on every name, one of which is a third of the rows; rows, nulls and other columns stay."""
    laws = many_laws(50_000)
    asked = asked_names(laws, random.Random(2))
    asked += [laws[7]] * (len(asked) // 2) + [None, " 訴願人 違反" + laws[3]]
    rows = spark.createDataFrame(list(enumerate(asked)), "place long, name string").withColumn("law_", F.lit(1))
    # repeated and null laws change nothing
    table = spark.createDataFrame([*enumerate(laws), (60_000, laws[0]), (60_001, None)], "place long, law string")
    found = C.resolve_laws(rows, "name", table)
    assert found.columns == ["place", "name", "law_", "law"]
    got, names = {r["place"]: r["law"] for r in found.collect()}, LawNames(laws)
    assert len(got) == len(asked)
    for place, name in enumerate(asked):
        assert got[place] == names.resolve("".join((name or "").split())), name


def test_empty_tables(spark):
    rows = spark.createDataFrame([("依據某辦法",), ("同法",)], "name string")
    none = spark.createDataFrame([], "place long, law string")
    assert sorted(r["law"] for r in C.resolve_laws(rows, "name", none).collect()) == ["同法", "某辦法"]
    assert C.resolve_laws(rows.limit(0), "name", none).count() == 0


def test_a_citation_as_written_is_resolved_once_for_a_batch():
    from docketry.functions.citations import _Reader

    reader, taken = _Reader(), []
    resolve = reader._part
    reader._part = lambda match: taken.append(match[0]) or resolve(match)
    texts = ["按行政罰法第7條及訴願法§1之2", "另行政罰法第7條，再依行政罰法第８條", None, "惟同法第3條"]
    assert [reader.names_of(text) for text in texts] == [[part["citation"] for part in reader.distinct(text)] for text in texts]
    assert reader.names_of(texts[0]) == ["行政罰法第7條", "訴願法第1條之2"] and reader.names_of(texts[3]) == []
    assert len(taken) == len(set(taken))


def test_only_runs_of_other_digits_are_translated():
    from docketry import values as V
    from docketry.functions.citations import _Reader

    reader = _Reader()
    for text in ("", None, "依訴願法第１０條之２及第3條", "甲" * 50 + "０１２３４５６７８９0123456789", "無數字"):
        assert reader.plain(text) == (text or "").translate(str.maketrans(V.FULLWIDTH_DIGITS, V.ASCII_DIGITS))
    reader.digits = {}      # a text without other digits never meets the table
    assert reader.plain("依訴願法第10條") == "依訴願法第10條"
    assert reader.names_of("依訴願法第10條") == ["訴願法第10條"]
