from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from millrace.operators import profiles, scopes, scores
from millrace.operators.phrases import Entry, extract_from_segments
from millrace.operators.segments import segments
from millrace.operators.title_tags import AREA, HEAD, KIND, NOISE, RANK, Vocabulary, normalised_titles, roles_of, titles_of


def test_hierarchical_scores(spark):
    schema = "k int, country string, city string, _e0 int"
    expected = spark.createDataFrame([(1, "XA", "b", 0), (1, "XA", "c", 0), (2, "XB", None, 0), (3, "XC", "d", 0), (3, "XC", "d", 0)], schema)
    found = spark.createDataFrame([(1, "XA", "b", 0), (1, "XA", None, 0), (2, "XB", "e", 0), (4, "XA", "b", 0), (3, "XD", "d", 0), (1, "XA", "b", 0)], schema)
    row = scores.hierarchical_scores(expected, found, "k", ["country", "city"]).first()
    assert tuple(row) == (5, 1, 1, 3, 4, 1, 0.4, 0.25)
    none = scores.hierarchical_scores(expected.limit(0), found.limit(0), "k", ["country", "city"]).first()
    assert tuple(none) == (0, 0, 0, 0, 0, 0, None, None)


def test_stratified_share(spark):
    labels = spark.createDataFrame([("a", True), ("a", False), ("b", True), ("b", None), ("c", None)], "s string, hit boolean")
    sizes = spark.createDataFrame([("a", 30), ("b", 10), ("c", 60)], "s string, size long")
    share, error, reach = scores.stratified_share(labels, "s", "hit", sizes).first()
    assert share == 0.625 and reach == 25 and error == pytest.approx(30 * 0.5 / 40)
    assert scores.stratified_share(labels.limit(0), "s", "hit", sizes).first()[0] is None


def test_pair_recall_and_ceilings_and_sets(spark):
    labelled = spark.createDataFrame([(1, 2, True), (4, 3, True), (5, 6, False), (7, 8, True)], "a int, b int, same boolean")
    found = spark.createDataFrame([(2, 1), (3, 4), (6, 5), (3, 4)], "a int, b int")
    assert tuple(scores.pair_recall(labelled, found, "a", "b", "same").first()) == (3, 2, 1, pytest.approx(2 / 3))
    expected = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "id int, l string")
    given = spark.createDataFrame([(1, "x"), (2, "z"), (3, "z")], "id int, l string")
    assert sorted(map(tuple, scores.within_ceilings(expected, given, "id", "l", {"x": 1}).collect()), key=str) == [("x", 2, 1, True), ("y", 1, 1, False), (None, 1, 0, True)]
    items = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (2, "b"), (3, None), (4, "c"), (2, "a")], "k int, i string")
    assert [(r.items, r.n_keys) for r in scores.commonest_sets(items, "k", "i", 2).collect()] == [(["a", "b"], 2), ([], 1)]


def test_scopes(spark):
    df = spark.createDataFrame(
        [(1, "IN", None, "xx", ["p", "q"], D(2026, 1, 1, 23), 5), (2, "UNKNOWN", "R", None, ["p"], D(2026, 1, 2, 1), 7), (3, "UNKNOWN", "R", "fr", None, None, None), (4, "OUT", None, "en", [], D(2026, 1, 2, 9), 6), (5, None, None, "en", ["q", "p"], D(2026, 1, 3), None)],
        "id int, state string, reason string, lang string, items array<string>, at timestamp, years int",
    )
    scope = scopes.in_scope(F.col("state"), F.col("reason"), F.col("lang"), ["R"], ["en"])
    assert [r.x for r in df.select("id", scope.alias("x")).orderBy("id").collect()] == [True, True, False, False, False]
    assert [(r.id, r.n_met) for r in scopes.ranked_by_items(df, "id", F.col("items"), ["q", "p"], "at").collect()] == [(5, 2), (1, 2), (2, 1), (4, 0), (3, 0)]
    assert {r.n_met for r in scopes.ranked_by_items(df, "id", F.col("items"), [], "at").collect()} == {0}
    shown, counts = scopes.find(df, {"years": F.col("years") >= 5, "item": F.array_contains("items", "p")}, "at", "id")
    assert [r.id for r in shown.collect()] == [2, 1] and tuple(counts.first()) == (2, 1, 0)
    assert [r.v for r in df.select(scopes.variant(F.col("state"), {"IN": "lang", "OUT": "state"}).alias("v")).collect()] == ["xx", None, None, "OUT", None]


WORDS = Vocabulary(
    tags={"engineer": HEAD, "lead": RANK, "head": HEAD, "data": AREA, "data platform": KIND, "backend": AREA, "remote": NOISE, "manager": HEAD},
    respelled={"back end": "backend", "mgr": "manager", "eng": "engineer"}, whole={"chief data officer": "head data"},
)


@pytest.mark.parametrize(
    ("parts", "own", "titles"),
    [
        (["engineer", "backend"], [], ["backend engineer"]),
        (["remote", "back end eng"], [], ["backend engineer"]),
        (["head of data", "engineer"], [], ["data head", "engineer"]),
        (["head of data engineer"], [], ["data head"]),
        (["engineer data platform data"], [], ["data platform engineer"]),
        (["engineer / mgr", "data"], [], ["data engineer", "manager"]),
        (["engineer/mgr/head"], [], ["engineer", "manager"]),
        (["data engineer"], ["data"], ["engineer"]),
        (["chief data", "officer"], [], ["head data"]),
        (["lead"], [], []),
        ([], [], []),
    ],
)
def test_titles_of(parts, own, titles):
    assert titles_of(parts, WORDS, frozenset(own)) == titles


def test_normalised_titles(spark):
    df = spark.createDataFrame([(1, "Backend Eng, Remote", "z"), (2, None, "z"), (3, " ", "z"), (4, "Data Mgr | Eng", "z"), (5, "x" * 5000, "z"), (4, "Data Mgr | Eng", "z")], "id int, title string, titles_ string")
    found = normalised_titles(df, "title", WORDS, F.when(F.col("id") == 4, F.array(F.lit("data")))).withColumn("roles", roles_of(F.col("titles"), {"manager": "lead", "engineer": "none"}, {"engineer": "dev"}))
    assert sorted((r.id, r.titles, r.roles) for r in found.collect()) == [(1, ["backend engineer"], ["dev"]), (2, [], []), (3, [], []), (4, ["manager", "engineer"], ["lead"]), (4, ["manager", "engineer"], ["lead"]), (5, [], [])]
    assert normalised_titles(df.limit(0), "title", WORDS).count() == 0


def test_extraction_over_title_and_segments(spark):
    entries = [Entry("js", ("javascript",)), Entry("c", ("c++",))]
    df = spark.createDataFrame([(1, "JavaScript\nlead", "# Role\n- c++ and javascript\n> javascript here\nC++"), (2, None, None), (3, "c++", "> c++"), (1, "JavaScript\nlead", "# Role\n- c++ and javascript\n> javascript here\nC++")], "id int, title string, body string")
    found = extract_from_segments(df.withColumn("s", segments(F.col("body"))), "id", "title", "s", entries).collect()
    assert sorted((r.id, r.entry, r.segments) for r in found) == [(1, "c", [1, 3]), (1, "js", [-1, 1]), (3, "c", [-1])]


def test_profiles(spark):
    rows_ = spark.createDataFrame([("a", 1, "X"), ("a", 1, "X"), ("a", 2, None), ("b", 3, "Y"), (None, 4, "Y"), ("b", None, "Y")], "g string, m int, l string")
    found = {r.g: (r.n, round(r.share, 3), r.levels) for r in profiles.group_shares(rows_, "g", "m", "l").collect()}
    assert found == {"a": (2, 0.667, {"X": 0.5, "none": 0.5}), "b": (1, 0.333, {"Y": 1.0})}
    mentions = spark.createDataFrame([("dev lead", 1, "x"), ("dev lead", 2, "x"), ("dev lead", 2, "y"), ("ops lead", 3, "x"), ("ops lead", 3, "y"), ("cook", 4, "z"), ("ops", 5, "z"), (None, 6, "z"), ("cook", None, "z")], "g string, m int, i string")
    items = profiles.distinctive_items(mentions, "g", "m", "i", 0.6, 1).collect()
    assert {r.g: (r.i, round(r.lift, 3)) for r in items} == {"dev lead": ("x", 1.667), "ops lead": ("y", 2.5), "cook": ("z", 2.5), "ops": ("z", 2.5)}
    near = {r.g: r.near_g for r in profiles.nearest_groups(mentions, "g", "m", "i", 1).collect()}
    assert near == {"dev lead": "ops lead", "ops lead": "dev lead", "cook": "ops", "ops": "cook"}
    assert [(r.g, r.near_g) for r in profiles.fragments(mentions, "g", "m", "i", 0.5, 1).collect()] == [("dev lead", "ops lead")]
    assert profiles.fragments(mentions, "g", "m", "i", 0.5, 9).count() == 0 and profiles.group_shares(rows_.limit(0), "g", "m", "l").count() == 0
