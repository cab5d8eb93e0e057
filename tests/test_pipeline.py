from datetime import datetime as D

from pyspark.sql import functions as F

from millrace.functions import titles as T
from millrace.operators import names
from millrace.operators.phrases import Classifier, Entry
from millrace.pipeline import Pipeline

TEXT = "We build payment routing in Go.\nAt least 3 years with Go or five to 7 years of Rust. $30 years. 40 years old."


def pipeline(spark):
    rows = [
        (1, 10, "a", "X", "Senior Data Engineer (m/w/d), Olm", "Remote", "IT", TEXT, None, "Hybrid", D(2026, 1, 1)),
        (1, 10, "a", "X", "Senior Data Engineer (m/w/d), Olm", "Remote", "IT", TEXT, None, "Hybrid", D(2026, 1, 1)),
        (2, 10, "b", "X", "senior data  engineer (m/w/d), olm", "remote", "IT", TEXT + " ", None, None, D(2026, 1, 2)),
        (3, 11, "a", "Y", "Head of Sales", "Olm", "Sales", "grid balancing for all of us and the team", "en", None, None),
        (4, 11, "b", "Y", None, None, None, None, None, None, None),
    ]
    schema = "id long, company_id long, external_id string, ats string, title string, location string, department string, description string, language string, workplace_type string, first_published_at timestamp"
    companies = spark.createDataFrame([(10, "X", "acme", "US"), (11, "Y", "volt", "US")], "id long, ats string, slug string, region string")
    return Pipeline({"vacancy": spark.createDataFrame(rows, schema), "company": companies})


def test_passes(spark):
    p = pipeline(spark)
    urls = spark.createDataFrame([("https://b.example/acme",), ("https://b.example/newco",), ("ftp://b.example/x",)], "u string")
    boards, report = p.discover(urls, "u", "X", r"b\.example")
    assert boards.count() == 3 and tuple(report.first()) == (2, 1)
    _, report = p.sweep(spark.createDataFrame([(10, "a", "t")], "company_id long, external_id string, title string"), ["title"])
    assert tuple(report.first()) == (2, 0, 1, 3)
    cleaned, report = p.clean()
    assert {r.id: r.cleaned_title for r in cleaned.collect()} == {1: "Data Engineer Olm", 2: "data engineer olm", 3: "Head of Sales", 4: ""}
    assert report.first().vacancies == 4
    _, report = p.classify(Classifier(qualifiers=frozenset({"data"}), heads={"engineer": False}))
    assert report.first()["in"] == 2 and report.first()["unruled"] == 2
    _, report = p.extract([Entry("pay", ("payment routing",)), Entry("grid", ("grid balancing",)), Entry("go", ("go",))])
    assert tuple(report.first()) == (3, 5, 0)
    near, report = p.nearness()
    assert [tuple(r) for r in near.collect()] == [("IT", "Sales", 0.0)]
    assert p.break_down()[1].first().without_normal_title == 1
    assert {(r.id, tuple(r.work_modes)) for r in p.modes()[0].collect()} == {(1, ("REMOTE",)), (2, ("REMOTE",)), (3, ()), (4, ())}
    assert {r.id: (r.required_years, r.seniority_level) for r in p.seniority()[0].collect()} == {1: (5, "SENIOR"), 2: (5, "SENIOR"), 3: (None, None), 4: (None, None)}
    assert [tuple(r) for r in p.duplicates()[0].collect()] == [(1, 2)]


def test_titles(spark):
    row = spark.range(1).select(
        T.management_level(F.lit("Lead Director, Ops")), T.named_modes(F.lit("hybrid or on-site")), T.years_asked(F.lit("ten yrs")), T.years_asked(F.lit("none")),
        T.lowest_level(F.array(F.lit("III"), F.lit("SENIOR"), F.lit("MID"))), T.normal_title(F.lit("NEW! Sr. Web Dev II - 42")), T.role_of(F.lit("web dev"), {"web dev": "w"}, {"dev": "d"}), T.role_of(F.lit("app dev x"), {"web dev": "w"}, {"dev": "d"}),
    ).first()
    assert tuple(row) == ("DIRECTOR", ["HYBRID", "ONSITE"], 10, None, "MID", "web dev", "w", "d")


def test_names(spark):
    df = spark.createDataFrame([(i, i % 4, f"We use Zorba here. Zorba and the team. It is {w}.\nOf course use") for i, w in enumerate(["Zorba", "old", "new", "Olm"])], "id int, c int, t string")
    got = {r.word: tuple(r)[1:5] for r in names.word_evidence(df, "id", "c", "t").collect()}
    assert got["zorba"] == (4, 4, 5, 0) and got["use"] == (4, 4, 0, 8)
    known = spark.createDataFrame([("Olm",)], "word string")
    assert [r.word for r in names.name_candidates(names.word_evidence(df, "id", "c", "t"), known).collect()] == ["zorba"]
    assert names.words_nearby(spark.createDataFrame([(1, "a b c a"), (2, "b a")], "id int, t string"), "id", "t", 1).orderBy("word", "near_word").collect() == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    assert names.first_mentions(spark.createDataFrame([(1, "x\nNode-JS\nnode js"), (2, "nodejs"), (3, "nodejsx"), (4, None)], "id int, t string"), "id", "t", "node js").orderBy("id").collect() == [(1, 2, "Node-JS"), (2, 1, "nodejs")]
