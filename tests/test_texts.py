import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.html import marked_lines
from millrace.functions.numbers import coin, haversine_km, match_score, verdict, wilson
from millrace.functions.urls import board_region, board_slug, surt_prefix
from millrace.operators.phrases import Classifier, Entry, Matcher, phrase_labels
from millrace.operators.segments import split_segments


def one(spark, value, rule, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(rule(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("title", "cleaned"),
    [("Sr. Data Engineer (m/w/d)", "Data Engineer"), ("C++ / C# dev", "C++ C# dev"), ("R&D lead & more", "R&D lead more"), ("Node.js eng.", "Node.js eng"), ("Semi Senior Dev", "Dev"), ("", ""), (None, "")],
)
def test_clean_title(spark, title, cleaned):
    assert one(spark, title, T.clean_title) == cleaned


@pytest.mark.parametrize(("title", "left"), [("Dev (m/w/d)", "Dev "), ("Dev (x/y)", "Dev (x/y)"), ("Dev m/f/x", "Dev "), ("Dev (v/i)", "Dev (v/i)"), ("h264/x dev", "h264/x dev")])
def test_gender_marker(spark, title, left):
    assert one(spark, title, T.without_gender_marker).strip() == left.strip()


def test_seniority_words(spark):
    found = spark.createDataFrame([("Senior Jr. semi-senior Principal ux",)], "x string").select(*T.seniority_words(F.col("x"))).first()
    assert found[0] == ["MID", "SENIOR", "JUNIOR", "PRINCIPAL"] and found[1] == "ux"


@pytest.mark.parametrize(("name", "form"), [(" Back-End_dev ", "back end dev"), ("-x-", "-x-"), ("a / b", "a b"), (None, None)])
def test_name_form(spark, name, form):
    assert one(spark, name, T.name_form) == form


def test_folding(spark):
    assert one(spark, " A  b\n", T.folded) == "a b"
    assert one(spark, None, T.folded) == ""


def test_description_cleaning(spark):
    assert one(spark, "a b ☃ c\r\n\n  d️ €5 ", T.clean_description) == "a b c\nd €5"


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=60))
def test_cleaning_is_idempotent(spark, text):
    df = spark.createDataFrame([(text,)], "x string")
    once, twice = df.select(T.clean_description(F.col("x")), T.clean_description(T.clean_description(F.col("x")))).first()
    assert once == twice and "  " not in once


@pytest.mark.parametrize(
    ("text", "code"),
    [("The role is for you and the team will be with us", "en"), ("Wir suchen dich und das ist nicht alles für die Rolle", "de"), ("これは日本語の文章です、とても長い文章になります。", "ja"), ("мы ищем тебя для работы в нашей команде", "ru"), ("ми шукаємо тебе для роботи в нашій команді", "uk"), ("short", None), ("", None), (None, None)],
)
def test_language(spark, text, code):
    assert one(spark, text, lambda c: T.detected_language(F.lit(None).cast("string"), c)) == code
    assert one(spark, text, lambda c: T.detected_language(F.lit("en"), c)) is None


def test_sentences_and_headings(spark):
    assert one(spark, "Ask Dr. Who. We are i.e. here. \"Yes!\" No?", T.simple_sentences) == ["Ask Dr. Who.", "We are i.e. here.", '"Yes!" No?']
    for line, yes in (("Requirements", True), ("ABOUT", True), ("What you do:", True), ("We do it.", False), ("x" * 70 + ":", False)):
        assert one(spark, line, T.is_heading) is yes


def test_addresses(spark):
    assert one(spark, "https://Jobs.Example.org:443/a/b#c", surt_prefix) == "org,example,jobs)/a/b"
    assert one(spark, "*.example.org", surt_prefix) == "org,example,"
    hosts = r"boards\.x\.example"
    assert one(spark, "https://boards.x.example/Acme/jobs/1", lambda c: board_slug(c, hosts)) == "acme"
    assert one(spark, "https://boards.x.example/embed/job_board?b=1&for=acme", lambda c: board_slug(c, hosts)) == "acme"
    assert one(spark, "http://boards.x.example/acme", lambda c: board_slug(c, hosts)) is None
    assert one(spark, "https://boards.eu.x.example/a", board_region) == "EU"


def test_numbers(spark):
    low, high, mark, none = spark.range(1).select(*wilson(F.lit(8), F.lit(10)), verdict(F.lit(0.7), F.lit(0.9)), wilson(F.lit(0), F.lit(0))[0]).first()
    assert round(low, 4) == 0.4902 and round(high, 4) == 0.9433 and mark == "undecided" and none is None
    assert round(spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0], 2) == 111.2


def test_marked_lines():
    page = "<h2>Team</h2><p>We <b>build</b>.<br>More</p><ul><li>one</li><li><b>two</b></li></ul><div class='content-intro'>Legal</div><p><b>Bold</b></p><script>x</script>"
    assert marked_lines(page) == "# Team\nWe build.\nMore\n- one\n- two\n> Legal\n# Bold"
    assert marked_lines("<p> </p>") is None and marked_lines(None) is None and marked_lines("a &lt; b &amp; <p>#x") == "a < b &\nx"


def test_segments():
    text = "# Role\nWe build. You e.g. test it.\n- one • two\n> # Legal\n> We are fair.\nRequirements\n1. Java"
    assert split_segments(text) == [
        ("HEADING", None, "Role", False), ("SENTENCE", "Role", "We build.", False), ("SENTENCE", "Role", "You e.g. test it.", False),
        ("ITEM", "Role", "one", False), ("ITEM", "Role", "two", False), ("HEADING", None, "Legal", True), ("SENTENCE", "Legal", "We are fair.", True),
        ("HEADING", None, "Requirements", False), ("ITEM", "Requirements", "Java", False),
    ]
    assert split_segments(None) == [] == split_segments(" \n ")


def test_phrases(spark):
    titles = ["a b c b", "c  B", "A-b", "d", "", " ", None, "x" * 5000, "a b c b"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(titles)], "id long, title string, _text string").drop("_text")
    labels = {"b": "1", "b c": "2", "C b": "3", "a": "4"}
    found = {r.id: r.label for r in phrase_labels(df, "title", labels).collect()}
    assert found == {0: "2", 1: "3", 2: "4", 3: None, 4: None, 5: None, 6: None, 7: None, 8: "2"}
    assert phrase_labels(df, "title", {}).where("label is not null").count() == 0


def test_classifier(spark):
    c = Classifier({"data lead": "OUT", "data": "IN"}, frozenset({"sales"}), frozenset({"civil"}), frozenset({"web"}), {"engineer": False, "analyst": True})
    cases = {
        "data lead engineer": ("OUT", None), "web": ("UNKNOWN", "UNRULED"), "web engineer": ("IN", None), "sales web engineer": ("OUT", None), "analyst": ("UNKNOWN", "DOMAIN_AMBIGUITY"),
        "engineer": ("UNKNOWN", "SCOPE_AMBIGUITY"), "analyst engineer": ("UNKNOWN", "SCOPE_AMBIGUITY"), "engineer, analyst": ("UNKNOWN", "UNRULED"), "civil": ("UNKNOWN", "UNRULED"), None: ("UNKNOWN", "UNRULED"), "": ("UNKNOWN", "UNRULED"),
    }
    df = spark.createDataFrame([(t, "z") for t in cases], "title string, kind string")
    found = c.classify(df, "title")
    assert {r.title: (r.state, r.reason) for r in found.collect()} == cases | {"engineer, analyst": ("UNKNOWN", "DOMAIN_AMBIGUITY")} and found.columns == ["title", "kind", "state", "reason"]
    assert c.classify(df.limit(0), "title").count() == 0


def test_matcher():
    m = Matcher([Entry("js", ("javascript", "node js")), Entry("go", (), ("Go",), "js"), Entry("c", ("c++",)), Entry("r", (), ("R",))])
    assert m.found(["Go and JavaScript", "go, node-js at https://javascript.example", "c++ R", "R"]) == {"js": ([0, 1], False), "c": ([2], False), "go": ([0], True), "r": ([2], True)}
    assert m.found([]) == {} == m.found(["", None])


def test_small_text_rules(spark):
    assert one(spark, "Łódź d’Été ÆRØ", T.accent_folded) == "lodz dete aero" and one(spark, None, T.accent_folded) is None
    assert one(spark, "You build it We ship it and You (all) Lead", T.guessed_items) == ["You build it", "We ship it and", "You (all)", "Lead"]
    reasons = {"far": "too far", "pay": "pay|salary"}
    assert [one(spark, x, lambda c: T.first_reason(c, reasons)) for x in ("the salary, and too far", "too far and no pay", "none", None)] == ["pay", "far", None, None]
    row = spark.range(1).select(match_score(F.lit(4), F.lit(5), F.lit(1), F.lit(False)), match_score(F.lit(0), F.lit(0), F.lit(0), F.lit(False)), match_score(F.lit(1), F.lit(4), F.lit(None).cast("int"), F.lit(True)), coin(F.lit(1), 2).isNotNull()).first()
    assert tuple(row) == (65.0, 0.0, 5.0, True)


def test_headings_and_run_on_items_as_parameters():
    assert [x[0] for x in split_segments("How we do it all here\nWork.", frozenset({"how we do it all here"}))] == ["HEADING", "SENTENCE"]
    found = split_segments("We build it You own it (all) You ship it. The end You", starts=("You",))
    assert [(k, t) for k, _, t, _ in found] == [("SENTENCE", "We build it"), ("ITEM", "You own it (all)"), ("ITEM", "You ship it."), ("SENTENCE", "The end"), ("ITEM", "You")]
    assert len(split_segments("a You b\nc You d", starts=("You",))) == 2


def test_function_words_tell_labelled_texts(spark):
    named = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('de', 'en', 'es', 'fr', 'it', 'nl', 'pl', 'pt') and length(text) > 300")
    right, judged = named.select((T.word_language(F.col("text")) == F.col("lang")).cast("int").alias("r")).agg(F.sum("r"), F.count("r")).first()
    assert right / judged > 0.95 and judged > 500
    for lang, text in {"sv": "Vi är ett lag och du har inte mycket tid utan oss", "da": "Vi er et hold og du har ikke meget tid uden os efter at", "no": "Vi er et lag og du har ikke mye tid uten oss mellom", "fi": "Se on hyvä ja me olemme kanssa kun hän ei ole tämä"}.items():
        assert one(spark, text, T.word_language) == lang
