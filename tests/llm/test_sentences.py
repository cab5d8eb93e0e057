import os

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm.batches import decoded
from millrace.llm.sentences import Model, candidates, flows_of, quoted, sentence_units, train, units_of

DATA = "/root/testdata/sf0.01/documents.parquet"
NORMAL = ["We build old code.\nYou will see the sea.\nThe team is fine.", "Dr. Who came. We like it.\n\nYou do, i.e. some of it. The end is near.", "It costs 3.5 now.\nWe met Dr. Who at No. 5 there.\nThe rest follows."] * 40


@pytest.fixture(scope="module")
def model():
    if os.path.exists(DATA):
        rows = duckdb.sql(f"select text from read_parquet('{DATA}') where text is not null order by doc_id").fetchall()
        return train([r[0] for r in rows])
    return train(NORMAL)


CASES = [
    ["We use Go, etc. for the St. Olm building.", "Dr. Vey leads it."],
    ["“Ship it. Then measure,” says our lead K. Zau.", "We follow."],
    ["“Would you trust it?” is the question.", "Yes!"],
    ["Some call it review… others don't.", "What, no tea?!"],
    ["It grew by 6.2 percent, i.e. approx. 974 nodes.", "See https://a.example/v1.2/x.html?r=3 and stay."],
    ["(Yes, it counts too.)", "We pay for the move."],
    ["「まずA。次にB。」とCはいつも言います。", "詳細（A、Bなど。）は採用ページにあります。", "Gを知っていますか？"],
    ["“先做A。再做B。”C总是这样说。", "你了解D v1.7吗？"],
]


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
@pytest.mark.parametrize("units", CASES)
def test_units(model, units):
    text = ("" if ord(units[0][-1]) > 0x3000 else " ").join(units)
    assert [text[a:b] for a, b in units_of(text, model)] == units


def test_lines_and_marks(model):
    text = "﻿The team\n\n- You build it\n* You test it.\r\n• Fine!\nBenefits:\nWe pay."
    assert [text[a:b] for a, b in units_of(text, model)] == ["The team", "You build it", "You test it.", "Fine!", "Benefits:", "We pay."]


@pytest.mark.skipif(not os.path.exists(DATA), reason="needs the test tables")
def test_wrapped_text_runs_on(model):
    text = "Your first project brings the tenant billing closer to what our partners\nVelm and Orn expect. You will own the tenant billing on top of Gelder with\nour office."
    assert [text[a:b].replace("\n", " ") for a, b in units_of(text, model)] == ["Your first project brings the tenant billing closer to what our partners Velm and Orn expect.", "You will own the tenant billing on top of Gelder with our office."]


def test_thai_blank_ends_a_unit(model):
    text = "คุณจะดูแล Go ร่วมกับเรา เราจ่ายค่าย้าย"
    assert [text[a:b] for a, b in units_of(text, model)] == ["คุณจะดูแล Go ร่วมกับเรา", "เราจ่ายค่าย้าย"]


def test_run_together_and_numbers(model):
    assert [c.before for c in candidates("We met before.We met in v1.2 at a.m. and 3.5.")] == ["before", "a.m"]
    assert quoted("a «b» (c “d” e) ) “") == {4: 2, 10 + 2: 10} or quoted("«b»") == {2: 0}


@pytest.mark.parametrize("text", [None, "", " \n﻿ ", "...", "- \n* "])
def test_no_units(model, text):
    assert units_of(text, model) in ([], [(0, 3)]) and (text != "..." or units_of(text, model) == [])


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aA1 .!?\n\"“”()-•。ก…", max_size=60))
def test_units_are_apart_and_cover_all_words(text):
    m = Model(weights=[0.5, 2, 2, -1, -8, 1, -1, 1, 1, -3, -2, 0, 0, 0.5, -0.5, 0.3, 0, 0, 0, 0.3, 0.3])
    units = units_of(text, m)
    at = 0
    for a, b in units:
        assert at <= a < b <= len(text) and not text[a].isspace() and not text[b - 1].isspace()
        at = b
    covered = "".join(text[a:b] for a, b in units)
    assert [c for c in covered if c.isalnum()] == [c for c in text if c.isalnum()]
    assert all(x <= y for x, y in flows_of(text, None))


def test_frame(spark, model):
    df = spark.createDataFrame([(1, "One thing. Two things.", 5), (2, None, 5), (3, "", 5), (1, "One thing. Two things.", 5), (4, "We do it all day. " * 20_000, 5)], "id long, text string, start_at int")
    out = sentence_units(df, "id", "text", model)
    assert sorted(map(tuple, out.where("id = 1").collect())) == [(1, 0, 10), (1, 0, 10), (1, 11, 22), (1, 11, 22)]
    assert out.where("id = 4").count() == 20_000 and out.where("id in (2, 3)").count() == 0
    assert sentence_units(df.limit(0), "id", "text", model).count() == 0


def test_training_on_nothing():
    assert units_of("One. Two.", train([])) == units_of("One. Two.", train(["", " "]))
    assert units_of("One is fine. Two is too.", train([])) == [(0, 12), (13, 24)]


def test_decoded_slices_are_the_column():
    texts = ["a" * 5, None, "", "bc" * 40, "é", "x" * 9] * 3
    column = pa.array(texts)
    for most in (1, 10, 1000):
        slices = list(decoded(column.slice(1), most))
        assert [t for _, part in slices for t in part] == texts[1:] and [s for s, _ in slices] == [sum(len(p) for _, p in slices[:i]) for i in range(len(slices))]
        assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= most for _, p in slices)
    assert list(decoded(pa.array([], pa.string()))) == []
