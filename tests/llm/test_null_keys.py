from millrace.llm.languages import language_segments
from millrace.llm.near_duplicates import near_pairs
from millrace.llm.packing import pack
from millrace.llm.sentences import Model, sentence_units
from millrace.llm.tokens import has_vocabularies, sized_texts

LARGE = 2**60 + 1  # a float would lose its last digit
COUNTS = {"en": {"the": 5, "and": 3}}


def test_null_and_large_keys_pass_unchanged(spark):
    text = "the house and the sea and the old team"
    df = spark.createDataFrame([(None, text, "en"), (LARGE, text, "en")], "id long, body string, lang string")
    assert {r.id for r in language_segments(df, "id", "lang", "body", COUNTS).collect()} == {None, LARGE}
    assert {r.id for r in sentence_units(df, "id", "body", Model(weights=[0.0] * 21)).collect()} == {None, LARGE}
    sized = spark.createDataFrame([(None, "s", 3, 1), (LARGE, "s", 4, 2)], "id long, source string, n_tokens long, cluster long")
    assert {r.id for r in pack(sized, "id", "source", 10).collect()} == {None, LARGE}
    if has_vocabularies():
        assert {r.id for r in sized_texts(df, "id", "lang", "body").collect()} == {None, LARGE}
    assert [r.key for r in near_pairs(df, "id", ["body"], 0.65)[1].collect()] == [LARGE]
