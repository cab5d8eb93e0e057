from pyspark.sql import functions as F

from millrace.llm.languages import Labeller, language_segments, named_language, train_words

SAMPLE = {
    "en": ["the team moved the old code to the new house and you will see it", "we are looking for someone who has a weak spot for the sea"],
    "de": ["wir suchen einen Menschen der die Arbeit und das Haus mag", "die Gruppe hat viele offene Punkte und wir zahlen den Umzug"],
    "fr": ["nous cherchons une personne pour le travail dans la maison", "vous serez assis avec les gens qui aiment le vin et la mer"],
}


def model():
    counts = {}
    for lang, texts in SAMPLE.items():
        for text in texts:
            for w in text.lower().split():
                counts.setdefault(lang, {})[w] = counts.get(lang, {}).get(w, 0) + 1
    return counts


def test_named_language(spark):
    labels = ["EN", "en-XA", "de_XB", " German ", "french", "und", "unknown", "", None, "deu", "xx", "Klingon"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string").orderBy("i").select(named_language(F.col("x"))).collect()]
    assert got == ["en", "en", "de", "de", "fr", None, None, None, None, "de", None, None]


def test_segments_of_mixed_text(spark):
    text = "\n".join([
        "The team moved the old code and you will see it.", "# team", "Wir suchen einen Menschen der die Arbeit mag.", "die Gruppe hat viele offene Punkte 99",
        "これは長い日本語の文章です。とても長い文章になります。", "", "Nous cherchons une personne pour le travail.",
    ])
    df = spark.createDataFrame([(1, text, "en", "z"), (2, None, None, "z"), (3, "", "en", "z"), (4, "too short", "en", "z"), (1, text, "en", "z")], "id long, body string, label string, lang_code string")
    rows = sorted(tuple(r)[:4] for r in language_segments(df, "id", "label", "body", model()).collect())
    one = [(1, "en", 1, "en"), (1, "en", 3, "de"), (1, "en", 5, "ja"), (1, "en", 7, "fr")]
    assert rows == sorted(one * 2)
    assert language_segments(df.limit(0), "id", "label", "body", model()).count() == 0


def test_viterbi_matches_search_over_all_paths():
    import itertools

    import numpy as np

    from millrace.llm.languages import SWITCH_PENALTY

    lab = Labeller(model())
    lines = ["the house and the sea for you", "wir mag das haus und the vin", "le vin et la mer pour vous ok", "the the die die les les nous"]
    words = [line.split() for line in lines]
    allowed, scores = lab._lines(lines, words)
    scores = np.where(allowed, scores, -1e4)
    latin = [i for i in range(scores.shape[1]) if allowed[0, i]]
    value = lambda p: sum(scores[k, s] for k, s in enumerate(p)) - SWITCH_PENALTY * sum(a != b for a, b in zip(p, p[1:]))
    best = max(itertools.product(latin, repeat=len(lines)), key=value)
    expected = [k for k, (a, b) in enumerate(zip(best, best[1:]), 2) if a != b]
    assert [n for _, n, _, _ in lab.segments(["\n".join(lines)])] == [1, *expected]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.001"
    import os

    if not os.path.exists(d):
        return
    rows = spark.read.parquet(f"{d}/vacancy.parquet")
    counts = train_words(rows.where("id % 2 = 0"), "description", "language")
    held = language_segments(rows.where("id % 2 = 1 and language in ('en','de','es','fr','ja','ru')"), "id", "language", "description", counts)
    right = held.groupBy("id", "language").agg(F.max((F.col("lang_code") == F.col("language")).cast("int")).alias("ok")).agg(F.avg("ok")).first()[0]
    assert right > 0.8  # labels are wrong now and then


def test_long_text_and_training_without_labels(spark):
    assert Labeller(model()).segments(["the house and the sea for you " * 20_000])[0][2] == "en"
    assert train_words(spark.createDataFrame([("a", None)], "t string, l string"), "t", "l") == {}
    assert Labeller({}).segments(["これは長い日本語の文章です。とても長い文章になります。"])[0][2] == "ja"
