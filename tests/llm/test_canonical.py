import random

from millrace.llm.canonical import edit_distance, forest, map_to_list, readings, within

COUNTRIES = [("XA", "XA"), ("XB", "XB"), ("Norland", "XA"), ("XA.BA", "XA"), ("Twoland", "XA"), ("Twoland", "XB")]
KNOWN = {w.lower(): {c for v, c in COUNTRIES if v == w} for w, _ in COUNTRIES}


def slow_distance(a, b):
    """Unrestricted Damerau-Levenshtein by its definition."""
    from functools import cache

    @cache
    def d(i, j):
        best = max(i, j) if min(i, j) == 0 else min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
        for k in range(1, i):
            for m in range(1, j):
                if a[k - 1] == b[j - 1] and a[i - 1] == b[m - 1]:
                    best = min(best, d(k - 1, m - 1) + (i - k - 1) + 1 + (j - m - 1))
        return best

    return d(len(a), len(b))


def test_distance_is_the_true_metric():
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randint(0, 6))) for _ in range(60)]
    for a in words[:25]:
        for b in words:
            assert edit_distance(a, b) == slow_distance(a, b) == edit_distance(b, a)
    for a, b, c in zip(words, words[20:], words[40:]):
        assert edit_distance(a, c) <= edit_distance(a, b) + edit_distance(b, c)


def test_trees_find_all_within():
    rng = random.Random(5)
    words = list({"".join(rng.choices("abcd", k=rng.randint(3, 8))) for _ in range(300)})
    trees = forest(words + words[:9])
    for q in ["".join(rng.choices("abcd", k=rng.randint(3, 8))) for _ in range(40)]:
        for most in (0, 1, 2):
            found = within(trees, q, most)
            assert set(found) == {(edit_distance(q, w), w) for w in words if edit_distance(q, w) <= most} and len(found) == len(set(found))


def listed(spark):
    rows = [("Saint Olm", 1, "XA", 10), ("Ørbyvik", 2, "XA", 5), ("Ørbyvik", 3, "XB", 9), ("Vey, Lower Town", 4, "XB", 1), ("Ab", 5, "XA", 1), ("Tornelund", 6, "XA", None)]
    rows += [("Springfield", 7, "XC", 100), ("London", 8, "XD", 9_000_000), (None, 1, "XA", 1), ("nobody", None, "XA", 1)]
    return spark.createDataFrame(rows, "name string, entry_id long, country string, population long")


def countries(spark):
    return spark.createDataFrame([*COUNTRIES, (None, "XA"), ("none", None)], "word string, country string")


MEANT = {
    "St. Olm": 1, "SAINT  OLM, XA.BA, XA": 1, "Greater Saint Olm area": 1, "Remote - Saint Ollm (HQ)": 1, "Hybrid: orbyvik, Norland": 2, "Norland - Ørybvik - Site 4": 2,
    "XB-Ørbyvik": 3, "Ørbyvik": 3, "Ørbyvik, Twoland": 3, "'Vey, Lower Town'": 4, "(Tornelund (HQ))": 6, "Tornelnud (2 days onsite), XA": 6, "Tornelund, XB": 0, "Abc": 0, "Ab": 5, "Remote": 0,
    "": 0, " ": 0, None: 0, "x" * 5000: 0, "Springfield / London": 7, "London / Springfield": 8, "Springfeld / London": 8, "Springfeld / Lonndon": 8,
}


def test_values_by_either_path(spark):
    values = spark.createDataFrame([(v, "z") for v in [*MEANT, *list(MEANT)[:3]]], "v string, edits string")
    for most in (1000, 1):
        found = [tuple(r) for r in map_to_list(values, "v", listed(spark), countries(spark), most).select("v", "entry_id").collect()]
        assert dict(found) == MEANT and len(found) == len(MEANT)
    assert map_to_list(values.limit(0), "v", listed(spark), countries(spark)).count() == 0
    assert {r.entry_id for r in map_to_list(values, "v", listed(spark).limit(0), countries(spark)).collect()} == {0}


def test_readings_name_the_countries():
    assert readings("XA, Ørbyvik", KNOWN)[1] == {"XA"} and readings("Ørbyvik", KNOWN)[1] is None and readings("Ørbyvik, Twoland", KNOWN)[1] == {"XA", "XB"}


def test_broadcast_and_shards_agree(spark):
    rng = random.Random(8)
    names = ["".join(rng.choices("abcdefgh", k=rng.randint(7, 9))) for _ in range(120)]
    entries = spark.createDataFrame([(n, i % 100, rng.choice(["XA", "XB", None]), rng.choice([None, i * 7 % 5])) for i, n in enumerate(names)] + [(None, 1, "XA", 1)], "name string, entry_id long, country string, population long")
    wrong = [n[:4] + n[5:] for n in names[:60]]
    typed = wrong[:30] + [n[::-1] for n in names[:10]] + names[:20] + [None, "", " "] + [f"{a} / {b}" for a, b in zip(wrong, names[30:70])] + [f"{a}, {b}, XB" for a, b in zip(wrong, wrong[20:])]
    values = spark.createDataFrame([(t,) for t in typed], "v string")
    one, many = ({tuple(r) for r in map_to_list(values, "v", entries, countries(spark), most).collect()} for most in (1000, 30))
    assert one == many and len(one) == len(set(typed)) and (None, 0, None) in one and {e for _, _, e in one} >= {None, 0, 1}


def test_matches_by_definition(spark):
    """Without countries and several readings the answer is the least by (edits, people, id) over all entries."""
    rng = random.Random(9)
    names = list({"".join(rng.choices("abc", k=rng.randint(4, 8))) for _ in range(150)})
    rows = [(n, i, "XA", rng.randint(0, 3)) for i, n in enumerate(names)]
    typed = list({"".join(rng.choices("abc", k=rng.randint(2, 9))) for _ in range(120)})
    allowed = lambda t: 0 if len(t) < 4 else 1 if len(t) < 6 else 2
    best = {t: min(((edit_distance(t, n), -p, i) for n, i, _, p in rows if edit_distance(t, n) <= allowed(t)), default=(None, 0, 0)) for t in typed}
    found = map_to_list(spark.createDataFrame([(t,) for t in typed], "v string"), "v", spark.createDataFrame(rows, "name string, entry_id long, country string, population long"), countries(spark), 20)
    assert {r.v: (r.edits, r.entry_id) for r in found.collect()} == {t: (d, i) for t, (d, _, i) in best.items()}
