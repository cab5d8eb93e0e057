from datetime import datetime

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators.heavy_keys import heavy_keys, key_profile
from millrace.operators.packed import holds_delimiter, split_by_lists, split_packed, split_strings
from millrace.operators.snapshots import plain_key, snapshot_changes

T = datetime


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_profile_counts_copies_and_null_keys(spark):
    df = spark.createDataFrame(
        [(1, 10, T(2026, 1, 1), "a"), (1, 10, T(2026, 1, 3), "b"), (1, 11, None, "c"), (None, 12, None, "d"), (2, None, T(2026, 1, 2), "e")],
        "k int, i int, u timestamp, n_rows string",
    )
    assert rows(key_profile(df, "k", "i", "u")) == rows(
        spark.createDataFrame([(1, 3, 2, 1, T(2026, 1, 3)), (None, 1, 1, 0, None), (2, 1, 0, 1, T(2026, 1, 2))], "k int, r long, i long, d long, u timestamp")
    )


def test_profile_and_heavy_keys_of_nothing(spark):
    empty = spark.createDataFrame([], "k int, i int, u timestamp")
    assert key_profile(empty, "k", "i", "u").count() == 0
    assert heavy_keys(empty, "k", 0.1).count() == 0


def test_heavy_keys_match_brute_force(spark):
    values = [i % 7 if i % 3 else 99 for i in range(1000)] + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "k int")
    expected = {v for v in set(values) if v is not None and values.count(v) >= 0.095 * len(values)}
    assert {r.k for r in heavy_keys(df, "k", 0.095).collect()} == expected


@pytest.mark.parametrize(("raw", "plain"), [(" 00042\t", "42"), ("000", "0"), ("JR-007 ", "jr-007"), (" Ab ", "ab"), ("", ""), (None, None)])
def test_plain_key(spark, raw, plain):
    assert spark.createDataFrame([(raw,)], "x string").select(plain_key(F.col("x"))).first()[0] == plain


def changes(spark, data):
    df = spark.createDataFrame(data, "s int, c int, k string, v string, u timestamp, change_kind string")
    keys = {"c": F.col("c"), "key": plain_key(F.col("k"))}
    return {tuple(r) for r in snapshot_changes(df, "s", keys, ["v"], "u").collect()}


def test_changes_between_neighbours(spark):
    early, late = T(2026, 1, 1), T(2026, 1, 2)
    data = [
        (1, 1, "a", "x", early, ""), (2, 1, " A", "x", late, ""),  # the same, written otherwise
        (1, 1, "b", "x", early, ""), (2, 1, "b", None, early, ""),  # changed to null
        (1, 1, "c", "x", late, ""), (1, 1, "c", "y", early, ""), (1, 1, "c", "z", None, ""), (2, 1, "c", "x", None, ""),  # the greatest date counts
        (1, 1, "d", "x", early, ""), (5, 1, "d", "x", early, ""),  # gone, and back later
        (2, 1, "e", "", early, ""), (5, 1, "e", None, early, ""),  # empty is not null
        (2, None, None, "n", early, ""),
    ]
    assert changes(spark, data) == {
        (2, 1, "b", "changed"), (2, 1, "d", "removed"), (2, 1, "e", "added"), (2, None, None, "added"),
        (5, 1, "a", "removed"), (5, 1, "b", "removed"), (5, 1, "c", "removed"), (5, 1, "d", "added"), (5, 1, "e", "changed"), (5, None, None, "removed"),
    }


def test_no_changes_without_two_snapshots(spark):
    assert changes(spark, []) == set()
    assert changes(spark, [(3, 1, "a", "x", None, ""), (3, 1, "a", "x", None, "")]) == set()


SUFFIXES = pa.array(["xa", "xa.ba", "land"], pa.large_string())


def split(text):
    return split_strings(pa.array([text]), SUFFIXES, ["vey, lower town", "halmen/ostra"])[2].to_pylist()


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("A; B;;C", ["A", "B", "C"]),
        ("A, B", ["A", "B"]),
        ("A, XA", ["A, XA"]),
        ("A, xa.ba, XA, B, Land", ["A, xa.ba, XA", "B, Land"]),
        ("Land, A", ["Land, A"]),
        ("A (x, y), B", ["A (x, y)", "B"]),
        ('"A, XA","B ""N"" c",C', ["A, XA", 'B "N" c', "C"]),
        ('["A, B", "C \\"N\\" d"]', ["A, B", 'C "N" d']),
        ("«A/B» / “C, D”; 'E; F'", ["A/B", "C, D", "E; F"]),
        ("A, B and C", ["A", "B", "C"]),
        ("A, and B", ["A", "B"]),
        ("A & B or C", ["A", "B", "C"]),
        ("A&B", ["A&B"]),
        ("• A • B", ["A", "B"]),
        ("- A\r\n- B", ["A", "B"]),
        ("Vey, Lower Town; Halmen/Ostra", ["Vey, Lower Town", "Halmen/Ostra"]),
        ("A - B", ["A - B"]),
        ("O'Neil's, B", ["O'Neil's", "B"]),
        ('5" pipe; B', ['5" pipe', "B"]),
        ("A; A", ["A", "A"]),
        ("A+B + C d", ["A", "B", "C d"]),
        ("N/A", ["N/A"]),
        ("n/a; B", ["n/a", "B"]),
        ("Ab/c", ["Ab", "c"]),
        ("a/Bc/d", ["a", "Bc", "d"]),
        (" ;, / ", []),
        ("", []),
        (None, []),
    ],
)
def test_split(text, values):
    assert split(text) == values


def plain_split(text):
    return [x.strip() for x in text.replace("|", ";").split(";") if x.strip()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abé語 ;|", max_size=20), max_size=6))
def test_split_matches_plain_split(texts):
    parents, positions, values = split_strings(pa.array(texts, pa.string()), SUFFIXES, [])
    got = {}
    for p, n, v in zip(parents.tolist(), positions.tolist(), values.to_pylist()):
        got.setdefault(p, []).append((n, v))
    for i, text in enumerate(texts):
        assert got.get(i, []) == list(enumerate(plain_split(text), 1))


def test_lists_of_any_length_give_the_same_values(spark):
    texts = ["A, XA; B", "Vey, Lower Town, Land; c", "Saint Vey, Lower Town and Halmen/Ostra", None, "", ";", "Halmen/Ostrava", "x" * 50_000 + "; B", "A+B, xa.ba", "A+B, xa.ba"]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "id long, packed string, _word string")
    ends = spark.createDataFrame([("XA",), ("xa.ba",), ("Land",), (None,), ("--",)], "a string")
    whole = spark.createDataFrame([("Vey, Lower Town",), ("Halmen/Ostra",)], "a string").where(holds_delimiter(F.col("a")))
    one, many = (rows(split_by_lists(df, "id", "packed", ends, whole, most)) for most in (100, 1))
    assert one == many and (1, 1, "Vey, Lower Town, Land", 2) in one and (6, 2, "Ostrava", 2) in one and len(one) == 14
    assert split_by_lists(df, "id", "packed", ends.limit(0), whole, 0).where("id = 2").count() == 2


def test_split_packed_frame(spark):
    df = spark.createDataFrame([(1, "A; B", "z"), (2, None, "z"), (3, "x" * 200_000, "z"), (1, "A; B", "z")], "id long, packed string, value string")
    got = rows(split_packed(df, "id", "packed").select("id", "pos", F.length("value"), "n_values"))
    assert got == [(1, 1, 1, 2), (1, 1, 1, 2), (1, 2, 1, 2), (1, 2, 1, 2), (3, 1, 200_000, 1)]
    assert split_packed(df.limit(0), "id", "packed").count() == 0
