from datetime import datetime as D
from itertools import combinations
from math import log, sqrt

from pyspark.sql import functions as F

from millrace.operators import events, mirror, sampling
from millrace.operators.duplicates import exact_duplicates
from millrace.operators.nearness import group_nearness
from millrace.plans import records
from millrace.session import cut_lineage, rows_within


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_reconcile(spark):
    held = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", None), (2, "a", "x"), (3, "a", "x")], "s int, k string, v string")
    new = spark.createDataFrame([(1, "a", "x"), (1, "c", "y"), (1, "d", "z"), (2, "b", "q"), (4, "a", "x")], "s int, k string, v string")
    table, report = mirror.reconcile(held, new, "s", "k", ["v"])
    assert rows(table) == rows(new)
    assert rows(report) == [(1, 1, 1, 1), (2, 1, 0, 1), (3, 0, 0, 1), (4, 1, 0, 0)]
    outcome = spark.createDataFrame([(1, "published"), (2, "unreadable"), (3, "not_found")], "s int, outcome string")
    table, report = mirror.reconcile(held, new, "s", "k", ["v"], outcome)
    assert rows(table) == [(1, "a", "x"), (1, "c", "y"), (1, "d", "z"), (2, "a", "x")]
    assert rows(report) == [(1, 1, 1, 1), (2, 0, 0, 0), (3, 0, 0, 1)]


def test_small_mirror_steps(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert rows(mirror.insert_absent(held, spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string"), ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(mirror.record_outputs(held, spark.createDataFrame([(1, "n")], "k int, v string"), "k", ["v"])) == [(1, "n"), (2, None)]
    assert rows(mirror.survivors(held, spark.createDataFrame([(2,), (2,)], "p int"), "k", "p")) == [(2, "b")]
    assert rows(mirror.clear_dangling(spark.createDataFrame([(1, 2), (2, 9), (3, None)], "i int, r int"), "r", "i")) == [(1, 2), (2, None), (3, None)]
    names = spark.createDataFrame([("s", "B", 2), ("s", "A", 5), ("s", " ", 1), ("s", "B", 9), ("s", "A", 7), ("t", None, 1)], "k string, v string, p int")
    assert rows(mirror.commonest(names, "k", "v", "p")) == [("s", "B", 2)]
    assert [r.k for r in mirror.tail_after(held, "k", 1, 5).collect()] == [2]


def test_exact_duplicates(spark):
    data = [
        (1, 10, "T", "Body  x", D(2026, 1, 5)), (2, 20, "t", "body x", D(2026, 1, 1)), (3, 20, "T ", "BODY X", D(2026, 1, 9)), (4, 10, "T", " ", D(2026, 1, 1)),
        (5, 10, "T", None, D(2026, 1, 1)), (6, 30, "T", "body x", None), (7, 30, "U", "body x", None), (3, 20, "T ", "BODY X", D(2026, 1, 9)),
    ]
    df = spark.createDataFrame(data, "id int, board int, title string, body string, first timestamp")
    assert rows(exact_duplicates(df, "id", "board", [F.col("title")], F.col("body"), "first")) == [(1, 3), (2, 3), (6, 3)]
    assert exact_duplicates(df.limit(0), "id", "board", [F.col("title")], F.col("body"), "first").count() == 0


def test_nearness_matches_plain_python(spark):
    data = {"a": [{"x", "y"}, {"x"}], "b": [{"x", "z"}, {"y"}, {"w"}], "c": [{"v"}]}
    mentions = [(g, f"{g}{i}", item) for g, members in data.items() for i, m in enumerate(members) for item in m]
    n = sum(map(len, data.values()))
    df = {i: sum(i in m for ms in data.values() for m in ms) for i in "xyzwv"}
    w = {g: {i: sum(i in m for m in ms) / len(ms) * log(n / df[i]) for i in df if any(i in m for m in ms)} for g, ms in data.items()}
    unit = {g: {i: x / sqrt(sum(y * y for y in ws.values())) for i, x in ws.items()} for g, ws in w.items()}
    expected = {(a, b): round(sum(x * unit[b].get(i, 0) for i, x in unit[a].items()), 9) for a, b in combinations("abc", 2)}
    got = group_nearness(spark.createDataFrame([*mentions, (None, "q", "x")], "g string, m string, i string"), "g", "m", "i").collect()
    assert {(r[0], r[1]): round(r[2], 9) for r in got} == expected


def test_samples(spark):
    sizes = spark.createDataFrame([("a", 50), ("b", 30), ("c", 21)], "s string, n int")
    assert {r.s: r.drawn for r in sampling.largest_remainder(sizes, "s", "n", 10).collect()} == {"a": 5, "b": 3, "c": 2}
    df = spark.range(300).select("id", (F.col("id") % 3).alias("s")).repartition(5)
    small, large = (rows(sampling.stratified_sample(df, "s", "id", n, 4).select("s", "drawn", "id")) for n in (3, 8))
    assert len(large) == 24 and [r for r in large if r[1] <= 3] == small
    low, high = sampling.bootstrap_interval(spark.range(400).select((F.col("id") % 10).alias("v")), "v", 200, 1).first()
    assert 3.8 < low < 4.5 < high < 5.2
    labels = spark.createDataFrame([("p", "right"), ("p", "wrong"), ("p", "unclear"), ("q", "right")], "c string, a string")
    weights = spark.createDataFrame([("p", 1), ("q", 3)], "c string, size int")
    assert rows(sampling.precision_by_cell(labels, "c", "a", weights)) == [("p", 1, 2, 0.5), ("q", 1, 1, 1.0), (None, 2, 3, 0.875)]


def test_events(spark):
    data = [("k", D(2026, 1, 1, 0, 0, 5), "a", 1), ("k", D(2026, 1, 1, 0, 1, 5), "a", 2), ("k", D(2026, 1, 1, 0, 4, 6), "b", 3)]
    df = spark.createDataFrame(data, "k string, t timestamp, s string, v int")
    assert [r.gap_seconds for r in events.silent_gaps(df, "k", "t", 180).collect()] == [181.0]
    assert [(r.s, r.n) for r in events.spans(df, "k", "t", "v", "s").orderBy("first_at").collect()] == [("a", 2), ("b", 1)]
    days = [("k", D(2026, 1, d, h), s, d * 24 + h) for d, h, s in [(1, 1, "a"), (1, 5, None), (1, 6, None), (2, 1, None), (4, 1, "a"), (4, 2, "a"), (5, 1, "a"), (5, 2, "b")]]
    over = spark.createDataFrame([*days, (None, D(2026, 1, 1), "x", 1), ("k", None, "x", 1)], "k string, t timestamp, s string, v int")
    assert [(r.s, r.n) for r in events.spans(over, "k", "t", "v", "s").where("k is not null").orderBy("first_at").collect()] == [("a", 1), (None, 3), ("a", 3), ("b", 1)]
    assert [r.gap_seconds / 3600 for r in events.silent_gaps(over, "k", "t", 18 * 3600).orderBy("gap_end").collect()] == [19.0, 48.0, 23.0]
    assert [r.v for r in events.minute_grid(df, "k", "t", "v").orderBy("minute").collect()] == [1, 2, 2, 2, 3]
    line = spark.createDataFrame([("2026-01-01T00:00:00Z main BOARD slug=a n=3",), ("no log",)], "l string").select(*events.log_fields(F.col("l"))).collect()
    assert line[0][1] == "BOARD" and line[0][2] == {"slug": "a", "n": "3"} and line[1][0] is None and line[1][2] == {}


def test_session_helpers(spark):
    assert rows_within(spark.range(3), 3) and not rows_within(spark.range(4), 3)
    assert cut_lineage(spark.range(5)).count() == 5


def test_opening_duplicates_compare_slug_mode_and_description(spark, tmp_path):
    data = [
        (1, 10, "T", "L", "Remote", "one body", D(2026, 1, 1)), (2, 11, "t", "l", "Remote", "One  body", D(2026, 1, 2)), (3, 10, "T", "L", "Remote", "other", D(2026, 1, 3)),
        (4, 12, "T", "L", "Remote", "one body", D(2026, 1, 4)), (5, 10, "T", "L", "OnSite", "one body", D(2026, 1, 5)), (1, 10, "T", "L", "Remote", "one body", D(2026, 1, 1)),
    ]
    columns = "id int, company_id int, title string, location string, workplace_type string, description string, first_published_at timestamp"
    spark.createDataFrame(data, columns).write.parquet(f"{tmp_path}/vacancy.parquet")
    spark.createDataFrame([(10, "a"), (11, "a"), (12, "b")], "id int, slug string").write.parquet(f"{tmp_path}/company.parquet")
    assert rows(records.opening_duplicates(spark, str(tmp_path))) == [(2, 1)]


def test_snapshot_mirror_takes_all_snapshots_plain_keys_and_latest_rows(spark, tmp_path):
    late, early = D(2026, 1, 2), D(2026, 1, 1)
    data = [(1, "007", late, "a"), (2, "7", late, "a"), (2, " 7", early, "z"), (3, "7", late, "b"), (3, "X", late, "c"), (4, "x ", late, "c")]
    full = [(n, 1, k, t, title, None, None, None, None) for n, k, t, title in data]
    columns = "snapshot_no int, company_id int, external_id string, updated_at timestamp, title string, location string, department string, pay_min_cents long, description_hash string"
    spark.createDataFrame(full, columns).write.parquet(f"{tmp_path}/vacancy_snapshot.parquet")
    spark.createDataFrame([(1, "BROKEN")], "id int, board_status string").write.parquet(f"{tmp_path}/company.parquet")
    found = records.snapshot_mirror(spark, str(tmp_path)).select("snapshot_no", "added", "updated", "deleted")
    assert rows(found) == [(2, 0, 0, 0), (3, 1, 1, 0), (4, 0, 0, 1)]
    assert rows(records.snapshot_mirror_gated(spark, str(tmp_path))) == [(1, 1)]
