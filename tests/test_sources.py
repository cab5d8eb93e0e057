import gzip
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.urls import site_board
from millrace.sources import archives, boards, exports, lists
from millrace.streaming.mirrors import follow_snapshots, sessions, windowed


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lists(spark, tmp_path):
    path = tmp_path / "skills.tsv"
    path.write_text('1\tNode "js"\tweb\tnode-js|nodejs\t\t\n\n2\tGo\tlang\tgolang\tGo\t1\n3\tR\n')
    got = {r.id: r for r in lists.taxonomy(spark, str(path)).collect()}
    assert got["1"].name == 'Node "js"' and got["1"].aliases == ["node-js", "nodejs"] and got["2"].parent == "1" and got["3"].parent is None and got["3"].aliases == []
    for extra in ("1\tX\n", "4\tNODE_JS\n4\tY\n", "5\tNode js\t\tnode js\n6\tnode-js\n", "7\tZ\t\t\t\t9\n"):
        bad = tmp_path / "bad.tsv"
        bad.write_text("1\tA\n" + extra)
        with pytest.raises(ValueError):
            lists.taxonomy(spark, str(bad))
    unread = tmp_path / "unread.tsv"
    unread.write_text("ats\tslug\treason\nX\ta\ttoo large\n")
    assert rows(lists.unread_boards(spark, str(unread))) == [("X", "a", "too large")]
    unread.write_text("ats\tslug\treason\nX\ta\n")
    with pytest.raises(ValueError):
        lists.unread_boards(spark, str(unread))
    regions = spark.createDataFrame([("all", "*"), ("n", "XA")], "region string, country string")
    countries = spark.createDataFrame([("XA",), ("XB",)], "code string")
    assert rows(lists.region_countries(regions, countries)) == [("all", "XA"), ("all", "XB"), ("n", "XA")]
    with pytest.raises(ValueError):
        lists.region_countries(spark.createDataFrame([("n", "ZZ")], "region string, country string"), countries)
    words = spark.createDataFrame([("dev", "HEAD", "r"), ("dev", "JOB", "")], "phrase string, use string, role string")
    assert lists.phrase_roles(words, spark.createDataFrame([("r",)], "slug string")).count() == 2
    assert spark.range(1).select(lists.offset_minutes(F.lit("5.75"))).first()[0] == 345


def test_boards(spark):
    listed = {"jobs": [{"id": 1, "title": "Dev", "location": {"name": "Olm"}, "departments": [{"name": "IT"}], "content": "&lt;p&gt;Hi &amp;amp; go&lt;/p&gt;", "pay_input_ranges": [{"min_cents": 5, "max_cents": 9, "currency_type": "EUR"}], "first_published": "2026-01-02T00:00:00Z"}]}
    parts = {"jobs": [{"id": "b", "title": "Ops", "location": "Olm", "secondaryLocations": [{"location": "Vey"}], "compensation": {"summaryComponents": [{"compensationType": "Equity", "minValue": 1}, {"compensationType": "Salary", "interval": "1 YEAR", "currencyCode": "USD", "minValue": 10.5, "maxValue": 20}]}}]}
    sections = [{"id": "c", "text": "Lead", "categories": {"location": "Olm", "allLocations": ["Olm", "Vey"]}, "description": "<p>Hi</p>", "lists": [{"text": "Do", "content": "<li>a</li>"}], "additional": "<p>End</p>", "createdAt": 0, "salaryRange": {"min": 1.0, "max": 2.0}}]
    frame = lambda x: spark.createDataFrame([(7, json.dumps(x)), (8, "not json"), (9, None)], "company_id int, body string")
    a, = boards.listed_board(frame(listed)).collect()
    assert (a.external_id, a.location, a.department, a.description, a.pay_min_cents, a.pay_currency, a.published_at.year) == ("1", "Olm", "IT", "Hi & go", 5, "EUR", 2026)
    b, = boards.component_board(frame(parts)).collect()
    assert (b.secondary_locations, b.pay_min_cents, b.pay_max_cents, b.pay_interval, b.description) == (["Vey"], 1050, 2000, "1 YEAR", None)
    c, = boards.section_board(frame(sections)).collect()
    assert c.description == "Hi\n# Do\n- a\nEnd" and c.pay_max_cents == 200 and c.published_at.year == 1970
    assert rows(boards.unreadable(frame(listed))) == [(8,), (9,)]
    placed = spark.createDataFrame([("Olm", ["Vey"], ["Olm", "Olm"]), (" ", None, None)], "l string, s array<string>, e array<string>")
    assert [r[0] for r in placed.select(boards.declared_locations(F.col("l"), F.col("s"), F.col("e"))).collect()] == [["Olm", "Vey", "Olm"], []]


def test_archives(spark, tmp_path):
    line = 'org,x)/a 20260101000000 {"url": "https://x.org/a", "filename": "c/warc/1.gz"}\n'
    other = 'org,x)/b 20260101000000 {"url": "https://x.org/b", "filename": "c/robots/1.gz"}\n'
    with gzip.open(tmp_path / "block.gz", "wt") as f:
        f.write(line + other)
    assert [r.url for r in archives.index_blocks(spark, str(tmp_path / "block.gz")).collect()] == ["https://x.org/a"]
    (tmp_path / "bad").write_text("nonsense\n")
    with pytest.raises(Exception, match="no index line"):
        archives.index_blocks(spark, str(tmp_path / "bad")).collect()
    index = spark.createDataFrame([(0, k) for k in ("a", "com,b", "com,c", "com,d", "net")], "s int, k string")
    assert [r.k for r in archives.blocks_for_prefix(index, "s", "k", "com,c").orderBy("k").collect()] == ["com,b", "com,c"]
    assert [r.k for r in archives.blocks_for_prefix(index, "s", "k", "com,").orderBy("k").collect()] == ["a", "com,b", "com,c", "com,d"]
    pages = {"": [["original"], ["u1"], ["u2"], [], ["k1"]], "k1": [["original"], ["u3"]]}
    (tmp_path / "pages.json").write_text(json.dumps(pages))
    spark.dataSource.register(archives.PagedListing)
    assert rows(spark.read.format("paged_listing").option("path", str(tmp_path / "pages.json")).load()) == [(0, "u1"), (0, "u2"), (1, "u3")]
    (tmp_path / "loop.json").write_text(json.dumps({"": [["original"], [], [""]]}))
    with pytest.raises(Exception, match="given twice"):
        spark.read.format("paged_listing").option("path", str(tmp_path / "loop.json")).load().collect()


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "abcd" * 5), (2, None), (3, "ab")], "i int, t string")
    assert tuple(exports.length_report(df, "t").first()) == (2, 11, 20, 3, 5)
    assert tuple(exports.length_report(df.limit(0), "t").first()) == (0, 0, 0, 0, 0)
    hashes = {r.i: r.t_hash for r in exports.hashed(df, "t").collect()}
    assert hashes[2] == "" and len(hashes[1]) == 32
    exports.write_tsv(exports.hashed(df, "t"), str(tmp_path / "h"))
    assert spark.read.csv(str(tmp_path / "h"), sep="\t", header=True).count() == 3
    path = exports.publish(df, str(tmp_path / "t"), "1")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        exports.publish(df, str(tmp_path / "t"), "1")
    for n in (1, 2, 2):
        exports.append_series(spark.range(n), str(tmp_path / "s"), f"2026-01-0{n}")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3
    exports.write_json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3


def test_streams(spark, tmp_path):
    arriving = tmp_path / "in"
    for n, data in enumerate([[(1, "a", "x"), (2, "a", "x")], [(1, "b", "y")]]):
        spark.createDataFrame(data, "s int, k string, v string").coalesce(1).write.mode("append").parquet(str(arriving))
        query = follow_snapshots(spark, str(arriving), "s int, k string, v string", str(tmp_path / "m"), str(tmp_path / "c"), "s", "k", ["v"])
        query.awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "m/batch=1"))) == [(1, "b", "y"), (2, "a", "x")]
    events = spark.createDataFrame([("u", "2026-01-01 00:00:00", 1.0), ("u", "2026-01-01 00:20:00", 2.0), ("u", "2026-01-01 02:00:00", 4.0)], "k string, t string, v double").withColumn("t", F.to_timestamp("t"))
    assert [r.total for r in windowed(events, "t", "k", "v").orderBy("start").collect()] == [3.0, 4.0]
    assert [r.n for r in sessions(events, "t", "k").orderBy("start").collect()] == [2, 1]


def test_capped_listings(spark):
    facets = spark.createDataFrame([("place", "a", 1500), ("place", "b", 500), ("kind", "x", 700), ("kind", "y", 700), ("kind", "z", 601), ("part", "p", 90)], "facet string, value string, n long")
    assert {r.facet for r in boards.covering_facet(facets, 2000).collect()} == {"place"} and boards.covering_facet(facets, 500).count() == 0
    listed = spark.createDataFrame([("1", "A", "IN"), ("2", "B", "IN"), ("3", "C", "OUT"), ("1", "A", "IN")], "external_id string, title string, state string")
    assert tuple(boards.complete(listed, "external_id", 3).first()) == (3, True) and not boards.complete(listed, "external_id", 4).first().complete
    held = spark.createDataFrame([("1", "A"), ("2", "old")], "external_id string, title string")
    assert [r.external_id for r in boards.details_wanted(listed, held, F.col("state") == "IN").collect()] == ["2"]
    answers = spark.createDataFrame([(404, None), (200, 3), (200, 0), (500, None)], "c int, n int")
    assert [r[0] for r in answers.select(boards.board_status(F.col("c"), F.col("n"))).collect()] == ["NOT_FOUND", "ACTIVE", "EMPTY", None]


def test_probe_answers_and_site_addresses(spark):
    answers = [(1, 200, '{"name": " Olm ", "jobs": [{}]}'), (2, 200, '{"jobs": []}'), (3, 404, "gone"), (4, 500, None), (5, 200, "no json")]
    found = boards.probed(spark.createDataFrame(answers, "company_id int, code int, body string"))
    assert rows(found) == [(1, "ACTIVE", "Olm"), (2, "EMPTY", None), (3, "NOT_FOUND", None), (4, None, None), (5, None, None)]
    urls = ["https://olm.wd5.board.example/en-US/Careers/job/1", "https://OLM.wd5.board.example/Careers", "https://olm.board.example/x", "http://olm.wd5.board.example/a", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(site_board(F.col("u")).alias("s")).collect()
    assert [tuple(r.s) if r.s else None for r in got] == [("olm", "wd5", "Careers"), ("olm", "wd5", "Careers"), None, None, None]
