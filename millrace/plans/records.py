"""Queries that mirror, reconcile, join, aggregate and rank records, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import haversine_km, rate, wilson
from millrace.operators import events as ev
from millrace.operators import mirror, sampling
from millrace.operators.duplicates import exact_duplicates
from millrace.operators.nearness import group_nearness
from millrace.operators.snapshots import plain_key
from millrace.session import cut_lineage
from millrace.sources.boards import declared_locations as board_locations
from millrace.sources.tables import table

COMPARED = ["title", "location", "department", "pay_min_cents", "description_hash"]


def _mirrored(spark: SparkSession, d: str, outcome: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All snapshots mirrored one after the other into the first: what is held, and a report by snapshot and company.

    Keys are plain ones; where a snapshot holds a key twice, the row updated last counts.
    """
    rows = table(spark, d, "vacancy_snapshot", "snapshot_no", "company_id", "external_id", "updated_at", *COMPARED).where("snapshot_no is not null")
    latest = F.max(F.struct("updated_at", *COMPARED)).alias("r")
    last = cut_lineage(rows.withColumn("external_id", plain_key(F.col("external_id"))).groupBy("snapshot_no", "company_id", "external_id").agg(latest))
    numbers = [r[0] for r in last.select("snapshot_no").distinct().orderBy("snapshot_no").collect()]
    steps = [last.where(F.col("snapshot_no") == n).select("company_id", "external_id", *(f"r.{c}" for c in COMPARED)) for n in numbers]
    held = steps[0] if steps else last.select("company_id", "external_id", *(f"r.{c}" for c in COMPARED))
    reports = last.limit(0).selectExpr("snapshot_no", "company_id", "0L as added", "0L as updated", "0L as deleted")
    for n, published in zip(numbers[1:], steps[1:], strict=True):
        held, report = mirror.reconcile(held, published, "company_id", "external_id", COMPARED, outcome)
        held = cut_lineage(held)
        reports = reports.unionByName(report.withColumn("snapshot_no", F.lit(n)))
    return held, reports


def snapshot_mirror(spark: SparkSession, d: str) -> DataFrame:
    """What each snapshot after the first changes, by company."""
    return _mirrored(spark, d)[1]


def snapshot_mirror_gated(spark: SparkSession, d: str) -> DataFrame:
    """What is held after all snapshots, boards that weren't read keeping theirs."""
    return _mirrored(spark, d, _outcome(spark, d))[0].groupBy("company_id").agg(F.count(F.lit(1)).alias("n_held"))


def _outcome(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "company", "id", "board_status").select(F.col("id").alias("company_id"), F.when(F.col("board_status") == "ACTIVE", "published").when(F.col("board_status") == "NOT_FOUND", "not_found").otherwise("unreadable").alias("outcome"))


def document_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Documents of equal text, whatever their source; the one kept is of the source that had the text first."""
    rows = table(spark, d, "documents", "doc_id", "source", "text", "fetched_at")
    return exact_duplicates(rows, "doc_id", "source", [], F.col("text"), "fetched_at")


def opening_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Openings of one slug, title, location, mode and description that repeat another."""
    rows = table(spark, d, "vacancy", "id", "company_id", "title", "location", "workplace_type", "description", "first_published_at").dropDuplicates(["id"])
    slugs = table(spark, d, "company", F.col("id").alias("company_id"), "slug").dropDuplicates(["company_id"])
    own = rows.join(slugs, "company_id", "left").withColumn("slug", F.coalesce(F.concat(F.lit("s"), "slug"), F.concat(F.lit("b"), F.col("company_id").cast("string"))))
    return exact_duplicates(own, "id", "company_id", [F.col("slug"), F.col("title"), F.col("location"), F.col("workplace_type")], F.col("description"), "first_published_at")


def company_names(spark: SparkSession, d: str) -> DataFrame:
    return mirror.commonest(table(spark, d, "company", "id", "slug", "name"), "slug", "name", "id")


def companies_added(spark: SparkSession, d: str) -> DataFrame:
    companies = table(spark, d, "company", "ats", "slug", "region")
    return mirror.insert_absent(companies.where("region = 'US'"), companies.where("region = 'EU'"), ["ats", "slug"]).groupBy("ats", "region").agg(F.count(F.lit(1)).alias("n"))


def recorded_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Every opening with what the last run derived, null where it was left out."""
    ids = table(spark, d, "vacancy", "id").distinct().withColumnRenamed("id", "vacancy_id").withColumn("seniority_level", F.lit("stale"))
    return mirror.record_outputs(ids, table(spark, d, "normalized_vacancy", "vacancy_id", "seniority_level"), "vacancy_id", ["seniority_level"])


def surviving_outputs(spark: SparkSession, d: str) -> DataFrame:
    active = table(spark, d, "company", "id", "board_status").where("board_status = 'ACTIVE'").select(F.col("id").alias("company_id"))
    kept = table(spark, d, "vacancy", "id", "company_id").join(active, "company_id", "left_semi")
    return mirror.survivors(table(spark, d, "normalized_vacancy", "id", "vacancy_id"), kept, "vacancy_id", "id")


def regions_by_url(spark: SparkSession, d: str) -> DataFrame:
    eu = table(spark, d, "vacancy", "company_id", "url").where(F.col("url").rlike(r"^https://[^/]*ashby"))
    return table(spark, d, "company", "id", "region").join(eu, F.col("id") == F.col("company_id"), "left_semi").select("id", "region")


def after_page(spark: SparkSession, d: str) -> DataFrame:
    return mirror.tail_after(table(spark, d, "company", "id", "slug"), "slug", "m", 50)


def supported_scope(spark: SparkSession, d: str) -> DataFrame:
    lang = F.lower(F.col("language"))
    return table(spark, d, "vacancy", "id", "language").where(lang.isNull() | lang.isin("en", "es")).groupBy("language").agg(F.count_distinct("id").alias("n"))


def declared_locations(spark: SparkSession, d: str) -> DataFrame:
    """All places an opening declares: its location, the secondary ones, and what else its location list has."""
    rows = table(spark, d, "normalized_vacancy_location", "normalized_vacancy_id", "list_name", "pos", "location").where("trim(location) <> ''")

    def of(kind: str) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col("list_name") == kind, F.struct("pos", "location"))))
        return F.transform(held, lambda x: x["location"])

    lists = rows.groupBy("normalized_vacancy_id").agg(of("LOCATION").alias("own"), of("SECONDARY_LOCATIONS").alias("secondary"))
    every = board_locations(F.get("own", F.lit(0)), F.col("secondary"), F.col("own"))
    return lists.select("normalized_vacancy_id", F.array_join(every, " | ").alias("locations"))


def work_modes(spark: SparkSession, d: str) -> DataFrame:
    """Openings by source and mode; null modes (not run) and empty ones (none found) apart."""
    nv = table(spark, d, "normalized_vacancy", "vacancy_id", "work_modes")
    ats = table(spark, d, "vacancy", "id", "ats").distinct()
    mode = F.explode_outer(F.when(F.col("work_modes").isNull(), F.array(F.lit("NOT_RUN"))).when(F.size("work_modes") == 0, F.array(F.lit("NONE"))).otherwise(F.col("work_modes")))
    return nv.join(ats, F.col("vacancy_id") == F.col("id")).select("ats", mode.alias("mode")).groupBy("ats", "mode").agg(F.count(F.lit(1)).alias("n"))


def seniority_tally(spark: SparkSession, d: str) -> DataFrame:
    """Levels against required years, with subtotals by grouping sets."""
    years = F.col("required_years")
    by_years = F.when(years <= 1, "ENTRY").when(years == 2, "JUNIOR").when(years <= 4, "MID").when(years <= 7, "SENIOR").when(years >= 8, "STAFF")
    rows = table(spark, d, "normalized_vacancy", "seniority_level", "required_years").select(F.coalesce("seniority_level", F.lit("-")).alias("named"), F.coalesce(by_years, F.lit("-")).alias("by_years"))
    return rows.cube("named", "by_years").agg(F.count(F.lit(1)).alias("n"))


def mode_pivot(spark: SparkSession, d: str) -> DataFrame:
    return sampling.confusion(table(spark, d, "vacancy", "ats", "workplace_type").where("ats is not null"), "ats", "workplace_type", ["Remote", "Hybrid", "OnSite"])


def pay_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentile and rounded mean, by currency."""
    rows = table(spark, d, "vacancy", "id", "pay_currency", "pay_min_cents").where("pay_min_cents is not null and pay_currency is not null")
    return rows.groupBy("pay_currency").agg(F.expr("percentile_disc(0.95) within group (order by pay_min_cents)").cast("long").alias("p95"), F.round(F.avg("pay_min_cents"), 2).alias("mean_cents"), F.count_distinct("id").alias("n_openings"))


def slug_concentration(spark: SparkSession, d: str) -> DataFrame:
    """Share of the five largest companies, companies with one opening, and all."""
    n = table(spark, d, "vacancy", "company_id", "id").groupBy("company_id").agg(F.count_distinct("id").alias("n"))
    top = n.orderBy(F.desc("n"), "company_id").limit(5).agg(F.sum("n").alias("top"))
    whole = n.agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("singletons"), F.count(F.lit(1)).alias("companies"))
    return whole.withColumn("top5_share", F.round(top.scalar() / F.col("total"), 6))


def department_nearness(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "vacancy", "id", "department", "title").select("id", "department", F.explode(F.array_distinct(F.split(F.lower(F.trim("title")), r"[^\p{L}]+"))).alias("word")).where("word <> ''")
    return group_nearness(words, "department", "id", "word").withColumn("nearness", F.round("nearness", 6))


def places_within(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of places at most 500 km apart; only those in the same or neighbouring cubes of 500 km meet, whatever their latitude."""
    radius, side = 6371.0, 500.0
    lat, lon = F.radians("latitude"), F.radians("longitude")
    axes = {"x": F.cos(lat) * F.cos(lon), "y": F.cos(lat) * F.sin(lon), "z": F.sin(lat)}
    p = table(spark, d, "place", "id", "latitude", "longitude").where("latitude is not null and longitude is not null")
    p = p.select("*", *(F.floor(v * radius / side).cast("int").alias(k) for k, v in axes.items()))
    near = p
    for k in axes:
        near = near.withColumn(k, F.explode(F.sequence(F.col(k) - 1, F.col(k) + 1)))
    a, b = p.alias("a"), near.alias("b")
    km = haversine_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    meet = (F.col("a.x") == F.col("b.x")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.z") == F.col("b.z")) & (F.col("a.id") < F.col("b.id"))
    return a.join(b, meet).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.round(km, 3).alias("km")).where("km <= 500")


def language_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Declared two-letter language of openings by source: count, share and interval of those in English."""
    rows = table(spark, d, "vacancy", "id", "ats", "language").distinct().where(F.col("language").rlike("^[a-z]{2}$"))
    counts = rows.groupBy("ats").agg(F.count_if(F.col("language") == "en").alias("hits"), F.count(F.lit(1)).alias("total"))
    low, high = wilson(F.col("hits"), F.col("total"))
    return counts.select("ats", "hits", "total", F.round(rate(F.col("hits"), F.col("total")), 6).alias("share"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def sample_allocation(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "documents", "source").groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    return sampling.largest_remainder(sizes, "source", "size", 100)


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_sample(table(spark, d, "documents", "doc_id", "source"), "source", "doc_id", 5, 11)


def mean_interval(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap interval of the mean length of documents, with 200 resamples."""
    return sampling.bootstrap_interval(table(spark, d, "documents", "n_chars"), "n_chars", 200, 5)


def user_gaps(spark: SparkSession, d: str) -> DataFrame:
    return ev.silent_gaps(table(spark, d, "events", "user_id", "ts"), "user_id", "ts", 6 * 3600).withColumn("gap_seconds", F.round("gap_seconds", 3))


def event_spans(spark: SparkSession, d: str) -> DataFrame:
    return ev.spans(table(spark, d, "events", "user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id", "event_type").where("n > 1")


def last_events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", "user_id", "ts", "event_id", "event_type", "props")
    last = rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("r"))
    return last.select("user_id", "r.event_id", "r.event_type", "r.k")


def hourly_values(spark: SparkSession, d: str) -> DataFrame:
    hour = F.date_trunc("hour", "ts")
    return table(spark, d, "events", "ts", "event_type", "value").groupBy(hour.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("total"))


def large_orders(spark: SparkSession, d: str) -> DataFrame:
    """Top ten orders of each customer segment by revenue."""
    revenue = table(spark, d, "lineitem", "l_orderkey", "l_extendedprice", "l_discount").groupBy("l_orderkey").agg(F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")).alias("revenue"))
    rows = revenue.join(table(spark, d, "orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.desc("revenue"), "o_orderkey"))
    return rows.withColumn("rank", rank).where("rank <= 10").select("c_mktsegment", "o_orderkey", F.col("revenue").cast("double").alias("revenue"), "rank")


def price_summary(spark: SparkSession, d: str) -> DataFrame:
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("sum_qty"), F.sum(price).cast("double").alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n")
    )


def label_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the mean embeddings of labels."""
    rows = table(spark, d, "embeddings", "label", "embedding").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = rows.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    unit = mean.join(mean.groupBy("label").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("l")), "label").select("label", "i", (F.col("x") / F.col("l")).alias("u"))
    a, b = unit.alias("a"), unit.alias("b")
    return a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.label") < F.col("b.label"))).groupBy(F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b")).agg(F.round(F.sum(F.col("a.u") * F.col("b.u")), 5).alias("cosine"))


QUERIES = {f.__name__: f for f in (
    snapshot_mirror, snapshot_mirror_gated, document_duplicates, opening_duplicates, company_names, companies_added, recorded_outputs, surviving_outputs, regions_by_url, after_page, supported_scope,
    declared_locations, work_modes, seniority_tally, mode_pivot, pay_percentiles, slug_concentration, department_nearness, places_within, language_agreement,
    sample_allocation, seeded_sample, mean_interval, user_gaps, event_spans, last_events, hourly_values, large_orders, price_summary, label_similarity,
)}

_SNAP = """WITH t AS (SELECT *, lower(trim(external_id, ' ' || chr(9) || chr(10) || chr(13))) AS bare FROM vacancy_snapshot),
  s AS (SELECT snapshot_no, company_id, CASE WHEN regexp_full_match(bare, '[0-9]+') THEN regexp_replace(bare, '^0+([0-9])', '\\1') ELSE bare END AS k, updated_at, title, location, department, pay_min_cents, description_hash FROM t),
  o AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY snapshot_no, company_id, k ORDER BY updated_at DESC NULLS LAST, title DESC NULLS LAST, location DESC NULLS LAST) = 1)"""

_SAME = r"lower(trim(regexp_replace(coalesce({0}, ''), '[\s\x{{00a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]+', ' ', 'g')))"
_KEPT = """e AS (SELECT *, first_value(board) OVER (PARTITION BY k ORDER BY f ASC NULLS LAST, ident) AS first_board FROM b),
        w AS (SELECT *, first_value(ident) OVER (PARTITION BY k ORDER BY (board = first_board) DESC, f DESC NULLS LAST, ident DESC) AS kept_id FROM e)"""

_WILSON = "round((hits / total::DOUBLE + 3.8416 / (2 * total) {0} 1.96 * sqrt(hits / total::DOUBLE * (1 - hits / total::DOUBLE) / total + 3.8416 / (4 * total::DOUBLE * total))) / (1 + 3.8416 / total), 6)"

ORACLES = {
    "snapshot_mirror": _SNAP + """, j AS (SELECT coalesce(p.snapshot_no, h.snapshot_no + 1) AS snapshot_no, coalesce(p.company_id, h.company_id) AS company_id, h.k IS NULL AS fresh, p.k IS NULL AS gone,
          (h.title, h.location, h.department, h.pay_min_cents, h.description_hash) IS DISTINCT FROM (p.title, p.location, p.department, p.pay_min_cents, p.description_hash) AS differs
        FROM o h FULL JOIN o p ON p.company_id = h.company_id AND p.k = h.k AND p.snapshot_no = h.snapshot_no + 1)
        SELECT snapshot_no, company_id, count(*) FILTER (fresh) AS added, count(*) FILTER (NOT fresh AND NOT gone AND differs) AS updated, count(*) FILTER (gone) AS deleted
        FROM j WHERE snapshot_no BETWEEN 2 AND (SELECT max(snapshot_no) FROM o) GROUP BY 1, 2""",
    "snapshot_mirror_gated": _SNAP + """SELECT o.company_id, count(*) AS n_held FROM o LEFT JOIN company c ON c.id = o.company_id
        WHERE o.snapshot_no = CASE WHEN c.board_status IN ('ACTIVE', 'NOT_FOUND') THEN (SELECT max(snapshot_no) FROM o) ELSE (SELECT min(snapshot_no) FROM o) END GROUP BY 1""",
    "document_duplicates": f"""WITH b AS (SELECT doc_id AS ident, source AS board, fetched_at AS f, {_SAME.format('text')} AS k FROM documents WHERE {_SAME.format('text')} <> ''),
        {_KEPT} SELECT ident AS doc_id, kept_id FROM w WHERE ident <> kept_id""",
    "opening_duplicates": f"""WITH v AS (SELECT id, any_value(company_id) AS company_id, any_value(title) AS title, any_value(location) AS location, any_value(workplace_type) AS mode, any_value(description) AS description, any_value(first_published_at) AS f FROM vacancy GROUP BY id),
        b AS (SELECT v.id AS ident, company_id AS board, f, (coalesce(c.slug, company_id::VARCHAR), {_SAME.format('title')}, {_SAME.format('location')}, {_SAME.format('mode')}, {_SAME.format('description')}) AS k
          FROM v LEFT JOIN company c ON c.id = v.company_id WHERE {_SAME.format('description')} <> ''),
        {_KEPT} SELECT ident AS id, kept_id FROM w WHERE ident <> kept_id""",
    "company_names": """WITH c AS (SELECT slug, name, count(*) AS n, min(id) AS first_id FROM company WHERE trim(name) <> '' GROUP BY 1, 2)
        SELECT slug, name, n FROM c QUALIFY row_number() OVER (PARTITION BY slug ORDER BY n DESC, first_id) = 1""",
    "companies_added": "SELECT ats, region, count(*) AS n FROM company WHERE region = 'US' OR (region = 'EU' AND (ats, slug) NOT IN (SELECT (ats, slug) FROM company WHERE region = 'US')) GROUP BY 1, 2",
    "recorded_outputs": "SELECT v.id AS vacancy_id, n.seniority_level FROM (SELECT DISTINCT id FROM vacancy) v LEFT JOIN normalized_vacancy n ON n.vacancy_id = v.id",
    "surviving_outputs": "SELECT id, vacancy_id FROM normalized_vacancy WHERE vacancy_id IN (SELECT v.id FROM vacancy v JOIN company c ON c.id = v.company_id WHERE c.board_status = 'ACTIVE')",
    "regions_by_url": "SELECT id, region FROM company WHERE id IN (SELECT company_id FROM vacancy WHERE regexp_matches(url, '^https://[^/]*ashby'))",
    "after_page": "SELECT id, slug FROM company WHERE slug > 'm' ORDER BY slug, id LIMIT 50",
    "supported_scope": "SELECT language, count(DISTINCT id) AS n FROM vacancy WHERE language IS NULL OR lower(language) IN ('en', 'es') GROUP BY 1",
    "declared_locations": """WITH l AS (SELECT *, row_number() OVER (PARTITION BY normalized_vacancy_id, list_name ORDER BY pos) AS n FROM normalized_vacancy_location WHERE trim(location) <> '')
        SELECT normalized_vacancy_id, string_agg(location, ' | ' ORDER BY CASE WHEN list_name <> 'LOCATION' THEN 1 WHEN n = 1 THEN 0 ELSE 2 END, pos, location) AS locations FROM l GROUP BY 1""",
    "work_modes": """SELECT v.ats, m.mode, count(*) AS n FROM (SELECT vacancy_id, unnest(CASE WHEN work_modes IS NULL THEN ['NOT_RUN'] WHEN len(work_modes) = 0 THEN ['NONE'] ELSE work_modes END) AS mode FROM normalized_vacancy) m
        JOIN (SELECT DISTINCT id, ats FROM vacancy) v ON v.id = m.vacancy_id GROUP BY 1, 2""",
    "seniority_tally": """SELECT named, by_years, count(*) AS n FROM (SELECT coalesce(seniority_level, '-') AS named,
        CASE WHEN required_years <= 1 THEN 'ENTRY' WHEN required_years = 2 THEN 'JUNIOR' WHEN required_years <= 4 THEN 'MID' WHEN required_years <= 7 THEN 'SENIOR' WHEN required_years >= 8 THEN 'STAFF' ELSE '-' END AS by_years
        FROM normalized_vacancy) GROUP BY CUBE (named, by_years)""",
    "mode_pivot": """SELECT ats, count(*) FILTER (workplace_type = 'Remote') AS "Remote", count(*) FILTER (workplace_type = 'Hybrid') AS "Hybrid", count(*) FILTER (workplace_type = 'OnSite') AS "OnSite" FROM vacancy WHERE ats IS NOT NULL GROUP BY 1""",
    "pay_percentiles": """SELECT pay_currency, quantile_disc(pay_min_cents, 0.95)::BIGINT AS p95, round(avg(pay_min_cents), 2) AS mean_cents, count(DISTINCT id) AS n_openings
        FROM vacancy WHERE pay_min_cents IS NOT NULL AND pay_currency IS NOT NULL GROUP BY 1""",
    "slug_concentration": """WITH n AS (SELECT company_id, count(DISTINCT id) AS n FROM vacancy GROUP BY 1), t AS (SELECT sum(n) AS top FROM (SELECT n FROM n ORDER BY n DESC, company_id LIMIT 5))
        SELECT sum(n)::BIGINT AS total, count(*) FILTER (n = 1) AS singletons, count(*) AS companies, round(any_value(top) / sum(n), 6) AS top5_share FROM n, t""",
    "department_nearness": r"""WITH m AS (SELECT DISTINCT department AS g, id AS m, unnest(string_split_regex(lower(trim(title)), '[^\p{L}]+')) AS i FROM vacancy WHERE department IS NOT NULL),
        p AS (SELECT * FROM m WHERE i <> ''), n AS (SELECT g, count(DISTINCT m) AS n FROM p GROUP BY g), d AS (SELECT i, count(DISTINCT m) AS df FROM p GROUP BY i),
        w AS (SELECT p.g, p.i, count(*) / any_value(n.n)::DOUBLE * ln((SELECT count(DISTINCT m) FROM p) / any_value(d.df)::DOUBLE) AS w FROM p JOIN n USING (g) JOIN d USING (i) GROUP BY p.g, p.i),
        u AS (SELECT g, i, w / sqrt(sum(w * w) OVER (PARTITION BY g)) AS u FROM w WHERE w > 0), g AS (SELECT DISTINCT g FROM u)
        SELECT a.g AS department, b.g AS near_department, round(coalesce((SELECT sum(x.u * y.u) FROM u x JOIN u y ON x.i = y.i WHERE x.g = a.g AND y.g = b.g), 0), 6) AS nearness FROM g a JOIN g b ON a.g < b.g""",
    "places_within": """WITH p AS (SELECT a.id AS id_a, b.id AS id_b, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(b.latitude - a.latitude) / 2), 2)
          + cos(radians(a.latitude)) * cos(radians(b.latitude)) * pow(sin(radians(b.longitude - a.longitude) / 2), 2)))) AS km FROM place a JOIN place b ON a.id < b.id)
        SELECT id_a, id_b, round(km, 3) AS km FROM p WHERE round(km, 3) <= 500""",
    "language_agreement": f"""WITH c AS (SELECT ats, count(*) FILTER (language = 'en') AS hits, count(*) AS total FROM (SELECT DISTINCT id, ats, language FROM vacancy) WHERE regexp_matches(language, '^[a-z]{{2}}$') GROUP BY 1)
        SELECT ats, hits, total, round(hits / total::DOUBLE, 6) AS share, {_WILSON.format('-')} AS low, {_WILSON.format('+')} AS high FROM c""",
    "sample_allocation": """WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY 1), e AS (SELECT *, size * 100 / (SELECT sum(size) FROM s)::DOUBLE AS x FROM s),
        r AS (SELECT source, size, floor(x) AS f, row_number() OVER (ORDER BY x - floor(x) DESC, source NULLS FIRST) AS k, 100 - sum(floor(x)) OVER () AS missing FROM e)
        SELECT source, size, (f + CASE WHEN k <= missing THEN 1 ELSE 0 END)::BIGINT AS drawn FROM r""",
    "user_gaps": """WITH g AS (SELECT user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap_start, ts AS gap_end FROM events)
        SELECT *, round((epoch_us(gap_end) - epoch_us(gap_start)) / 1e6, 3) AS gap_seconds FROM g WHERE (epoch_us(gap_end) - epoch_us(gap_start)) / 1e6 > 21600""",
    "event_spans": """WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND lag(1) OVER w IS NOT NULL THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
        SELECT user_id, event_type, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n FROM r GROUP BY user_id, run, event_type HAVING count(*) > 1""",
    "last_events": "SELECT user_id, event_id, event_type, (props->>'$.k')::INT AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "hourly_values": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY 1, 2",
    "large_orders": """WITH r AS (SELECT l_orderkey, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4)) AS revenue FROM lineitem GROUP BY 1)
        SELECT c_mktsegment, o_orderkey, revenue::DOUBLE AS revenue, row_number() OVER (PARTITION BY c_mktsegment ORDER BY revenue DESC, o_orderkey) AS rank
        FROM r JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey QUALIFY rank <= 10""",
    "price_summary": """SELECT l_returnflag, l_linestatus, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS sum_qty, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS sum_price,
        round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "label_similarity": """WITH r AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM r GROUP BY 1, 2),
        u AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS u FROM m)
        SELECT a.label AS label_a, b.label AS label_b, round(sum(a.u * b.u), 5) AS cosine FROM u a JOIN u b ON a.i = b.i AND a.label < b.label GROUP BY 1, 2""",
}
