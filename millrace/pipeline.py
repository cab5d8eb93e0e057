"""The passes over a corpus in their order, each giving its outputs and a report of one row.

A pass is a pure function of its input tables, so running one again replaces what it gave before.
``Pipeline`` holds the tables by name; a pass adds its own. Nothing runs until outputs are written
or a report is read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import titles
from millrace.functions.urls import board_region, board_slug
from millrace.operators.duplicates import exact_duplicates
from millrace.operators.mirror import insert_absent, reconcile
from millrace.operators.nearness import group_nearness
from millrace.operators.phrases import Classifier, Entry, extract_entries
from millrace.operators.segments import segments
from millrace.sources.tables import table

Result = tuple[DataFrame, DataFrame]


@dataclass
class Pipeline:
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def over(cls, spark: SparkSession, directory: str, *names: str) -> Pipeline:
        return cls({n: table(spark, directory, n) for n in names})

    def _record(self, name: str, outputs: DataFrame, report: DataFrame) -> Result:
        self.tables[name] = outputs
        return outputs, report

    def openings(self) -> DataFrame:
        """Each opening once."""
        return self.tables["vacancy"].dropDuplicates(["id"])

    def discover(self, urls: DataFrame, url: str, ats: str, hosts: str) -> Result:
        """Boards that addresses name, added to those held; EU wins where both regions are seen."""
        seen = urls.select(board_slug(F.col(url), hosts).alias("slug"), board_region(F.col(url)).alias("region")).where("slug is not null")
        found = seen.groupBy("slug").agg(F.when(F.max((F.col("region") == "EU").cast("int")) == 1, "EU").otherwise("US").alias("region")).select(F.lit(ats).alias("ats"), "slug", "region")
        held = self.tables["company"].select("ats", "slug", "region")
        added = found.join(held, ["ats", "slug"], "left_anti")
        report = found.agg(F.count(F.lit(1)).alias("slugs")).withColumn("companies_added", added.agg(F.count(F.lit(1))).scalar())
        return self._record("boards", insert_absent(held, found, ["ats", "slug"]), report)

    def sweep(self, published: DataFrame, compared: list[str], outcome: DataFrame | None = None) -> Result:
        """Published openings mirrored into the held ones."""
        held = self.openings().select("company_id", "external_id", *compared)
        mirrored, by_board = reconcile(held, published, "company_id", "external_id", compared, outcome)
        report = by_board.agg(F.count(F.lit(1)).alias("boards"), *(F.sum(c).alias(c) for c in ("added", "updated", "deleted")))
        return self._record("mirror", mirrored, report)

    def clean(self) -> Result:
        t, lang = F.col("title"), T.detected_language(F.col("language"), F.col("description"))
        cleaned = self.openings().select(
            "id", "title", T.clean_title(t).alias("cleaned_title"), T.clean_description(F.col("description")).alias("cleaned_description"),
            lang.alias("detected_language"), segments(F.col("description")).alias("segments"),
        )
        rules = {"distinct_titles": t, "distinct_cleaned_titles": T.clean_title(t), "by_spacing": T.spaced(t), "by_gender_marker": T.without_gender_marker(t), "by_characters": T.title_characters(t)}
        report = self.openings().agg(F.count(F.lit(1)).alias("vacancies"), *(F.count_distinct(v).alias(k) for k, v in rules.items()), F.count(lang).alias("languages_detected"))
        return self._record("cleaned", cleaned, report)

    def classify(self, classifier: Classifier) -> Result:
        states = classifier.classify(self.tables["cleaned"].select("id", "cleaned_title"), "cleaned_title").select("id", "state", "reason")
        count = lambda column, value: F.count_if(F.col(column) == value).alias(value.lower())
        return self._record("states", states, states.agg(F.count(F.lit(1)).alias("vacancies"), *(count("state", s) for s in ("IN", "OUT", "UNKNOWN")), *(count("reason", r) for r in ("UNRULED", "DOMAIN_AMBIGUITY", "SCOPE_AMBIGUITY"))))

    def extract(self, entries: Iterable[Entry]) -> Result:
        found = extract_entries(self.openings(), "id", "description", entries)
        report = found.agg(F.count_distinct("id").alias("vacancies"), F.count(F.lit(1)).alias("rows"), F.count_if("from_context").alias("rows_from_context_keys"))
        return self._record("skills", found, report)

    def break_down(self) -> Result:
        t = F.col("title")
        parts = self.openings().select("id", titles.normal_title(t).alias("normal_title"), titles.management_level(t).alias("management_level"))
        return self._record("breakdown", parts, parts.agg(F.count(F.lit(1)).alias("vacancies"), F.count_if(F.col("normal_title") == "").alias("without_normal_title")))

    def modes(self) -> Result:
        found, evidence = titles.first_evidence(**{k: titles.named_modes(F.col(c)) for k, c in (("location", "location"), ("field", "workplace_type"), ("title", "title"), ("description", "description"))})
        rows = self.openings().select("id", "ats", found.alias("work_modes"), evidence.alias("evidence"))
        return self._record("modes", rows.drop("evidence"), rows.groupBy("ats", "evidence").agg(F.count(F.lit(1)).alias("n")))

    def seniority(self) -> Result:
        named, _ = T.seniority_words(F.coalesce("title", F.lit("")))
        rows = self.openings().select("id", titles.lowest_level(named).alias("named"), titles.years_asked(F.col("description")).alias("required_years"))
        out = rows.withColumn("seniority_level", titles.level_of(F.col("named"), F.col("required_years")))
        report = out.agg(F.count(F.lit(1)).alias("vacancies"), F.count("named").alias("named_by_title"), F.count("required_years").alias("with_required_years"), F.count("seniority_level").alias("with_seniority_level"))
        return self._record("seniority", out, report)

    def duplicates(self) -> Result:
        rows = self.openings().join(self.tables["company"].select(F.col("id").alias("company_id"), "slug"), "company_id", "left")
        found = exact_duplicates(rows, "id", "company_id", [F.col("slug"), F.col("title"), F.col("location")], F.col("description"), "first_published_at")
        return self._record("duplicates", found, found.agg(F.count(F.lit(1)).alias("duplicates")).withColumn("vacancies", self.openings().agg(F.count(F.lit(1))).scalar()))

    def nearness(self, group: str = "department") -> Result:
        """How near groups of openings are by the skills found in them."""
        mentions = self.tables["skills"].join(self.openings().select("id", group), "id")
        near = group_nearness(mentions, group, "id", "entry")
        return self._record("nearness", near, near.agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct(group).alias("groups")))
