"""Web archive indexes: block lines, sorted cluster indexes and paged listings."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def index_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``surt, ts, url, filename`` of captures in index blocks (text, gzip or not).

    A line is a key, a time and a JSON object; lines of other files than captures, and those without
    a URL, are left out. A line of another form ends the read with an error.
    """
    parts = spark.read.text(path).where("trim(value) <> ''").select(F.regexp_extract("value", r"^(\S+) (\d{14}) (\{.*\})\s*$", 1).alias("surt"), F.regexp_extract("value", r"^(\S+) (\d{14}) (\{.*\})\s*$", 2).alias("ts"), F.from_json(F.regexp_extract("value", r"(\{.*\})\s*$", 1), "url string, filename string").alias("j"), "value")
    bad = (F.col("surt") == "") | F.col("j").isNull()
    wanted = F.coalesce(F.col("j.filename").contains("/warc/") & F.col("j.url").isNotNull(), F.lit(False))
    error = F.raise_error(F.concat(F.lit("no index line: "), F.substring("value", 1, 80))).cast("boolean")
    return parts.where(F.when(bad, error).otherwise(wanted)).select("surt", "ts", "j.url", "j.filename")


def blocks_for_prefix(index: DataFrame, shard: str, key: str, prefix: str) -> DataFrame:
    """The blocks of a sorted index of first keys that can hold keys with ``prefix``.

    A block holds the keys from its own to the next block's: wanted are the blocks whose key has the
    prefix and the one before the first of them. Keys are compared within each shard of the index.
    """
    following = F.lead(key).over(Window.partitionBy(shard).orderBy(key))
    end = prefix[:-1] + chr(ord(prefix[-1]) + 1) if prefix else None
    rows = index.withColumn("_next", following)
    begins = F.lit(True) if end is None else F.col(key) < end
    return rows.where(begins & (F.col("_next").isNull() | (F.col("_next") >= prefix))).drop("_next")


class PagedListing(DataSource):
    """Listings saved as JSON pages of one-field rows, each page under the resume key that asks for it.

    Options: ``path``, a JSON file ``{key: page}``, the first key empty. A page's first row is its
    header; after an empty row stands the resume key of the next page. Pages are followed until one
    has no such key; a key that comes twice is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "page int, original string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagedReader(self.options["path"])


class _PagedReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        return [InputPartition(0)]  # each page names the next

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        with open(self.path) as saved:
            pages = json.load(saved)
        key, seen, number = "", set(), 0
        while key is not None:
            if key in seen:
                raise ValueError(f"resume key given twice: {key!r}")
            seen.add(key)
            rows, following = pages[key], None
            for i, row in enumerate(rows[1:], 1):
                if not row:
                    following = rows[i + 1][0]
                    break
                yield number, row[0]
            key, number = following, number + 1
