"""Sources and sinks: landing records, tables, reports and exports. Paths are read and written by Spark alone."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG = "name string, organizer string, level string, category string, official_url string, description string, verified_at string, status string"
CONTEST = "title string, detail_url string, source_url string, source string"


def read_catalog_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The authoritative catalog, a JSON array of entries (or JSON lines), as standard records."""
    raw = spark.read.schema(CATALOG).option("multiLine", multi_line).json(path)
    return raw.select(
        F.col("name").alias("title"), "organizer", F.col("level").alias("contest_level"), "category",
        F.coalesce("official_url", F.lit("")).alias("source_url"), F.coalesce("status", F.lit("active")).alias("status"), F.lit(True).alias("is_ministry_approved"),
    )


def read_contest_records(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Listing records, a JSON array (or JSON lines), as raw events."""
    raw = spark.read.schema(CONTEST).option("multiLine", multi_line).json(path)
    return raw.select("title", F.coalesce("detail_url", "source_url").alias("url"), F.coalesce("source", F.lit("unknown")).alias("source_name"))


#: Limits of a run where the configuration has none.
LIMITS = {"max_future_days": 400, "max_page_bytes": 2097152}
SOURCES = (
    "known_platforms array<struct<name string, domain string, base_url string, authority string>>, search_queries array<string>, "
    "exclusion_patterns array<string>, max_future_days int, max_page_bytes int"
)


@dataclass(frozen=True)
class SourceConfig:
    """platforms (name, domain, base_url, authority), the patterns of what is left out, and the limits of a run."""

    platforms: DataFrame
    exclusion_patterns: list[str]
    limits: dict[str, int]


def read_source_config(spark: SparkSession, path: str, multi_line: bool = True) -> SourceConfig:
    """The configuration of the sources, one JSON object. Missing limits have their defaults, a missing list is empty; of
    two platforms with one domain the first counts."""
    raw = spark.read.schema(SOURCES).option("multiLine", multi_line).json(path)
    each = raw.select(F.posexplode("known_platforms").alias("place", "p")).select("place", "p.*").withColumn("domain", F.lower("domain"))
    columns = ["name", "base_url", "authority"]
    platforms = each.filter("domain <> ''").groupBy("domain").agg(*[F.min_by(F.struct(c), "place")[c].alias(c) for c in columns])
    one = raw.select("exclusion_patterns", *LIMITS).first()  # one row by definition
    given = one.asDict() if one else {}
    return SourceConfig(platforms.select("name", "domain", "base_url", "authority"), given.get("exclusion_patterns") or [], {k: given.get(k) or v for k, v in LIMITS.items()})


def apply_source_config(pages: DataFrame, config: SourceConfig, url: str, title: str, html: str, otherwise: str = "low") -> DataFrame:
    """pages without those of more than the permitted bytes and those whose title has an excluded phrase (any case), with
    platform and platform_authority of the platform whose domain is the URL's host or a parent of it. A host's parents are
    equality keys, so that the join does not compare all pairs; of several the longest domain counts."""
    left_out = [F.lower(F.coalesce(F.col(title), F.lit(""))).contains(p.lower()) for p in config.exclusion_patterns if p]
    small = F.coalesce(F.octet_length(html), F.lit(0)) <= config.limits["max_page_bytes"]
    kept = pages.filter(small & ~reduce(lambda a, b: a | b, left_out, F.lit(False)))
    host = F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://([^/?#]*)", 1), r"^.*@|:\d*$", "")
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = kept.select(host.alias("_host"), parents.alias("_domain")).distinct().select("_host", F.explode("_domain").alias("_d"))
    known = config.platforms.select(F.col("domain").alias("_d"), F.col("name").alias("_name"), F.col("authority").alias("_authority"))
    best = found.join(known, "_d").groupBy("_host").agg(F.max_by(F.struct("_name", "_authority"), F.length("_d")).alias("_d"))
    both = kept.withColumn("_host", host).join(best, "_host", "left")
    return both.select(*pages.columns, F.col("_d._name").alias("platform"), F.coalesce("_d._authority", F.lit(otherwise)).alias("platform_authority"))


def read_pages(pages: DataFrame, max_bytes: int = 2 << 20, max_chars: int = 8192) -> DataFrame:
    """Landed pages of status 200 (where a status is known) and bounded size, their text cut."""
    ok = F.col("status") == 200 if "status" in pages.columns else F.lit(True)
    return pages.filter(ok & (F.octet_length("html") <= max_bytes)).withColumn("html", F.substring("html", 1, max_chars))


class TableStore:
    """Named Parquet tables below a path. A table is written to a folder of its own, and one small pointer row, appended
    last, makes it the current one: readers see the old table or the new one, and a failed write changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self, name: str) -> DataFrame:
        return self.spark.read.schema("version long, folder string").parquet(f"{self.path}/{name}/versions")

    def exists(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/versions")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self, name: str) -> DataFrame:
        folder = self._versions(name).orderBy(F.desc("version")).first().folder
        return self.spark.read.parquet(f"{self.path}/{name}/{folder}")

    def overwrite(self, name: str, df: DataFrame) -> None:
        folder = f"v-{uuid.uuid4().hex}"
        last = self._versions(name).agg(F.max("version")).first()[0] if self.exists(name) else 0
        df.write.parquet(f"{self.path}/{name}/{folder}")
        self.spark.createDataFrame([(last + 1, folder)], "version long, folder string").write.mode("append").parquet(f"{self.path}/{name}/versions")


def stream_raw_events(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Newly arrived records of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def write_report(decisions: DataFrame, totals: dict[str, int], path: str, source: str, reason: str, order: str, samples: int = 20) -> None:
    """A run's report as JSON, from the stored decision table: the given totals, the funnel of each source, every accepted
    row, and the first samples of them."""
    spark = decisions.sparkSession
    spark.createDataFrame([(k, int(v)) for k, v in sorted(totals.items())], "name string, n long").coalesce(1).write.json(f"{path}/totals")
    decisions.groupBy(source, reason).agg(F.count("*").alias("n")).write.json(f"{path}/funnel")
    accepted = decisions.filter(F.col(reason) == "accepted")
    accepted.write.json(f"{path}/accepted")
    accepted.orderBy(order).limit(samples).write.json(f"{path}/samples")


def export_ranked(df: DataFrame, path: str, columns: list[str]) -> None:
    """The given columns as CSV with a header, nulls empty."""
    export_columns(df, columns).write.option("header", True).csv(path)


def export_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def write_snapshot(df: DataFrame, path: str, run_date: Column) -> None:
    """The records as crawled, below the date of the run."""
    df.withColumn("run_date", run_date).write.mode("append").partitionBy("run_date").parquet(path)


def append_new(seed: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """seed and those incoming rows, one a key, whose key it lacks."""
    return seed.unionByName(incoming.dropDuplicates([key]).join(seed.select(key), key, "left_anti").select(*seed.columns))
