"""Files the archive keeps next to its tables."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ingest import confirmed_overrides, override_template
from ..operators.taxonomy import Taxonomy

PAGE_SCHEMA = ("url string, kind string, ref string, http_status int, is_missing boolean,"
               " fetched_at timestamp, html string")
OVERRIDE_SCHEMA = ("unit string, town string, lat string, lon string, reports string, uncertain string,"
                   " confirmed string, note string")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page store: parquet partitioned by kind."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def write_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    pages.write.mode(mode).option("compression", "zstd").partitionBy("kind").parquet(path)


def load_overrides(spark: SparkSession, path: str) -> DataFrame:
    return confirmed_overrides(spark.read.csv(path, header=True, schema=OVERRIDE_SCHEMA))


def write_override_template(units: DataFrame, confirmed: DataFrame, path: str) -> None:
    override_template(units, confirmed).write.mode("overwrite").csv(path, header=True)


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """{"aliases": {variant: canonical}} to rows."""
    doc = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "aliases map<string,string>")["aliases"]
    return doc.select(F.explode(parsed).alias("variant", "canonical"))


def load_slugs(spark: SparkSession, path: str) -> DataFrame:
    """{slug: name} to rows."""
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.explode(F.from_json("value", "map<string,string>")).alias("slug", "name"))


def load_candidates(spark: SparkSession, path: str) -> DataFrame:
    """{town: [{county, state, lat, lon, population}]} to rows."""
    doc = spark.read.text(path, wholetext=True)
    place = "array<struct<county:string,state:string,lat:double,lon:double,population:bigint>>"
    towns = doc.select(F.explode(F.from_json("value", f"map<string,{place}>")).alias("town", "places"))
    return towns.select("town", F.inline("places"))


def load_taxonomy(spark: SparkSession, path: str) -> Taxonomy:
    """Taxonomy file: JSON, or YAML where a YAML reader is installed. One small file, read
    through Spark so that it may lie in any store."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as exc:
            raise RuntimeError("reading YAML needs the yaml package; convert the file to JSON") from exc
        return Taxonomy.from_entries(yaml.safe_load(text))
    return Taxonomy.from_entries(json.loads(text))
