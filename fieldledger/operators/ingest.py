"""Upserts, frontiers, guards and overrides of the ingest side."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

FAILURE_LIMIT = 0.25
# Fixed value: texts that mark a row as confirmed.
TRUE_WORDS = ["1", "y", "yes", "true", "t"]


def _keep(df: DataFrame, keys: list[str], chosen: Column) -> DataFrame:
    """One row per key. An aggregate, not a window: each task keeps one row per key,
    so a key with very many versions is reduced before the shuffle."""
    return df.groupBy(*keys).agg(chosen.alias("_r")).select(*keys, "_r.*")


def upsert_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return _keep(df, keys, F.max_by(F.struct(*rest), F.struct(*order)))


def upsert_prefer_populated(df: DataFrame, keys: list[str], attribute: str, seq: str) -> DataFrame:
    """First row per key, unless it lacks the attribute and a later one has it."""
    rest = [c for c in df.columns if c not in keys]
    return _keep(df, keys, F.min_by(F.struct(*rest), F.struct(F.col(attribute).isNull(), F.col(seq))))


def upsert_coalesce(dim: DataFrame, updates: DataFrame, key: str, new_wins: list[str] = (),
                    old_wins: list[str] = ()) -> DataFrame:
    tagged = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in [*new_wins, *old_wins]])
    out = dim.join(tagged, key, "left")
    for c in new_wins:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c))
    for c in old_wins:
        out = out.withColumn(c, F.coalesce(c, f"_new_{c}"))
    return out.select(*dim.columns)


def insert_or_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Target plus the rows whose key it lacks; rows must be unique by key."""
    return target.unionByName(rows.join(target.select(*keys), keys, "left_anti"))


def harvest_ids(pages: DataFrame, pattern: str, column: str = "html") -> DataFrame:
    ids = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))
    return pages.select(F.explode(F.array_distinct(ids)).alias("id")).select(F.col("id").try_cast("bigint").alias("id"))


def distinct_ids(pages: DataFrame, pattern: str) -> DataFrame:
    return harvest_ids(pages, pattern).dropDuplicates()


def discover_max_id(pages: DataFrame, pattern: str) -> DataFrame:
    return harvest_ids(pages, pattern).agg(F.max("id").alias("max_id"))


def crawl_frontier(top: DataFrame, cached: DataFrame, limit: int | None = None, block: int = 1 << 16) -> DataFrame:
    """Ids from 2 to the highest known one (``max_id``, one row) that are not cached. The ids
    are laid out in blocks first, so no list of them is longer than a block."""
    blocks = top.where(F.col("max_id") >= 2).select("max_id", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.floor(F.col("max_id") / block))).alias("b"))
    ids = blocks.select(F.explode(F.sequence(F.greatest(F.lit(2), F.col("b") * block),
                                             F.least("max_id", F.col("b") * block + block - 1))).alias("id"))
    out = ids.join(cached.select("id"), "id", "left_anti")
    return out if limit is None else out.orderBy("id").limit(limit)


def failure_rate(attempts: DataFrame, failed: Column) -> DataFrame:
    return attempts.agg(F.count("*").alias("attempted"), F.count_if(failed).alias("failed")) \
        .withColumn("rate", F.try_divide("failed", "attempted"))


def failure_rate_guard(attempts: DataFrame, failed: Column, limit: float = FAILURE_LIMIT) -> DataFrame:
    """The failure rate; the job stops when it is above the limit."""
    stop = F.assert_true(F.coalesce(F.col("rate") <= limit, F.lit(True)), F.lit("failure rate above the limit"))
    return failure_rate(attempts, failed).where(stop.isNull())


def progress_stats(attempts: DataFrame, kind: str, ok: Column, missing: Column, failed: Column) -> DataFrame:
    return attempts.groupBy(kind).agg(F.count_if(ok).alias("ok"), F.count_if(missing).alias("missing"),
                                      F.count_if(failed).alias("failed"))


def confirmed_overrides(rows: DataFrame) -> DataFrame:
    """Rows a person confirmed, with usable coordinates; texts in, doubles out."""
    yes = F.lower(F.trim(F.coalesce("confirmed", F.lit("")))).isin(TRUE_WORDS)
    return rows.where(yes).select(F.trim("unit").alias("unit"), F.col("lat").try_cast("double").alias("lat"),
                                  F.col("lon").try_cast("double").alias("lon")) \
        .where(F.col("lat").isNotNull() & F.col("lon").isNotNull())


def override_template(units: DataFrame, confirmed: DataFrame) -> DataFrame:
    """All units by volume; confirmed coordinates win over the current ones."""
    kept = confirmed.select("unit", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    done = F.col("_lat").isNotNull()
    return units.join(kept, "unit", "left").select(
        "unit", "town", F.coalesce("_lat", "lat").alias("lat"), F.coalesce("_lon", "lon").alias("lon"), "reports",
        F.col("geo_uncertain").cast("int").alias("uncertain"), F.when(done, "yes").otherwise("").alias("confirmed"),
        F.when(done, "hand-confirmed").otherwise("").alias("note")).orderBy(F.desc("reports"), "unit")


def alias_fold(df: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Variant names replaced by their canonical name; aliases: variant, canonical."""
    renamed = aliases.select(F.col("variant").alias(name), F.col("canonical").alias("_canonical"))
    return df.join(renamed, name, "left").withColumn(name, F.coalesce("_canonical", name)).drop("_canonical")


def norm_title(c: Column) -> Column:
    """Letters and digits only; NULL when none is left, so that such titles match nothing."""
    return F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(""))


def slug_dim(pairs: DataFrame) -> DataFrame:
    """Normalised name to its distinct slugs; a name may have several."""
    keyed = pairs.withColumn("key", norm_title(F.col("name"))).where(F.col("key").isNotNull())
    return keyed.groupBy("key").agg(F.array_sort(F.collect_set("slug")).alias("slugs"))


def payload(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, document): every result row as JSON, one table."""
    parts = [df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("document"))
             for name, df in sections.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def payload_sink(sections: dict[str, DataFrame], path: str) -> None:
    payload(sections).write.mode("overwrite").partitionBy("section").text(path)


def canonical_row(df: DataFrame) -> Column:
    """A row as JSON that any engine can write alike: names in order, nulls kept, doubles to six places
    without trailing zeros."""
    from pyspark.sql import types as T
    fields = [F.col(f.name).cast("decimal(18,6)").alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
              for f in sorted(df.schema.fields, key=lambda f: f.name)]
    return F.to_json(F.parse_json(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})))


def section_documents(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, document): the rows of a section under their key, an array of objects as a variant.

    Rows stand in the order of their text; equal rows stay. The keys are joined by a bar, no keys give one
    document and none for an empty section. A section's rows for one key must be bounded by what the section
    is, such as months, bands or labels of a unit.
    """
    key = F.concat_ws("|", *keys) if keys else F.lit("")
    rows = df.select(key.alias("key"), canonical_row(df).alias("row")).groupBy("key").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    return rows.select("key", F.parse_json(F.concat(F.lit("["), F.array_join("rows", ","), F.lit("]"))).alias("document"))


def publish(sections: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Writes each section's documents to its own folder, one after the other; a section written again
    replaces itself and leaves the others alone."""
    for name, (df, keys) in sections.items():
        section_documents(df, keys).write.mode("overwrite").parquet(f"{path}/section={name}")


def published(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, document) of what is published. Read with its schema, so that one section is pruned to its folder."""
    return spark.read.schema("key string, document variant, section string").parquet(path).select("section", "key", "document")


def sql_escape_hatch(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Any SQL over the named tables, with all its rows."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
