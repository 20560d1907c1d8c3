"""The bound tables: observations, units, labels, tags, catches and daily series,
all derived from the parquet tables of one folder."""
from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import calendar_parts
from ..operators.effort import calibrate_effort, restate_rates
from ..operators.series import conditions_columns
from ..sources.tables import settle

_facts: ContextVar[dict[tuple[str, str], DataFrame] | None] = ContextVar("facts", default=None)


@contextmanager
def shared_facts() -> Iterator[None]:
    """Inside it, the facts that several steps read are settled at their first use and read back by the others."""
    token = _facts.set({} if _facts.get() is None else _facts.get())
    try:
        yield
    finally:
        _facts.reset(token)


def once(name: str, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The named fact of a folder: made anew by each caller, or once where facts are shared."""
    facts = _facts.get()
    if facts is None:
        return make()
    if (name, sf_dir) not in facts:
        facts[name, sf_dir] = settle(make())
    return facts[name, sf_dir]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_observations(spark, sf_dir) -> DataFrame:
    """One row per order, before effort hours are known."""
    lines = (table(spark, sf_dir, "lineitem").groupBy("l_orderkey")
             .agg(F.sum("l_quantity").alias("qty"), F.max("l_extendedprice").alias("price"),
                  F.max("l_tax").alias("tax"), F.max("l_linenumber").alias("line_no")))
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = (orders.join(customer, orders.o_custkey == customer.c_custkey)
              .join(nation, F.col("c_nationkey") == nation.n_nationkey)
              .join(lines, orders.o_orderkey == lines.l_orderkey, "left"))
    priority = F.col("o_orderpriority")
    picked = joined.select(
        F.col("o_orderkey").alias("obs_id"),
        F.col("n_nationkey").cast("long").alias("unit_id"), F.col("n_name").alias("unit"),
        F.to_date("o_orderdate").alias("obs_date"),
        F.when(priority == "1-URGENT", "AM").when(priority == "2-HIGH", "PM")
         .when(priority == "3-MEDIUM", "ALL_DAY").alias("slot"),
        F.when(F.col("o_orderstatus") == "P", "posted_estimate")
         .otherwise("reservation").alias("date_source"),
        F.col("qty").alias("count_total"), (F.col("price") / 10000.0).alias("max_weight"),
        F.when(F.col("tax") > 0, F.col("tax") * 50.0).alias("clarity_ft"),
        F.when(F.col("line_no") >= 4, 40.0 + F.col("qty") % 50).alias("water_temp_f"),
        (F.col("line_no") * 3.0).alias("depth_max_ft"))
    return calendar_parts(picked, "obs_date")


def observations(spark, sf_dir) -> DataFrame:
    """The fact table with measured effort hours and rates."""
    def make() -> DataFrame:
        raw = raw_observations(spark, sf_dir)
        return restate_rates(raw, calibrate_effort(raw))
    return once("observations", sf_dir, make)


def scored(spark, sf_dir) -> DataFrame:
    return observations(spark, sf_dir).where(F.col("rate").isNotNull())


def units(spark, sf_dir) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        k.cast("long").alias("unit_id"), F.col("n_name").alias("unit"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("Town_"), (k % 9).cast("string")).alias("town"),
        F.when(k % 12 != 11, (5 + (k * 7) % 50).cast("double")).alias("acres"),
        (60 + (k * 13) % 90).cast("double").alias("day_rate"),
        (8 + k % 20).cast("double").alias("max_depth_ft"),
        (25.8 + ((k * 37) % 113) / 10.0).alias("lat"),
        (-103.1 + ((k * 53) % 96) / 10.0).alias("lon"),
        (k % 5 == 3).alias("geo_uncertain"))


def labels(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("obs_id"), F.col("p_brand").alias("category"),
        F.when(F.col("p_type") == "STANDARD", "unspecified").otherwise(F.col("p_type")).alias("subtype"),
        F.col("l_returnflag").alias("color"),
        F.when(F.col("l_linestatus") == "O", "field").otherwise("narrative").alias("source"))


def tags(spark, sf_dir) -> DataFrame:
    flag, line_no = F.col("l_returnflag"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("obs_id"),
        F.when(flag == "A", "vegetation").when(flag == "N", "structure")
         .otherwise("technique").alias("kind"),
        F.concat(F.lit("v"), (F.col("l_suppkey") % 7).cast("string")).alias("value"),
        F.when((flag == "A") & (F.col("l_linestatus") == "F"),
               F.when(line_no <= 2, "heavy").when(line_no <= 4, "moderate")
                .otherwise("light")).alias("detail"))


def catches(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.col("l_orderkey").alias("obs_id"),
        F.when(size <= 10, "unspecified").when(size <= 30, "largemouth")
         .when(size <= 40, "crappie").otherwise("catfish").alias("species"),
        F.col("l_quantity").cast("long").alias("n"))


def series(spark, sf_dir) -> DataFrame:
    """One row per unit and calendar day: the daily measurements."""
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    q = F.col("q")
    return (line.join(supplier, line.l_suppkey == supplier.s_suppkey)
            .groupBy("s_nationkey", F.to_date("l_shipdate").alias("obs_date"))
            .agg(F.sum("l_quantity").alias("q"))
            .select(F.col("s_nationkey").cast("long").alias("unit_id"), "obs_date",
                    (40.0 + q % 60).alias("temp_max_f"), (30.0 + q % 60).alias("temp_mean_f"),
                    (20.0 + q % 60).alias("temp_min_f"), ((q % 5) / 10.0).alias("precip_in"),
                    (3.0 + q % 17).alias("wind_max_mph"), ((q * 11) % 360).alias("wind_dir_deg"),
                    ((q * 7) % 101).alias("cloud_pct"),
                    (1000.0 + ((q * 3) % 40) / 2.0).alias("pressure_hpa")))


def conditions(spark, sf_dir) -> DataFrame:
    return conditions_columns(series(spark, sf_dir), cell=["unit_id"], day="obs_date")


def frame(spark, sf_dir) -> DataFrame:
    """Fact table joined to units and same-day conditions, with its four bands."""
    from ..operators.frames import trips_frame
    return trips_frame(observations(spark, sf_dir), units(spark, sf_dir),
                       conditions(spark, sf_dir))
