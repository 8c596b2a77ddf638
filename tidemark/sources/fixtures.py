"""Panel tables from the driver's star schema, and checked readers and writers."""

from __future__ import annotations

import csv
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.normalize import parse_number

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, columns: list[str], exact: bool = True) -> DataFrame:
    """All-text scan whose header must equal (exact) or contain the columns."""
    header = spark.read.option("header", True).csv(path).columns
    if header != columns if exact else not set(columns) <= set(header):
        raise ValueError(f"header {header} does not match {columns}")
    schema = StructType([StructField(c, StringType()) for c in header])
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path).select(*columns)


def read_snapshot_dates(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot dates of a manifest, whose items are objects or bare strings."""
    text = spark.read.text(path, wholetext=True)
    item = F.explode(F.from_json(F.get_json_object("value", "$.snapshots"), "array<string>")).alias("item")
    return text.select(item).select(F.to_date(F.coalesce(F.get_json_object("item", "$.snapshot_date"), F.col("item"))).alias("snapshot_date"))


#: A bar's numeric fields, and its fields in the order of files.
BAR_NUMBERS = ["open", "high", "low", "close", "preclose", "volume", "amount", "adjustflag", "turn", "tradestatus", "pctChg", "isST"]
BAR_COLUMNS = [
    "date", "code", "code_name", "industry_code", "industry_name", "open", "high", "low", "close", "preclose", "volume", "amount", "turn", "pctChg", "tradestatus", "isST", "adjustflag", "adjustment", "data_source",
]


def normalize_bars(parts: list[DataFrame], constituents: DataFrame, constants: dict[str, str]) -> DataFrame:
    """Raw bars of all codes with numbers (what is none becomes NULL), names and constants, by date and code.

    A code with two names is an error.
    """
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    names = constituents.select("code", "code_name").distinct()
    if not names.groupBy("code").count().filter("count > 1").isEmpty():
        raise ValueError("a code has several names")
    typed = every.withColumns({c: parse_number(F.col(c).cast("string"), commas=False) for c in BAR_NUMBERS})
    named = typed.join(names, "code", "left").withColumns({k: F.lit(v) for k, v in constants.items()})
    return named.select(*BAR_COLUMNS).orderBy("date", "code")


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """One CSV file with a byte order mark and a header; a column that is not among the fields is an error.

    For small results: the rows come to the driver one partition at a time.
    """
    if extra := set(rows.columns) - set(fields):
        raise ValueError(f"columns {sorted(extra)} are not among the fields")
    with open(path, "w", encoding="utf-8-sig", newline="") as target:
        writer = csv.DictWriter(target, fields, lineterminator="\n")
        writer.writeheader()
        writer.writerows(r.asDict() for r in rows.toLocalIterator())


def write_split(df: DataFrame, path: str) -> None:
    """One folder per split, rows in date order inside a file."""
    df.sortWithinPartitions("split", "date").write.mode("overwrite").partitionBy("split").parquet(path)


def report_json(tables: dict[str, DataFrame]) -> str:
    """Small result tables as one JSON text; NaN is refused."""
    return json.dumps({k: [r.asDict(True) for r in v.collect()] for k, v in tables.items()}, ensure_ascii=False, indent=2, allow_nan=False, default=str)


def number_text(value):
    """Numbers with 12 significant digits, as files carry them."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), F.format_string("%.12g", value))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (code, date): a code is a part brand, a date a ship date. One shuffle on (code, date), one on code."""
    lines = table(spark, sf_dir, "lineitem").select("l_shipdate", "l_discount", *LINE_ORDER)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("code"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    at = F.struct(*LINE_ORDER)
    daily = (
        lines.join(parts, "l_partkey")
        .groupBy("code", F.to_date("l_shipdate").alias("date"))
        .agg(
            F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
            F.sum("l_quantity").cast("double").alias("volume"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount"),
            F.when(F.max("l_discount") == 0, 0).otherwise(1).alias("tradestatus"),
        )
    )
    before = F.coalesce(F.lag("close").over(W.partitionBy("code").orderBy("date")), F.col("open"))
    return daily.withColumn("turn", F.col("volume") / 1000).withColumn("preclose", before * F.when(F.dayofmonth("date") == 15, 0.98).otherwise(1.0))


def brand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The name dimension, one row per code."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("code")).agg(F.max("p_name").alias("code_name"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly snapshots: a code is a member if the number of its lines in the month before is no multiple of 3."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("code"))
    month = F.add_months(F.trunc(F.to_date("l_shipdate"), "month"), 1)
    counted = lines.join(parts, "l_partkey").groupBy(month.alias("snapshot_date"), "code").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") % 3 != 0).select("snapshot_date", F.col("snapshot_date").alias("effective_date"), "code")
