"""Analysis inputs built from the driver tables (the fixtures of FIXTURES.md §3).

Each builder has a Spark form (``(spark, sf_dir) -> DataFrame``) and the same
derivation as a SQL common table expression, so registered queries and their
oracle SQL read exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
REG_X = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_returnflag"]
BIN_X = ["l_quantity", "l_extendedprice", "l_discount"]
# fixed splits for the binning-table checks (bins (-inf,s1), [s1,s2), ..., [sk,inf))
REG_SPLITS = {"l_quantity": [13.0, 26.0, 38.0], "l_discount": [0.02, 0.05, 0.08], "l_tax": [0.02, 0.04, 0.06]}
BIN_SPLITS = {"l_quantity": [13.0, 26.0, 38.0], "l_extendedprice": [10000.0, 30000.0, 50000.0],
              "l_discount": [0.02, 0.05, 0.08]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nulls_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with nulls planted on o_totalprice (key % 7 = 0) and o_orderpriority (key % 11 = 0)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast(T.DoubleType()))
         .otherwise(F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None).cast(T.StringType()))
         .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))


NULLS_ORDERS_SQL = """nulls_orders AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         o_orderdate,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)"""


def bin_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with y = 1 when the item was returned ('R'), else 0."""
    li = table(spark, sf_dir, "lineitem")
    return li.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))


BIN_LINEITEM_SQL = """bin_lineitem AS (
  SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem)"""


def bin_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents left join labels; quality is null for unlabelled documents."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left")


BIN_DOCUMENTS_SQL = """bin_documents AS (
  SELECT d.*, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def bool_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_returnflag") == "R").alias("is_returned"),
                     (F.col("l_discount") > 0.05).alias("big_discount"))


BOOL_LINEITEM_SQL = """bool_lineitem AS (
  SELECT l_returnflag = 'R' AS is_returned, l_discount > 0.05 AS big_discount FROM lineitem)"""


#: y is made of the first two of these, the first more; the others are noise
PLANTED_X = ["l_quantity", "l_discount", "l_tax", "l_suppkey"]


def planted_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with y = quantity / 50 + 5 x discount + a tenth of a hash of the row's keys."""
    li = table(spark, sf_dir, "lineitem")
    noise = F.crc32(F.concat_ws(":", "l_orderkey", "l_linenumber")) / F.lit(float(1 << 32))
    return li.withColumn("y", F.col("l_quantity") / 50.0 + 5.0 * F.col("l_discount") + 0.1 * noise)


#: columns of :func:`date_strings`: order dates as ISO with a fraction, with Z, with an offset, with month names, and a mixture
DATE_STRINGS = ["iso_micro", "iso_z", "iso_offset", "named", "long_name", "mixture"]


def date_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders' dates written as text in several shapes; every second date of ``mixture`` is of another shape."""
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    stamp = F.concat(day.cast("string"), F.lit("T00:00:"), F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0"))
    micro = F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0")
    return o.select(F.concat(stamp, F.lit("."), micro).alias("iso_micro"), F.concat(stamp, F.lit("Z")).alias("iso_z"),
                    F.concat(stamp, F.lit("+02:00")).alias("iso_offset"), F.date_format(day, "d MMM yyyy").alias("named"),
                    F.date_format(day, "MMMM d, yyyy").alias("long_name"),
                    F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "d MMM yyyy")).otherwise(day.cast("string")).alias("mixture"))


DATE_STRINGS_SQL = """date_strings AS (
  SELECT stamp || '.' || micro AS iso_micro, stamp || 'Z' AS iso_z, stamp || '+02:00' AS iso_offset,
    strftime(day, '%-d %b %Y') AS named, strftime(day, '%B %-d, %Y') AS long_name,
    CASE WHEN o_orderkey % 2 = 0 THEN strftime(day, '%-d %b %Y') ELSE CAST(day AS VARCHAR) END AS mixture
  FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day,
          CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T00:00:' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS stamp,
          lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS micro FROM orders))"""
