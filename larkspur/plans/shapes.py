"""The reference shapes (graph, chunks, calls, prices, messages) over the tables at hand, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.shared import table


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and suppliers. Small parts have no description, the largest no type."""
    part, supplier = t(spark, sf, "part"), t(spark, sf, "supplier")
    p = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") <= 45, F.col("p_type")).alias("type"), F.when(F.col("p_size") > 5, F.col("p_brand")).otherwise("").alias("description"), F.col("p_partkey").cast("long").alias("pos"))
    s = supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("SUPPLIER").alias("type"), F.col("s_name").alias("description"), (F.col("s_suppkey") + 1_000_000_000_000).cast("long").alias("pos"))
    return p.unionByName(s)


def people(spark: SparkSession, sf: str) -> DataFrame:
    """All vertices: parts, suppliers and customers, whom no delivery connects. Those in debt have no description, those of little money no type."""
    c = t(spark, sf, "customer")
    money = F.col("c_acctbal")
    rows = c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.when(money >= 2000, "CUSTOMER").alias("type"), F.when(money >= 0, F.col("c_mktsegment")).otherwise(" ").alias("description"), (F.col("c_custkey") + 2_000_000_000_000).cast("long").alias("pos"))
    return vertices(spark, sf).unionByName(rows)


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Lines from part to supplier (odd ones) or from supplier to part (even ones)."""
    rows = t(spark, sf, "lineitem")
    p, s = (F.concat(F.lit(k), F.col(c).cast("string")) for k, c in (("p", "l_partkey"), ("s", "l_suppkey")))
    odd = F.col("l_linenumber") % 2 == 1
    return rows.select(F.when(odd, p).otherwise(s).alias("src"), F.when(odd, s).otherwise(p).alias("dst"), "l_quantity", "l_orderkey", "l_returnflag")


def all_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Deliveries, an edge a pair of ends."""
    ends = deliveries(spark, sf)
    return ends.groupBy("src", "dst").agg(F.sum("l_quantity").cast("double").alias("weight"), F.min("l_orderkey").cast("long").alias("pos"), F.min("l_returnflag").alias("keywords"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as chunks of text."""
    o = t(spark, sf, "orders")
    return o.select(F.col("o_orderkey").cast("string").alias("chunk_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus", F.col("o_custkey").cast("string")).alias("content"))


def sourced(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers with the orders that they come from, as one string."""
    rows = t(spark, sf, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    keys = F.array_join(F.transform(F.array_sort(F.collect_list("l_orderkey")), lambda x: x.cast("string")), "<SEP>")
    return rows.groupBy("l_suppkey").agg(keys.alias("source_id")).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("id"), "source_id")


def starts(spark: SparkSession, sf: str) -> DataFrame:
    """The suppliers of one nation."""
    return t(spark, sf, "supplier").where("s_nationkey = 7").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as model calls: phase, tokens, seconds; refunds and errors failed."""
    e = t(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", "user_id", F.col("event_type").alias("phase"), "ts", F.col("value").alias("sec"), k.alias("tokens_in"), (k * 2).alias("tokens_out"), (k + 5).alias("tokens_emb"), F.when(F.col("event_type") == "error", "failed").alias("error"))


def prices(spark: SparkSession, sf: str) -> DataFrame:
    """A daily price series of each order priority."""
    o = t(spark, sf, "orders")
    rows = o.groupBy(F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return rows.agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").alias("volume"))


V = """V AS (
  SELECT 'p' || p_partkey AS id, p_name AS name, CASE WHEN p_size <= 45 THEN p_type END AS type, CASE WHEN p_size > 5 THEN p_brand ELSE '' END AS description, p_partkey::BIGINT AS pos FROM part
  UNION ALL SELECT 's' || s_suppkey, s_name, 'SUPPLIER', s_name, s_suppkey + 1000000000000 FROM supplier
)"""
_CUSTOMERS = """, VC AS (
  SELECT * FROM V UNION ALL SELECT 'c' || c_custkey, c_name, CASE WHEN c_acctbal >= 2000 THEN 'CUSTOMER' END, CASE WHEN c_acctbal >= 0 THEN c_mktsegment ELSE ' ' END, c_custkey + 2000000000000 FROM customer
)"""
#: Parts, suppliers and customers.
VC = V + _CUSTOMERS
EA = """E AS (
  SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS src, CASE WHEN l_linenumber % 2 = 1 THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS dst,
    sum(l_quantity)::DOUBLE AS weight, min(l_orderkey)::BIGINT AS pos, min(l_returnflag) AS keywords
  FROM lineitem GROUP BY 1, 2
)"""
S = "S AS (SELECT src, dst FROM E UNION ALL SELECT dst, src FROM E)"
DC = "D AS (SELECT VC.*, coalesce(n, 0)::BIGINT AS degree FROM VC LEFT JOIN (SELECT src, count(*) AS n FROM S GROUP BY src) ON src = id)"
D = "D AS (SELECT V.*, coalesce(n, 0)::BIGINT AS degree FROM V LEFT JOIN (SELECT src, count(*) AS n FROM S GROUP BY src) ON src = id)"
START = "B AS (SELECT 's' || s_suppkey AS id FROM supplier WHERE s_nationkey = 7)"
CHUNKS = "C AS (SELECT o_orderkey::VARCHAR AS chunk_id, o_orderpriority || ' ' || o_orderstatus || ' ' || o_custkey AS content FROM orders)"
SOURCED = "X AS (SELECT 's' || l_suppkey AS id, string_agg(l_orderkey::VARCHAR, '<SEP>' ORDER BY l_orderkey) AS source_id FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem) GROUP BY l_suppkey)"
CALLS = """L AS (
  SELECT event_id, user_id, event_type AS phase, ts, value AS sec, json_extract_string(props, '$.k')::BIGINT AS tokens_in, json_extract_string(props, '$.k')::BIGINT * 2 AS tokens_out,
    json_extract_string(props, '$.k')::BIGINT + 5 AS tokens_emb, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events
)"""
PRICES = """P AS (
  SELECT o_orderpriority AS ticker, o_orderdate::TIMESTAMP AS ts, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders GROUP BY 1, 2
)"""


def given(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}\n"
