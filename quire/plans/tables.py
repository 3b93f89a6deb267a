"""Test tables as the frames that operators take, with the same definitions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label, key, name, props, source_text: orders as documents, customers, suppliers, parts and nations as entities."""
    kinds = [
        ("orders", "Document", "o", "o_orderkey", None), ("customer", "Person", "c", "c_custkey", "c_name"),
        ("supplier", "Organization", "s", "s_suppkey", "s_name"), ("part", "Technology", "p", "p_partkey", "p_name"),
        ("nation", "Location", "n", "n_nationkey", "n_name")
    ]
    out = None
    for name, label, prefix, key, shown in kinds:
        n = F.col(shown) if shown else F.lit(None).cast("string")
        number = F.col(key).cast("long")
        # Every seventh entity lacks its name property, every eleventh its title or provenance.
        prop = F.when(number % 7 != 0, F.coalesce(n, F.lit("untitled")))
        df = table(spark, sf_dir, name).select(
            F.lit(label).alias("label"), _key(prefix, key).alias("key"), n.alias("name"), number.alias("num"),
            F.when(
                F.lit(label == "Document"), F.create_map(F.lit("doc_id"), _key(prefix, key), F.lit("title"), prop)
            ).otherwise(F.create_map(F.lit("name"), prop)).alias("props"),
            F.when(number % 11 != 0, F.when(number % 5 == 0, F.lit("")).otherwise(F.lit("row"))).alias("source_text"),
        )
        out = df if out is None else out.unionByName(df)
    return out


NODES_SQL = """nodes AS (
  SELECT *, CASE WHEN num % 7 <> 0 THEN coalesce(name, 'untitled') END AS prop, CASE WHEN num % 11 <> 0 THEN CASE
  WHEN num % 5 = 0 THEN '' ELSE 'row' END END AS source_text FROM (
    SELECT 'Document' AS label, 'o' || o_orderkey AS key, CAST(NULL AS VARCHAR) AS name, CAST(o_orderkey AS BIGINT) AS num FROM orders
    UNION ALL SELECT 'Person', 'c' || c_custkey, c_name, c_custkey FROM customer
    UNION ALL SELECT 'Organization', 's' || s_suppkey, s_name, s_suppkey FROM supplier
    UNION ALL SELECT 'Technology', 'p' || p_partkey, p_name, p_partkey FROM part
    UNION ALL SELECT 'Location', 'n' || n_nationkey, n_name, n_nationkey FROM nation))"""


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges before merging, with a weight and a total order (seq)."""
    def edge(df, src, src_key, rel, dst, dst_key, seq, weight):
        return df.select(
            F.lit(src).alias("src_label"), src_key.alias("src_key"), F.lit(rel).alias("rel_type"), F.lit(dst).alias("dst_label"),
            dst_key.alias("dst_key"), seq.cast("long").alias("seq"), weight.cast("double").alias("weight")
        )

    orders, items, suppliers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_quantity").cast("int")
    parts = [
        edge(orders, "Document", _key("o", "o_orderkey"), "MENTIONS_PERSON", "Person", _key("c", "o_custkey"), F.col("o_orderkey") * 10, F.col("o_totalprice")),
        edge(
            items, "Document", _key("o", "l_orderkey"), "MENTIONS_ORG", "Organization", _key("s", "l_suppkey"), seq,
            F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity"))
        ),
        edge(
            items, "Document", _key("o", "l_orderkey"), "MENTIONS_TECH", "Technology", _key("p", "l_partkey"), seq,
            F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity"))
        ),
        edge(suppliers, "Organization", _key("s", "s_suppkey"), "LOCATED_AT", "Location", _key("n", "s_nationkey"), F.col("s_suppkey") * 10, F.lit(1.0)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RAW_EDGES_SQL = """raw_edges AS (
  SELECT 'Document' AS src_label, 'o' || o_orderkey AS src_key, 'MENTIONS_PERSON' AS rel_type, 'Person' AS dst_label,
  'c' || o_custkey AS dst_key, o_orderkey * 10 AS seq, CAST(o_totalprice AS DOUBLE) AS weight FROM orders
  UNION ALL SELECT 'Document', 'o' || l_orderkey, 'MENTIONS_ORG', 'Organization', 's' || l_suppkey,
  (l_orderkey * 10 + l_linenumber) * 1000 + CAST(l_quantity AS INTEGER), CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END FROM lineitem
  UNION ALL SELECT 'Document', 'o' || l_orderkey, 'MENTIONS_TECH', 'Technology', 'p' || l_partkey,
  (l_orderkey * 10 + l_linenumber) * 1000 + CAST(l_quantity AS INTEGER), CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END FROM lineitem
  UNION ALL SELECT 'Organization', 's' || s_suppkey, 'LOCATED_AT', 'Location', 'n' || s_nationkey, s_suppkey * 10, 1.0 FROM supplier)"""
EDGES_SQL = RAW_EDGES_SQL + """, edges AS (SELECT DISTINCT src_label, src_key, rel_type, dst_label, dst_key FROM raw_edges)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_edges(spark, sf_dir).drop("seq", "weight").distinct()


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.lit("Organization").alias("label"), _key("s", "s_suppkey").alias("key"))


SEEDS_SQL = "seeds AS (SELECT 'Organization' AS label, 's' || s_suppkey AS key FROM supplier)"


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers under the names of their nations in differing spellings, for canonicalisation."""
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows
    spelled = lambda k: F.when(F.col(k) % 3 == 0, F.upper("n_name")).when(
        F.col(k) % 3 == 1, F.concat(F.lower("n_name"), F.lit("."))
    ).otherwise(F.concat(F.lit(" "), F.col("n_name")))
    parts = [
        table(spark, sf_dir, t).join(nation, F.col(f"{p}_nationkey") == F.col("n_nationkey")).select(
            F.lit(label).alias("label"), _key(p, k).alias("key"),
            F.concat(spelled(k), F.lit(" "), (F.col(k) % 40).cast("string")).alias("name")
        ) for t,
        p, k, label in (("customer", "c", "c_custkey", "Person"), ("supplier", "s", "s_suppkey", "Organization"))
    ]
    return parts[0].unionByName(parts[1])


VARIANTS_SQL = """variants AS (
  SELECT label, key, CASE WHEN k % 3 = 0 THEN upper(n_name) WHEN k % 3 = 1 THEN lower(n_name) || '.' ELSE ' ' || n_name END || ' ' || (k % 40) AS name FROM (
    SELECT 'Person' AS label, 'c' || c_custkey AS key, c_custkey AS k, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT 'Organization', 's' || s_suppkey, s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey))"""
