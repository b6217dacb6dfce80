"""Views of the driver's tables as the engine's data models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.graph import BFO, CCO, IOF, LABEL, OWL, SUB, TYPE

#: Small literal graph with a diamond, a cycle and an isolated class, beside the tables' tree.
EXTRA_EDGES = (("x:d", "x:b"), ("x:d", "x:c"), ("x:b", "x:a"), ("x:c", "x:a"), ("y:1", "y:2"), ("y:2", "y:1"), ("y:3", "y:1"))
ISOLATED = ("z:alone",)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("genre"), "source")


def hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers under nations under regions, and the literal edges."""
    c = table(spark, sf, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("s"), F.concat(F.lit("nation:"), "c_nationkey").alias("o"))
    s = table(spark, sf, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("s"), F.concat(F.lit("nation:"), "s_nationkey").alias("o"))
    n = table(spark, sf, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("s"), F.concat(F.lit("region:"), "n_regionkey").alias("o"))
    return c.union(s).union(n).union(spark.createDataFrame(list(EXTRA_EDGES), "s string, o string"))


HIERARCHY_SQL = (
    "SELECT 'customer:' || c_custkey AS s, 'nation:' || c_nationkey AS o FROM customer UNION ALL "
    "SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier UNION ALL "
    "SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation UNION ALL "
    "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in EXTRA_EDGES) + ") v(s, o)"
)


def ontology(spark: SparkSession, sf: str) -> DataFrame:
    """Triples of the hierarchy: declared classes, labels, subclass axioms and a few properties."""
    e = hierarchy(spark, sf)
    t = lambda s, p, o, kind="iri": (s.alias("s"), F.lit("iri").alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    sub = e.select(*t(F.col("s"), SUB, F.col("o")))
    alone = spark.createDataFrame([(x,) for x in ISOLATED], "s string")
    cls = e.select("s").union(e.select("o")).union(alone).distinct()
    typed = cls.select(*t(F.col("s"), TYPE, F.lit(OWL + "Class")))
    n = table(spark, sf, "nation").select(*t(F.concat(F.lit("nation:"), "n_nationkey"), LABEL, F.col("n_name"), "literal"))
    r = table(spark, sf, "region").select(*t(F.concat(F.lit("region:"), "r_regionkey"), LABEL, F.col("r_name"), "literal"))
    props = spark.createDataFrame([("p:supplies", "ObjectProperty"), ("p:orders", "ObjectProperty"), ("p:price", "DatatypeProperty")], "s string, k string")
    return sub.union(typed).union(n).union(r).union(props.select(*t(F.col("s"), TYPE, F.concat(F.lit(OWL), "k"))))


def supplies(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and suppliers of a ship day, of all lines, as assertions."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return table(spark, sf, "lineitem").select(F.concat_ws(":", F.lit("part"), day, "l_partkey").alias("s"), F.concat_ws(":", F.lit("supplier"), day, "l_suppkey").alias("o"))


SUPPLIES_SQL = "SELECT 'part:' || l_shipdate::DATE || ':' || l_partkey AS s, 'supplier:' || l_shipdate::DATE || ':' || l_suppkey AS o FROM lineitem"


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(terms, labels): vectors from id 50 on, and those before."""
    e = table(spark, sf, "embeddings")
    return e.where("vec_id >= 50").select(F.col("vec_id").alias("term"), F.col("embedding").alias("v"), F.col("label").alias("genre")), e.where("vec_id < 50").select(F.col("vec_id").alias("label"), F.col("embedding").alias("w"))


#: Namespaces for regions, so that all categories of the alignment cascade appear.
REGION_NAMESPACE = ((0, CCO + "r0"), (1, IOF + "r1"), (2, BFO + "0000002"), (3, BFO + "0000144"), (4, "urn:other#r4"))
