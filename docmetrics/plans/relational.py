"""Relational floor over the star schema: joins, aggregates, windows, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import recognize, retrieval, scoring
from .registry import big, query, r6


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS discount
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def qx01_pricing_summary(t, spark):
    li = t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(charge), 2).alias("charge"), r6(F.avg("l_discount")).alias("discount"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name""")
def qx02_local_supplier_volume(t, spark):
    r = t("region").where("r_name = 'ASIA'")
    n = t("nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    s = t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    j = t("lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer"), (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""")
def qx03_semi_join(t, spark):
    back = t("lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    return t("orders").join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1""")
def qx04_anti_join(t, spark):
    return t("customer").join(t("orders").where("o_orderpriority = '1-URGENT'").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) * 2 + grouping(l_linestatus) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def qx05_cube(t, spark):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), big(F.grouping_id()).alias("level"))


@query("""SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (o_orderstatus), ())""")
def qx06_grouping_sets(t, spark):
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    return t("orders").groupingSets([[p], [s], []], p, s).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey, o_orderkey, CAST(row_number() OVER w AS INT) AS rn, round(sum(o_totalprice) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running, round(avg(o_totalprice) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def qx07_windows(t, spark):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("moving"))


@query("""(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 0)""")
def qx08_set_operations(t, spark):
    both = t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()
    return both.subtract(t("nation").where("n_regionkey = 0").select("n_nationkey"))


@query("""SELECT p_brand, round(median(l_extendedprice), 2) AS median, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def qx09_exact_quantiles(t, spark):
    j = t("lineitem").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    s = scoring.with_median(j.groupBy("p_brand").agg(F.countDistinct("l_suppkey").alias("suppliers")), j, ["p_brand"], "l_extendedprice", "median")
    return s.select("p_brand", F.round("median", 2).alias("median"), "suppliers")


@query("""SELECT c_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM customer LEFT JOIN orders ON c_custkey = o_custkey) WHERE k = 1""")
def qx10_top_order_per_customer(t, spark):
    best = t("orders").groupBy("o_custkey").agg(F.max(F.struct("o_totalprice", (-F.col("o_orderkey")).alias("k"))).alias("b"))
    j = t("customer").join(best, F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.select("c_custkey", (-F.col("b.k")).alias("o_orderkey"), F.round("b.o_totalprice", 2).alias("price"))


@query()
def q81_recognize(t, spark):
    """Every document through the simulated recogniser, with how much it lost."""
    docs = t("documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    r = recognize.recognize(docs, recognize.SimulatedRecognizer).select("id", F.length("text").alias("read"), "error")
    return r.join(docs.select("id", F.length("text").alias("n")), "id").select("id", "n", "read", "error")


@query("""WITH s AS (SELECT vec_id, label, list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) AS n FROM embeddings) SELECT vec_id, label, round(sqrt(n), 6) AS norm FROM s""")
def q82_vector_norms(t, spark):
    return t("embeddings").select("vec_id", "label", r6(retrieval.norm2(F.col("embedding"))).alias("norm"))
