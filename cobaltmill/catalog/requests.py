"""Analysis requests with trends, ranks, subtotals, pivots and exact quantiles over the sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cobaltmill.catalog.charting import SALES_SQL
from cobaltmill.catalog.registry import register
from cobaltmill.plans.analysis import run_spec
from cobaltmill.session import table

_TABLES = ("lineitem", "orders", "customer", "nation", "region")
_SALES = {
    "source": "lineitem",
    "joins": [{"table": "orders", "on": [["l_orderkey", "o_orderkey"]]},
              {"table": "customer", "on": [["o_custkey", "c_custkey"]]},
              {"table": "nation", "on": [["c_nationkey", "n_nationkey"]]},
              {"table": "region", "on": [["n_regionkey", "r_regionkey"]]}],
    "derive": {"revenue": "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))",
               "month": "date_format(o_orderdate, 'yyyy-MM')", "segment": "nullif(c_mktsegment, 'BUILDING')"},
}


def _sales(spark, sf, **spec):
    return run_spec({n: table(spark, sf, n) for n in _TABLES}, {**_SALES, **spec})


@register("analysis_trend", SALES_SQL + """,
m AS (SELECT r_name, strftime(o_orderdate, '%Y-%m') AS month, sum(revenue) AS total FROM sales GROUP BY ALL),
t AS (
  SELECT r_name, month, CAST(total AS DOUBLE) AS total,
    CAST(sum(total) OVER w AS DOUBLE) AS so_far,
    round(avg(CAST(total AS DOUBLE)) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smooth,
    CAST(total - lag(total) OVER w AS DOUBLE) AS moved,
    round(100 * CAST(total - lag(total) OVER w AS DOUBLE) / CAST(lag(total) OVER w AS DOUBLE), 6) AS moved_pct,
    round(CAST(total AS DOUBLE) / CAST(sum(total) OVER (PARTITION BY r_name) AS DOUBLE), 9) AS part,
    rank() OVER (PARTITION BY r_name ORDER BY total DESC) AS place
  FROM m WINDOW w AS (PARTITION BY r_name ORDER BY month))
SELECT * FROM t
""")
def analysis_trend(spark, sf):
    """Monthly revenue of each region: running sum, mean of three months, change, share and rank."""
    months = [{"column": "month"}]
    done = _sales(
        spark, sf, group_by=["r_name", "month"], metrics=[{"column": "revenue", "agg": "sum", "name": "total"}],
        trends=[{"kind": kind, "name": name, "column": "total", "by": ["r_name"], "order_by": months, **more}
                for kind, name, more in (("running_sum", "so_far", {}), ("moving_mean", "smooth", {"n": 3}),
                                         ("change", "moved", {}), ("change_pct", "moved_pct", {}), ("share", "part", {}))]
        + [{"kind": "rank", "name": "place", "by": ["r_name"], "order_by": [{"column": "total", "descending": True}]}])
    return done.select(
        "r_name", "month", *[F.col(c).cast("double").alias(c) for c in ("total", "so_far", "moved")],
        F.round(F.col("smooth").cast("double"), 6).alias("smooth"), F.round("moved_pct", 6).alias("moved_pct"),
        F.round("part", 9).alias("part"), "place")


@register("analysis_rank", """
SELECT o_orderkey, rank() OVER w AS place, dense_rank() OVER w AS step,
       row_number() OVER (ORDER BY o_orderdate DESC, o_orderpriority, o_custkey, o_orderkey) AS n,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (
         ORDER BY o_orderdate DESC, o_orderpriority, o_custkey, o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS so_far
FROM orders WINDOW w AS (ORDER BY o_orderdate DESC, o_orderpriority)
""")
def analysis_rank(spark, sf):
    """All orders in one ranking, with ties, without a window over the whole table."""
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    ties = [{"column": "o_orderdate", "descending": True}, {"column": "o_orderpriority"}]
    unique = [*ties, {"column": "o_custkey"}, {"column": "o_orderkey"}]
    done = run_spec(orders, {
        "derive": {"price": "CAST(o_totalprice AS DECIMAL(18,2))"},
        "trends": [{"kind": "rank", "name": "place", "order_by": ties}, {"kind": "dense_rank", "name": "step", "order_by": ties},
                   {"kind": "row_number", "name": "n", "order_by": unique},
                   {"kind": "running_sum", "name": "so_far", "column": "price", "order_by": unique}]})
    return done.select("o_orderkey", "place", "step", "n", F.col("so_far").cast("double").alias("so_far"))


def _levels_sql(sets: str) -> str:
    sales = SALES_SQL.replace("SELECT o.*,", "SELECT o.*, l_quantity, nullif(c_mktsegment, 'BUILDING') AS segment,")
    return sales + f"""
SELECT r_name, segment, CAST(grouping(r_name, segment) AS INTEGER) AS level, count(*) AS n,
       CAST(sum(revenue) AS DOUBLE) AS total, round(CAST(sum(revenue) AS DOUBLE) / count(*), 4) AS mean,
       max(l_quantity) AS most
FROM sales GROUP BY {sets} (r_name, segment)
"""


def _levels(spark, sf, sets):
    done = _sales(spark, sf, group_by=["r_name", "segment"], subtotals=sets, metrics=[
        {"agg": "count", "name": "n"}, {"column": "revenue", "agg": "sum", "name": "total"},
        {"column": "revenue", "agg": "mean", "name": "mean"}, {"column": "l_quantity", "agg": "max", "name": "most"}])
    total = F.col("total").cast("double")
    return done.withColumns({"mean": F.round(total / F.col("n"), 4), "total": total})


@register("analysis_rollup", _levels_sql("ROLLUP"))
def analysis_rollup(spark, sf):
    """Revenue by region and segment with subtotals; some segments are null in the data."""
    return _levels(spark, sf, "rollup")


@register("analysis_cube", _levels_sql("CUBE"))
def analysis_cube(spark, sf):
    return _levels(spark, sf, "cube")


@register("analysis_pivot", """
SELECT o_orderpriority, sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F')::DOUBLE AS F,
       sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'O')::DOUBLE AS O,
       sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'P')::DOUBLE AS P
FROM orders GROUP BY o_orderpriority
""")
def analysis_pivot(spark, sf):
    done = run_spec(table(spark, sf, "orders"), {
        "derive": {"price": "CAST(o_totalprice AS DECIMAL(18,2))"}, "group_by": ["o_orderpriority"],
        "pivot": {"column": "o_orderstatus", "values": ["F", "O", "P"]},
        "metrics": [{"column": "price", "agg": "sum", "name": "total"}]})
    return done.select("o_orderpriority", *[F.col(c).cast("double").alias(c) for c in "FOP"])


@register("analysis_quantiles", """
SELECT l_returnflag, count(*) AS n, median(l_extendedprice) AS middle, quantile_cont(l_extendedprice, 0.9) AS high,
       quantile_cont(l_extendedprice, 0.001) AS low, median(l_quantity) AS middle_quantity
FROM lineitem GROUP BY l_returnflag
""")
def analysis_quantiles(spark, sf):
    """Exact medians and quantiles of a few large groups."""
    price = "l_extendedprice"
    return run_spec(table(spark, sf, "lineitem"), {"group_by": ["l_returnflag"], "metrics": [
        {"agg": "count", "name": "n"}, {"column": price, "agg": "median", "name": "middle"},
        {"column": price, "agg": "quantile", "p": 0.9, "name": "high"},
        {"column": price, "agg": "quantile", "p": 0.001, "name": "low"},
        {"column": "l_quantity", "agg": "median", "name": "middle_quantity"}]})
