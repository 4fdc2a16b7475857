"""Aggregates, chart relations and analysis requests over the sales tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobaltmill.catalog.registry import register
from cobaltmill.functions import vocab
from cobaltmill.operators import aggregates as A
from cobaltmill.operators import charts
from cobaltmill.operators.profile import column_roles
from cobaltmill.plans.analysis import chart_with_fallback, run_spec
from cobaltmill.session import table


def money(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order with its revenue and place.

    Lines are summed per order before the join, so the large table is shuffled once and reduced.
    """
    net = money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(net).alias("revenue")
    )
    customers = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    places = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "n_name", "r_name")
    placed = customers.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"
    )
    return lines.join(orders.join(placed, F.col("o_custkey") == F.col("c_custkey")), "o_orderkey")


SALES_SQL = """
WITH sales AS (
  SELECT o.*, n_name, r_name, c_mktsegment,
         CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS revenue
  FROM lineitem JOIN orders o ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)
"""


@register("analysis_spec", SALES_SQL + """
SELECT r_name AS label, round(CAST(sum(revenue) AS DOUBLE), 4) AS value FROM sales GROUP BY r_name HAVING count(DISTINCT n_name) > 1
""")
def analysis_spec(spark, sf):
    names = ("lineitem", "orders", "customer", "nation", "region")
    return run_spec({n: table(spark, sf, n) for n in names}, {
        "source": "lineitem",
        "joins": [{"table": "orders", "on": [["l_orderkey", "o_orderkey"]]},
                  {"table": "customer", "on": [["o_custkey", "c_custkey"]]},
                  {"table": "nation", "on": [["c_nationkey", "n_nationkey"]]},
                  {"table": "region", "on": [["n_regionkey", "r_regionkey"]]}],
        "derive": {"revenue": "CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))"},
        "group_by": ["r_name"],
        "metrics": [{"column": "revenue", "agg": "sum", "name": "total"},
                    {"column": "n_name", "agg": "distinct", "name": "nations"}],
        "having": [{"column": "nations", "op": ">", "value": 1}],
        "chart": "ranking",
    })


@register("analysis_spec_matrix", """
SELECT o_orderstatus AS label, o_orderpriority AS segment, CAST(count(*) AS DOUBLE) AS value
FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice * 2 > 100000 GROUP BY ALL
""")
def analysis_spec_matrix(spark, sf):
    return run_spec({"orders": table(spark, sf, "orders")}, {
        "source": "orders", "derive": {"double_price": "o_totalprice * 2"},
        "filters": [{"column": "o_orderstatus", "op": "in", "value": ["F", "O"]},
                    {"column": "double_price", "op": ">", "value": 100000}],
        "group_by": ["o_orderstatus", "o_orderpriority"],
        "metrics": [{"agg": "count", "name": "n"}], "chart": "stacked",
    })


@register("spec_retry_columns", """
SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top, median(o_totalprice) AS middle,
       'o_orderprioritty -> o_orderpriority, o_totalprise -> o_totalprice' AS replaced
FROM orders WHERE o_orderstatus NOT IN ('F', 'P') AND o_totalprice BETWEEN 1000 AND 400000 AND o_custkey IS NOT NULL GROUP BY o_orderpriority
""")
def spec_retry_columns(spark, sf):
    replaced: dict[str, str] = {}
    found = run_spec(table(spark, sf, "orders"), {
        "filters": [{"column": "O_OrderStatus", "op": "not in", "value": ["F", "P"]},
                    {"column": "o_totalprise", "op": "between", "value": [1000, 400000]},
                    {"column": "o_custkey", "op": "is not null"}],
        "group_by": ["o_orderprioritty"],
        "metrics": [{"agg": "count", "name": "n"}, {"column": "o_totalprise", "agg": "max", "name": "top"},
                    {"column": "o_totalprice", "agg": "median", "name": "middle"}],
    }, replaced)
    told = ", ".join(f"{a} -> {b}" for a, b in sorted(replaced.items()))
    return found.withColumn("replaced", F.lit(told))


@register("chart_fallback_chain", """
SELECT c_mktsegment AS label, CAST(count(*) AS DOUBLE) AS value, 'aggregated_table' AS chart_origin
FROM customer GROUP BY c_mktsegment
""")
def chart_fallback_chain(spark, sf):
    customers = table(spark, sf, "customer")
    summary = A.group_by(customers, "c_mktsegment", name="customers")
    spec = {"group_by": ["no_such_thing"], "metrics": [{"agg": "count", "name": "n"}], "chart": "bar"}
    return chart_with_fallback(customers, spec, {"result": customers, "resumen": summary})


@register("group_count", """
SELECT o_orderstatus AS status, count(*) AS n FROM orders
WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus
""")
def group_count(spark, sf):
    keyed = table(spark, sf, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return A.group_by(keyed, "status", name="n")


def _flagged(spark, sf):
    known = F.when(F.col("l_returnflag") != "R", money("l_extendedprice"))
    return table(spark, sf, "lineitem").select(
        "l_returnflag", "l_quantity", "l_extendedprice", known.alias("known_price")
    )


@register("group_sum", """
SELECT l_returnflag, CAST(coalesce(sum(CASE WHEN l_returnflag <> 'R'
       THEN CAST(l_extendedprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS total
FROM lineitem GROUP BY l_returnflag
""")
def group_sum(spark, sf):
    grouped = A.group_by(_flagged(spark, sf), "l_returnflag", "sum", "known_price", "total")
    return grouped.withColumn("total", F.col("total").cast("double"))


@register("group_mean", """
SELECT l_returnflag, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem GROUP BY l_returnflag
""")
def group_mean(spark, sf):
    grouped = A.group_by(_flagged(spark, sf), "l_returnflag", "mean", "l_quantity", "mean_quantity")
    return grouped.withColumn("mean_quantity", F.round("mean_quantity", 6))


@register("group_max", """
SELECT l_returnflag, max(l_extendedprice) AS top FROM lineitem GROUP BY l_returnflag
""")
def group_max(spark, sf):
    return A.group_by(_flagged(spark, sf), "l_returnflag", "max", "l_extendedprice", "top")


@register("group_min", """
SELECT l_returnflag, min(l_extendedprice) AS low FROM lineitem GROUP BY l_returnflag
""")
def group_min(spark, sf):
    return A.group_by(_flagged(spark, sf), "l_returnflag", "min", "l_extendedprice", "low")


def _roles_sql() -> str:
    parts = []
    columns = (
        ("o_orderkey", True), ("o_custkey", True), ("o_orderstatus", False), ("o_totalprice", True),
        ("o_orderdate", False), ("o_orderpriority", False),
    )
    for pos, (name, numeric) in enumerate(columns):
        distinct = "max(CAST(NULL AS BIGINT))" if numeric else f"count(DISTINCT {name})"
        categorical = "false" if numeric else f"count(DISTINCT {name}) BETWEEN 2 AND 50"
        parts.append(
            f"SELECT CAST({pos} AS BIGINT) AS pos, '{name}' AS \"column\", {numeric} AS is_numeric, "
            f"{'date' in name} AS is_date, {distinct} AS n_distinct, "
            f"{categorical} AS is_categorical FROM orders"
        )
    return " UNION ALL ".join(parts)


@register("column_roles", _roles_sql())
def column_roles_query(spark, sf):
    return column_roles(table(spark, sf, "orders"))


@register("auto_chart", """
SELECT event_type AS label, CAST(sum(event_id) AS DOUBLE) AS value, 'pie' AS kind,
       'event_type' AS group_column
FROM events GROUP BY event_type
""")
def auto_chart(spark, sf):
    return charts.auto_chart(table(spark, sf, "events")).drop("sort_key")


@register("auto_chart_aggregated", """
SELECT n_name AS label, CAST(count(*) AS DOUBLE) AS value, 'bar' AS kind, 'n_name' AS group_column
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
""")
def auto_chart_aggregated(spark, sf):
    customers, nations = table(spark, sf, "customer"), table(spark, sf, "nation")
    by_nation = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    tables = {"resultado": table(spark, sf, "orders"), "ranking": A.group_by(by_nation, "n_name", name="customers")}
    return charts.auto_chart_aggregated(tables).drop("sort_key")


@register("value_coerce", """
SELECT event_id,
       coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS from_json,
       CAST(0 AS DOUBLE) AS from_text,
       round(coalesce(value / CASE WHEN event_type = 'view' THEN NULL ELSE 7 END, 0), 4) AS from_number
FROM events
""")
def value_coerce(spark, sf):
    from cobaltmill.functions import numbers as N

    seventh = F.col("value") / F.when(F.col("event_type") != "view", F.lit(7))
    return table(spark, sf, "events").select(
        "event_id",
        N.text_value_coerce(F.get_json_object("props", "$.k")).alias("from_json"),
        N.text_value_coerce(F.col("event_type")).alias("from_text"),
        N.value_coerce(seventh).alias("from_number"),
    )


@register("label_coerce", """
SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer_label,
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS status_label
FROM orders
""")
def label_coerce(spark, sf):
    from cobaltmill.functions import numbers as N

    return table(spark, sf, "orders").select(
        "o_orderkey", N.label_coerce(F.col("o_custkey")).alias("customer_label"),
        N.label_coerce(F.nullif("o_orderstatus", F.lit("P"))).alias("status_label"),
    )


_MONTHS_SQL = "[" + ", ".join(f"'{m}'" for m in vocab.MONTHS_ES) + "]"


@register("month_sort", f"""
SELECT list_extract({_MONTHS_SQL}, month(o_orderdate)) AS label,
       CAST(count(*) AS DOUBLE) AS value, CAST(month(o_orderdate) AS INTEGER) AS sort_key
FROM orders GROUP BY month(o_orderdate)
""")
def month_sort(spark, sf):
    names = F.array(*[F.lit(m) for m in vocab.MONTHS_ES])
    by_month = table(spark, sf, "orders").select(
        F.element_at(names, F.month("o_orderdate")).alias("mes")
    )
    return charts.bar(A.group_by(by_month, "mes"), "mes", "value")


@register("chart_bar", """
SELECT o_orderpriority AS label, CAST(count(*) AS DOUBLE) AS value,
       CAST(NULL AS INTEGER) AS sort_key
FROM orders GROUP BY o_orderpriority
""")
def chart_bar(spark, sf):
    return charts.bar(A.group_by(table(spark, sf, "orders"), "o_orderpriority"), "o_orderpriority", "value")


@register("chart_line", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS label, CAST(count(*) AS DOUBLE) AS value
FROM events GROUP BY CAST(ts AS DATE)
""")
def chart_line(spark, sf):
    days = table(spark, sf, "events").select(F.to_date("ts").alias("day"))
    return charts.line(A.group_by(days, "day"), "day", "value").drop("sort_key")


@register("chart_pie", """
WITH s AS (SELECT l_returnflag AS label,
                  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value
           FROM lineitem GROUP BY l_returnflag)
SELECT label, value, round(100 * value / (SELECT sum(value) FROM s), 4) AS percent FROM s
""")
def chart_pie(spark, sf):
    priced = table(spark, sf, "lineitem").select("l_returnflag", money("l_extendedprice").alias("price"))
    return charts.pie(A.group_by(priced, "l_returnflag", "sum", "price"), "l_returnflag", "value")


@register("chart_ranking", SALES_SQL + """
SELECT n_name AS label, round(CAST(sum(revenue) AS DOUBLE), 4) AS value FROM sales GROUP BY n_name
""")
def chart_ranking(spark, sf):
    by_nation = A.group_by(sales(spark, sf), "n_name", "sum", "revenue")
    return charts.ranking(by_nation, "n_name", "value")


@register("chart_scatter", """
SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part
""")
def chart_scatter(spark, sf):
    return charts.scatter(table(spark, sf, "part"), "p_size", "p_retailprice")


@register("chart_heatmap", """
WITH m AS (SELECT l_returnflag, l_linestatus,
                  CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) * 40 / count(*) AS v
           FROM lineitem GROUP BY ALL)
SELECT dense_rank() OVER (ORDER BY l_linestatus) - 1 AS x,
       dense_rank() OVER (ORDER BY l_returnflag) - 1 AS y, round(v, 3) AS v,
       round((SELECT least(min(v), -1.0) FROM m), 3) AS colour_min,
       round((SELECT greatest(max(v), 1.0) FROM m), 3) AS colour_max
FROM m
""")
def chart_heatmap(spark, sf):
    share = F.sum(money("l_tax")).cast("double") * 40 / F.count(F.lit(1))
    matrix = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(share.alias("v"))
    return charts.heatmap(matrix, "l_returnflag", "l_linestatus", "v")


def _corr_sql() -> str:
    cols = (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "late_price",
    )
    cells = ", ".join(
        f"{{'row': '{a}', 'col': '{b}', 'r': corr({a}, {b})}}" for a in cols for b in cols
    )
    return (
        f"SELECT c.row AS \"row\", c.col AS col, round(c.r, 6) AS r "
        f"FROM (SELECT unnest([{cells}]) AS c FROM (SELECT *, CASE WHEN l_orderkey > 500 THEN l_extendedprice + 1e9 END AS late_price "
        f"FROM lineitem))"
    )


@register("corr_matrix", _corr_sql())
def corr_matrix(spark, sf):
    late = F.when(F.col("l_orderkey") > 500, F.col("l_extendedprice") + 1e9)  # null at first, then far from 0
    lines = table(spark, sf, "lineitem").withColumn("late_price", late)
    return charts.corr_matrix(lines).withColumn("r", F.round("r", 6))


@register("chart_stacked", """
WITH p AS (SELECT DISTINCT o_orderpriority FROM orders),
     s AS (SELECT DISTINCT o_orderstatus FROM orders)
SELECT s.o_orderstatus AS label, p.o_orderpriority AS segment,
       CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS value
FROM s CROSS JOIN p LEFT JOIN orders o
  ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority
GROUP BY ALL
""")
def chart_stacked(spark, sf):
    priced = table(spark, sf, "orders").select(
        "o_orderstatus", "o_orderpriority", money("o_totalprice").alias("price")
    )
    return charts.stacked(priced, "o_orderstatus", "o_orderpriority", "price")


@register("demand_summary", """
SELECT 'l_quantity' AS quantity_column, count(*) AS n_rows, sum(l_quantity) AS total,
       round(sum(l_quantity) / count(*), 6) AS mean_per_row
FROM lineitem
""")
def demand_summary(spark, sf):
    summary = A.demand_summary(table(spark, sf, "lineitem"))
    return summary.withColumn("mean_per_row", F.round("mean_per_row", 6))


@register("conditional_pct", """
SELECT o_orderstatus, count(o_orderkey) AS n_orders,
       round(100 * avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END), 6) AS urgent_pct
FROM orders GROUP BY o_orderstatus
""")
def conditional_pct(spark, sf):
    shares = A.conditional_pct(
        table(spark, sf, "orders"), ["o_orderstatus"], "o_orderkey",
        F.col("o_orderpriority") == "1-URGENT", "n_orders", "urgent_pct",
    )
    return shares.withColumn("urgent_pct", F.round("urgent_pct", 6))


@register("chart_history", """
SELECT user_id, event_id, CAST(rank AS BIGINT) AS rank FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank
  FROM events)
WHERE rank <= 6
""")
def chart_history(spark, sf):
    newest = A.latest_n(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], 6)
    return newest.select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@register("chart_policy", """
WITH f AS (
  SELECT user_id, ts, event_id, 'chart_' || event_type || '_' ||
         CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) // 25 AS VARCHAR) || '.png' AS path
  FROM events),
first AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, path ORDER BY ts, event_id) = 1)
SELECT user_id, path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank
FROM first QUALIFY rank <= 4
""")
def chart_policy(spark, sf):
    quarter = F.floor(F.get_json_object("props", "$.k").cast("long") / 25).cast("string")
    name = F.concat(F.lit("chart_"), "event_type", F.lit("_"), quarter, F.lit(".png"))
    artifacts = table(spark, sf, "events").select("user_id", "ts", "event_id", name.alias("path"))
    kept = A.chart_policy(
        artifacts, ["user_id"], "path", F.struct("ts", "event_id"), len(vocab.CHART_TYPES)
    )
    return kept.withColumn("rank", F.col("rank").cast("long"))


@register("compliance_evidence", f"""
WITH d AS (
  SELECT l_returnflag,
         CASE WHEN l_discount < 0.05 THEN lpad(CAST(l_partkey AS VARCHAR), 10, '2208500000')
              ELSE CAST(l_partkey AS VARCHAR) END AS tariff,
         CASE WHEN l_returnflag = 'R' THEN ' ' ELSE 'CO' END AS origin,
         l_extendedprice AS fob,
         CASE WHEN l_returnflag = 'N' THEN l_extendedprice - l_tax ELSE l_extendedprice + l_tax END AS cif
  FROM lineitem),
c AS (
  SELECT l_returnflag,
         count(*) FILTER (WHERE regexp_full_match(tariff, '[0-9]{{10}}')) AS n_tariff,
         count(*) FILTER (WHERE trim(origin) <> '') AS n_origin, count(*) AS n_values,
         count(*) FILTER (WHERE cif < fob) AS n_cif_below_fob
  FROM d GROUP BY l_returnflag)
SELECT *, CASE WHEN n_tariff > 0 THEN 'ok' ELSE '{vocab.MISSING_EVIDENCE}' END AS tariff_state,
       CASE WHEN n_origin > 0 THEN 'ok' ELSE '{vocab.MISSING_EVIDENCE}' END AS origin_state,
       CASE WHEN n_cif_below_fob > 0 THEN 'cif_below_fob' ELSE 'ok' END AS value_state
FROM c
""")
def compliance_evidence(spark, sf):
    part = F.col("l_partkey").cast("string")
    sign = F.when(F.col("l_returnflag") == "N", -F.col("l_tax")).otherwise(F.col("l_tax"))
    return A.compliance_evidence(
        table(spark, sf, "lineitem"), ["l_returnflag"],
        tariff=F.when(F.col("l_discount") < 0.05, F.lpad(part, 10, "2208500000")).otherwise(part),
        origin=F.when(F.col("l_returnflag") == "R", " ").otherwise("CO"),
        fob=F.col("l_extendedprice"), cif=F.col("l_extendedprice") + sign,
    )
