"""Declarative analysis requests: a small spec becomes ordinary DataFrame calls.

    {"source": table name, "joins": [{"table", "on": [[left, right], ...], "how"}],
     "derive": {name: SQL expression}, "filters": [{"column", "op", "value"}], "group_by": [...],
     "metrics": [{"column", "agg", "name"}], "having": [{"column", "op", "value"}],
     "subtotals": "rollup", "cube" or [[key, ...], ...], "pivot": {"column", "values"},
     "trends": [{"kind", "name", "column", "by": [...], "order_by": [{"column", "descending"}], "n"}],
     "order_by": [{"column", "descending"}], "limit": n, "chart": "ranking", "x": column, "y": column}

Metrics are those of ``aggregate``, with ``median`` and ``quantile`` (``p``) exact for groups of any size. Subtotals
add a column ``level`` and keep null keys; a pivot turns the values of one more key into columns of the only
metric. Trends are computed after grouping and ``having``, within the groups of ``by``.

Charts with a label and a value take the only key and the first metric, stacked bars and heatmaps two
keys, and scatter plots ``x`` and ``y``.
"""

from __future__ import annotations

from difflib import get_close_matches

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.operators import charts
from cobaltmill.operators.aggregates import aggregate
from cobaltmill.operators.levels import grouped_levels, pivoted
from cobaltmill.operators.quantiles import exact_quantiles
from cobaltmill.operators.trends import add_trends
from cobaltmill.session import materialise

FILTER_OPS = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(*v), "not in": lambda c, v: ~c.isin(*v),
    "between": lambda c, v: c.between(*v), "contains": lambda c, v: c.contains(v),
    "is null": lambda c, v: c.isNull(), "is not null": lambda c, v: c.isNotNull(),
}
LABEL_CHARTS = {
    "bar": charts.bar, "line": charts.line, "pie": charts.pie, "ranking": charts.ranking,
}
#: Metrics with passes of their own.
QUANTILES = ("median", "quantile")
MATRIX_CHARTS = {"stacked": charts.stacked, "heatmap": charts.heatmap}


class UnknownColumn(ValueError):
    """A spec names a column the table does not have."""


def find_column(name: str, columns: list[str], corrections: dict[str, str] | None = None) -> str:
    """The schema's column of that name, whatever its case.

    A misspelt name is an error that says which column is nearest. A caller who passes a dictionary for
    ``corrections`` gets the nearest column instead, and the replacement is recorded there.
    """
    by_lower = {c.lower(): c for c in columns}
    if name.lower() in by_lower:
        return name if name in columns else by_lower[name.lower()]
    close = get_close_matches(name.lower(), list(by_lower), n=1, cutoff=0.75)
    if close and corrections is not None:
        corrections[name] = by_lower[close[0]]
        return corrections[name]
    hint = f"; did you mean {by_lower[close[0]]!r}?" if close else ""
    raise UnknownColumn(f"no column {name!r}; the table has {', '.join(columns)}{hint}")


def joined_source(data: dict[str, DataFrame], spec: dict) -> DataFrame:
    """The source table with the joins of the spec, in their order; equal keys keep the left column."""
    df = data[spec["source"]]
    for rule in spec.get("joins", []):
        right = data[rule["table"]]
        pairs = [(find_column(a, df.columns), find_column(b, right.columns)) for a, b in rule["on"]]
        condition = [df[a] == right[b] for a, b in pairs]
        twice = [right[b] for a, b in pairs if a == b]
        df = df.join(right, condition, rule.get("how", "inner"))
        for column in twice:
            df = df.drop(column)
    return df


def known(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are all known."""
    for k in keys:
        df = df.filter(F.col(f"`{k}`").isNotNull())
    return df


def grouped(df: DataFrame, keys: list[str], metrics: list[dict]) -> DataFrame:
    """The metrics per key; medians and quantiles come from their own passes and are joined by key."""
    plain = [m for m in metrics if m["agg"] not in QUANTILES]
    found = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*[
        aggregate(F.col(f"`{m['column']}`") if m["column"] else None, m["agg"]).alias(m["name"])
        for m in plain or [{"agg": "count", "column": None, "name": "__rows"}]])
    exact = [m for m in metrics if m["agg"] in QUANTILES]
    for column in dict.fromkeys(m["column"] for m in exact):
        if column is None:
            raise ValueError("a median needs a column")
        shares = {m["name"]: m.get("p", 0.5) for m in exact if m["column"] == column}
        values = exact_quantiles(df, keys, column, shares)
        if keys:
            found = found.join(materialise(values, "quantile-values"), keys, "left")
        else:
            found = found.withColumn("__one", F.lit(0)).join(
                materialise(values.withColumn("__one", F.lit(0)), "quantile-values"), "__one", "left").drop("__one")
    return found.select(*[F.col(f"`{c}`") for c in [*keys, *[m["name"] for m in metrics]]])


def trend_groups(trends: list[dict], find) -> list[tuple[list[str], list[tuple[str, bool]], list[dict]]]:
    """Trends with the same groups and order, which are sorted once. A trend may use an earlier one."""
    out: list[tuple[list[str], list[tuple[str, bool]], list[dict]]] = []
    names = {t["name"] for t in trends}

    def column(name: str) -> str:
        return name if name in names else find(name)

    for t in trends:
        by = [column(c) for c in t.get("by", [])]
        order = [(column(o["column"]), bool(o.get("descending"))) for o in t.get("order_by", [])]
        measure = {**t, "column": column(t["column"]) if t.get("column") else None}
        new = {m["name"] for m in out[-1][2]} if out else set()
        used = {measure["column"], *by, *[c for c, _ in order]}
        if out and out[-1][:2] == (by, order) and not used & new:
            out[-1][2].append(measure)
        else:
            out.append((by, order, [measure]))
    return out


def run_spec(data: DataFrame | dict[str, DataFrame], spec: dict,
             corrections: dict[str, str] | None = None) -> DataFrame:
    """Run one analysis request on a table, or on the named one of several tables with its joins.

    With ``corrections`` misspelt columns are replaced by the nearest ones, which it then holds.
    """
    df = joined_source(data, spec) if isinstance(data, dict) else data

    def find(name: str) -> str:
        return find_column(name, df.columns, corrections)

    def col(name: str) -> Column:
        return F.col(f"`{find(name)}`")

    def keep(rules: list[dict]) -> DataFrame:
        kept = df
        for rule in rules:
            kept = kept.filter(FILTER_OPS[rule["op"]](col(rule["column"]), rule.get("value")))
        return kept

    for name, expression in spec.get("derive", {}).items():
        df = df.withColumn(name, F.expr(expression))
    df = keep(spec.get("filters", []))
    keys = [find(k) for k in spec.get("group_by", [])]
    metrics = [{**m, "column": find(m["column"]) if m.get("column") else None} for m in spec.get("metrics", [])]
    if spec.get("subtotals"):
        if any(m["agg"] in QUANTILES for m in metrics):
            raise ValueError("subtotals have no medians or quantiles")
        df = grouped_levels(df, keys, metrics, spec["subtotals"])
    elif spec.get("pivot"):
        if len(metrics) != 1 or metrics[0]["agg"] in (*QUANTILES, "distinct"):
            raise ValueError("a pivot takes one metric that is a count, sum, mean, maximum or minimum")
        df = pivoted(known(df, keys), keys, find(spec["pivot"]["column"]), metrics[0], spec["pivot"].get("values"))
    elif metrics:
        df = grouped(known(df, keys), keys, metrics)
    if metrics:
        df = keep(spec.get("having", []))
    for by, order, measures in trend_groups(spec.get("trends", []), find):
        df = add_trends(df, by, order, measures)
    order = [
        col(o["column"]).desc() if o.get("descending") else col(o["column"]).asc()
        for o in spec.get("order_by", [])
    ]
    df = df.orderBy(*order) if order else df
    df = df.limit(spec["limit"]) if spec.get("limit") else df
    chart = spec.get("chart")
    wanted = 1 if chart in LABEL_CHARTS else 2 if chart in MATRIX_CHARTS else len(keys)
    if len(keys) != wanted:
        raise ValueError(f"a {chart} chart takes {wanted} key(s), not {len(keys)}")
    if chart in LABEL_CHARTS:
        return LABEL_CHARTS[chart](df, keys[0], spec["metrics"][0]["name"])
    if chart in MATRIX_CHARTS:
        return MATRIX_CHARTS[chart](df, keys[0], keys[1], spec["metrics"][0]["name"])
    if chart == "scatter":
        x, y = (find(spec[axis]) for axis in "xy")
        return charts.scatter(df, x, y)
    if chart:
        raise ValueError(f"no chart {chart!r}")
    return df


def chart_with_fallback(df: DataFrame, spec: dict | None, tables: dict[str, DataFrame]) -> DataFrame | None:
    """The requested chart, else one from a named aggregate, else one from the raw table."""
    if spec and spec.get("chart"):
        try:
            return run_spec(df, spec).select("label", "value").withColumn(
                "chart_origin", F.lit("requested"))
        except UnknownColumn:
            pass
    for origin, chart in (
        ("aggregated_table", lambda: charts.auto_chart_aggregated(tables)),
        ("raw_table", lambda: charts.auto_chart(df)),
    ):
        found = chart()
        if found is not None:
            return found.select("label", "value").withColumn("chart_origin", F.lit(origin))
    return None
