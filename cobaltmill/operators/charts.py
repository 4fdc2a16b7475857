"""Chart relations: one row per point, with an explicit sort key instead of a global row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cobaltmill.functions import numbers as N
from cobaltmill.functions import text as T
from cobaltmill.functions import vocab
from cobaltmill.operators.aggregates import group_by
from cobaltmill.operators.ordering import positions
from cobaltmill.operators.comoments import correlations
from cobaltmill.operators.profile import column_roles, is_numeric
from cobaltmill.session import materialise

# Points in one JSON document.
OPTION_BLOCK = 1_000


def points(df: DataFrame, label: str, value: str) -> DataFrame:
    """Label and value under the chart rules: null labels blank, bad values 0, four places."""
    return df.select(
        N.label_coerce(F.col(label)).alias("label"), N.value_coerce(F.col(value)).alias("value")
    )


def _month_number(label: Column, months: tuple[str, ...]) -> Column:
    names = F.array(*[F.lit(m) for m in months])
    return F.array_position(names, F.lower(T.strip(label))).cast("int")


def month_sort(chart: DataFrame) -> DataFrame:
    """Adds ``sort_key``: calendar position when every non-blank label is a month, else null.

    Blank labels sort last (99). Points with a null key keep the order of their labels. The points
    are stored first, so that the check of all labels does not aggregate the source again.
    """
    chart = materialise(chart, "chart")
    es, en = (_month_number(F.col("label"), m) for m in (vocab.MONTHS_ES, vocab.MONTHS_EN))
    blank = T.strip(F.col("label")) == ""
    verdict = chart.agg(
        F.when(F.bool_and(blank | (es > 0)), "es").when(F.bool_and(blank | (en > 0)), "en").alias("lang")
    ).scalar()
    month = F.when(verdict == "es", es).when(verdict == "en", en)
    return chart.withColumn("sort_key", F.when(month == 0, 99).otherwise(month))


def bar(df: DataFrame, label: str, value: str) -> DataFrame:
    return month_sort(points(df, label, value))


def line(df: DataFrame, label: str, value: str) -> DataFrame:
    """Trend points in label order (calendar order for months)."""
    return bar(df, label, value).orderBy("sort_key", "label")


def pie(df: DataFrame, label: str, value: str) -> DataFrame:
    """Slices with their percentage of the total."""
    slices = points(df, label, value)
    total = slices.agg(F.sum("value")).scalar()
    return slices.withColumn("percent", F.round(100 * F.col("value") / F.nullif(total, F.lit(0.0)), 4))


def ranking(df: DataFrame, label: str, value: str) -> DataFrame:
    """Ascending by value, as drawn from the bottom of a horizontal bar chart."""
    return points(df, label, value).orderBy("value", "label")


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(N.value_coerce(F.col(x)).alias("x"), N.value_coerce(F.col(y)).alias("y"))


def axis(df: DataFrame, column: str, index: str) -> DataFrame:
    """Distinct labels of an axis with their position in order, however many there are."""
    labels = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return materialise(positions(labels, [F.col(column)], index), "axis")


def heatmap(matrix: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """Matrix cells as column index, row index, value, with the colour range (at least -1 to 1)."""
    matrix = materialise(matrix.select(row, col, value), "matrix")
    v = F.coalesce(F.nanvl(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    span = matrix.agg(F.struct(
        F.least(F.min(v), F.lit(-1.0)).alias("low"), F.greatest(F.max(v), F.lit(1.0)).alias("high")
    )).scalar()
    placed = matrix.join(axis(matrix, col, "x"), col, "left").join(axis(matrix, row, "y"), row, "left")
    return placed.select(
        "x", "y", F.round(v, 3).alias("v"),
        F.round(span.getField("low"), 3).alias("colour_min"),
        F.round(span.getField("high"), 3).alias("colour_max"),
    )


def corr_matrix(df: DataFrame, max_columns: int | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlations of the numeric columns, in one pass.

    A column without spread has no correlation (null). Without numeric columns there are no rows.
    """
    cols = [f.name for f in df.schema.fields if is_numeric(f)][:max_columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "row string, col string, r double")
    return correlations(df, {c: F.col(f"`{c}`").cast("double") for c in cols}).select("row", "col", "r")


def stacked(df: DataFrame, category: str, segment: str, value: str,
            segments: list[str] | None = None) -> DataFrame:
    """One value per category and segment; combinations without rows are 0.

    The segments are the chart's series; their names, not the rows, are held as one list.
    """
    sums = materialise(
        df.groupBy(category, segment).agg(F.sum(value).alias("__sum")), "segments")
    named = sums.agg(F.array_sort(F.collect_set(segment))).scalar() if segments is None else F.lit(segments)
    cells = sums.select(F.col(category).alias("__category")).distinct().select(
        "__category", F.explode(named).alias("segment"))
    joined = cells.join(
        sums, F.col("__category").eqNullSafe(F.col(category)) & (F.col("segment") == F.col(segment)), "left")
    return joined.select(
        N.label_coerce(F.col("__category")).alias("label"), cells["segment"],
        N.value_coerce(F.col("__sum")).alias("value"))


def option_json(chart: DataFrame, kind: str, title: str, block: int = OPTION_BLOCK) -> DataFrame:
    """JSON chart specification from a (label, value) relation, one row per ``block`` points.

    Points stand in the order of ``sort_key`` (if there is one) and label. A browser draws the only
    block of a usual chart; a longer one comes in blocks, numbered from 0.
    """
    order = [F.col(c) for c in ("sort_key", "label", "value") if c in chart.columns]
    placed = positions(chart.select("label", "value", *[c for c in ("sort_key",) if c in chart.columns]), order)
    ordered = F.sort_array(F.collect_list(F.struct("position", "label", "value")))
    series = F.struct(
        F.lit(kind).alias("type"), F.transform(ordered, lambda p: p["value"]).alias("data")
    )
    blocks = placed.groupBy(F.floor(F.col("position") / block).alias("block"))
    return blocks.agg(F.to_json(F.struct(
        F.struct(F.lit(title).alias("text")).alias("title"),
        F.struct(F.transform(ordered, lambda p: p["label"]).alias("data")).alias("xAxis"),
        F.array(series).alias("series"),
    )).alias("spec"))


def chart_plan(df: DataFrame) -> dict | None:
    """Group column, value column and chart type chosen from the column roles."""
    roles = column_roles(df).orderBy("pos").collect()  # one row per column
    dated = next((r for r in roles if r["is_date"]), None)
    group = dated or next((r for r in roles if r["is_categorical"]), None)
    if group is None:
        return None
    value = next((r["column"] for r in roles if r["is_numeric"] and r["column"] != group["column"]), None)
    distinct = group["n_distinct"] or 0
    kind = (
        "line" if dated else "pie" if distinct <= 7
        else "horizontal_bar" if distinct > 15 else "bar"
    )
    return {"group": group["column"], "value": value, "kind": kind}


def auto_chart(df: DataFrame) -> DataFrame | None:
    """Chart relation of a raw table: sum of the first numeric column, or row counts.

    None without a column to group by, or with fewer than two points.
    """
    plan = chart_plan(df)
    if plan is None:
        return None
    grouped = group_by(df, plan["group"], "sum" if plan["value"] else "count", plan["value"])
    drawn = bar(grouped, plan["group"], "value")
    if len(drawn.take(2)) < 2:
        return None
    return (
        drawn
        .withColumn("kind", F.lit(plan["kind"])).withColumn("group_column", F.lit(plan["group"]))
    )


def auto_chart_aggregated(tables: dict[str, DataFrame]) -> DataFrame | None:
    """Chart the first named table of 2 to 200 rows as it stands, always as bars.

    A candidate is stored up to one row past the limit, so that it is computed only once.
    """
    for name in vocab.AGGREGATED_TABLE_NAMES:
        if name not in tables:
            continue
        df = materialise(tables[name].limit(201), "candidate")
        if not 2 <= df.count() <= 200:
            continue
        plan = chart_plan(df)
        value = (plan or {}).get("value")
        if plan is None or value is None:
            continue
        return (
            bar(df, plan["group"], value)
            .withColumn("kind", F.lit("bar")).withColumn("group_column", F.lit(plan["group"]))
        )
    return None
