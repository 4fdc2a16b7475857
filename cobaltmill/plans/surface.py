"""Names a user can call: SQL functions in the session and helpers for notebooks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from cobaltmill.functions import clock
from cobaltmill.functions import numbers as N
from cobaltmill.functions import text as T
from cobaltmill.functions import webhooks as H
from cobaltmill.operators import charts
from cobaltmill.plans.analysis import chart_with_fallback, run_spec
from cobaltmill.plans.clean import clean_files, clean_table
from cobaltmill.session import table
from cobaltmill.sources.sinks import write_records, write_report

#: Each SQL function: its parameter, the result type, and the column function that is its body.
SQL_FUNCTIONS: dict[str, tuple[str, str, Callable[[Column], Column]]] = {
    "norm_text": ("s STRING", "STRING", T.norm_text),
    "parse_usd": ("s STRING", "DOUBLE", N.parse_usd),
    "parse_cop": ("s STRING", "DOUBLE", N.parse_cop),
    "id_normalize": ("s STRING", "STRING", N.id_normalize),
    "whole_pesos": ("n BIGINT", "BIGINT", H.whole_pesos),
    "local_day": ("t TIMESTAMP_NTZ", "DATE", clock.local_day),
    "chart_value": ("v DOUBLE", "DOUBLE", N.value_coerce),
    "chart_label": ("s STRING", "STRING", N.label_coerce),
}


def _sql_of(spark: SparkSession, parameter: str, use: Callable[[Column], Column]) -> str:
    """The SQL text that Catalyst gives for a column function, so that there is one body for both."""
    shown = spark.createDataFrame([], parameter).select(use(F.col(parameter.split()[0])).alias("x"))
    return shown._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register_sql_functions(spark: SparkSession) -> None:
    """Temporary SQL functions; Catalyst inlines their bodies, so a call costs the same as writing it out."""
    for name, (parameter, result, use) in SQL_FUNCTIONS.items():
        body = _sql_of(spark, parameter, use)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameter}) RETURNS {result} RETURN {body}")


def helpers() -> dict[str, Callable]:
    """Loader, chart helpers and report writers by name."""
    return {
        "load_table": table, "clean_table": clean_table, "clean_files": clean_files, "run_spec": run_spec,
        "chart_with_fallback": chart_with_fallback, "write_records": write_records,
        "write_report": write_report,
        **{name: getattr(charts, name) for name in (
            "bar", "line", "pie", "ranking", "scatter", "heatmap", "corr_matrix", "stacked",
            "auto_chart", "auto_chart_aggregated",
        )},
    }
