from __future__ import annotations

import re

from pyspark.sql import DataFrame


def text(df: DataFrame) -> str:
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def pushed_filters(df: DataFrame) -> list[str]:
    return re.findall(r"PushedFilters: \[(.*)\]", text(df))


def read_columns(df: DataFrame) -> list[list[str]]:
    """Columns that each scan reads."""
    return [re.findall(r"(\w+):", s) for s in re.findall(r"ReadSchema: struct<(.*)>", text(df))]


def count(df: DataFrame, node: str) -> int:
    """How often a physical operator stands in the plan, by the beginning of its name."""
    return len(re.findall(rf"^\({r'\d+'}\) {node}", text(df), re.M))
