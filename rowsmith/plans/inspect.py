"""What a plan pushes to the scan, and what the scan really read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def pushed_filters(df: DataFrame) -> list[str]:
    """The PushedFilters entries of all scans."""
    return re.findall(r"PushedFilters: \[(.*?)\](?:, ReadSchema|$)", plan_text(df))


def scan_schema(df: DataFrame) -> list[str]:
    return re.findall(r"ReadSchema: (struct<.*>)", plan_text(df))


def num_leaves(df: DataFrame) -> int:
    """How many leaf columns the scans read."""

    def leaves(kind: T.DataType) -> int:
        if isinstance(kind, T.StructType):
            return sum(leaves(f.dataType) for f in kind.fields)
        if isinstance(kind, T.ArrayType):
            return leaves(kind.elementType)
        if isinstance(kind, T.MapType):
            return leaves(kind.keyType) + leaves(kind.valueType)
        return 1

    scans = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves(T._parse_datatype_json_string(scans.apply(i).schema().json())) for i in range(scans.size()))


def has_shuffle(df: DataFrame) -> bool:
    return "Exchange" in plan_text(df)


def scanned_rows(df: DataFrame) -> int:
    """Runs the plan and sums the rows that file scans produced, after row-group and page skipping."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()

    def walk(node) -> int:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        total = node.metrics().get("numOutputRows").get().value() if name == "FileSourceScanExec" else 0
        children = node.children()
        return total + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(plan)
