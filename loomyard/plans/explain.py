"""What a plan does, as figures for tests: pushed filters, read columns, exchanges, Python stages."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class PlanFacts:
    exchanges: int
    python: int
    cartesian: bool
    pushed: list[str]
    columns: list[str]


def plan_facts(df: DataFrame) -> PlanFacts:
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    tree = text.split("\n\n\n")[0]
    return PlanFacts(
        exchanges=len(re.findall(r"[-+: ]Exchange", tree)),
        python=len(re.findall(r"MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas", tree)),
        cartesian="CartesianProduct" in tree or "BroadcastNestedLoopJoin" in tree,
        pushed=re.findall(r"PushedFilters: \[(.*?)\]\n", text),
        columns=re.findall(r"ReadSchema: struct<(.*?)>\n", text),
    )
