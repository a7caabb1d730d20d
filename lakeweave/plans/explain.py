"""Physical plans as rows (id, parent, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def plan_rows(df: DataFrame) -> list[tuple[int, int, str]]:
    """The nodes of the physical plan in pre-order; the root's parent is 0."""
    rows: list[tuple[int, int, str]] = []

    def walk(node, parent: int) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.initialPlan(), parent)
        if kind in ("WholeStageCodegenExec", "InputAdapter", "ColumnarToRowExec"):
            return walk(node.children().head(), parent)
        rows.append((len(rows) + 1, parent, node.simpleString(200)))
        me = len(rows)
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i), me)

    walk(df._jdf.queryExecution().executedPlan(), 0)
    return rows


def explain(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(plan_rows(df), "id long, parent long, detail string")
