"""Final adaptive physical plan of a DataFrame, for plan inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame


def final_plan(df: DataFrame) -> str:
    """Run the DataFrame's own physical plan (so AQE finalizes it: query
    stages, runtime broadcasts, coalesced or split partitions) and return
    the final plan text. A ``write``/``collect`` would plan a separate
    query execution and leave this one at its initial plan."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    lines = plan.toString().splitlines()
    # keep the top-level final plan; nested subqueries carry their own
    # (indented) initial-plan sections, which stay
    for i, line in enumerate(lines):
        if line.startswith("+- == Initial Plan =="):
            lines = lines[:i]
            break
    return "\n".join(lines)
