"""Validation report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartula.operators import usage_reports


def write_reports(reports: DataFrame, validations: DataFrame, folder: str) -> None:
    """JSON lines: report heads, reported items, findings and library usage, each a folder.

    The parts share the ``script`` key; items are written as rows of their own, so a script
    with very many usages is never gathered into one record.
    """
    parts = {
        "reports": reports,
        "items": usage_reports.report_items(validations),
        "findings": usage_reports.findings(validations),
        "libraries": usage_reports.library_usage(validations),
    }
    for name, df in parts.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")


def nested_reports(reports: DataFrame, validations: DataFrame, scripts: list[str]) -> DataFrame:
    """One nested record per named script, for reading a few reports at a time."""
    items = usage_reports.report_items(validations.filter(F.col("script").isin(scripts)))
    item = F.struct("seq", "kind", "name", "owner", "line", "status", "confidence", "message", "suggestions")
    gathered = items.groupBy("script").agg(F.array_sort(F.collect_list(item)).alias("validation_details"))
    return reports.filter(F.col("script").isin(scripts)).join(gathered, "script", "left")
