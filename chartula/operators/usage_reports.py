"""Scores, findings and reports over the validation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartula.operators.ranking import first_per_key
from chartula.operators.usage_checks import CONFIDENT

KINDS = ["import", "class", "method", "attribute", "function"]

#: Advice by finding: what was counted, and where to look.
ADVICE = {
    "METHOD_NOT_FOUND": "calls of unknown methods; compare them with the members the graph lists for the class",
    "ATTRIBUTE_NOT_FOUND": "reads of unknown attributes; compare them with the fields the graph lists for the class",
    "INVALID_PARAMETERS": "calls whose arguments do not fit; compare them with the stored signatures",
}
NO_FINDINGS = "nothing to correct in what the graph covers"
LOW_CONFIDENCE = "much of the usage lies outside of the graph, so little of it was judged"


def overall_confidence(scripts: DataFrame, validations: DataFrame) -> DataFrame:
    """Mean confidence of the graph items of each script, 1.0 without any."""
    means = validations.filter("in_graph").groupBy("script").agg(F.avg("confidence").alias("_mean"))
    joined = scripts.select("script").distinct().join(means, "script", "left")
    return joined.select("script", F.coalesce("_mean", F.lit(1.0)).alias("overall_confidence"))


def _first_reports(validations: DataFrame) -> DataFrame:
    """One row per (script, line, name, type) of methods and attributes, methods first."""
    rows = validations.filter(F.col("kind").isin("method", "attribute"))
    rows = rows.withColumn("_order", (F.col("kind") != "method").cast("int"))
    return first_per_key(rows, ["script", "line", "name", "owner"], ["_order", "seq"]).drop("_order")


def findings(validations: DataFrame) -> DataFrame:
    """``(script, type, line, seq, name, description, suggestion)``."""
    graph_items = validations.filter("in_graph")
    missing = _first_reports(graph_items.filter("status = 'NOT_FOUND'"))
    is_method = F.col("kind") == "method"
    described = F.concat(F.when(is_method, "method ").otherwise("attribute "), F.concat_ws(".", "owner", "name"), F.lit(": unknown"))
    rows = missing.select(
        "script",
        F.when(is_method, "METHOD_NOT_FOUND").otherwise("ATTRIBUTE_NOT_FOUND").alias("type"),
        "line",
        "seq",
        "name",
        described.alias("description"),
        F.when(is_method, F.get("suggestions", F.lit(0))).alias("suggestion"),
    )
    parameters = graph_items.filter("kind = 'method' AND param_status = 'INVALID'").select(
        "script",
        F.lit("INVALID_PARAMETERS").alias("type"),
        "line",
        "seq",
        "name",
        F.concat(F.lit("method "), F.concat_ws(".", "owner", "name"), F.lit(": "), "param_message").alias("description"),
        F.lit(None).cast("string").alias("suggestion"),
    )
    return rows.unionByName(parameters)


def report_items(validations: DataFrame) -> DataFrame:
    """Graph items as reported: methods and attributes once per (line, name, type)."""
    graph_items = validations.filter("in_graph")
    return graph_items.filter(~F.col("kind").isin("method", "attribute")).unionByName(_first_reports(graph_items))


def validation_summary(scripts: DataFrame, validations: DataFrame) -> DataFrame:
    """Per script: counts by status over the reported items and the hallucination rate."""

    def having(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    counts = report_items(validations).groupBy("script").agg(
        F.count(F.lit(1)).alias("total_validations"),
        having("VALID").alias("valid_count"),
        having("INVALID").alias("invalid_count"),
        having("UNCERTAIN").alias("uncertain_count"),
        having("NOT_FOUND").alias("not_found_count"),
    )
    names = ["total_validations", "valid_count", "invalid_count", "uncertain_count", "not_found_count"]
    rows = scripts.select("script").distinct().join(counts, "script", "left").na.fill(0, names)
    wrong = F.col("invalid_count") + F.col("not_found_count")
    return rows.withColumn(
        "hallucination_rate", wrong / F.greatest(F.lit(1), F.col("valid_count") + wrong)
    )


def library_usage(validations: DataFrame) -> DataFrame:
    """What each script uses of each imported module: one row per module and use.

    ``kind`` is ``import`` for the module itself.  A use belongs to the module that is its full
    name or type without the last part.
    """
    imports = validations.filter("kind = 'import'").withColumn("module", F.col("owner"))
    imports = first_per_key(imports.select("script", "module", "seq", "status", "confidence"), ["script", "module"], ["seq"])
    simple = F.substring_index("owner", ".", -1)
    uses = (
        validations.filter("kind <> 'import' AND owner LIKE '%.%'")
        .withColumn("module", F.left("owner", F.length("owner") - F.length(simple) - F.lit(1)))
        .withColumn("class_name", F.when(F.col("kind").isin("method", "attribute"), simple))
    )
    used = uses.join(imports.select("script", "module"), ["script", "module"], "left_semi").select(
        "script", "module", "kind", "seq", "name", "class_name", "status", "confidence"
    )
    null = F.lit(None).cast("string")
    modules = imports.select(
        "script", "module", F.lit("import").alias("kind"), "seq", null.alias("name"), null.alias("class_name"), "status", "confidence"
    )
    return modules.unionByName(used)


def recommendations(scripts: DataFrame, found: DataFrame, confidence: DataFrame) -> DataFrame:
    """``(script, recommendations)`` by finding counts and overall confidence."""

    counts = found.groupBy("script").agg(*(F.count_if(F.col("type") == kind).alias(kind) for kind in ADVICE))
    rows = scripts.select("script").distinct().join(counts, "script", "left").na.fill(0, list(ADVICE))
    rows = rows.join(confidence, "script")
    counted = [F.when(F.col(kind) > 0, F.concat_ws(" ", F.col(kind).cast("string"), F.lit(text))) for kind, text in ADVICE.items()]
    lines = F.array(
        *counted,
        F.when(F.greatest(*ADVICE) == 0, F.lit(NO_FINDINGS)),
        F.when(F.col("overall_confidence") < CONFIDENT, F.lit(LOW_CONFIDENCE)),
    )
    return rows.select("script", F.array_compact(lines).alias("recommendations"))


def script_reports(usage_scripts: DataFrame, validations: DataFrame) -> DataFrame:
    """One report head per script: usage counts, status counts, confidence, findings, advice."""
    counts = validations.groupBy("script").agg(
        *(F.count_if(F.col("kind") == k).alias(f"total_{k}s") for k in KINDS)
    )
    found = findings(validations)
    found_counts = found.groupBy("script").agg(F.count(F.lit(1)).alias("hallucinations"))
    confidence = overall_confidence(usage_scripts, validations)
    totals = [f"total_{k}s" for k in KINDS] + ["hallucinations"]
    return (
        usage_scripts.select("script").distinct()
        .join(counts, "script", "left")
        .join(validation_summary(usage_scripts, validations), "script")
        .join(confidence, "script")
        .join(found_counts, "script", "left")
        .join(recommendations(usage_scripts, found, confidence), "script")
        .na.fill(0, totals)
    )


def batch_summary(reports: DataFrame) -> DataFrame:
    """One row over all scripts."""
    return reports.agg(
        F.count(F.lit(1)).alias("total_scripts"),
        F.sum("total_validations").alias("total_validations"),
        F.sum("valid_count").alias("total_valid"),
        F.sum("invalid_count").alias("total_invalid"),
        F.sum("not_found_count").alias("total_not_found"),
        F.sum("hallucinations").alias("total_hallucinations"),
        F.avg("overall_confidence").alias("average_confidence"),
    )


def worst_scripts(reports: DataFrame, n: int = 5) -> DataFrame:
    return (
        reports.select("script", "hallucinations", "overall_confidence")
        .orderBy(F.desc("hallucinations"), F.asc("script"))
        .limit(n)
    )
