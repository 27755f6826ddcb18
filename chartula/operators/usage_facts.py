"""Usage events to typed usage tables: imports, instantiations, method calls, attributes, functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartula.operators.ranking import last_per_key

# Name parts that mark a call as making an object.
CLASS_PATTERNS = [
    "Model", "Provider", "Client", "Agent", "Manager", "Handler",
    "Builder", "Factory", "Service", "Controller", "Processor",
]
METHOD_RESULT = "method_result"
CONTEXT_RESULT = "context_manager_result"
# Fixed values: (part of the owner's type, method) whose async scope yields an object of a known type.
ASYNC_SCOPES = [("pydantic_ai", "run_stream", "pydantic_ai.StreamedRunResult")]


@dataclass
class Usage:
    scripts: DataFrame
    imports: DataFrame
    instantiations: DataFrame
    method_calls: DataFrame
    attributes: DataFrame
    functions: DataFrame


def import_rows(events: DataFrame) -> DataFrame:
    """``(script, seq, line, module, name, alias, is_from_import)``."""
    rows = events.filter(F.col("event").isin("import", "from_import"))
    return rows.select(
        "script",
        "seq",
        "line",
        F.col("target").alias("module"),
        F.col("member").alias("name"),
        "alias",
        (F.col("event") == "from_import").alias("is_from_import"),
    )


def import_map(imports: DataFrame) -> DataFrame:
    """``(script, key, full)``: what a local name stands for; the later import wins."""
    full = F.when(
        F.col("is_from_import") & (F.col("module") != ""), F.concat_ws(".", "module", "name")
    ).otherwise(F.col("name"))
    named = imports.select("script", F.coalesce("alias", "name").alias("key"), full.alias("full"), "seq")
    return last_per_key(named, ["script", "key"], ["seq"]).select("script", "key", "full")


def _never_broadcast(names: DataFrame) -> DataFrame:
    """A table with rows of every script, for joins by shuffle.

    Spark takes sizes after parsing from the files that scripts are read or made from, which says nothing about how
    many events they hold; by these it would send the names of all scripts to every task.
    """
    return names.hint("merge")


def resolve_names(rows: DataFrame, mapping: DataFrame, name: str, out: str) -> DataFrame:
    """Full name of ``name``: exact import, else import of its first dotted part, else NULL."""
    mapping = _never_broadcast(mapping)
    exact = mapping.select("script", F.col("key").alias(name), F.col("full").alias("_exact"))
    head = mapping.select("script", F.col("key").alias("_head"), F.col("full").alias("_base"))
    joined = rows.join(exact, ["script", name], "left")
    joined = joined.withColumn(
        "_head", F.when(F.col(name).contains("."), F.substring_index(F.col(name), ".", 1))
    ).join(head, ["script", "_head"], "left")
    rest = F.substring(F.col(name), F.length("_head") + 1, F.length(name))
    resolved = F.coalesce("_exact", F.concat("_base", rest))
    return joined.select(*rows.columns, resolved.alias(out))


def _makes_object(name: Column, full: Column) -> Column:
    first = F.left(name, F.lit(1))
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    return capital | F.coalesce(full.rlike("|".join(CLASS_PATTERNS)), F.lit(False))


def usage_tables(facts: DataFrame) -> Usage:
    """Typed usage of every script from ``(script, events, error)``."""
    events = facts.select("script", F.explode("events").alias("_e")).select("script", "_e.*")
    imports = import_rows(events)
    mapping = import_map(imports)
    made = events.filter(F.col("event").isin("assign_call", "call"))
    made = resolve_names(made, mapping, "member", "full_name").withColumn(
        "_object", (F.col("event") == "assign_call") | _makes_object(F.col("member"), F.col("full_name"))
    )
    instance = F.concat(F.lit("<"), F.lower("member"), F.lit("_instance>"))
    instantiations = made.filter("_object").select(
        "script",
        "seq",
        "line",
        F.when(F.col("event") == "assign_call", F.col("target")).otherwise(instance).alias("variable"),
        F.col("member").alias("class_name"),
        F.col("full_name").alias("full_class_name"),
        "args",
        "kwargs",
    )
    functions = made.filter(~F.col("_object")).select(
        "script", "seq", "line", F.col("member").alias("function_name"), "full_name", "args", "kwargs"
    )
    typed = typed_usage(events, instantiations)
    shared = ["script", "seq", "line", F.col("object").alias("object_name")]
    return Usage(
        scripts=facts.select("script", "error"),
        imports=imports,
        instantiations=instantiations,
        method_calls=typed.filter("event = 'method'").select(
            *shared, F.col("member").alias("method_name"), "args", "kwargs", "object_type"
        ),
        attributes=typed.filter("event = 'attribute'").select(
            *shared, F.col("member").alias("attribute_name"), "object_type"
        ),
        functions=functions,
    )


def typed_usage(events: DataFrame, instantiations: DataFrame) -> DataFrame:
    """Method calls and attribute reads with ``object_type``.

    In this order: the last assignment visited before the use, the enclosing async scope of a
    known kind, the last assignment of the script.
    """
    made = instantiations.filter(~F.col("variable").startswith("<")).select(
        "script", "seq", F.col("variable").alias("object"), F.coalesce("full_class_name", "class_name").alias("_type")
    )
    marked = events.filter(F.col("event").isin("assign_method", "with_scope")).select(
        "script",
        "seq",
        F.col("target").alias("object"),
        F.when(F.col("event") == "assign_method", METHOD_RESULT).otherwise(CONTEXT_RESULT).alias("_type"),
    )
    assigned = made.unionByName(marked)
    uses = events.filter(F.col("event").isin("method", "attribute", "async_scope"))
    # One window per (script, variable): the running last type is the type when visited.
    timeline = uses.unionByName(assigned, allowMissingColumns=True)
    visited = Window.partitionBy("script", "object").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    timeline = timeline.withColumn("_seen", F.last("_type", ignorenulls=True).over(visited))
    timeline = timeline.filter(F.col("event").isNotNull())

    known = F.lit(None).cast("string")
    for part, method, result in ASYNC_SCOPES:
        fits = F.col("_seen").contains(part) & (F.col("member") == method)
        known = F.when(fits, F.lit(result)).otherwise(known)
    scopes = timeline.filter("event = 'async_scope'").withColumn("_scope_type", known)
    scopes = last_per_key(
        scopes.filter(F.col("_scope_type").isNotNull()).select(
            "script", F.col("target").alias("object"), "seq", F.col("line").alias("_from"), F.col("end_line").alias("_to"), "_scope_type"
        ),
        ["script", "object"],
        ["seq"],
    ).drop("seq")
    final = assigned.groupBy("script", "object").agg(F.max_by("_type", "seq").alias("_final"))
    rows = timeline.filter("event <> 'async_scope'")
    rows = rows.join(_never_broadcast(scopes), ["script", "object"], "left")
    rows = rows.join(_never_broadcast(final), ["script", "object"], "left")
    scoped = F.when(F.col("line").between(F.col("_from"), F.col("_to")), F.col("_scope_type"))
    return rows.withColumn("object_type", F.coalesce("_seen", scoped, "_final"))
