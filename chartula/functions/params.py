"""Rendering parameter lists and checking calls against them, as pure expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chartula.functions.exprs import let


def render_simple(params: Column) -> Column:
    return F.transform(params, lambda p: F.concat(p["name"], F.lit(":"), p["type"]))


def render_detailed(params: Column) -> Column:
    """``[kind] name:type=default``; the kind is left out for positional parameters."""

    def one(p: Column) -> Column:
        default = (
            F.when(p["optional"] & p["default"].isNotNull(), F.concat(F.lit("="), p["default"]))
            .when(p["optional"], F.lit("=None"))
            .otherwise(F.lit(""))
        )
        kind = F.when(
            p["kind"] != "positional", F.concat(F.lit("["), p["kind"], F.lit("] "))
        ).otherwise(F.lit(""))
        return F.concat(kind, p["name"], F.lit(":"), p["type"], default)

    return F.transform(params, one)


def _parsed(expected: Column) -> Column:
    """Rendered parameters as structs (kind, body, name, optional)."""

    def one(text: Column) -> Column:
        kind = F.regexp_extract(text, r"^\s*\[([^\]]+)\]", 1)
        body = F.trim(F.regexp_replace(text, r"^\s*\[[^\]]+\]", ""))
        return F.struct(
            kind.alias("kind"),
            body.alias("body"),
            F.substring_index(body, ":", 1).alias("name"),
            body.contains("=").alias("optional"),
        )

    return F.transform(expected, one)


def check_call(expected: Column, args: Column, kwargs: Column) -> Column:
    """STRUCT<status, confidence, message> for a call against rendered parameters.

    Tests run in this order: too many positional, too few positional, unknown keywords,
    missing keyword-only.  Positionals given by keyword still count as missing.
    """
    def names(parsed: Column, keyword_only: bool) -> Column:
        kind = F.lit(keyword_only)
        return F.filter(
            parsed,
            lambda p: ~p["body"].startswith("*") & p["body"].contains(":") & ((p["kind"] == "keyword_only") == kind),
        )

    def required(params: Column) -> Column:
        return F.transform(F.filter(params, lambda p: ~p["optional"]), lambda p: p["name"])

    def all_names(params: Column) -> Column:
        return F.transform(params, lambda p: p["name"])

    none = F.array().cast("array<string>")
    keys = F.coalesce(F.map_keys(kwargs), none)

    def signature(parsed: Column) -> Column:
        plain, only = names(parsed, False), names(parsed, True)
        return F.struct(
            F.exists(parsed, lambda p: p["body"].startswith("**")).alias("var_keyword"),
            F.exists(parsed, lambda p: p["body"].rlike(r"^\*[^*]")).alias("var_positional"),
            F.size(required(plain)).alias("required"),
            F.size(plain).alias("allowed"),
            F.array_sort(F.array_except(keys, F.concat(all_names(plain), all_names(only)))).alias("unknown"),
            F.array_sort(F.array_except(required(only), keys)).alias("missing"),
        )

    given = F.greatest(F.coalesce(F.size(args), F.lit(0)), F.lit(0))

    def outcome(status: str, confidence: float, *message: Column) -> Column:
        return F.struct(
            F.lit(status).alias("status"),
            F.lit(confidence).alias("confidence"),
            F.concat(*message).alias("message"),
        )

    def listing(label: str, names: Column) -> list[Column]:
        return [F.lit(label), F.array_join(names, ", ")]

    def count(label: str, middle: str, limit: Column) -> list[Column]:
        return [F.lit(label), given.cast("string"), F.lit(middle), limit.cast("string")]

    def judge(sig: Column) -> Column:
        return (
            F.when(
                ~sig["var_positional"] & (given > sig["allowed"]),
                outcome(
                    "INVALID",
                    0.8,
                    *count("positional arguments given: ", ", accepted: ", sig["allowed"]),
                ),
            )
            .when(
                given < sig["required"],
                outcome(
                    "INVALID",
                    0.8,
                    *count("positional arguments given: ", ", needed: ", sig["required"]),
                ),
            )
            .when(
                ~sig["var_keyword"] & (F.size(sig["unknown"]) > 0),
                outcome("INVALID", 0.7, *listing("keywords not accepted: ", sig["unknown"])),
            )
            .when(
                F.size(sig["missing"]) > 0,
                outcome("INVALID", 0.8, *listing("keywords needed: ", sig["missing"])),
            )
            .otherwise(outcome("VALID", 0.9, F.lit("arguments fit")))
        )

    unknown = outcome("UNCERTAIN", 0.5, F.lit("no signature"))
    return F.when(expected.isNull() | (F.size(expected) <= 0), unknown).otherwise(
        let(_parsed(expected), lambda parsed: let(signature(parsed), judge))
    )
