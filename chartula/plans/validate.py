"""Validation of scripts against a code graph, from source text to reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from chartula.operators import code_facts, usage_checks, usage_facts, usage_reports
from chartula.operators.code_graph import CodeGraph, build_graph
from chartula.session import cut_lineage


@dataclass
class ValidationRun:
    validations: DataFrame
    checked_imports: DataFrame
    reports: DataFrame


def graph_from_files(files: DataFrame, *, include_init: bool = False) -> CodeGraph:
    """Code graph of ``(repo, path, content)``.  Sources are parsed once; the tables are kept."""
    facts = cut_lineage(code_facts.extract_definitions(files, include_init=include_init))
    return build_graph(facts).materialised()


def validate_scripts(scripts: DataFrame, graph: CodeGraph) -> ValidationRun:
    """Reports for ``(script, content)``.  Sources are parsed once and the validations kept."""
    facts = cut_lineage(code_facts.extract_usage(scripts))
    usage = usage_facts.usage_tables(facts)
    validations, checked = usage_checks.validate(usage, graph)
    validations = cut_lineage(validations)
    return ValidationRun(validations, checked, usage_reports.script_reports(usage.scripts, validations))
