"""JSON metadata: assembly and containment."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def assemble(fields: dict[str, Column], extra: Column | None = None) -> Column:
    """JSON text of the given fields; ``extra`` is a struct whose fields are appended."""
    columns = [value.alias(name) for name, value in fields.items()]
    if extra is not None:
        columns.append(extra.alias("extra"))
    return F.to_json(F.struct(*columns))


def variant(metadata: Column) -> Column:
    return F.try_parse_json(metadata)


def contains(metadata: Column, wanted: dict[str, Any]) -> Column:
    """Subset test: every key of ``wanted`` is present with an equal value.

    Nested objects are subsets themselves; a list requires each wanted element to be present.
    ``metadata`` is JSON text.
    """
    return _contains(variant(metadata), "$", wanted)


def _key(name: str) -> str:
    return "['" + name.replace("'", "\\'") + "']"


def _contains(value: Column, where: str, wanted: dict[str, Any]) -> Column:
    test = F.lit(True)
    for name, item in wanted.items():
        test = test & _matches(value, where + _key(name), item)
    return F.coalesce(test, F.lit(False))


def _matches(value: Column, where: str, item: Any) -> Column:
    if isinstance(item, dict):
        present = F.try_variant_get(value, where, "variant").isNotNull()
        return present & _contains(value, where, item)
    if isinstance(item, list):
        stored = F.try_variant_get(value, where, "array<variant>")
        test = stored.isNotNull()
        for element in item:
            test = test & _has_element(stored, element)
        return test
    return _same(value, where, item)


def _has_element(stored: Column, element: Any) -> Column:
    return F.exists(stored, lambda s: F.coalesce(_same(s, "$", element), F.lit(False)))


def _same(value: Column, where: str, item: Any) -> Column:
    if item is None:
        return F.is_variant_null(F.try_variant_get(value, where, "variant"))
    kind = F.schema_of_variant(F.try_variant_get(value, where, "variant"))
    if isinstance(item, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, where, "boolean") == F.lit(item))
    if isinstance(item, (int, float)):
        numeric = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)")
        return numeric & (F.try_variant_get(value, where, "double") == F.lit(float(item)))
    if isinstance(item, str):
        return (kind == "STRING") & (F.try_variant_get(value, where, "string") == F.lit(item))
    raise TypeError(f"cannot match metadata value {json.dumps(item, default=str)}")
