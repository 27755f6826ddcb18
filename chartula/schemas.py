"""Schemas of the stored tables and of the facts exchanged between jobs."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields])


_S, _I, _L, _B = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()
VECTOR = T.ArrayType(T.FloatType())
STRINGS = T.ArrayType(_S)

RAW_PAGES = _struct(("url", _S), ("markdown", _S))

CHUNKS = _struct(
    ("id", _S),
    ("url", _S),
    ("chunk_number", _I),
    ("content", _S),
    ("metadata", _S),
    ("source_id", _S),
    ("embedding", VECTOR),
)

CODE_EXAMPLES = _struct(
    ("id", _S),
    ("url", _S),
    ("chunk_number", _I),
    ("content", _S),
    ("summary", _S),
    ("metadata", _S),
    ("source_id", _S),
    ("embedding", VECTOR),
)

SOURCES = _struct(
    ("source_id", _S),
    ("summary", _S),
    ("total_words", _L),
    ("created_at", T.TimestampType()),
    ("updated_at", T.TimestampType()),
)

WIKI_PAGES = _struct(
    ("page_id", _S),
    ("title", _S),
    ("space_key", _S),
    ("url", _S),
    ("markdown_content", _S),
    ("author", _S),
    ("created", _S),
    ("last_modified", _S),
    ("labels", STRINGS),
    ("parent_page_id", _S),
)

SOURCE_FILES = _struct(("repo", _S), ("path", _S), ("content", _S))

PARAM = _struct(("name", _S), ("type", _S), ("kind", _S), ("optional", _B), ("default", _S))

CALLABLE = _struct(
    ("name", _S),
    ("params", T.ArrayType(PARAM)),
    ("return_type", _S),
    ("args", STRINGS),
    ("ord", _I),
)

# One row per source file, as emitted by the definition extractor.
FILE_FACTS = _struct(
    ("repo", _S),
    ("path", _S),
    ("line_count", _I),
    (
        "classes",
        T.ArrayType(
            _struct(
                ("name", _S),
                ("ord", _I),
                ("methods", T.ArrayType(CALLABLE)),
                ("attributes", T.ArrayType(_struct(("name", _S), ("type", _S), ("ord", _I)))),
            )
        ),
    ),
    ("functions", T.ArrayType(CALLABLE)),
    ("imports", STRINGS),
    ("error", _S),
)

# One row per script, as emitted by the usage extractor: a flat event list in visiting order.
USAGE_EVENT = _struct(
    ("seq", _I),
    ("line", _I),
    ("end_line", _I),
    ("event", _S),
    ("target", _S),
    ("object", _S),
    ("member", _S),
    ("alias", _S),
    ("args", STRINGS),
    ("kwargs", T.MapType(_S, _S)),
)
SCRIPT_FACTS = _struct(("script", _S), ("events", T.ArrayType(USAGE_EVENT)), ("error", _S))
