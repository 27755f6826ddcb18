"""Python source to definition and usage facts.

The two extractors are the only place where source text is parsed: each turns one file into
one row of plain facts.  Names, types, keys and edges are worked out from them in Spark.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from chartula.schemas import FILE_FACTS, SCRIPT_FACTS

PARSE_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError)
Function = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Type of what has no annotation.
UNTYPED = "Any"
# Kinds of expressions that types are made of, and how defaults are shown by kind ("" as written).
TYPE_FORMS = ["Name", "Attribute", "Subscript", "Constant", "Tuple", "List"]
SHORT_DEFAULTS = {"Constant": "", "Name": "", "Attribute": "", "List": "[]", "Dict": "{}"}


def extract_definitions(files: DataFrame, *, include_init: bool = False) -> DataFrame:
    """``(repo, path, content)`` to one row of classes, functions and imports per file."""

    def facts(row: dict) -> dict:
        found = {"classes": [], "functions": [], "imports": [], "line_count": None, "error": None}
        try:
            found.update(definitions(row["content"], include_init))
        except PARSE_ERRORS as error:
            found["error"] = f"{type(error).__name__}: {error}"
        return {"repo": row["repo"], "path": row["path"], **found}

    rows = _spread(files.select("repo", "path", "content"), "repo", "path")
    return _per_row(rows, facts, FILE_FACTS)


def extract_usage(scripts: DataFrame) -> DataFrame:
    """``(script, content)`` to one row of usage events per script."""

    def facts(row: dict) -> dict:
        try:
            return {"script": row["script"], "events": usage_events(row["content"]), "error": None}
        except PARSE_ERRORS as error:
            return {"script": row["script"], "events": [], "error": f"{type(error).__name__}: {error}"}

    return _per_row(_spread(scripts.select("script", "content"), "script"), facts, SCRIPT_FACTS)


def _spread(files: DataFrame, *keys: str) -> DataFrame:
    """Files over a fixed number of partitions: parsing costs far more than moving the text, and
    input splits hold very different numbers of files."""
    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.repartition(parts, *keys)


def _per_row(df: DataFrame, facts: Callable[[dict], dict], schema: T.StructType) -> DataFrame:
    arrow_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([facts(r) for r in batch.to_pylist()], schema=arrow_schema)

    return df.mapInArrow(run, schema)


def _parse(content: str | None) -> ast.Module:
    if content is None:
        raise ValueError("content is not readable text")
    return ast.parse(content)


# --- definitions ------------------------------------------------------------------------------


def definitions(content: str | None, include_init: bool = False) -> dict:
    tree = _parse(content)
    nodes = list(ast.walk(tree))
    classes = [n for n in nodes if isinstance(n, ast.ClassDef)]
    members = {id(item) for c in classes for item in c.body}

    def public(name: str) -> bool:
        return not name.startswith("_") or (include_init and name == "__init__")

    def class_facts(node: ast.ClassDef, order: int) -> dict:
        methods = [i for i in node.body if isinstance(i, Function) and public(i.name)]
        fields = [
            i
            for i in node.body
            if isinstance(i, ast.AnnAssign) and isinstance(i.target, ast.Name) and public(i.target.id)
        ]
        return {
            "name": node.name,
            "ord": order,
            "methods": [_callable(m, n, skip_self=True) for n, m in enumerate(methods)],
            "attributes": [
                {"name": f.target.id, "type": type_name(f.annotation), "ord": n} for n, f in enumerate(fields)
            ],
        }

    functions = [n for n in nodes if isinstance(n, Function) and id(n) not in members and public(n.name)]
    imports = [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names]
    imports += [n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module]
    return {
        "classes": [class_facts(c, n) for n, c in enumerate(classes)],
        "functions": [_callable(f, n, skip_self=False) for n, f in enumerate(functions)],
        "imports": sorted(set(imports)),
        "line_count": len(content.splitlines()),
    }


def _callable(node, order: int, *, skip_self: bool) -> dict:
    return {
        "name": node.name,
        "params": parameters(node.args),
        "return_type": type_name(node.returns) or UNTYPED,
        "args": [a.arg for a in node.args.args if not (skip_self and a.arg == "self")],
        "ord": order,
    }


def parameters(args: ast.arguments) -> list[dict]:
    """Parameters in signature order without ``self``: star names are optional, others by their default."""
    first_default = len(args.args) - len(args.defaults)
    signature = [(a, "positional", "", args.defaults[n - first_default] if n >= first_default else None) for n, a in enumerate(args.args)]
    signature += [(args.vararg, "var_positional", "*", None)]
    signature += [(a, "keyword_only", "", d) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    signature += [(args.kwarg, "var_keyword", "**", None)]
    untyped = {"var_keyword": "Dict[str, Any]"}
    return [
        {
            "name": stars + arg.arg,
            "type": type_name(arg.annotation) or untyped.get(kind, UNTYPED),
            "kind": kind,
            "optional": bool(stars) or default is not None,
            "default": default_value(default),
        }
        for arg, kind, stars, default in signature
        if arg is not None and (kind != "positional" or arg.arg != "self")
    ]


class _PlainTypes(ast.NodeTransformer):
    """Puts ``Any`` for whatever part of an annotation is no name, subscript, constant or listing."""

    def visit(self, node: ast.AST) -> ast.AST:
        if isinstance(node, ast.expr) and type(node).__name__ not in TYPE_FORMS:
            return ast.copy_location(ast.Name(UNTYPED, ast.Load()), node)
        return self.generic_visit(node)


def type_name(node: ast.expr | None) -> str | None:
    """An annotation's plain parts as written; a quoted one (a forward reference) without its quotes."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return node.value
    return None if node is None else as_written(_PlainTypes().visit(node))


def default_value(node: ast.expr | None) -> str | None:
    """A default as written, or the short form of its kind."""
    return None if node is None else SHORT_DEFAULTS.get(type(node).__name__, "...") or as_written(node)


def as_written(node: ast.expr) -> str:
    return ast.unparse(node)


# --- usage --------------------------------------------------------------------------------------


def dotted(node: ast.expr) -> str | None:
    """``a.b.c`` for a chain of attributes on a name, else None."""
    text = ast.unparse(node) if isinstance(node, ast.Name | ast.Attribute) else ""
    return text if text and all(part.isidentifier() for part in text.split(".")) else None


def usage_events(content: str | None) -> list[dict]:
    """Imports, assignments of call results, with-scopes, calls and attribute reads.

    Breadth-first, like the visiting order the type rules refer to.  A call that is the value
    of an assignment or opens a with-scope is reported there and not again on its own.
    """
    nodes = list(ast.walk(_parse(content)))
    events: list[dict] = []
    reported: set[int] = set()
    called: set[int] = set()

    def emit(event: str, node: ast.AST, **fields) -> None:
        events.append({"seq": len(events), "line": node.lineno, "event": event, **fields})

    def signature(call: ast.Call) -> dict:
        return {
            "args": [as_written(a) for a in call.args],
            "kwargs": {k.arg: as_written(k.value) for k in call.keywords if k.arg},
        }

    def emit_method(call: ast.Call) -> None:
        owner = dotted(call.func.value)
        if owner:
            emit("method", call, object=owner, member=call.func.attr, **signature(call))

    for node in nodes:
        match node:
            case ast.Import(names=names):
                for a in names:
                    emit("import", node, target=a.name, member=a.name, alias=a.asname)
            case ast.ImportFrom(module=module, names=names):
                for a in names:
                    emit("from_import", node, target=module or "", member=a.name, alias=a.asname)

    for node in nodes:
        match node:
            case ast.Assign(targets=[ast.Name(id=name)], value=ast.Call(func=ast.Name(id=made)) as call):
                emit("assign_call", node, target=name, member=made, **signature(call))
                reported.add(id(call))
            case ast.Assign(targets=[ast.Name(id=name)], value=ast.Call(func=ast.Attribute()) as call):
                emit("assign_method", node, target=name)
                emit_method(call)
                reported.add(id(call))
            case ast.With(items=items) | ast.AsyncWith(items=items):
                for item in items:
                    match item:
                        case ast.withitem(
                            context_expr=ast.Call(func=ast.Attribute()) as call, optional_vars=ast.Name(id=name)
                        ):
                            emit_method(call)
                            reported.add(id(call))
                            emit(
                                "async_scope" if isinstance(node, ast.AsyncWith) else "with_scope",
                                node,
                                target=name,
                                object=dotted(call.func.value),
                                member=call.func.attr,
                                end_line=node.end_lineno,
                            )
            case ast.Call() if id(node) in reported:
                pass
            case ast.Call(func=ast.Attribute() as func):
                emit_method(node)
                called.add(id(func))
            case ast.Call(func=ast.Name(id=name)):
                emit("call", node, member=name, **signature(node))
            case ast.Attribute() if id(node) not in called:
                owner = dotted(node.value)
                if owner:
                    emit("attribute", node, object=owner, member=node.attr)
    return events
