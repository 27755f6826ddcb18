"""A code graph and script usage derived from the driver tables.

Regions stand for repositories, nations for files, customers for classes, orders for methods
and attributes, suppliers for functions, and events for the usages of scripts.  The statements
are written in the SQL both engines share, so a query and its counterpart read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartula.operators.code_graph import CodeGraph, import_targets
from chartula.operators.ranking import first_per_key
from chartula.operators.usage_facts import Usage

REPOS = "SELECT replace(lower(r_name), ' ', '-') AS repo FROM region"

FILES = """SELECT replace(lower(r_name), ' ', '-') AS repo, concat('src/pkg', n_regionkey, '/mod', n_nationkey, '.py') AS path,
    concat('pkg', n_regionkey, '.mod', n_nationkey) AS module_name, CAST(n_nationkey * 10 AS INTEGER) AS line_count, n_nationkey
    FROM nation JOIN region ON n_regionkey = r_regionkey"""

CLASS_ROWS = f"""SELECT f.repo, f.path, concat('C', c_custkey % 40) AS class_name,
    concat(f.module_name, '.C', c_custkey % 40) AS class_full_name, c_custkey
    FROM customer JOIN ({FILES}) f ON c_nationkey = f.n_nationkey"""


def _params(key: str) -> str:
    """Rendered parameters, separated by bars, varying with a key."""
    return f"""CASE {key} % 5 WHEN 0 THEN '' WHEN 1 THEN 'a:int' WHEN 2 THEN 'a:int|b:str=1'
        WHEN 3 THEN 'a:int|[var_positional] *args:Any=None'
        ELSE 'a:int|[keyword_only] k:int|[var_keyword] **kw:Any=None' END"""


METHOD_ROWS = f"""SELECT c.class_name, c.class_full_name, concat('do_', o_orderkey % 23) AS name, {_params('o_orderkey')} AS params,
    o_orderstatus AS return_type, o_orderkey AS ord FROM orders JOIN ({CLASS_ROWS}) c ON o_custkey = c.c_custkey"""

ATTRIBUTE_ROWS = f"""SELECT c.class_name, c.class_full_name, concat('at_', o_orderkey % 13) AS name, o_orderstatus AS type,
    o_orderkey AS ord FROM orders JOIN ({CLASS_ROWS}) c ON o_custkey = c.c_custkey"""

FUNCTION_ROWS = f"""SELECT f.repo, f.path, concat('fn', s_suppkey % 9) AS name, concat(f.module_name, '.fn', s_suppkey % 9) AS full_name,
    {_params('s_suppkey')} AS params, 'int' AS return_type, s_suppkey AS ord
    FROM supplier JOIN ({FILES}) f ON s_nationkey = f.n_nationkey"""

IMPORTS = f"""SELECT DISTINCT f.repo, f.path, concat('pkg', c_custkey % 6, '.mod', c_custkey % 7) AS import_name
    FROM customer JOIN ({FILES}) f ON c_nationkey = f.n_nationkey"""

# Usage: one script per user.  Scripts import a module, a package, a repository by its name in
# another spelling, or something outside the graph.
_U = "user_id % 40"
MODULE = f"""CASE WHEN {_U} < 25 THEN concat('pkg', user_id % 5, '.mod', {_U}) WHEN {_U} < 30 THEN concat('pkg', user_id % 5)
    WHEN {_U} < 33 THEN 'MIDDLE_EAST' ELSE concat('ext', {_U}) END"""

USAGE_IMPORTS = f"""SELECT concat('s', user_id) AS script, min(event_id) AS seq, min(event_id) AS line, {MODULE} AS module,
    'C1' AS name, CAST(NULL AS VARCHAR(10)) AS alias, true AS is_from_import FROM events GROUP BY user_id"""

_E = "CAST(floor(event_id / 4) AS BIGINT)"
OWNER = f"""CASE {_E} % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('ext.C', {_E} % 45) WHEN 2 THEN concat('C', {_E} % 45)
    WHEN 3 THEN concat({MODULE}, '.C', {_E} % 45) WHEN 4 THEN concat('pkg', user_id % 5, '.C', {_E} % 45)
    ELSE concat('pkg', user_id % 5, '.mod', {_E} % 25, '.C', {_E} % 45) END"""

USAGE = f"""SELECT concat('s', user_id) AS script, event_id AS seq, event_id AS line, event_id % 4 AS kind, {OWNER} AS owner,
    CASE WHEN event_id % 3 = 0 THEN concat('at_', {_E} % 15) ELSE concat('do_', {_E} % 29) END AS member,
    concat('fn', {_E} % 11) AS function_name,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat({MODULE}, '.fn', {_E} % 11) END AS function_full,
    {_E} % 4 AS n_args, {_E} % 3 AS kw FROM events"""


class Derived:
    """Runs the statements over the driver tables of one folder."""

    def __init__(self, t):
        self.t = t

    def rows(self, sql: str) -> DataFrame:
        return self.t.sql(sql, "region", "nation", "customer", "supplier", "orders", "events")


def _listed(params: str = "params"):
    return F.filter(F.split(params, r"\|"), lambda p: p != "")


def graph(t) -> CodeGraph:
    d = Derived(t)
    files = d.rows(FILES).drop("n_nationkey")
    class_rows = d.rows(CLASS_ROWS)
    imports = d.rows(IMPORTS)

    def members(sql: str) -> DataFrame:
        unique = first_per_key(d.rows(sql), ["class_full_name", "name"], ["ord"]).drop("ord")
        return unique.select(
            F.concat_ws("::", "class_full_name", "name").alias("id"),
            F.concat_ws(".", "class_full_name", "name").alias("full_name"),
            "*",
        )

    def with_params(rows: DataFrame) -> DataFrame:
        plain = F.transform(_listed(), lambda p: F.regexp_replace(p, r"^\[[a-z_]+\] |=.*$", ""))
        args = F.transform(plain, lambda p: F.substring_index(p, ":", 1))
        return rows.select(
            *(c for c in rows.columns if c not in ("params", "return_type")),
            args.alias("args"),
            plain.alias("params_list"),
            _listed().alias("params_detailed"),
            "return_type",
        )

    return CodeGraph(
        repositories=d.rows(REPOS),
        files=files,
        classes=class_rows.select(F.col("class_full_name").alias("full_name"), F.col("class_name").alias("name")).distinct(),
        class_files=class_rows.select("repo", "path", F.col("class_full_name").alias("full_name")).distinct(),
        methods=with_params(members(METHOD_ROWS)),
        attributes=members(ATTRIBUTE_ROWS),
        functions=with_params(first_per_key(d.rows(FUNCTION_ROWS), ["repo", "path", "name"], ["ord"]).drop("ord")),
        imports=imports,
        import_targets=import_targets(imports, files),
    )


def usage(t) -> Usage:
    d = Derived(t)
    rows = d.rows(USAGE)
    args = F.slice(F.array(F.lit("1"), F.lit("2"), F.lit("3")), 1, F.col("n_args").cast("int"))
    kwargs = (
        F.when(F.col("kw") == 1, F.create_map(F.lit("b"), F.lit("1")))
        .when(F.col("kw") == 2, F.create_map(F.lit("k"), F.lit("1"), F.lit("zz"), F.lit("2")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    rows = rows.withColumns({"args": args, "kwargs": kwargs})
    base = ["script", "seq", "line"]
    return Usage(
        scripts=rows.select("script").distinct(),
        imports=d.rows(USAGE_IMPORTS),
        instantiations=rows.filter("kind = 2 AND owner IS NOT NULL").select(
            *base,
            F.lit("x").alias("variable"),
            F.substring_index("owner", ".", -1).alias("class_name"),
            F.col("owner").alias("full_class_name"),
            "args",
            "kwargs",
        ),
        method_calls=rows.filter("kind = 0").select(
            *base,
            F.lit("x").alias("object_name"),
            F.col("member").alias("method_name"),
            "args",
            "kwargs",
            F.col("owner").alias("object_type"),
        ),
        attributes=rows.filter("kind = 1").select(
            *base, F.lit("x").alias("object_name"), F.col("member").alias("attribute_name"), F.col("owner").alias("object_type")
        ),
        functions=rows.filter("kind = 3").select(
            *base, "function_name", F.col("function_full").alias("full_name"), "args", "kwargs"
        ),
    )
